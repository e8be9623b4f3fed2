import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kvlake.llm import lm_score as L


def tokens(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+|[^0-9a-z\x80-\U0010ffff\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows, good, fold):
    """Scores of (id, text) rows by exact counts."""
    word, pair = {}, {}
    for i, t in rows:
        w = tokens(t)
        for model in ("target", "whole"):
            if model == "whole" or i in good:
                key = model, fold[t]
                word.setdefault(key, Counter()).update(w)
                pair.setdefault(key, Counter()).update(zip(w, w[1:]))
    out = {}
    for i, t in rows:
        w, loss = tokens(t), []
        for model in ("target", "whole"):
            c, p = word.get((model, 1 - fold[t]), Counter()), pair.get((model, 1 - fold[t]), Counter())
            n = sum(c.values())
            share = lambda x: (c[x] + L.ALPHA) / (n + L.ALPHA * L.WORDS)  # noqa: E731,B023
            s = 0.0
            for k, x in enumerate(w):
                h = c[w[k - 1]] if k else 0
                hw = p[w[k - 1], x] if k else 0
                s -= math.log((hw + L.MU * share(x)) / (h + L.MU))
            loss.append(s / len(w) if w else None)
        out[i] = (len(w), *loss)
    return out


def test_against_exact_counts(spark):
    rnd = random.Random(6)
    voc = ["the", "OF", "été", "x1", "***", "a-b", "!?", "ñ"]
    rows = [(k, " ".join(rnd.choices(voc, k=rnd.randrange(40)))) for k in range(60)] + [(60, None), (61, ""), (62, " \n"), (63, "the " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(2, 1, 0), (None, 1, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    good = {k for k in range(40) if k % 2} | {2}
    fold = {r.text: r._kv_fold for r in L._dealt(df, "doc_id", "text").collect()}
    want = brute(rows, good, fold)
    got = L.cross_entropy_difference(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        n, a, b = want[r.doc_id]
        assert r.n_tokens == n
        if n:
            assert (r.target_loss, r.background_loss) == pytest.approx((a, b), rel=1e-5)
            assert r.ce_difference == pytest.approx(r.target_loss - r.background_loss)
        else:
            assert r.target_loss is r.background_loss is r.ce_difference is None
    assert {r.ce_difference for r in L.cross_entropy_difference(df, labels.limit(0)).collect()} <= {0.0, None}
    assert L.cross_entropy_difference(df.limit(0), labels).count() == 0


def test_held_out_labels(spark):
    """Documents labelled good score lower than others, without their own counts."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = {r.doc_id: r.ce_difference for r in L.cross_entropy_difference(docs, labels).collect()}
    lab = {r.doc_id: r.quality for r in labels.collect()}
    good = np.array([got[k] for k, q in lab.items() if q == 1 and got[k] is not None])
    bad = np.sort([got[k] for k, q in lab.items() if q == 0 and got[k] is not None])
    auc = (1 - np.searchsorted(bad, good) / len(bad)).mean()
    assert auc > 0.75, auc


def test_repeated_rows_count_as_often(spark):
    rows = [(k, t) for k, t in enumerate(["a b c", "a c b", "b b a", "c a a"])] * 3 + [(9, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fold = {r.text: r._kv_fold for r in L._dealt(df, "doc_id", "text").collect()}
    want = brute(rows, {0, 1}, fold)
    got = L.cross_entropy_difference(df, spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")).collect()
    assert len(got) == 13
    for r in got:
        n, target, whole = want[r.doc_id]
        assert (r.n_tokens, r.target_loss, r.background_loss) == (n, pytest.approx(target), pytest.approx(whole))
