import math
import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvlake.llm import quality as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)


def stats(texts):
    s = Q.text_stats(pa.array(texts, pa.string()))
    return list(zip(*(s[c].tolist() for c in Q.COUNTS[:5])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \n\té#|\x85 ", max_size=60), st.lists(st.sampled_from(["a b c d e f ", "a\n", "é ", "x b\n"]), max_size=12).map("".join)), max_size=6))
def test_stats(texts):
    assert stats(texts) == [brute(t) for t in texts]


def test_sliced_and_long():
    texts = ["x", None, "a b c d e " * 40_000, "", "é " * 3]
    arr = pa.array(texts, pa.string()).slice(1, 3)
    assert list(zip(*(Q.text_stats(arr)[c].tolist() for c in Q.COUNTS[:5]))) == [brute(t) for t in texts[1:4]]


def test_forest_finds_outliers():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    f = Q.IsolationForest(x)
    assert f.score(np.full((1, 4), 8.0))[0] > np.quantile(f.score(x), 0.99)


def test_scores_against_walked_paths():
    """Paths of every row through every tree, a leaf's value being its depth and the mean
    path of the rows that come to it."""
    x = np.random.default_rng(3).normal(size=(40, 3)).round(1)
    f = Q.IsolationForest(x, trees=7, subsample=40)  # each tree grows on all rows
    mean = lambda n: 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    paths = np.zeros(len(x))
    for feature, cut, left, right, _, _ in f.trees:
        ends = []
        for row in x:
            k = depth = 0
            while feature[k] >= 0:
                k, depth = (left if row[feature[k]] <= cut[k] else right)[k], depth + 1
            ends.append((k, depth))
        held = Counter(k for k, _ in ends)
        paths += [d + mean(held[k]) for k, d in ends]
    assert f.score(x) == pytest.approx(2 ** (-paths / 7 / mean(40)))
    assert Q.path_scores(pickle.loads(pickle.dumps(f.plain)), x) == pytest.approx(f.score(x))


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_whole_table(tables):
    docs, labels = tables
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in Q.quality_rules(docs, labels).collect()}
    assert got.keys() == texts.keys()
    for k, r in got.items():
        want = brute(texts[k])
        assert tuple(r[c] for c in Q.COUNTS[:5]) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    good = [got[r.doc_id].kept for r in labels.where("quality = 1").collect() if not got[r.doc_id].base_failed]
    bad = [got[r.doc_id].kept for r in labels.where("quality = 0").collect()]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.5


def test_filter_keeps_columns(spark):
    rnd = random.Random(1)
    text = lambda: " ".join("".join(rnd.choices("abcdefg", k=5)) for _ in range(60))
    rows = [(k, text(), k) for k in range(50)] + [(50, None, 1), (51, "", 1), (52, "short", 1), (None, text(), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(3, 0, None), (None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = Q.filter_documents(docs, labels)
    assert out.schema == docs.schema
    kept = {r.doc_id for r in out.collect()}
    assert not kept & {50, 51, 52} and len(kept & set(range(50))) >= 45
    assert Q.filter_documents(docs.limit(0), labels).count() == 0
    assert Q.quality_rules(docs, labels.limit(0)).where("kept").count() == 51
