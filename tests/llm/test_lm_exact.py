"""Counts stay exact where there are more words and pairs than any fixed table holds."""

import random

import pytest

from kvlake.llm import lm_score as L
from tests.llm.test_lm_score import brute


def test_many_words_and_pairs(spark):
    rnd = random.Random(9)
    # 400,000 rare words and over a million pairs, beside pairs that stand everywhere
    rows = [(k, " ".join(f"r{rnd.randrange(400_000)}" if rnd.random() < 0.8 else rnd.choice(["the", "of", "and"]) for _ in range(2000))) for k in range(800)]
    rows += [(k, rows[0][1]) for k in range(800, 805)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(805)], "doc_id long, quality int")
    fold = {r.text: r._kv_fold for r in L._dealt(df, "doc_id", "text").collect()}
    want = brute(rows, set(range(0, 805, 4)), fold)
    got = L.cross_entropy_difference(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        n, target, whole = want[r.doc_id]
        assert (r.n_tokens, r.target_loss, r.background_loss) == (n, pytest.approx(target, rel=1e-9), pytest.approx(whole, rel=1e-9))


def test_null_ids_and_null_labels(spark):
    rows = [(None, "a b c"), (None, "a b d"), (1, "a b c"), (1, "x y"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1), (2, 1)], "doc_id int, quality int")
    got = L.cross_entropy_difference(df, labels).collect()
    assert sorted(r.n_tokens for r in got) == [0, 2, 3, 3, 3]
    assert {r.ce_difference for r in got} == {0.0, None}
