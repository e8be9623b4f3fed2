import itertools
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlake.llm import packing as P


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), min_size=1, max_size=8), st.integers(1, 5))
def test_boundaries_are_optimal(histogram, k):
    got = P.best_boundaries(histogram, k)
    top = max(histogram)
    every = (sorted({*c, top}) for n in range(k) for c in itertools.combinations(sorted(histogram), n))
    assert len(got) <= k and got[-1] == top
    assert P.padding(histogram, got) == min(P.padding(histogram, b) for b in every)


@pytest.mark.parametrize("shard_rows", [10, 10_000])
def test_pack(spark, shard_rows):
    rnd = random.Random(2)
    n = [0, 0, 1, 2048, 2049, 10_000] + [rnd.randrange(1, 900) for _ in range(200)]
    rows = [(k, "w " * v, k) for k, v in enumerate(n)] + [(900, None, 0), (None, "a b", 0), (7, "w " * n[7], 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    out = P.pack(df, shard_rows=shard_rows).collect()
    total = Counter()
    for r in out:
        total[r.doc_id] += r.n_tokens
    want = Counter()
    for k, t, _ in rows:
        want[k] += len((t or "").split())
    assert total == want
    bounds = P.best_boundaries(Counter(r.n_tokens for r in out), P.BUCKETS)
    batches = defaultdict(list)
    for r in out:
        if r.n_tokens == 0:
            assert (r.bucket, r.batch, r.slot) == (0, None, None)
            continue
        assert r.bucket == min(b for b in bounds if b >= r.n_tokens)
        batches[r.bucket, r.shard, r.batch].append(r.slot)
    for (bucket, shard, batch), slots in batches.items():
        full = P.BATCH_TOKENS // bucket
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= full
        assert len(slots) == full or (bucket, shard, batch + 1) not in batches
    assert P.pack(df.limit(0)).count() == 0


def test_other_lengths(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("é").alias("text"))
    assert {r.n_tokens for r in P.pack(df, tokens=F.octet_length("text")).collect()} == {2}


def test_repeated_rows_are_dealt_too(spark):
    """A third of all rows is one document, another third has no id: no shard holds either."""
    rows = [(7, "a b c")] * 3000 + [(None, "a b")] * 3000 + [(100 + k, "a b c d") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = P.pack(df, shard_rows=500, batch_tokens=P.MAX_LEN).collect()
    assert len(out) == len(rows)
    held = Counter((r.bucket, r.shard) for r in out)
    assert max(held.values()) < 750
    slots = Counter((r.bucket, r.shard, r.batch, r.slot) for r in out)
    assert max(slots.values()) == 1 and all(r.slot < P.MAX_LEN // r.bucket for r in out)
