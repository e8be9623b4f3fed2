import random
from collections import defaultdict

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kvlake.llm import token_matrix as M


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 20).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.integers(0, n), max_size=30))))
def test_best_fit(case):
    size, lengths = case
    rows = []  # a plain search over all rows
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        room = [(size - sum(lengths[j] for j in r), n) for n, r in enumerate(rows)]
        best = min((x[0] for x in room if x[0] >= lengths[k]), default=None)
        if best is None:
            rows.append([k])
        else:
            [rows[n] for r, n in room if r == best][0].append(k)
    got = M.best_fit(lengths, size)
    assert sorted(k for r in got for k in r) == list(range(len(lengths)))
    assert all(sum(lengths[k] for k in r) <= size for r in got)
    assert len(got) == len(rows)


@pytest.mark.parametrize("size,block", [(64, 500), (2048, 4_000_000)])
def test_round_trip(spark, size, block):
    rnd = random.Random(8)
    texts = [None, "", "été " * 3000, "<|endoftext|>", "a" * 30_000, " " * 5000] + [" ".join(rnd.choices(["the", "of", "ñu", "x1"], k=rnd.randrange(200))) for _ in range(80)]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "null id", "x")], "doc_id long, text string, ids string")
    rows = M.token_matrix(df, row_tokens=size, block_tokens=block).cache()
    for r in rows.collect():
        assert len(r.ids) == 2 * size and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= size
        assert r.position_resets == r.cu_seqlens[:-1] and len(r.doc_ids) == len(r.pieces) == len(r.position_resets)
        assert set(np.frombuffer(r.ids, "<u2")[r.n_tokens :]) <= {M.PAD}
    enc = M._encoder(open(M.TOKENIZER, "rb").read(), M.PATTERN)
    found = defaultdict(dict)
    for r in M.segments(rows, size).collect():
        assert len(r.ids) == 2 * r.n_tokens and r.piece not in found[r.doc_id]
        found[r.doc_id][r.piece] = np.frombuffer(r.ids, "<u2").tolist()
    assert len(found) == len(texts) + 1
    for k, t in [*enumerate(texts), (None, "null id")]:
        parts = [found[k][p] for p in sorted(found[k])]
        assert all(len(p) == size for p in parts[:-1])
        ids = [i for p in parts for i in p]
        assert ids == enc.encode_ordinary(t or "") and enc.decode(ids) == (t or "")
    assert M.token_matrix(df.limit(0)).count() == 0


def test_pattern_is_the_tokenizers(spark):
    P = pytest.importorskip("public_tokenizers")
    mine, theirs = (tiktoken.Encoding("t", pat_str=p, mergeable_ranks=M._encoder(open(M.TOKENIZER, "rb").read(), M.PATTERN)._mergeable_ranks, special_tokens={}) for p in (M.PATTERN, P.PATTERN))
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50).collect():
        assert mine.encode_ordinary(r.text) == theirs.encode_ordinary(r.text)


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "the of the of")] * 5 + [(2, None)] * 3, "doc_id long, text string").coalesce(1)
    found = M.segments(M.token_matrix(df, row_tokens=64), 64).collect()
    assert sorted(r.doc_id for r in found) == [1] * 5 + [2] * 3 and len({bytes(r.ids) for r in found if r.doc_id == 1}) == 1
