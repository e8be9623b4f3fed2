import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlake.llm import line_chunks as C


def chunks(text):
    """(first line, last line + 1, may be removed) by the operator's own cuts."""
    return next(C.chunk_texts(pa.array([text], pa.string())))[3]


def brute(rows):
    """Texts of (id, text) rows after removal; compares texts of chunks, no hashes."""
    seen, out = {}, {}
    for i, t in sorted(set(r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        lines, kept = t.split("\n"), []
        for p, q, may in chunks(t):
            c = "\n".join(lines[p:q])
            if may and c in seen:
                continue
            seen.setdefault(c, i)
            kept += lines[p:q]
        out[i, t] = "\n".join(kept)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \né", max_size=30), st.lists(st.sampled_from(["a b", "", "x " * 60, "é"]), max_size=20).map("\n".join)), max_size=5))
def test_chunks_cover_all_lines(texts):
    got = list(C.chunk_texts(pa.array(texts, pa.string())))
    assert len(got) == len(texts)
    for t, (raw, start, end, own) in zip(texts, got):
        lines = (t or "").split("\n")
        assert [raw[a:b].decode() for a, b in zip(start, end)] == lines
        assert [k for p, q, _ in own for k in range(p, q)] == list(range(len(lines)))
        for p, q, may in own:
            words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines[p:q]]
            assert may == (sum(w > 0 for w in words) >= 2 or words[0] >= 50)
            assert q - p <= C.MAX_LINES and (q - p == 1 or max(words) < 50)


def made_up():
    rnd = random.Random(3)
    line = lambda: " ".join(f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(1, 9)))
    passage, long = [line() for _ in range(12)], "long " + " ".join(f"y{rnd.randrange(99)}" for _ in range(60))
    rows = []
    for k in range(60):
        body = [line() for _ in range(rnd.randrange(12))]
        if k % 3 == 0:
            at = rnd.randrange(len(body) + 1)
            body[at:at] = passage
        if k % 4 == 0:
            body.insert(rnd.randrange(len(body) + 1), long)
        rows.append((k, "\n".join(body)))
    rows += [(60, rows[3][1]), (61, None), (62, ""), (63, "\n\n\n"), (64, "same line here\n" * 50), rows[3], rows[3], (None, rows[6][1])]
    return rows, passage, long


def test_dedup(spark):
    rows, passage, long = made_up()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, hash string")
    want = brute(rows)
    out = C.dedup_lines(df)
    assert out.schema == df.schema
    got = out.collect()
    assert len(got) == len(rows)
    old = {}
    for i, t in rows:
        old.setdefault(i, t)
    for r in got:
        assert r.text == (None if old[r.doc_id] is None else want[r.doc_id, old[r.doc_id]])
    assert sum(long in (r.text or "") for r in got) == 1
    middle = "\n".join(passage[3:6])  # not cut off from its neighbours
    assert sum(middle in (r.text or "") for r in got) <= 4
    assert C.dedup_lines(df.limit(0)).count() == 0


def test_other_bytes_of_one_hash_stay(spark, monkeypatch):
    """With a hash that calls everything equal, the byte comparison saves all."""
    import xxhash

    monkeypatch.setattr(C, "xxhash", type("X", (), {"xxh3_128_digest": staticmethod(lambda b: b"0" * 16)}))
    df = spark.createDataFrame([(k, "\n".join(f"l {k} {j}" for j in range(5))) for k in range(9)], "doc_id long, text string")
    assert C.dedup_lines(df).exceptAll(df).count() == 0
    assert xxhash


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = {i: t for (i, _), t in brute(rows).items()}
    assert {r.doc_id: r.text for r in C.dedup_lines(docs).collect()} == want
    got = C.report(docs).withColumnRenamed("doc_id", "i").join(spark.createDataFrame(list(want.items()), "i long, t string"), "i")
    assert got.where(F.col("text_sha256") != F.sha2("t", 256)).count() == 0
    assert got.where("n_removed > 0").count() > 0


def test_very_long_text_and_line(spark):
    long = "\n".join(f"line {k} of many words " + "z " * (k % 7) for k in range(200_000))
    rows = [(0, long), (1, "head\n" + long), (2, "x" * 3_000_000), (3, "x" * 3_000_000)]
    got = {r.doc_id: r.text for r in C.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), passages=True).collect()}
    assert got[0] == long and got[1] == "head" and got[2] == got[3] == rows[2][1]  # one word is not fifty
