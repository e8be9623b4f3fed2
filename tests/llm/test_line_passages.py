"""Removal of passages against a brute force that knows nothing of the cuts."""

import random

import pytest

import corpus_pipeline
from kvlake.llm import line_chunks as C


def repeated_lines(rows, least=50):
    """(id, line) of the lines with words in a run of lines of ``least`` words or more that
    stood before, in an earlier document or in the same one without overlap."""
    seen, out = {}, set()
    for i, t in rows:
        lines = t.split("\n")
        for p in range(len(lines)):
            for q in range(p + 1, len(lines) + 1):
                run = "\n".join(lines[p:q])
                if len(run.split()) < least:
                    continue
                j, end = seen.setdefault(run, (i, q))
                if j != i or p >= end:
                    out.update((i, k) for k in range(p, q) if lines[k].split())
    return out


def planted(n_lines, seed):
    rnd = random.Random(seed)
    line = lambda n: " ".join(f"w{rnd.randrange(900)}" for _ in range(n))
    cuts = sorted(rnd.sample(range(12, 49), n_lines - 1)) if n_lines > 2 else [rnd.randrange(12, 49)]
    passage = [line(b - a) for a, b in zip([0, *cuts], [*cuts, 60])]
    rows = []
    for k in range(40):
        body = [line(rnd.randrange(3, 12)) for _ in range(rnd.randrange(4, 13))]
        at = rnd.randrange(len(body) + 1)
        body[at:at] = passage
        rows.append((k, "\n".join(body)))
    return rows, passage


@pytest.mark.parametrize("n_lines", [2, 3, 4, 5, 6])
def test_planted_passages(spark, n_lines):
    rows, passage = planted(n_lines, n_lines)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in C.dedup_lines(df, passages=True).collect()}
    assert all(x in got[0] for x in passage)
    assert not [k for k in range(1, 40) if any(x in got[k] for x in passage)]


def test_against_all_runs(spark):
    rnd = random.Random(5)
    pool = [" ".join(f"p{k}x{j}" for j in range(rnd.choice([1, 4, 9, 20, 49, 50, 70]))) for k in range(30)] + ["", " "]
    rows = []
    for k in range(50):
        body = [f"own {k} {j}" for j in range(3)]
        for _ in range(3):
            a = rnd.randrange(len(pool))
            at = rnd.randrange(len(body) + 1)
            body[at:at] = pool[a : a + rnd.randrange(1, 7)]
        rows.append((k, "\n".join(body)))
    rows += [(50, "same line here\n" * 50), (51, "\n\n".join(pool[:9])), (52, "\n\n".join(pool[:9]))]
    want = repeated_lines(rows)
    out = C.report(spark.createDataFrame(rows, "doc_id long, text string"), passages=True).collect()
    gone = {(r.doc_id, k) for r in out for x in r.removed.split(",") if x for k in range(int(x.split("-")[0]), int(x.split("-")[1]) + 1)}
    assert want and want <= gone
    # what goes besides: repeated chunks, and lines without words
    text = dict(rows)
    chunks = C.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    short = {(r.doc_id, k) for r in chunks for x in r.removed.split(",") if x for k in range(int(x.split("-")[0]), int(x.split("-")[1]) + 1)}
    run_of_chunk = {(i, k) for i, k in gone - want - short if text[i].split("\n")[k].split()}
    seen = {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            seen.setdefault(x, (i, k))
    assert all(seen[text[i].split("\n")[k]] < (i, k) for i, k in run_of_chunk)


def test_other_bytes_of_one_hash_stay(spark, monkeypatch):
    monkeypatch.setattr(C, "xxhash", type("X", (), {"xxh3_128_digest": staticmethod(lambda b: b"0" * 16)}))
    df = spark.createDataFrame([(k, "\n".join(f"l {k} {j} " + "z " * 20 for j in range(5))) for k in range(9)], "doc_id long, text string")
    assert C.dedup_lines(df, passages=True).exceptAll(df).count() == 0


def test_pipeline_stage(spark):
    rows, passage = planted(3, 8)
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, n_chars long")
    got = corpus_pipeline.line_stage(spark, df, "").collect()
    assert sum(any(x in r.text.split("\n") for x in passage) for r in got) == 1
    assert all(r.n_chars == len(r.text) for r in got)
