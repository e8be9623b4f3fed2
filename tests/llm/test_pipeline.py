"""The pipeline against brute force: each stage on its own input, and the whole run."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from kvlake.llm import decontaminate, line_chunks, quality
from kvlake.llm.packing import MAX_LEN
from tests.llm.test_decontaminate import words
from tests.llm.test_near_dup import brute as brute_classes
from tests.llm.test_quality import brute as brute_stats

D = "/root/testdata/sf0.01"


def cut(text, items):
    """Text without benchmark passages, or None if they are a twentieth of its words."""
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    w, hit = words(text), set()
    for size in {len(i) for i in items}:
        for j in range(len(w) - size + 1):
            if tuple(w[j : j + size]) in items:
                hit.update(range(j, j + size))
    if hit and 20 * len(hit) >= len(w):
        return None
    for j in sorted(hit, reverse=True):
        end = spans[j + 1][0] if j + 1 in hit else spans[j][1]
        text = text[: spans[j][0]] + text[end:]
    return text


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], D).cache())
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.schema.simpleString() == steps[0].schema.simpleString()
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_quality_stage(spark, steps):
    kept, all_ = texts(steps[1]), texts(steps[0])
    verdict = {r.doc_id for r in quality.quality_rules(steps[0], spark.read.parquet(f"{D}/labels.parquet")).where("kept").collect()}
    assert kept.keys() == verdict and kept.items() <= all_.items()
    for t in kept.values():
        n, _, _, _, rep = brute_stats(t)
        assert n >= 10 and 100 * rep <= 20 * n


def shortest_runs(lines, least=50):
    """Runs of lines that reach ``least`` words and do not without their first, or last, line."""
    n = [len(x.split()) for x in lines]
    for p in range(len(lines)):
        total = 0
        for q in range(p, len(lines)):
            total += n[q]
            if total >= least:
                yield p, q + 1
                break
        total = 0
        for q in range(p, -1, -1):
            total += n[q]
            if total >= least:
                yield q, p + 1
                break


def test_line_stage(steps):
    """What the stage takes out is what the operator reports; every repeated run of 50 words
    is in it, found here by the texts of runs alone; and no line goes without an earlier copy."""
    before, after = texts(steps[1]), texts(steps[2])
    gone = {(r.doc_id, k) for r in line_chunks.report(steps[1], passages=True).collect() for x in r.removed.split(",") if x for a, b in [x.split("-")] for k in range(int(a), int(b) + 1)}
    first, runs, seen = {}, set(), {}
    for i, t in sorted(before.items()):
        lines = t.split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if (i, k) not in gone)
        assert after.get(i) == (kept if kept.split() else None)
        for k, x in enumerate(lines):
            first.setdefault(x, (i, k))
            assert (i, k) not in gone or not x.split() or first[x] < (i, k)
        for p, q in shortest_runs(lines):
            run = "\n".join(lines[p:q])
            j, end = seen.setdefault(run, (i, q))
            if j != i or p >= end:
                runs.update((i, k) for k in range(p, q) if lines[k].split())
    assert runs and runs <= gone


def test_near_dup_stage(steps):
    rows = list(texts(steps[2]).items())
    assert texts(steps[3]) == {i: t for (i, t), c in zip(rows, brute_classes(rows)) if i == c}


def test_benchmark_stage(spark, steps):
    items = set()
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = words(r.text)
        items.update(tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12)) if w)
    want = {i: cut(t, items) for i, t in texts(steps[3]).items()}
    assert texts(steps[4]) == {i: t for i, t in want.items() if t is not None}


def test_packing_and_run(spark, steps):
    total = Counter()
    for r in steps[5].collect():
        total[r.doc_id] += r.n_tokens
        assert r.n_tokens <= min(r.bucket, MAX_LEN)
    assert total == Counter({i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts(steps[4]).items()})
    assert sorted(corpus_pipeline.run(spark, D).collect()) == sorted(steps[5].collect())


def test_odd_rows(spark, tmp_path):
    rnd = random.Random(2)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(n))
    one, two = text(80), text(3000)
    rows = [(0, one), (1, one), (2, two), (2, two), (3, None), (4, ""), (None, text(50)), (5, text(90))]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, batch string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, text(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 0 in got and 1 not in got and not got & {3, 4}


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables(spark, tmp_path, empty):
    rnd = random.Random(3)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(n))
    tables = {
        "documents": spark.createDataFrame([(k, text(60), "en", "s", 9) for k in range(8)], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(k, 1, 0) for k in range(8)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, text(20))], "item_id long, text string"),
    }
    for name, df in tables.items():
        (df.limit(0) if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    assert len({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == (0 if empty == "documents" else 8)


def test_columns_with_names_of_results(spark):
    """Names that stages use for results pass through each of them."""
    rnd = random.Random(4)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(n))
    names = "class_id string, bands int, node string, n_words int, kept string, removed int, hash string, quality int, band int, root int, pivot int"
    one = text(50)
    rows = [(k, t, *[str(k) if "string" in c else k for c in names.split(", ")]) for k, t in enumerate([one, one, text(50)])]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(3)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, text(20))], "item_id long, text string")
    for stage in (lambda d: quality.filter_documents(d, labels), lambda d: corpus_pipeline.line_stage(spark, d, ""), lambda d: corpus_pipeline.near_dup_stage(spark, d, ""), lambda d: decontaminate.decontaminate(d, bench)):
        df2 = stage(df)
        assert df2.schema == df.schema and {r.class_id for r in df2.collect()} <= {"0", "1", "2"}
    assert {r.doc_id for r in corpus_pipeline.near_dup_stage(spark, df, "").collect()} == {0, 2}
