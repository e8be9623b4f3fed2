"""Against a brute force over all windows, on small made-up texts and on the test tables."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import pyarrow as pa
from kvlake.llm import decontaminate as D

SCHEMA = "doc_id long, text string, lang string, _x int"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items, window=13):
    d = words(text)
    hit, met = set(), set()
    for name, t in items:
        w = words(t)
        k = min(window, len(w))
        for i in range(len(w) - k + 1) if k else ():
            for j in range(len(d) - k + 1):
                if d[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    met.add(name)
    return len(d), len(hit), sorted(met)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5), st.lists(st.lists(st.sampled_from("abcd"), max_size=30), max_size=4), st.integers(1, 5))
def test_automaton(items, docs, window):
    auto = D.Matcher(D.build([(str(k), [w.encode() for w in i]) for k, i in enumerate(items)], window))
    got = D.match_texts(pa.array([" ".join(d) for d in docs], pa.string()), auto)
    for (n, spans, met, _), d in zip(got, docs):
        want = brute(" ".join(d), [(str(k), " ".join(i)) for k, i in enumerate(items)], window)
        assert (n, sum(e - s for s, e in spans), sorted(met)) == want


@pytest.fixture
def tables(spark):
    rnd = random.Random(5)
    voc = ["été", "LA", "b", "c1", "ñ", "x", "Of"]
    item = [" ".join(rnd.choices(voc, k=k)) for k in (40, 30, 13, 12, 5, 0)]
    docs = [None, "", "?!", "hello", "a" * 50_000]
    for _ in range(40):
        a = rnd.choice(item).split()
        s = rnd.randrange(max(1, len(a)))
        docs.append(", ".join(rnd.choices(voc, k=rnd.randrange(60)) + a[s : s + rnd.randrange(1, 25)] + rnd.choices(voc, k=9)))
    docs += docs[5:9]
    b = spark.createDataFrame([(k % 5, t) for k, t in enumerate(item)] + [(9, None), (None, item[0])], "item_id long, text string")
    return spark.createDataFrame([(k, t, "en", 1) for k, t in enumerate(docs)], SCHEMA), b


@pytest.mark.parametrize("block", [30, 500_000])
def test_contamination(tables, block):
    docs, bench = tables
    items = [(None if r.item_id is None else str(r.item_id), r.text) for r in bench.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in D.contamination(docs, bench, block_words=block).collect():
        n, hit, met = brute(texts[r.doc_id], [i for i in items if i[0] is not None])
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(met))
        assert r.items_sha256 == hashlib.sha256(",".join(met).encode()).hexdigest()
        assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    sets = {}
    for r in bench.collect():
        w = words(r.text)
        for i in range(max(1, len(w) - 12)):
            sets.setdefault(tuple(w[i : i + 13]), set()).add(str(r.item_id))
    sizes = {len(k) for k in sets if k}
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    for r in D.contamination(docs, bench).collect():
        w, hit, met = texts[r.doc_id], set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if (own := sets.get(tuple(w[j : j + k]))) is not None:
                    hit.update(range(j, j + k))
                    met |= own
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(met))


@pytest.mark.parametrize("block", [25, 500_000])
def test_decontaminate_cuts_and_drops(spark, block):
    passage = " ".join(f"w{k}" for k in range(20))
    long = " ".join(f"z{k}" for k in range(1000))
    docs = spark.createDataFrame([(1, passage, "en", 0), (2, f"{long}. Été {passage}! {long}", "en", 0), (3, "clean text", "en", 0), (4, None, None, 0)], SCHEMA)
    bench = spark.createDataFrame([(1, passage), *((k, f"other item {k} " * 5) for k in range(2, 9))], "item_id long, text string")
    out = {r.doc_id: r.text for r in D.decontaminate(docs, bench, block_words=block).collect()}
    assert out == {2: f"{long}. Été ! {long}", 3: "clean text", 4: None}
    assert D.decontaminate(docs, bench).schema == docs.schema


def test_empty(spark, tables):
    docs, bench = tables
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in D.contamination(docs, bench.limit(0)).collect()} == {0}
