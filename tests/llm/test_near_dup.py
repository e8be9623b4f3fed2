import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlake.llm import near_dup as N


def words(t):
    return tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))


def shingles(w):
    return Counter(w[i : i + 5] for i in range(len(w) - 4))


def jaccards(a, b):
    both = a.keys() & b.keys()
    if not both:
        return 0.0, 0.0
    wa, wb = ({k: 1 + math.log(v) for k, v in x.items()} for x in (a, b))
    p = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in a.keys() | b.keys()) for d in both)
    return len(both) / len(a.keys() | b.keys()), p


def brute(rows, threshold=0.8):
    """Class id of each (id, text) row."""
    key = lambda t: words(t) or (t or "").encode()
    texts = list(dict.fromkeys(key(t) for _, t in rows))
    at = {t: k for k, t in enumerate(texts)}
    sets = [shingles(t) if isinstance(t, tuple) else Counter() for t in texts]
    up = list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    near = defaultdict(list)
    for k, s in enumerate(sets):
        seen = {j for g in s for j in near[g]}
        for j in seen:
            # the probability Jaccard is costly and never far from the plain one here
            both = len(s.keys() & sets[j].keys()) / len(s.keys() | sets[j].keys())
            if both >= threshold or both > 0.3 and max(jaccards(s, sets[j])) >= threshold:
                up[top(k)] = top(j)
        for g in s:
            near[g].append(k)
    least = {}
    for i, t in rows:
        r = top(at[key(t)])
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(top(at[key(t)])) for _, t in rows]


@settings(max_examples=200, deadline=None)
@given(*[st.dictionaries(st.integers(0, 12), st.integers(1, 9), min_size=1)] * 2)
def test_similarities(a, b):
    arr = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], np.uint32))
    assert N.similarities(*arr(a), *arr(b)) == pytest.approx(jaccards(a, b))


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    for size, over in ((3, 2), (40, 30), (2000, 1700)):
        key = rng.integers(1, 2**63, 2 * size - over).astype(np.uint64)
        a, b = {int(k): int(rng.integers(1, 5)) for k in key[:size]}, {int(k): int(rng.integers(1, 5)) for k in key[size - over :]}
        m = 4096
        sig = [N.prob_min_hash(1, np.zeros(len(s), np.int64), np.array(list(s), np.uint64), N.weights(np.array(list(s.values()))), m)[0] for s in (a, b)]
        arr = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)], np.uint32))
        assert abs((sig[0] == sig[1]).mean() - N.similarities(*arr(a), *arr(b))[1]) < 4 * 0.5 / math.sqrt(m)
        assert set(sig[0].tolist()) <= set(a)


def made_up():
    rnd = random.Random(4)
    voc = [f"w{k}" for k in range(3000)]
    rows = [(k, t) for k, t in enumerate([None, "", "", "?!", "?!", "!?", "one two", "One, two!", "a b c d", "a b c d e", "A B C D E."])]
    for n in (30, 200, 900):
        base = rnd.choices(voc, k=n)
        for edits in (0, 0, 1, 1, 2, 3, n // 60, n // 40, n // 10):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(n)] = rnd.choice(voc)
            rows.append((len(rows), " ".join(w)))
    drift = rnd.choices(voc, k=300)  # a chain: only neighbours are alike
    for _ in range(12):
        rows.append((len(rows), " ".join(drift)))
        drift = drift[12:] + rnd.choices(voc, k=12)
    line = " ".join(rnd.choices(voc, k=20))
    rows += [(len(rows), " ".join([line] * k + [rnd.choice(voc)])) for k in (3, 4, 9)]
    rows += rows[12:15] + [(None, rows[13][1]), (None, "only null has this text of some words"), (None, None)]
    rnd.shuffle(rows)
    return rows


def test_classes(spark):
    rows = made_up()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = N.near_duplicates(df).collect()
    want = dict(zip(map(str, rows), brute(rows)))
    size = Counter(brute(rows))
    assert len(got) == len(rows)
    ids = {r[0]: c for r, c in zip(rows, brute(rows)) if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            assert r.class_id == ids[r.doc_id], r
            assert r.class_size == size[r.class_id]
    kept = N.one_of_each(df)
    assert kept.schema == df.schema
    out = kept.collect()
    assert len(out) == len(set(want.values()))
    assert {r.doc_id for r in out} == set(want.values())
    assert N.near_duplicates(df.limit(0)).count() == 0 and N.one_of_each(df.limit(0)).count() == 0


def test_large_group(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(999)}" for _ in range(400)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(400)] = f"x{rnd.randrange(99)}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.class_id, r.class_size) for r in N.near_duplicates(df).collect()} == {(0, 300)}


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)]
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in up if top(n) != n}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = dict(zip((i for i, _ in rows), brute(rows)))
    assert {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()} == want


def test_plain_links_beside_repetition(spark):
    """Pairs of plain Jaccard over 0.8 whose other shingles are repeated: every one is found."""
    rows = []
    for k in range(80):
        shared = " ".join(f"s{k}x{j}" for j in range(104))
        rows += [(2 * k + x, shared + f" {y}{k}a {y}{k}b {y}{k}c {y}{k}d {y}{k}e" * 400) for x, y in enumerate("pq")]
    plain, prob = jaccards(shingles(words(rows[0][1])), shingles(words(rows[1][1])))
    assert plain > 0.82 and prob < 0.65
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def linked(rows, similar):
    """Class ids of rows, ``similar`` giving for each the rows that it is linked with."""
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in similar(a):
            x, y = top(a), top(int(b))
            up[max(x, y)] = min(x, y)
    return {rows[k][0]: rows[top(k)][0] for k in range(len(rows))}


def edited(rnd, base, edits, voc):
    w = list(base)
    for _ in range(edits):
        w[rnd.randrange(len(w))] = rnd.choice(voc)
    return tuple(w)


def test_near_and_apart_in_one_group(spark):
    """2,000 copies near one text and 2,000 that mostly are too far from it, some of which
    have each other's edits: as all pairs give."""
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    other = edited(rnd, base, 6, [f"o{k}" for k in range(99)])  # a second text with copies of its own
    few = [f"x{k}" for k in range(3)]
    many = [f"y{k}" for k in range(4000)]
    rows = [edited(rnd, base, rnd.randrange(1, 3), many) for _ in range(2000)]
    rows += [edited(rnd, base, rnd.randrange(3, 8), rnd.choice((few, many, many))) for _ in range(1800)]
    rows += [edited(rnd, w, 1, many) for w in rows[-100:]]  # each alike to its own far one alone
    rows += [edited(rnd, other, rnd.randrange(1, 5), many) for _ in range(100)]
    rnd.shuffle(rows)
    rows = [(k, w) for k, w in enumerate(rows)]
    sets = [set(shingles(w)) for _, w in rows]
    count = Counter(g for s in sets for g in s)
    column = {g: k for k, g in enumerate(g for g, n in count.items() if n > 1)}
    there = np.zeros((len(rows), len(column)), np.float32)
    for k, s in enumerate(sets):
        there[k, [column[g] for g in s if g in column]] = 1
    size = np.array([len(s) for s in sets])

    def similar(a):
        both = there @ there[a]
        return np.flatnonzero(both >= 0.8 * (size + size[a] - both) - 1e-6)

    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    want = linked(rows, similar)
    sizes = sorted(Counter(want.values()).values())
    assert sizes[-1] > 1500 and sizes.count(1) > 500 and sizes.count(2) > 20
    assert got == want


def join_rows(spark, since):
    """Rows that each join made in the SQL executions from ``since`` on, by its keys and kind."""
    store = spark._jsparkSession.sharedState().statusStore()
    out = Counter()
    for e in range(since, store.executionsCount()):
        of = store.executionsList(e, 1).head()
        values, nodes = store.executionMetrics(of.executionId()), store.planGraph(of.executionId()).allNodes()
        for k in range(nodes.size()):
            for m in range(nodes.apply(k).metrics().size()) if "Join" in nodes.apply(k).name() else ():
                metric = nodes.apply(k).metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    desc = re.sub(r"#\d+L?|^\w+Join ", "", nodes.apply(k).desc())
                    out[desc] += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out


def test_classes_within_one_group(spark, monkeypatch):
    """A text and its copies, and copies of two texts apart from it and from each other, with some
    between these two: as all pairs give, one row for each node where it meets its shingles,
    and no class held against itself."""
    rnd = random.Random(21)
    base, many = [f"w{k}" for k in range(150)], [f"y{k}" for k in range(5000)]
    places = [10 + 24 * k for k in range(6)]
    with_ = lambda name, which: [f"{name}{k}" if k in which else w for k, w in enumerate(base)]
    rows = [edited(rnd, base, rnd.randrange(1, 3), many) for _ in range(400)]
    rows += [edited(rnd, with_("q", places), rnd.randrange(1, 3), many) for _ in range(300)]
    rows += [edited(rnd, with_("r", [k + 5 for k in places]), rnd.randrange(1, 3), many) for _ in range(200)]
    rows += [edited(rnd, with_("s", rnd.sample(range(5, 145), 5)), 3, [f"z{k}" for k in range(4)]) for _ in range(100)]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    sets = [set(shingles(w)) for _, w in rows]
    similar = lambda a: [b for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = linked(rows, similar)
    assert sorted(Counter(want.values()).values())[-3:] == [200, 300, 400]

    nodes, looked, write = [], [], N.written

    def written(df):
        out = write(df)
        if {"pivot", "node", "z"} <= set(df.columns):
            nodes.append(out.select("pivot", "node").distinct().count())
        if {"shingle", "root", "big"} <= set(df.columns):
            main = "root = main" if "main" in out.columns else "false"  # these are not joined with each other
            n = out.where("not big and rank > 0 and rank <= s - among + 1").groupBy("pivot", "shingle")
            looked.append(sum(r.n**2 - r.m**2 for r in n.agg(F.count("*").alias("n"), F.count_if(F.expr(main)).alias("m")).collect()))
        return out

    monkeypatch.setattr(N, "written", written)
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()} == want
    made = {k: n for k, n in join_rows(spark, since).items() if re.match(r"\[pivot, node\], \[pivot, node\], Inner", k)}
    assert made and max(made.values()) <= max(nodes)
    assert looked[-1] < 100 * len(rows)


def test_repeated_shingles_in_one_group(spark):
    """The same with repeated lines, where the two similarities differ."""
    rnd = random.Random(13)
    base = [f"w{k}" for k in range(60)] + [f"l{k}" for k in range(8)] * 3
    rows = [edited(rnd, base, rnd.randrange(1, 6), [f"x{k}" for k in range(20)]) + tuple(f"l{k}" for k in range(8)) * rnd.randrange(4) for _ in range(500)]
    rows = [(k, w) for k, w in enumerate(rows)]
    sets = []
    for _, w in rows:
        s = sorted((hash(g) & 2**62 - 1, n) for g, n in shingles(w).items())
        sets.append((np.array([k for k, _ in s], np.uint64), np.array([n for _, n in s], np.uint32)))
    similar = lambda a: [b for b in range(a) if max(N.similarities(*sets[a], *sets[b])) >= 0.8 - 1e-9]
    want = linked(rows, similar)
    assert len(set(want.values())) > 20
    got = N.near_duplicates(spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_words_with_equal_polynomial_hashes_stay_apart(spark):
    from tests.llm.test_scan import thue_morse

    x, y = thue_morse(1024)
    rows = [(0, x), (1, y), (2, f"{x} {x}"), (3, f"{x} {y}")]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_very_long_texts(spark):
    """Texts of a million words, alike, edited and apart, beside short ones."""
    rnd = random.Random(3)
    long = [f"w{rnd.randrange(10**6)}" for _ in range(10**6)]
    rows = [(0, " ".join(long)), (1, " ".join(long[:-9] + ["x"] * 9)), (2, " ".join(reversed(long))), (3, "short text of six words here"), (4, None), (5, "")]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}
