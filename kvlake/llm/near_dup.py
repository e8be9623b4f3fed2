"""Near-duplicates by ProbMinHash.

A text is the weighted set of its 5-word shingles, a shingle that stands n times
weighing 1 + ln n.  Each shingle sends points of a Poisson process whose rate is
its weight; every point goes to one of ``REGISTERS`` registers, and a register keeps
the shingle of its earliest point.  Processes stop early, as soon as their next
point would come later than every register's present one.  Two texts share a
register with a probability equal to their probability Jaccard similarity.  A text
with repeated shingles has a second set of registers, all weights being 1, which two
texts share with a probability equal to their plain Jaccard similarity (without
repetition the first set is that).  The registers of a set form ``BANDS`` bands; texts that share a band are candidates, and each
candidate is verified on the full shingle sets: it is a link if its probability
Jaccard or its plain Jaccard similarity is 0.8 or more.

Scale and skew.  Copies are collapsed before anything else: a node is a distinct
sequence of words.  A band shared by many nodes never gives all pairs.  Its pivot is
the member that shares most bands with others, so mostly the text that the others
were edited from; every member is compared with the pivot, and the links so far make
classes.  All bands of one pivot are one group, which is looked through once more for
links between different classes, by the differences of its members from the pivot
(``_crossing``): texts that differ from it in other places part without being
compared, and no link is lost.  The tables are in proportion to the members and their
differences, whatever share of the documents a group has; only members of different
classes that share a rare difference are held against each other.  Classes are connected
components, found by alternating large-star and small-star steps on tables.  Nothing
but counts reaches the driver.

Defined results: words are runs of letters, digits and characters outside ASCII,
A-Z counting as a-z.  Texts with the same words are copies; texts without words
are copies if their bytes are equal, null counting as empty; a text of fewer than
five words only has copies.  The class id is the smallest document id of the class,
null if all are null; repeated rows are members of one class; an empty table gives
an empty result.  Other columns are not read.  Names beginning with ``_kv_`` are
reserved.  A text is held whole by the task that reads it, at some 60 bytes for each
of its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Tokens, as_bytes, folded, mix64, slices, windows, word_table
from .store import released, small_batches, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5  # texts of either similarity 0.8 miss all bands with probability 3e-6
REGISTERS = BANDS * ROWS
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sequence_ids(t: Tokens) -> np.ndarray:
    """128 bits of each text's sequence of words, as an (n, 2) array: the BLAKE2 digest
    of its words with a space between; of its bytes where it has no word."""
    raw = folded(t.data)
    keep = word_table("alnum")[raw] != 0
    inner = t.end[t.end < t.offsets[t.doc + 1]]  # each word's end, but for those that end a text
    raw[inner], keep[inner] = 32, True
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    some = memoryview(np.ascontiguousarray(raw[keep]))
    whole = memoryview(np.ascontiguousarray(t.data))
    out = np.zeros((t.n, 2), np.uint64)
    edges, offsets = at[t.offsets].tolist(), t.offsets.tolist()
    for k, n in enumerate(t.counts().tolist()):
        if n:
            x, y = edges[k], edges[k + 1]
            digest = hashlib.blake2b(some[x : y - (some[y - 1] == 32)], digest_size=16)
        else:
            digest = hashlib.blake2b(whole[offsets[k] : offsets[k + 1]], digest_size=16, person=b"without words")
        out[k] = np.frombuffer(digest.digest(), np.uint64)
    return out


def shingles(t: Tokens, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles, ordered by text and hash."""
    at, key = windows(t, h, SHINGLE)
    doc = t.doc[at]
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    return doc[start], key[start], np.diff(np.append(start, len(key)))


def weights(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def prob_min_hash(n: int, doc: np.ndarray, key: np.ndarray, weight: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers of n texts: the shingle whose process comes first in each.

    All processes of a slice advance together, a block of points at a time; those
    past the latest register of their text have ended.
    """
    time = np.full(n * m, np.inf)
    owner = np.zeros(n * m, np.uint64)
    now = np.zeros(len(key))
    k0, block = 0, 1
    while len(key):
        k = np.arange(k0, k0 + block, dtype=np.uint64)
        with np.errstate(over="ignore"):
            bits = mix64(key[:, None] + (k[None, :] + np.uint64(1)) * _STEP)
            slot = ((mix64(bits ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        when = now[:, None] + np.cumsum(gap, axis=1)
        now = when[:, -1]
        cell = (doc[:, None] * m + slot.astype(np.int64)).ravel()
        who, when = np.broadcast_to(key[:, None], gap.shape).ravel(), when.ravel()
        early = when < time[cell]
        cell, who, when = cell[early], who[early], when[early]
        np.minimum.at(time, cell, when)
        won = time[cell] == when
        owner[cell[won]] = who[won]
        there = np.unique(doc)
        latest = np.zeros(n)
        latest[there] = time.reshape(n, m)[there].max(axis=1)
        alive = now < latest[doc]
        doc, key, weight, now = doc[alive], key[alive], weight[alive], now[alive]
        k0, block = k0 + block, min(64, block * 2 if k0 else 1)
    return owner.reshape(n, m)


def band_hashes(registers: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes; the number of the band is part of each."""
    r = registers.reshape(len(registers), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, r.shape[:2])
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            h = mix64(h * _STEP + r[:, :, j])
    return h


def all_bands(n: int, doc: np.ndarray, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands of n texts, (n, 2 * BANDS), and which of them count: the weighted ones, and
    of texts with repeated shingles also the plain ones that differ from these."""
    bands, there = np.zeros((n, 2 * BANDS), np.uint64), np.zeros((n, 2 * BANDS), bool)
    bands[:, :BANDS] = band_hashes(prob_min_hash(n, doc, key, weights(count)))
    there[np.unique(doc), :BANDS] = True
    again = np.unique(doc[count > 1])
    of = np.isin(doc, again)
    plain = band_hashes(prob_min_hash(len(again), np.searchsorted(again, doc[of]), key[of], np.ones(int(of.sum()))))
    bands[again, BANDS:], there[again, BANDS:] = plain, plain != bands[again, :BANDS]
    return bands, there


def _by_text(column: pa.Array):
    """Of each slice: the range of texts, its tokens and their hashes, and its ids."""
    data, off = as_bytes(column)
    for a, b in slices(off):
        t = Tokens(data[off[a] : off[b]], off[a : b + 1] - off[a], "alnum")
        yield a, b, t, t.hashes(True), sequence_ids(t)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of an (n, k) uint64 array as binary values."""
    n, k = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (8 * k)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).astype("<u8").tobytes())])


def _sketcher(text_col: str, names: list[str]):
    def run(batches):
        for batch in batches:
            for a, b, t, h, ids in _by_text(batch.column(batch.schema.get_field_index(text_col))):
                doc, key, count = shingles(t, h)
                bands, there = all_bands(b - a, doc, key, count)
                flat = pa.array(bands[there].astype(np.int64))
                at = np.zeros(b - a + 1, np.int32)
                np.cumsum(there.sum(axis=1), out=at[1:])
                cols = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*cols, _binary(ids), pa.ListArray.from_arrays(pa.array(at), flat)], names=[*names, "_kv_node", "_kv_bands"])

    return run


def _shingler(text_col: str):
    def run(batches):
        for batch in batches:
            for a, b, t, h, ids in _by_text(batch.column(batch.schema.get_field_index(text_col))):
                doc, key, count = shingles(t, h)
                at = (np.searchsorted(doc, np.arange(b - a + 1)) * 8).astype(np.int32)
                keys = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at), pa.py_buffer(key.astype("<u8").tobytes())])
                counts = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at // 2), pa.py_buffer(count.astype("<u4").tobytes())])
                length = np.bincount(doc, 2 * weights(count) - 1, b - a)
                yield pa.RecordBatch.from_arrays([_binary(ids), keys, counts, pa.array(length)], names=["_kv_node", "_kv_keys", "_kv_counts", "_kv_l"])

    return run


def similarities(ka: np.ndarray, ca: np.ndarray, kb: np.ndarray, cb: np.ndarray) -> tuple[float, float]:
    """Plain and probability Jaccard of two sorted shingle sets with counts."""
    if not len(ka) or not len(kb):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    both = kb[at] == ka
    n = int(both.sum())
    if not n:
        return 0.0, 0.0
    plain = n / (len(ka) + len(kb) - n)
    wa, wb = weights(ca), weights(cb)
    a, b = wa[both], wb[at[both]]
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    # of a shared d': its weight in A over A's of d if its ratio is larger, else in B
    tail = np.r_[np.cumsum(a[::-1])[::-1], 0.0] + wa[~both].sum()
    head = np.r_[0.0, np.cumsum(b)] + (wb.sum() - b.sum())
    k = np.arange(n)
    return plain, float((1.0 / (tail[k] / a + head[k] / b)).sum())


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """Keys and counts of both nodes of a row."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    return [np.frombuffer(column(c)[k].as_buffer(), "<u8" if c[0] == "k" else "<u4") for c in ("ka", "ca", "kb", "cb")]


def _verifier(threshold: float):
    """Whether a and b are linked, and how many shingles one of them alone has."""

    def run(batches):
        for batch in batches:
            keep, apart = [], []
            for k in range(batch.num_rows):
                ka, ca, kb, cb = _sets(batch, k)
                keep.append(max(similarities(ka, ca, kb, cb)) >= threshold - 1e-9)
                apart.append(len(np.setxor1d(ka, kb, assume_unique=True)))
            ab = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")]
            yield pa.RecordBatch.from_arrays([*ab, pa.array(keep, pa.bool_()), pa.array(apart, pa.int64())], names=["a", "b", "link", "apart"])

    return run


def _differ(batches):
    """(b, a, shingle): the shingles that one of a and b alone has."""
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b"))
        for k in range(batch.num_rows):
            ka, _, kb, _ = _sets(batch, k)
            x = np.setxor1d(ka, kb, assume_unique=True).astype(np.int64)
            for i in range(0, len(x), 65_536):
                part = pa.array(x[i : i + 65_536])
                at = pa.array(np.full(len(part), k))
                yield pa.RecordBatch.from_arrays([b.take(at), a.take(at), part], names=["pivot", "node", "shingle"])


def _crossing(group: DataFrame, differ: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes of a group that may be links.

    ``group``: pivot, node, root, and ``z`` = apart - c L.  ``differ``: the shingles
    that make up a node's difference from its pivot.

    Let d be the difference (a set of shingles) of a node from the pivot, n its number
    of shingles and W the sum of their weights.  x and y differ in the symmetric
    difference of their own d.  A link of threshold t has at most c (L(x) + L(y)) in it,
    with c = (1 - t) / (1 + t) and L = 2 W - n:  the plain similarity needs
    c (n(x) + n(y)), and n <= L.  The probability Jaccard similarity is at most the
    share that common shingles have of all, each weighing the larger of its two weights:
    for the term of a common shingle is its weight x' over the sum of max(x, y x'/y'),
    which is at least that of max(x, y) where x' >= y', and y'/x' of it otherwise.  As
    weights are 1 or more, common shingles weigh at most
    W(x) + W(y) less all that is not common, less their number; c L follows.

    So d(x) and d(y) have o = (z(x) + z(y)) / 2 shingles in common at least.  Those that
    no other difference of the group has cannot be among them; a node with fewer than
    its least o others is done.  Of the others, ordered from the rarest on, x and y must
    share one of the first s - o + 1.  The largest class of a group has many members
    and every other node is held against it with the least z of that class, and
    against the other nodes with theirs.  Nodes with an o of 0 or less meet each other.
    """
    sizes = group.groupBy("pivot", "root").agg(F.count("*").alias("n"))
    largest = written(sizes.groupBy("pivot").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("k")).where("k > 1").select("pivot", F.col("m.root").alias("largest")))
    nodes = written(group.join(largest, "pivot").select("pivot", "node", "root", "z", (F.col("root") == F.col("largest")).alias("big")))
    used = [largest, nodes]
    for _ in range(2):  # without those that are done, more shingles are alone
        rest = differ.join(nodes.select("pivot", "node"), ["pivot", "node"], "left_semi")
        held = written(rest.groupBy("pivot", "shingle").agg(F.count("*").alias("held")).where("held > 1"))
        both = written(rest.join(held, ["pivot", "shingle"]))
        own = both.groupBy("pivot", "node").agg(F.count("*").alias("s"))
        least = written(nodes.groupBy("pivot").agg(F.min(F.when(F.col("big"), F.col("z"))).alias("in_"), F.min(F.when(~F.col("big"), F.col("z"))).alias("out")))
        z = F.col("z")
        across = F.ceil((z + F.when(F.col("big"), F.col("out")).otherwise(F.col("in_"))) / 2 - 1e-6)
        among = F.when(~F.col("big"), F.ceil((z + F.col("out")) / 2 - 1e-6))
        nodes = nodes.select("pivot", "node", "root", "z", "big").join(least, "pivot").join(own, ["pivot", "node"], "left")
        nodes = nodes.select("pivot", "node", "root", "z", "big", F.coalesce("s", F.lit(0)).alias("s"), across.alias("across"), among.alias("among"))
        nodes = written(nodes.where("s >= across or s >= among"))
        used += [held, both, least, nodes]
    # one row for each node meets its shingles, from the rarest on; only those it needs come out
    own = both.groupBy("pivot", "node").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("own"))
    first = lambda needed: F.col("s") - F.greatest(F.col(needed), F.lit(1)) + 1
    longest = F.greatest(first("across"), F.when(F.col("among").isNotNull(), first("among")), F.lit(0)).cast("int")
    names = ["pivot", "node", "root", "z", "big", "s", "across", "among"]
    rank = nodes.join(own, ["pivot", "node"]).select(*names, F.posexplode(F.slice("own", F.lit(1), longest)).alias("at", "one"))
    rank = rank.select(*names, F.col("one.shingle").alias("shingle"), (F.col("at") + 1).alias("rank"))
    zero = nodes.where("across <= 0 or among <= 0").select(*names, F.lit(0).cast("long").alias("shingle"), F.lit(0).alias("rank"))
    rank = written(rank.unionByName(zero))

    def needing(needed: str, rows: DataFrame) -> DataFrame:
        return rows.where(F.when(F.col("rank") > 0, F.col("rank") <= first(needed)).otherwise(F.col(needed) <= 0))

    def met(x: DataFrame, y: DataFrame, apart):
        x, y = (d.select("pivot", "shingle", F.struct("node", "root", "z", "s", "rank").alias(c)) for d, c in ((x, "x"), (y, "y")))
        o = (F.col("x.z") + F.col("y.z")) / 2 - 1e-6
        # what is before the first shingle in common is not in common
        may = (o <= F.least(F.col("x.s") - F.col("x.rank"), F.col("y.s") - F.col("y.rank")) + 1) & ((F.col("shingle") != 0) | (o <= 0))
        both = x.join(y, ["pivot", "shingle"]).where(apart & may)
        return both.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))

    big, small = rank.where("big"), rank.where("not big")
    pairs = met(needing("across", big), needing("across", small), F.lit(True))
    # a class is not held against itself: the one that has most nodes of a shingle meets the others
    # alone, so no more than twice the pairs of different classes are looked at
    among = needing("among", small)
    by_class = among.groupBy("pivot", "shingle", "root").agg(F.count("*").alias("n"))
    main = by_class.groupBy("pivot", "shingle").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("k")).where("k > 1")
    main = written(main.select("pivot", "shingle", F.col("m.root").alias("main")))
    among = written(among.join(main, ["pivot", "shingle"]))
    most, others = among.where("root = main"), among.where("root <> main")
    pairs = pairs.unionByName(met(most, others, F.lit(True)))
    pairs = pairs.unionByName(met(others, others, (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))))
    out = written(pairs.distinct())
    released(*used, rank, main, among)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of undirected links (a, b), the root being the
    smallest node of the component.  Alternates large-star and small-star steps,
    each written to the shared folder, until the edges stay as they are.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark, before = None, None
    while mark is None or mark != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, edges = edges, written(small.where("u <> v").distinct())
        released(old)
        mark, before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0], mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _text_key(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members (id, text key, node) and the class of each node (node, class_id,
    class_size, n_texts, keep: the text key and whether it is the kept node)."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col), F.col(text_col), _text_key(text_col).alias("_kv_text"))
    binary = lambda *names: [T.StructField(c, T.BinaryType()) for c in names]
    kind = T.StructType([docs.schema[id_col], *binary("_kv_text", "_kv_node"), T.StructField("_kv_bands", T.ArrayType(T.LongType()))])
    rows = written(slim.mapInArrow(_sketcher(text_col, [id_col, "_kv_text"]), kind))
    # copies collapse here; their bands are equal
    nodes = rows.groupBy("_kv_node").agg(F.first("_kv_bands").alias("bands"))
    bands = written(nodes.select(F.col("_kv_node").alias("node"), F.explode("bands").alias("band")))
    shared = written(bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    member = written(bands.join(shared, "band"))  # rows of the bands that two nodes or more share
    released(bands, shared)
    central = member.groupBy("node").agg(F.sum("n").alias("score"))
    pivot = member.join(central, "node").groupBy("band").agg(F.max(F.struct("score", "node")).alias("m"))
    pivot = written(pivot.select("band", F.col("m.node").alias("pivot")))
    pairs = written(member.join(pivot, "band").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    released(member, pivot)

    ends = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "_kv_node")
    # one document of each text that is needed: copies are one row before the first join, and
    # with the id as a part of the key their texts are dealt apart in the second
    one = F.min(F.struct("_kv_text", F.col(id_col).alias("_kv_id"))).alias("m")
    needed = written(rows.groupBy("_kv_node").agg(one).join(ends, "_kv_node", "left_semi").select(F.col("m._kv_text").alias("_kv_needed"), "m._kv_id"))
    texts = slim.join(needed.hint("merge"), (F.col("_kv_text") == F.col("_kv_needed")) & F.col(id_col).eqNullSafe(F.col("_kv_id")), "left_semi")
    texts = texts.groupBy("_kv_text", id_col).agg(F.first(text_col).alias("text_")).select("text_")
    sets = written(texts.mapInArrow(_shingler("text_"), T.StructType(binary("_kv_node", "_kv_keys", "_kv_counts") + [T.StructField("_kv_l", T.DoubleType())])))

    def with_sets(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("_kv_node").alias("a"), F.col("_kv_keys").alias("ka"), F.col("_kv_counts").alias("ca"))
        two = sets.select(F.col("_kv_node").alias("b"), F.col("_kv_keys").alias("kb"), F.col("_kv_counts").alias("cb"))
        return pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b")

    def verified(pairs: DataFrame) -> DataFrame:
        return written(with_sets(pairs).mapInArrow(_verifier(threshold), "a binary, b binary, link boolean, apart long"))

    tested = verified(pairs)
    roots = components(tested.where("link"))

    # groups whose members, without the pivot, are in two classes or more
    group = tested.select(F.col("b").alias("pivot"), F.col("a").alias("node"), "apart").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = written(group.groupBy("pivot").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("pivot"))
    share = (1 - threshold) / (1 + threshold)
    length = sets.select(F.col("_kv_node").alias("node"), F.col("_kv_l").alias("l"))
    group = written(group.join(mixed, "pivot", "left_semi").join(length, "node").select("pivot", "node", "root", (F.col("apart") - share * F.col("l")).alias("z")))
    if not group.isEmpty():
        differ = with_sets(group.select(F.col("node").alias("a"), F.col("pivot").alias("b"))).mapInArrow(_differ, "pivot binary, node binary, shingle long")
        differ = written(differ)
        crossing = _crossing(group, differ)
        more = verified(crossing)
        if not more.where("link").isEmpty():
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.where("link").select("a", "b")))
        released(differ, crossing, more)
    released(pairs, tested, sets, needed, mixed, group)

    members = rows.select(F.col(id_col), "_kv_text", "_kv_node")
    first = F.min(F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), F.col("_kv_text").alias("text"))))
    per_node = members.groupBy("_kv_node").agg(first.alias("least"), F.min("_kv_text").alias("any"), F.count("*").alias("n"))
    per_node = per_node.join(roots.withColumnRenamed("node", "_kv_node"), "_kv_node", "left").select("_kv_node", "least", "any", "n", F.coalesce("root", "_kv_node").alias("root"))
    total = per_node.groupBy("root").agg(F.min("least").alias("least"), F.min("any").alias("any"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts"))
    # written, as is what is returned, so that these joins read plain exchanges and a large
    # class or many copies can be split
    total = written(total.select("root", F.col("least.id").alias("class_id"), "class_size", "n_texts", F.coalesce("least.text", "any").alias("keep")))
    return members, written(per_node.select("_kv_node", "root").join(total, "root").drop("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, class_id, class_size (rows) and n_texts (distinct
    word sequences of the class)."""
    members, by_node = classes(docs, id_col, text_col, **options)
    return members.join(by_node, "_kv_node").select(id_col, "class_id", "class_size", "n_texts")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each class, one row of it, with the
    columns of ``docs``."""
    members, by_node = classes(docs, id_col, text_col, **options)
    kept = by_node.select(F.col("keep").alias("_kv_keep"), F.col("class_id").alias("_kv_class")).distinct()
    out = docs.withColumn("_kv_text", _text_key(text_col))
    out = out.join(kept, (out["_kv_text"] == kept["_kv_keep"]) & out[id_col].eqNullSafe(kept["_kv_class"]))
    return out.dropDuplicates([id_col, "_kv_text"]).select(*docs.columns)
