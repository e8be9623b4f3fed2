"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items form one suffix automaton.  The words of
each document stream through it and the longest match that ends at each word is
tracked.  A word inside any occurrence of a window of ``window`` consecutive item
words (a shorter item is one window) is a hit.

Before the automaton, a vectorised filter cuts a text at every pair of adjacent
words that no item has: no match of two words or more crosses such a cut, and
only stretches that could hold a whole window go on.  Words are told apart by 64-bit
hashes there; in the stretches that go on, their bytes are compared.

Test items are dealt to blocks of about ``block_words`` words by a hash of the item.
A task builds each block's automaton and hands it on as flat arrays (about 60 bytes a
word of the items).  A block is broadcast, passed by all documents, and released before
the next one; so memory follows the block, not the benchmark.  With one block the
documents pass once, without a shuffle; with more, each pass writes the hits it found
and these are joined to the documents in the end.

Defined results: null or empty texts have no words, are not contaminated and are
kept; items without words match nothing; a repeated item id stands for all of its
texts; items with a null id hit but have no name; an empty benchmark or an empty
document table gives zero hits or no rows; repeated documents have equal results.  An
item of any length stays in one block, and a text is held whole by the task that reads
it, at some 60 bytes for each of its words.  Names beginning with ``_kv_`` are reserved
and refused in the documents; all other columns pass through.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Tokens, as_bytes, slices, span_hashes
from .store import released, small_batches, written

WINDOW = 13
BLOCK_WORDS = 500_000  # words of test items in one automaton
COVERAGE_PERCENT = 5
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z."""
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


class _Builder:
    """Generalised suffix automaton of sequences of word ids; state 0 is the root."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def extend(self, last: int, c: int) -> int:
        """The state of the sequence of ``last`` with c after it."""
        if c in self.next[last]:  # the path is there already (generalised case)
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = self._new(self.len[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        k = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = k
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k


def build(items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> dict:
    """The automaton of the items as flat arrays.

    ``hash`` (sorted), ``word`` and ``ends``: the words, a word's id being its place;
    ``pairs``: codes of adjacent words; ``edge`` and ``to``: transitions by
    state * words + id, sorted; ``anchor``: of each state, the one on its way up that
    holds the suffix of exactly ``window`` words; ``own`` and ``of``: pairs of a state
    and an item that ends there, by state: items of a window's length or more at the
    anchors of their places, shorter ones at their ends; ``up``: of each state, the
    nearest on the way up, itself included, that a shorter item ends in.
    """
    words = sorted({w for _, ws in items for w in ws})
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    h = span_hashes(raw, ends - np.array([len(w) for w in words], np.int64), ends, False)
    order = np.argsort(h)
    words = [words[k] for k in order]
    vocab, v = {w: k for k, w in enumerate(words)}, max(1, len(words))
    auto, pairs, least = _Builder(), set(), window
    names: dict = {}
    long, short = [], []  # (state, item)
    for name, ws in items:
        ids = [vocab[w] for w in ws]
        if not ids:
            continue
        least = min(least, len(ids))
        pairs.update(a * v + b for a, b in zip(ids, ids[1:]))
        of = names.setdefault(name, len(names))
        last = 0
        for k, c in enumerate(ids):
            last = auto.extend(last, c)
            if k >= window - 1:
                long.append((last, of))
        if len(ids) < window:
            short.append((last, of))
    size = len(auto.len)
    anchor, up, brief = [0] * size, [0] * size, {s for s, _ in short}
    for s in sorted(range(1, size), key=auto.len.__getitem__):
        link = auto.link[s]
        if auto.len[s] >= window:
            anchor[s] = s if auto.len[link] < window else anchor[link]
        up[s] = s if s in brief else up[link]
    edges = [(s * v + c, t) for s, out in enumerate(auto.next) for c, t in out.items()]
    edges = np.array(sorted(edges), np.int64).reshape(-1, 2)
    own = np.array(sorted({(anchor[s], of) for s, of in long} | set(short)), np.int64).reshape(-1, 2)
    return {
        "hash": h[order], "word": b"".join(words), "ends": np.cumsum([len(w) for w in words]).astype(np.int64),
        "pairs": np.array(sorted(pairs), np.int64), "edge": edges[:, 0].copy(), "to": edges[:, 1].astype(np.int32),
        "link": np.array(auto.link, np.int32), "len": np.array(auto.len, np.int32), "anchor": np.array(anchor, np.int32),
        "up": np.array(up, np.int32), "own": own[:, 0].copy(), "of": own[:, 1].astype(np.int32),
        "names": list(names), "least": least, "window": window,
    }


class Matcher:
    """Streams word ids through the arrays of ``build``."""

    def __init__(self, auto: dict):
        self.auto, self.words = auto, max(1, len(auto["hash"]))
        view = lambda c: memoryview(np.ascontiguousarray(auto[c]))
        self.edge, self.to, self.link, self.len, self.anchor, self.up, self.own, self.of = map(view, ("edge", "to", "link", "len", "anchor", "up", "own", "of"))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Id of each word by its hash, -1 if no item has it."""
        known = self.auto["hash"]
        if not len(known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at, -1)

    def is_word(self, k: int, word: bytes) -> bool:
        ends = self.auto["ends"]
        return self.auto["word"][int(ends[k - 1]) if k else 0 : int(ends[k])] == word

    def _step(self, state: int, c: int) -> int:
        """The next state, or -1."""
        key = state * self.words + c
        at = bisect_left(self.edge, key)
        return self.to[at] if at < len(self.edge) and self.edge[at] == key else -1

    def _owners(self, state: int, met: set) -> None:
        at = bisect_left(self.own, state)
        while at < len(self.own) and self.own[at] == state:
            met.add(self.of[at])
            at += 1

    def scan(self, ids: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans (first word, last word + 1) of one stretch and the items met."""
        spans, met = [], set()
        state = length = 0
        window, lens, link = self.auto["window"], self.len, self.link
        for i, c in enumerate(ids):
            if c < 0:
                state = length = 0
                continue
            to = self._step(state, c)
            while to < 0 and state:
                state = link[state]
                length = lens[state]
                to = self._step(state, c)
            if to < 0:
                continue
            state, length, reach = to, length + 1, 0
            if length >= window:
                self._owners(self.anchor[state], met)
                reach = window
            s = self.up[state]
            while s > 0:
                if lens[s] <= length:
                    self._owners(s, met)
                    reach = max(reach, lens[s])
                s = self.up[link[s]]
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, {self.auto["names"][k] for k in met}


def _stretches(ids: np.ndarray, doc: np.ndarray, auto: dict) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that may hold a window."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = ids >= 0
    joined = np.zeros(n, bool)  # to the word before
    both = np.flatnonzero(known[1:] & known[:-1] & (doc[1:] == doc[:-1])) + 1
    pairs = auto["pairs"]
    if len(pairs) and len(both):
        code = ids[both - 1] * len(auto["hash"]) + ids[both]
        at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
        joined[both[pairs[at] == code]] = True
    start = np.flatnonzero(known & ~joined)
    stop = np.flatnonzero(known & ~np.append(joined[1:], False)) + 1
    keep = stop - start >= auto["least"]
    return start[keep], stop[keep]


def match_texts(column: pa.Array, matcher: Matcher):
    """For each text: number of words, hit spans in words, items, and hit spans in bytes."""
    data, off = as_bytes(column)
    out = []
    for a, b in slices(off):
        o = off[a : b + 1] - off[a]
        raw = data[off[a] : off[b]]
        t = Tokens(raw, o, "alnum")
        ids = matcher.ids(t.hashes(True))
        start, stop = _stretches(ids, t.doc, matcher.auto)
        found: dict[int, tuple[list, set]] = {}
        for x, y in zip(start.tolist(), stop.tolist()):
            own = [k if matcher.is_word(k, raw[p:q].tobytes().lower()) else -1 for k, p, q in zip(ids[x:y].tolist(), t.start[x:y].tolist(), t.end[x:y].tolist())]
            spans, met = matcher.scan(own)
            if spans:
                k = int(t.doc[x])
                have = found.setdefault(k, ([], set()))
                base = x - int(t.first[k])
                have[0].extend((s + base, e + base) for s, e in spans)
                have[1].update(met)
        counts = t.counts().tolist()
        for k in range(b - a):
            spans, met = found.get(k, ((), ()))
            f = int(t.first[k])
            out.append((counts[k], list(spans), met, [(int(t.start[f + s] - o[k]), int(t.end[f + e - 1] - o[k])) for s, e in spans]))
    return out


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [
    T.StructField("_kv_words", T.LongType()),
    T.StructField("_kv_spans", SPAN),
    T.StructField("_kv_items", T.ArrayType(T.StringType())),
    T.StructField("_kv_bytes", SPAN),
]
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _matcher(sent, text_col: str, names: list[str], hits_only: bool):
    def run(batches):
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(pickle.loads(sent.value))
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            found = match_texts(col(text_col), matcher)
            pack = lambda rows: pa.array([[{"start": s, "end": e} for s, e in _merge(r)] for r in rows], _ARROW_SPAN)
            new = [
                pa.array([f[0] for f in found], pa.int64()),
                pack([f[1] for f in found]),
                pa.array([sorted(set(f[2]) - {None}) for f in found], pa.list_(pa.string())),
                pack([f[3] for f in found]),
            ]
            out = pa.RecordBatch.from_arrays([*(col(c) for c in names), *new], names=[*names, *(f.name for f in FOUND)])
            yield out.filter(pa.array([bool(f[1]) for f in found], pa.bool_())) if hits_only else out

    return run


def _build_block(window: int):
    def run(rows: pa.Table) -> pa.Table:
        items = sorted(zip(rows["_kv_item"].to_pylist(), rows["_kv_text"].to_pylist()), key=lambda r: (r[0] or "", r[1] or ""))
        auto = pickle.dumps(build([(i, item_words(t)) for i, t in items], window))
        return pa.table({"block": rows["_kv_block"].slice(0, 1), "auto": pa.array([auto], pa.binary())})

    return run


def automata(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> tuple[DataFrame, int]:
    """A table (block, auto: the pickled arrays of ``build``), and the number of blocks."""
    items = benchmark.select(F.col(id_col).cast("string").alias("_kv_item"), F.col(text_col).alias("_kv_text"))
    words = items.agg(F.sum(F.regexp_count("_kv_text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).collect()[0][0]
    blocks = max(1, -(-(words or 0) // block_words))
    items = items.withColumn("_kv_block", F.pmod(F.xxhash64("_kv_item", "_kv_text"), F.lit(blocks)).cast("int"))
    return written(items.groupBy("_kv_block").applyInArrow(_build_block(window), "block int, auto binary")), blocks


def _row_key(docs: DataFrame, text_col: str):
    """Equal for rows with equal texts: these have equal hits."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def matched(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None, cut: float | None = None) -> DataFrame:
    """The kept columns with ``_kv_words``, hit spans in words ``_kv_spans`` and in
    bytes ``_kv_bytes``, and the sorted ids of the items met, ``_kv_items``.  With ``cut``, the
    columns of ``docs`` alone: hits are taken out of the texts, and documents of which they
    are ``cut`` percent or more go."""
    spark = docs.sparkSession
    small_batches(spark)
    if taken := [c for c in docs.columns if c.startswith("_kv_")]:
        raise ValueError(f"names beginning with _kv_ are reserved: {taken}")
    keep = docs.columns if keep is None else keep
    names = list(dict.fromkeys([*keep, text_col]))
    table, blocks = automata(benchmark, item_id, item_text, window, block_words)

    def sent_block(block: int):
        auto = table.where(F.col("block") == block).select("auto").collect()  # one block at a time
        return spark.sparkContext.broadcast(bytes(auto[0]["auto"]) if auto else pickle.dumps(build([], window)))

    kind = lambda names: T.StructType([*(docs.schema[c] for c in names), *FOUND])
    if blocks == 1:
        sent = sent_block(0)
        released(table)
        if cut is not None:
            return docs.mapInArrow(_cleaner(sent, text_col, docs.columns, cut), docs.schema)
        out = docs.select(*names).mapInArrow(_matcher(sent, text_col, names, False), kind(names))
        return out.select(*keep, *(f.name for f in FOUND))
    keyed = docs.select(F.col(text_col), _row_key(docs, text_col).alias("_kv_key"))
    hits = None
    for block in range(blocks):
        sent = sent_block(block)
        found = keyed.mapInArrow(_matcher(sent, text_col, [text_col, "_kv_key"], True), T.StructType([docs.schema[text_col], T.StructField("_kv_key", T.BinaryType()), *FOUND]))
        found = written(found.select("_kv_key", *(f.name for f in FOUND)).dropDuplicates(["_kv_key"]))
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    released(table)
    merged = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  # one row for each block at most
    hits = hits.groupBy("_kv_key").agg(merged("_kv_spans"), merged("_kv_items"), merged("_kv_bytes"))
    out = docs.select(*names).withColumn("_kv_key", _row_key(docs, text_col)).join(written(hits), "_kv_key", "left")
    count = F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    none = F.array().cast(SPAN)
    out = out.select(
        *keep,
        count.alias("_kv_words"),
        _united("_kv_spans", none).alias("_kv_spans"),
        F.coalesce(F.array_sort(F.array_distinct("_kv_items")), F.array().cast("array<string>")).alias("_kv_items"),
        _united("_kv_bytes", none).alias("_kv_bytes"),
    )
    if cut is None:
        return out
    out = out.where(~((_n_hit() > 0) & (100 * _n_hit() >= cut * F.col("_kv_words"))))
    return out.select(*docs.columns, "_kv_bytes").mapInArrow(_cut(text_col, docs.columns), docs.schema)


def _united(spans: str, none):
    """Ordered spans, those that meet as one."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def add(acc, x):
        joined = F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))
        return F.when(last(acc)["end"] >= x["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.coalesce(F.aggregate(F.array_sort(spans), none, add), none)


def _n_hit():
    return F.aggregate("_kv_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: words, hit words, items with an occurring window and verdict."""
    m = matched(docs, benchmark, text_col, keep=[id_col], **options)
    m = m.select(id_col, F.col("_kv_words").alias("n_words"), _n_hit().alias("n_hit"), F.size("_kv_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_kv_items"), 256).alias("items_sha256"))
    return m.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(100 // COVERAGE_PERCENT) * F.col("n_hit") >= F.col("n_words")))


def _without(text: str, spans) -> str:
    """The text without (first byte, last byte + 1)."""
    raw, at, parts = text.encode(), 0, []
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]]).decode()


def _cut(text_col: str, names: list[str]):
    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            texts = [_without(t, [(s["start"], s["end"]) for s in spans]) if spans else t for t, spans in zip(col(text_col).to_pylist(), col("_kv_bytes").to_pylist())]
            cols = [pa.array(texts, batch.schema.field(text_col).type) if c == text_col else col(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _cleaner(sent, text_col: str, names: list[str], cut: float):
    """Matching and cutting in one pass."""

    def run(batches):
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(pickle.loads(sent.value))
            col = batch.column(batch.schema.get_field_index(text_col))
            keep, new = [], {}
            for k, (n, spans, _, places) in enumerate(match_texts(col, matcher)):
                hit = sum(e - s for s, e in _merge(spans))
                keep.append(not (hit and 100 * hit >= cut * n))
                if hit and keep[-1]:
                    new[k] = _without(col[k].as_py(), _merge(places))
            if new:
                texts = pa.array([new[k] if k in new else t for k, t in enumerate(col.to_pylist())], col.type)
                batch = batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col), texts)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", coverage_percent: float = COVERAGE_PERCENT, **options) -> DataFrame:
    """Documents without benchmark passages: spans of window length or more are
    cut out of the text; a document of which they cover ``coverage_percent`` or
    more goes as a whole.  Columns are those of ``docs``."""
    return matched(docs, benchmark, text_col, cut=coverage_percent, **options)


def oracle(window: int = WINDOW, coverage_percent: int = COVERAGE_PERCENT) -> str:
    """``contamination`` of the test tables in DuckDB SQL, by joining all windows as texts."""
    upper = "".join(map(chr, range(65, 91)))
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH doc AS (SELECT doc_id, {words} AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
sized AS (SELECT item, w, least({window}, len(w)) AS k FROM item WHERE len(w) > 0),
owned AS (SELECT DISTINCT item, k, array_to_string(w[p:p + k - 1], ' ') AS part FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM sized)),
placed AS (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS part FROM
  (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM doc, (SELECT DISTINCT k FROM owned) WHERE len(w) >= k)),
hit AS (SELECT doc_id, p, k, item FROM placed JOIN owned USING (k, part)),
held AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id),
met AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND {100 // coverage_percent} * n_hit >= len(w), false) AS contaminated
FROM doc LEFT JOIN held USING (doc_id) LEFT JOIN met USING (doc_id)"""
