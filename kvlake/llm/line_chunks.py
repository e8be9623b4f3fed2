"""Line de-duplication by content-defined chunks of lines and by runs of 50 words.

Every line is hashed, and a rolling hash over the last two line hashes chooses
where a chunk of lines ends, so an insertion above a passage moves no boundary
inside it.  A chunk has at least ``MIN_LINES`` and at most ``MAX_LINES`` lines; a line of
``LONG_WORDS`` words or more is a chunk of its own.  Chunks of several lines with
words, and such long lines, that occur again anywhere, in other documents or in the
same one, are removed except for their first occurrence (smallest document id,
then place).  Equal hashes (128 bits) only propose; the bytes of all occurrences
are compared, and where any differ, nothing of that hash is removed.

The cuts depend on neighbouring lines, so chunks alone (``passages=False``) leave most
short passages in place.  With ``passages`` every shortest run of lines that reaches
``LONG_WORDS`` words, forwards from each line with words and backwards from each, is
proposed and compared too.  These runs cover every line with words of every passage of
that many words, whatever stands around it, so all later copies go, line by line.  A run
that overlaps its own first occurrence stays; lines without words between two removed
lines go with them.

Scale: the first pass shuffles hashes alone; per-hash counts and first places are
added up before the shuffle, so a chunk that a third of all documents share is one
row for each task.  The texts move twice, once to be compared and once to be
rewritten, each time dealt by a key of their own; these two joins are merge joins at
every size, since the lists that they bring to the texts grow with the input.

Defined results: a null text stays null; rows with equal id and text are one
document, so both keep the same chunks; a null id comes after all others; a text
that loses all of its lines is empty; an empty table gives an empty result.  Without
passages a short line that repeats alone between changing neighbours goes only where the
cuts fall so.  Other columns pass through.  Names beginning with ``_kv_`` are reserved.
A text is held whole by the task that reads it, at some 60 bytes for each of its words
and lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Tokens, as_bytes, mix64, slices, span_hashes
from .store import released, small_batches, written

MIN_LINES, MAX_LINES = 2, 8
DIVISOR = 2  # a chunk ends at one of so many lines, on average
LONG_WORDS = 50


def _cut(roll: list[int], long: list[bool]) -> list[tuple[int, int]]:
    """Chunks (first line, last line + 1) of one text."""
    out, start = [], 0
    for k, (r, is_long) in enumerate(zip(roll, long)):
        if is_long:
            if start < k:
                out.append((start, k))
            out.append((k, k + 1))
            start = k + 1
        elif k + 1 - start >= MAX_LINES or k + 1 - start >= MIN_LINES and r % DIVISOR == 0:
            out.append((start, k + 1))
            start = k + 1
    if start < len(roll):
        out.append((start, len(roll)))
    return out


def _runs(words: list[int]) -> set[tuple[int, int]]:
    """Runs of lines (first, last + 1) that reach LONG_WORDS words and would not without
    their first line, or without their last; both of these have words."""
    at = [k for k, w in enumerate(words) if w]
    out: set[tuple[int, int]] = set()
    for step in (1, -1):
        order, total, x = at[::step], 0, 0
        for k in order:
            total += words[k]
            while total - words[order[x]] >= LONG_WORDS:
                total -= words[order[x]]
                x += 1
            if total >= LONG_WORDS:
                out.add((min(order[x], k), max(order[x], k) + 1))
    return out


def _scan(column: pa.Array):
    """Of each text: its bytes, line starts and ends, words of each line and chunks."""
    data, off = as_bytes(column)
    for a, b in slices(off):
        o = off[a : b + 1] - off[a]
        d = data[off[a] : off[b]]
        t = Tokens(d, o, "space")
        feed = np.flatnonzero(d == 10)
        # every text has one line more than it has line feeds
        at = np.searchsorted(feed, o)
        first = at + np.arange(b - a + 1)
        start = np.empty(first[-1], np.int64)
        start[first[:-1]] = o[:-1]
        start[np.arange(len(feed)) + np.repeat(np.arange(1, b - a + 1), np.diff(at))] = feed + 1
        end = np.append(start[1:] - 1, len(d))
        end[first[1:] - 1] = o[1:]
        words = np.searchsorted(t.start, end) - np.searchsorted(t.start, start)
        h = span_hashes(d, start, end, False)
        before = np.zeros(len(h), np.uint64)
        before[1:] = h[:-1]
        before[first[:-1]] = 0
        with np.errstate(over="ignore"):
            roll = (mix64(before * np.uint64(0x9E3779B97F4A7C15) + h) >> np.uint64(33)).tolist()
        long, words, raw = (words >= LONG_WORDS).tolist(), words.tolist(), d.tobytes()
        starts, ends = start.tolist(), end.tolist()
        for k in range(b - a):
            x, y = int(first[k]), int(first[k + 1])
            chunks = []
            for p, q in _cut(roll[x:y], long[x:y]):
                w = words[x + p : x + q]
                chunks.append((p, q, sum(v > 0 for v in w) >= MIN_LINES or w[0] >= LONG_WORDS))
            yield raw, starts[x:y], ends[x:y], words[x:y], chunks


def chunk_texts(column: pa.Array):
    """Of each text: its bytes, line starts and ends, and its chunks as (first line,
    last line + 1, whether it may be removed)."""
    for raw, start, end, _, chunks in _scan(column):
        yield raw, start, end, chunks


def span_texts(column: pa.Array, passages: bool):
    """Of each text: its bytes, line starts and ends, words of each line, and the spans of
    lines (first, last + 1) that are removed where they repeat."""
    for raw, start, end, words, chunks in _scan(column):
        spans = {(p, q) for p, q, may in chunks if may}
        yield raw, start, end, words, sorted(spans | _runs(words) if passages else spans)


def _key(id_col: str, text_col: str):
    return F.unhex(F.md5(F.concat_ws("\x01", F.coalesce(F.col(id_col).cast("string"), F.lit("\x02")), F.coalesce(F.col(text_col), F.lit("\x02")))))


SPAN = T.StructType([T.StructField("_kv_from", T.IntegerType()), T.StructField("_kv_to", T.IntegerType()), T.StructField("_kv_hash", T.BinaryType())])
SENT_BYTES = 8 << 20  # spans of a text overlap: their bytes leave in batches of about this size


def _proposer(text_col: str, names: list[str], passages: bool):
    def run(batches):
        for batch in batches:
            row, first, last, digest = [], [], [], []

            def out():
                cols = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row, pa.int64())) for c in names]  # noqa: B023
                arrays = [*cols, pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(digest, pa.binary())]  # noqa: B023
                return pa.RecordBatch.from_arrays(arrays, names=[*names, "_kv_from", "_kv_to", "_kv_hash"])

            for k, (raw, start, end, _, spans) in enumerate(span_texts(batch.column(batch.schema.get_field_index(text_col)), passages)):
                for p, q in spans:
                    row.append(k)
                    first.append(p)
                    last.append(q)
                    digest.append(xxhash.xxh3_128_digest(raw[start[p] : end[q - 1]]))
                    if len(row) >= SENT_BYTES >> 7:
                        yield out()
                        row, first, last, digest = [], [], [], []
            yield out()

    return run


def _teller(text_col: str):
    """(hash, bytes) of the spans that are listed in ``_kv_list``."""

    def run(batches):
        for batch in batches:
            digest, content, held = [], [], 0
            out = lambda: pa.RecordBatch.from_arrays([pa.array(digest, pa.binary()), pa.array(content, pa.binary())], names=["hash", "content"])  # noqa: E731,B023
            listed = batch.column(batch.schema.get_field_index("_kv_list"))
            for k, (raw, start, end, _, _) in enumerate(_scan(batch.column(batch.schema.get_field_index(text_col)))):
                for x in listed[k].as_py():
                    digest.append(x["hash"])
                    content.append(raw[start[x["from"]] : end[x["to"] - 1]])
                    held += len(content[-1])
                    if held >= SENT_BYTES:
                        yield out()
                        digest, content, held = [], [], 0
            yield out()

    return run


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """(``_kv_key``, ``_kv_drop``): of each document that loses any, the spans of lines
    that it loses."""
    small_batches(docs.sparkSession)
    slim = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).withColumn("_kv_key", _key(id_col, text_col))
    kind = T.StructType([docs.schema[id_col], T.StructField("_kv_key", T.BinaryType()), *SPAN])
    spans = written(slim.mapInArrow(_proposer(text_col, [id_col, "_kv_key"], passages), kind))
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_kv_key").alias("key"), F.col("_kv_from").alias("from"), F.col("_kv_to").alias("to"))
    # written, so that the join reads plain exchanges and a hash of many documents can be split
    again = written(spans.groupBy("_kv_hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    # the first occurrence stays, and so does what overlaps it
    stays = (F.col("_kv_key") == F.col("first.key")) & (F.col("_kv_from") < F.col("first.to"))
    found = spans.join(again, "_kv_hash").select("_kv_key", "_kv_from", "_kv_to", "_kv_hash", stays.alias("_kv_first")).distinct()
    found = written(found)

    own = found.groupBy("_kv_key").agg(F.collect_list(F.struct(F.col("_kv_from").alias("from"), F.col("_kv_to").alias("to"), F.col("_kv_hash").alias("hash"))).alias("_kv_list"))
    told = slim.select("_kv_key", text_col).join(own.hint("merge"), "_kv_key").select(text_col, "_kv_list").mapInArrow(_teller(text_col), "hash binary, content binary")
    unlike = told.groupBy("hash").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo <> hi")
    unlike = written(unlike.select("hash"))
    gone = found.where("not _kv_first").join(unlike, F.col("_kv_hash") == F.col("hash"), "left_anti")
    out = written(gone.groupBy("_kv_key").agg(F.collect_list(F.struct(F.col("_kv_from").alias("from"), F.col("_kv_to").alias("to"))).alias("_kv_drop")))
    released(spans, again, found, unlike)
    return out


def _lost(words: list[int], drop: list[dict], passages: bool) -> list[tuple[int, int]]:
    """Ranges of removed lines, in order and apart."""
    out: list[list[int]] = []
    for p, q in sorted((x["from"], x["to"]) for x in drop):
        if out and (p <= out[-1][1] or passages and not any(words[out[-1][1] : p])):
            out[-1][1] = max(q, out[-1][1])
        else:
            out.append([p, q])
    return [(p, q) for p, q in out]


def _rewriter(text_col: str, names: list[str], passages: bool):
    def run(batches):
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text_col))
            texts, gone = [], []
            drops = batch.column(batch.schema.get_field_index("_kv_drop")).to_pylist()
            for k, ((raw, start, end, words, _), drop) in enumerate(zip(_scan(col), drops)):
                lost = _lost(words, drop or [], passages)
                gone.append([{"start": p, "end": q} for p, q in lost])
                if lost:
                    out = {x for p, q in lost for x in range(p, q)}
                    texts.append(b"\n".join(raw[start[x] : end[x]] for x in range(len(start)) if x not in out).decode())
                else:
                    texts.append(col[k].as_py())
            cols = [pa.array(texts, col.type) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in names]
            spans = pa.array(gone, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*cols, spans], names=[*names, "_kv_gone"])

    return run


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """The documents without repeated chunks (with ``passages`` also without repeated passages), and ``_kv_gone``: the removed lines as
    (first, last + 1), counted from 0 in the old text."""
    drop = repeated(docs, id_col, text_col, passages)
    names = list(docs.columns)
    both = docs.withColumn("_kv_key", _key(id_col, text_col)).join(drop.hint("merge"), "_kv_key", "left").select(*names, "_kv_drop")
    return both.mapInArrow(_rewriter(text_col, names, passages), T.StructType([*docs.schema.fields, T.StructField("_kv_gone", SPANS)]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """The documents without repeated chunks (with ``passages`` also without repeated passages), with the columns of ``docs``."""
    return rewritten(docs, id_col, text_col, passages).select(*docs.columns)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """One row per document: id, lines before, lines removed, the removed ranges, and
    the digest of what is left."""
    out = rewritten(docs.select(id_col, text_col, F.regexp_count(text_col, F.lit("\n")).alias("_kv_feeds")), id_col, text_col, passages)
    removed = F.aggregate("_kv_gone", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(
        id_col,
        F.coalesce(F.col("_kv_feeds") + 1, F.lit(0)).cast("long").alias("n_lines"),
        removed.alias("n_removed"),
        F.concat_ws(",", F.transform("_kv_gone", lambda x: F.concat_ws("-", x["start"].cast("string"), (x["end"] - 1).cast("string")))).alias("removed"),
        F.length(text_col).cast("long").alias("n_chars"),
        F.sha2(F.col(text_col), 256).alias("text_sha256"),
    )
