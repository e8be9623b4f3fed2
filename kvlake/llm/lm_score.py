"""Language-model scoring by cross-entropy difference.

A target and a background bigram model share smoothing and differ in their counts
alone.  The target is counted on the documents labelled good, the background on
all documents.  Each token's loss under either model is
-log((c(h, w) + mu p(w)) / (c(h) + mu)) with p(w) = (c(w) + alpha) / (n + alpha WORDS), WORDS
being a constant of both models (the first word of a text has no h), and a document's
score is the mean of the losses' differences, target less background: the lower, the
closer to the target.

No document is scored by counts that hold it: documents are dealt to two folds by
a hash of their text, and each fold is scored by the other's counts.

Words and pairs of neighbours are counted one by one, by 64-bit hashes, so the tables
grow with what the input holds.  Documents of one fold are dealt by id to blocks of about
``BLOCK_BYTES``.  Each block adds up its own words and pairs first, so a pair that stands
everywhere is one entry for each block, and sends them, sorted and cut by their leading bits,
to as many parts as the input needs.  A part adds up the blocks and answers each with
the other fold's counts in the order of its question; the block then scores its documents.

Scale: texts move once to their blocks; entries move once as hashes with packed counts and
once as packed counts.  The driver sees one row of totals for each fold.  Rows of one id
and fold share a block, those without an id are dealt by text.

Defined results: a token is a run of letters and digits or a run of symbols, A-Z
counting as a-z; a text without tokens, or null, has null losses and score; a document
labelled more than once is a target if any of its labels is; repeated rows count
as often as they stand; without target documents both models are the background;
an empty table gives an empty result.  Other columns are not read.  A text is held whole
by the tasks that read it, at some 100 bytes for each of its words.  Names beginning
with ``_kv_`` are reserved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import Tokens, as_bytes, mix64, slices
from .store import small_batches

WORDS = 1 << 18  # words of the smoothing
MU, ALPHA = 4.0, 0.5
FOLDS = 2
BLOCK_BYTES = 16 << 20  # text of a block
LEAST = 32  # blocks of a fold, whatever the input


def _keys(column: pa.Array):
    """Of each slice: range of texts, tokens, whether a token is the first of its text,
    and its distinct keys with the places of the words and of the pairs in them (the pair
    of a first token is its word)."""
    data, off = as_bytes(column)
    for a, b in slices(off):
        t = Tokens(data[off[a] : off[b]], off[a : b + 1] - off[a], "runs")
        h = t.hashes(True)
        first = np.zeros(len(h), bool)
        first[t.first[:-1][t.counts() > 0]] = True
        before = np.zeros(len(h), np.uint64)
        before[1:] = h[:-1]
        with np.errstate(over="ignore"):
            pair = mix64(h + mix64(before + np.uint64(0x632BE59BD9B4E019)))
        keys, at = np.unique(np.concatenate([h, np.where(first, h, pair)]), return_inverse=True)
        at = at.astype(np.int32)
        yield a, b, t, first, keys, at[: len(h)], at[len(h) :]


def _pack(counts: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(counts.astype("<i8").tobytes(), asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(packed, decompressed_size=8 * n), "<i8")


def _merged(found: list[np.ndarray]) -> np.ndarray:
    """Distinct keys in order; a sort of them all is faster here than a hash table."""
    keys = np.sort(np.concatenate([np.zeros(0, np.uint64), *found]))
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return keys[new]


ASKED = "part int, _kv_block int, fold int, keys binary, target binary, whole binary"
TOLD = "_kv_block int, part int, n int, target binary, whole binary"


def _asker(id_col: str, text_col: str, bits: int):
    """A block's own counts, cut into parts by the leading bits of the keys."""

    def run(key, docs, good):
        if not docs.num_rows:
            return _table(ASKED, [])
        target = pc.fill_null(pc.is_in(docs[id_col], value_set=good["_kv_good"].combine_chunks(), skip_nulls=True), False).to_numpy()
        found, sums = [], []
        for a, b, t, first, keys, word, pair in _keys(docs[text_col]):
            at, of = np.concatenate([word, pair[~first]]), target[a:b][t.doc]
            of = np.concatenate([of, of[~first]])
            found.append(keys)
            sums.append([np.bincount(x, minlength=len(keys)) for x in (at[of], at)])
        table = _merged(found)
        count = np.zeros((2, len(table)), np.int64)
        for keys, own in zip(found, sums):
            count[:, np.searchsorted(table, keys)] += own
        edge = np.searchsorted(table >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        block, fold = key[0].as_py(), docs["_kv_fold"][0].as_py()
        rows = []
        for part, (x, y) in enumerate(zip(edge[:-1], edge[1:])):
            if x < y:
                rows.append((part, block, fold, table[x:y].astype("<u8").tobytes(), _pack(count[0, x:y]), _pack(count[1, x:y])))
        return _table(ASKED, rows)

    return run


def _table(kind: str, rows: list[tuple]) -> pa.Table:
    fields = [x.split() for x in kind.split(", ")]
    types = [pa.int32() if t == "int" else pa.binary() for _, t in fields]
    cols = zip(*rows) if rows else [[]] * len(fields)
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, types)], names=[n for n, _ in fields])


def _answerer(asked: pa.Table) -> pa.Table:
    """To each block that asks: the counts of its keys in the other fold."""
    blocks, folds = asked["_kv_block"].to_pylist(), asked["fold"].to_pylist()
    keys = [np.frombuffer(x.as_py(), "<u8") for x in asked["keys"]]
    table = _merged(keys)
    count = np.zeros((FOLDS, 2, len(table)), np.int64)
    places = [np.searchsorted(table, x) for x in keys]
    for f, at, target, whole in zip(folds, places, asked["target"], asked["whole"]):
        count[f, 0, at] += _unpack(target.as_py(), len(at))
        count[f, 1, at] += _unpack(whole.as_py(), len(at))
    part = asked["part"][0].as_py()
    return _table(TOLD, [(b, part, len(at), *(_pack(count[1 - f, k, at]) for k in (0, 1))) for b, f, at in zip(blocks, folds, places)])


def _scorer(id_col: str, text_col: str, total: list[list[int]]):
    """``total``: tokens of the target and of all documents, by fold."""

    def run(docs, told):
        n = docs.num_rows
        slices_ = list(_keys(docs[text_col])) if n else []
        table = _merged([x[4] for x in slices_])
        told = told.sort_by("part")
        sizes = told["n"].to_pylist()
        if sum(sizes) != len(table):
            raise ValueError(f"a block of {len(table)} keys was told {sum(sizes)} counts")
        count = [np.concatenate([np.zeros(0, np.int64), *(_unpack(x.as_py(), m) for x, m in zip(told[c], sizes))]) for c in ("target", "whole")]
        sums = total
        if not any(t for t, _ in total):
            count[0], sums = count[1], [[n, n] for _, n in total]
        counts, loss = np.zeros(n, np.int64), np.full((2, n), np.nan)
        for a, b, t, first, keys, word, pair in slices_:
            counts[a:b] = t.counts()
            some, at = counts[a:b] > 0, np.searchsorted(table, keys)
            other = sums[1 - docs["_kv_fold"][0].as_py()]
            for k in (0, 1):
                c = count[k][at].astype(np.float64)
                share = (c[word] + ALPHA) / (other[k] + ALPHA * WORDS)
                ch = np.zeros(len(word))
                ch[1:] = c[word[:-1]]
                ch[first] = 0  # the first word of a text is left to its own share
                cp = np.where(first, 0, c[pair])
                so_far = np.r_[0.0, np.cumsum(-np.log((cp + MU * share) / (ch + MU)))]
                loss[k, a:b][some] = (so_far[t.first[1:]] - so_far[t.first[:-1]])[some] / counts[a:b][some]
        none = counts == 0
        values = [pa.array(v, pa.float64(), mask=none) for v in (loss[0], loss[1], loss[0] - loss[1])]
        return pa.table([docs[id_col], pa.array(counts), *values], names=[id_col, "n_tokens", "target_loss", "background_loss", "ce_difference"])

    return run


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    fold = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(FOLDS)).cast("int")
    return docs.select(F.col(id_col), F.col(text_col), fold.alias("_kv_fold"))


def _measurer(id_col: str, text_col: str):
    """Tokens and bytes of each document."""

    def run(batches):
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731,B023
            data, off = as_bytes(col(text_col))
            n = [Tokens(data[off[a] : off[b]], off[a : b + 1] - off[a], "runs").counts() for a, b in slices(off)]
            n = np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([col(id_col), col("_kv_fold"), pa.array(n), pa.array(np.diff(off))], names=[id_col, "_kv_fold", "_kv_n", "_kv_bytes"])

    return run


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: id, n_tokens, target_loss, background_loss (nats a token)
    and ce_difference."""
    small_batches(docs.sparkSession)
    of_id = docs.schema[id_col]
    good = labels.where(F.col(label) == 1).select(F.col(id_col).try_cast(of_id.dataType).alias("_kv_good")).where("_kv_good is not null").distinct()
    rows = _dealt(docs, id_col, text_col)

    kind = T.StructType([of_id, T.StructField("_kv_fold", T.IntegerType()), T.StructField("_kv_n", T.LongType()), T.StructField("_kv_bytes", T.LongType())])
    slim = rows.mapInArrow(_measurer(id_col, text_col), kind)
    # a merge join at every size: the labels grow with the input
    slim = slim.join(good.hint("merge"), slim[id_col] == good["_kv_good"], "left")
    total, most = [[0, 0] for _ in range(FOLDS)], 0
    for r in slim.groupBy("_kv_fold").agg(F.sum(F.when(F.col("_kv_good").isNotNull(), F.col("_kv_n"))).alias("t"), F.sum("_kv_n").alias("n"), F.sum("_kv_bytes").alias("b")).collect():
        total[r["_kv_fold"]], most = [r["t"] or 0, r["n"]], max(most, r["b"])

    blocks = max(LEAST, -(-most // BLOCK_BYTES))
    bits = (FOLDS * blocks - 1).bit_length()
    to = lambda h, fold: (F.pmod(h, F.lit(blocks)) * FOLDS + fold).cast("int").alias("_kv_block")
    by = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    dealt = rows.select("*", to(by, F.col("_kv_fold")))
    fold = F.explode(F.array(*(F.lit(f) for f in range(FOLDS)))).alias("_kv_of")
    good = good.select("_kv_good", fold).select("_kv_good", to(F.xxhash64("_kv_good"), F.col("_kv_of")))
    asked = dealt.groupBy("_kv_block").cogroup(good.groupBy("_kv_block")).applyInArrow(_asker(id_col, text_col, bits), ASKED)
    told = asked.groupBy("part").applyInArrow(_answerer, TOLD)
    kind = T.StructType([of_id, T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "ce_difference"))])
    return dealt.groupBy("_kv_block").cogroup(told.groupBy("_kv_block")).applyInArrow(_scorer(id_col, text_col, total), kind)
