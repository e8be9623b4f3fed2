"""Token matrices: best-fit-decreasing packing of token ids.

Texts are tokenised, pieces longer than a row are split losslessly into full rows
and a rest, and the pieces of a block are placed longest first, each into the row
with the least room that still holds it.  A segment tree over room sizes finds that
row in logarithmic time.  A row is ``row_tokens`` little-endian ids (``uint16`` if
the vocabulary allows, else ``uint32``), padded at its end, with the cumulative
lengths of its segments and the places where positions start again.

A block is what one task has read, up to ``block_tokens`` tokens; blocks are packed
on their own, so there is no shuffle, memory is bounded and a lost task is redone
from its input split alone.  At most the last rows of a block are partly empty.

Defined results: a null or empty text is one segment of no tokens; repeated rows
are packed one by one, equal lengths in the order they were read; a text of any length
becomes as many rows as it needs; an empty table gives an empty result; ids are integers or
null; columns other than id and text are not read.

The tokenizer is a parameter: a file of ranks (base64 token and number a line) and the
pattern that cuts texts before them.  ``TOKENIZER`` is where the vocabularies of public
tokenizers lie here; the driver reads the file once and broadcasts it (half a megabyte),
and a missing file is an error before anything runs.
"""

from __future__ import annotations

import base64
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches

ROW_TOKENS = 2048
BLOCK_TOKENS = 4_000_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = "|".join([r"'(?:s|t|re|ve|m|ll|d)", r" ?\p{L}+", r" ?\p{N}+", r" ?[^\s\p{L}\p{N}]+", r"\s+(?!\S)", r"\s+"])
PAD = 0


class RoomTree:
    """Rows by room: a segment tree over 0..size counts the rows with each room."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        k = room + self.leaves
        while k:
            self.count[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, row) with the smallest room of at least ``least``."""
        k, count = least + self.leaves, self.count
        if not count[k]:
            while True:  # up to the first right sibling that holds a row
                if k == 1:
                    return None
                if not k & 1 and count[k + 1]:
                    k += 1
                    break
                k >>= 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        room = k - self.leaves
        while k:
            count[k] -= 1
            k >>= 1
        return room, self.rows[room].pop()


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Indices of the pieces of each row; pieces are no longer than ``size``."""
    tree, rows = RoomTree(size), []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[k])
        if found is None:
            found = size, len(rows)
            rows.append([])
        rows[found[1]].append(k)
        tree.add(found[0] - lengths[k], found[1])
    return rows


def _encoder(ranks: bytes, pattern: str):
    """The tokenizer; built once in a Python worker and kept in a module there."""
    import hashlib

    import tiktoken

    store = sys.modules.setdefault("_kvlake_tokenizers", types.ModuleType("_kvlake_tokenizers"))
    key = hashlib.blake2b(ranks + pattern.encode()).hexdigest()
    if not hasattr(store, key):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        setattr(store, key, tiktoken.Encoding("packed", pat_str=pattern, mergeable_ranks=table, special_tokens={}))
    return getattr(store, key)


def pack_block(pieces: list[tuple], size: int, kind: np.dtype) -> list[tuple]:
    """Rows (ids, cumulative lengths, tokens, ids of documents, numbers of pieces) of
    a block of (document, piece, tokens)."""
    out = []
    for row in best_fit([len(p[2]) for p in pieces], size):
        ids = np.full(size, PAD, kind)
        ends = np.cumsum([0, *(len(pieces[k][2]) for k in row)])
        for k, a, b in zip(row, ends, ends[1:]):
            ids[a:b] = pieces[k][2]
        out.append((ids.tobytes(), ends.tolist(), int(ends[-1]), [pieces[k][0] for k in row], [pieces[k][1] for k in row]))
    return out


ROWS = T.StructType([
    T.StructField("block", T.StringType()),
    T.StructField("row", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("pieces", T.ArrayType(T.LongType())),
    T.StructField("cu_seqlens", T.ArrayType(T.LongType())),
    T.StructField("position_resets", T.ArrayType(T.LongType())),
    T.StructField("ids", T.BinaryType()),
])


def _packer(sent, pattern: str, size: int, block_tokens: int, id_col: str, text_col: str):
    def run(batches):
        from pyspark import TaskContext

        ranks = sent.value
        encode = _encoder(ranks, pattern).encode_ordinary
        kind = np.dtype("<u2" if ranks.count(b"\n") < 65_535 else "<u4")
        task, block = TaskContext.get().partitionId(), 0
        pieces, held = [], 0

        def flush():
            rows = pack_block(pieces, size, kind)
            for a in range(0, len(rows), 512):
                part = rows[a : a + 512]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{task}-{block}"] * len(part)),
                    pa.array(range(a, a + len(part)), pa.int64()),
                    pa.array([r[2] for r in part], pa.int64()),
                    pa.array([r[3] for r in part], longs),
                    pa.array([r[4] for r in part], longs),
                    pa.array([r[1] for r in part], longs),
                    pa.array([r[1][:-1] for r in part], longs),
                    pa.array([r[0] for r in part], pa.binary()),
                ], names=ROWS.names)

        for batch in batches:
            names = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
            for doc, text in zip(names, batch.column(batch.schema.get_field_index(text_col))):
                ids = np.array(encode(text.as_py() or ""), kind)
                for n, a in enumerate(range(0, max(1, len(ids)), size)):
                    pieces.append((doc, n, ids[a : a + size]))
                held += len(ids)
                if held >= block_tokens:
                    yield from flush()
                    pieces, held, block = [], 0, block + 1
        if pieces:
            yield from flush()

    return run


def token_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN, row_tokens: int = ROW_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Packed rows.  ``tokenizer`` is a file of ranks, which the driver reads and
    sends to the executors; ids of documents must be integers."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # one file of about a megabyte
    need = docs.select(F.col(id_col).cast("long").alias(id_col), text_col)
    return need.mapInArrow(_packer(sent, pattern, row_tokens, block_tokens, id_col, text_col), ROWS)


def segments(rows: DataFrame, row_tokens: int = ROW_TOKENS) -> DataFrame:
    """(doc_id, piece, n_tokens, ids) of every segment, read back from packed rows."""
    width = (F.length("ids") / row_tokens).cast("long")
    one = rows.select("*", F.posexplode("doc_ids").alias("k", "doc_id"))
    start = F.get("cu_seqlens", F.col("k"))
    n = F.get("cu_seqlens", F.col("k") + 1) - start
    ids = F.substring("ids", (start * width + 1).cast("int"), (n * width).cast("int"))
    return one.select("doc_id", F.get("pieces", F.col("k")).alias("piece"), n.alias("n_tokens"), ids.alias("ids"))


def write_matrix(rows: DataFrame, path: str) -> None:
    """One Parquet file a task: ids as fixed-length binary rows beside their
    segment lengths and position resets."""
    rows.write.parquet(path)
