"""Packing into optimal length buckets.

The lengths of all pieces (a text beyond ``max_len`` tokens is split losslessly)
form one global histogram of at most ``max_len`` lengths, whatever the input.
Dynamic programming over it chooses the ``buckets`` boundaries with the least
padding.  Inside a bucket, each batch takes as many pieces as fit the token
budget.

A bucket is dealt to shards of about ``shard_rows`` pieces by a hash of the id, and
rows repeated more often than that by their place in the table, so no task holds a whole
bucket or a whole group of copies; each shard ends with at most one batch that is not
full.  Only the histogram reaches the driver.

A token is a run of characters other than ASCII white space, or any expression
given as ``tokens``.  Defined results: a text without tokens, or null, has one piece
of length 0 with bucket 0 and no batch; repeated rows are pieces of their own; ids may be
null; an empty table gives an empty result.  A text of any length becomes pieces of
``max_len``.  Columns other than the id are not carried along; an id column with the name
of a result column is refused.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

MAX_LEN = 2048
BUCKETS = 16
BATCH_TOKENS = 32_768
SHARD_ROWS = 16_384
RESULT = ("piece", "n_tokens", "bucket", "shard", "batch", "slot")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def best_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    ``cost[j]`` is the least padding of the j smallest lengths; a bucket of the
    lengths i..j-1 pads each to the largest of them.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v and k > 0), np.int64)
    u = len(lengths)
    if not u:
        return []
    n = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    count, total = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * lengths)]
    cost = np.r_[0.0, np.full(u, np.inf)]
    choice = []
    for _ in range(min(buckets, u)):
        new, pick = np.full(u + 1, np.inf), np.zeros(u + 1, np.int64)
        new[0] = 0
        for j in range(1, u + 1):
            c = cost[:j] + lengths[j - 1] * (count[j] - count[:j]) - (total[j] - total[:j])
            pick[j] = i = int(np.argmin(c))
            new[j] = c[i]
        cost = new
        choice.append(pick)
    out, j = [], u
    for pick in reversed(choice):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(pick[j])
    return out[::-1]


def padding(histogram: dict[int, int], bounds: list[int]) -> int:
    """Padding tokens of a histogram under these bounds."""
    return sum(v * (min(b for b in bounds if b >= k) - k) for k, v in histogram.items() if k > 0)


def pieces(docs: DataFrame, id_col: str, tokens: Column, max_len: int) -> DataFrame:
    """(id, piece, n_tokens); all pieces of a text but the last are of full length."""
    n = F.col("_kv_n")
    last = F.greatest(F.ceil(n / max_len) - 1, F.lit(0)).cast("int")
    return (
        docs.select(F.col(id_col), tokens.cast("long").alias("_kv_n"))
        .select(id_col, "_kv_n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
        .select(id_col, "piece", F.least(F.lit(max_len), n - F.col("piece").cast("long") * max_len).cast("long").alias("n_tokens"))
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, max_len: int = MAX_LEN, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each piece: id, piece, n_tokens, bucket (the padded length),
    shard, batch (number inside bucket and shard) and slot inside the batch."""
    if id_col in RESULT or id_col.startswith("_kv_"):
        raise ValueError(f"{id_col} is a column of the result; rename the id")
    if batch_tokens < max_len:
        raise ValueError("a batch must hold a piece of full length")
    tokens = word_count(F.col(text_col)) if tokens is None else tokens
    rows = written(pieces(docs, id_col, tokens, max_len))
    histogram = {r["n_tokens"]: r["count"] for r in rows.groupBy("n_tokens").count().collect()}
    bounds = best_boundaries(histogram, buckets)
    bucket, shards, lower = F.lit(0), F.lit(1), 0
    for b in bounds:
        held = sum(v for k, v in histogram.items() if lower < k <= b)
        inside = (F.col("n_tokens") > lower) & (F.col("n_tokens") <= b)
        bucket = F.when(inside, b).otherwise(bucket)
        shards = F.when(inside, -(-held // shard_rows)).otherwise(shards)
        lower = b
    rows = rows.withColumn("bucket", bucket.cast("long"))
    salt = F.lit(0).cast("long")
    hot = written(rows.groupBy(id_col, "piece").count().where(F.col("count") > shard_rows).select(F.col(id_col).alias("_kv_id"), F.col("piece").alias("_kv_piece")))
    if not hot.isEmpty():  # repeated rows are alike, so they may be dealt by their place in the table
        rows = rows.withColumn("_kv_at", F.monotonically_increasing_id())
        rows = rows.join(hot, F.col(id_col).eqNullSafe(F.col("_kv_id")) & (F.col("piece") == F.col("_kv_piece")), "left")
        salt = F.when(F.col("_kv_piece").isNotNull(), F.col("_kv_at")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col(id_col), F.col("piece"), salt), shards.cast("long")))
    order = Window.partitionBy("bucket", "shard").orderBy(F.xxhash64(id_col, "piece", F.lit(1)), id_col, "piece", "n_tokens")
    rows = rows.withColumn("_kv_k", F.row_number().over(order).cast("long") - 1)
    size = F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket"), F.lit(1)))
    real = F.col("bucket") > 0
    return rows.select(
        id_col, F.col("piece").cast("long").alias("piece"), "n_tokens", "bucket", "shard",
        F.when(real, F.floor(F.col("_kv_k") / size)).alias("batch"),
        F.when(real, F.col("_kv_k") % size).alias("slot"),
    )
