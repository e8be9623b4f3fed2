"""Latency statistics over logarithmic buckets.

Percentiles are those of the buckets: the upper bound of the first bucket that the
rank reaches, held inside the least and the largest value seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import log_bucket

PERCENTILES = (50, 95, 99)


def buckets(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or []), log_bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("c"))


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, population deviation, least, most and percentiles of each group.
    One pass over the rows counts the buckets (at most 128 a group); a second, with
    partial sums, the moments."""
    by = by or []
    v = F.col(value)
    moments = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.min(v).alias("least"), F.max(v).alias("most"))
    w = Window.partitionBy(*by).orderBy("bucket")
    upto = buckets(rows.where(v.isNotNull()), value, by).withColumn("upto", F.sum("c").over(w))
    counted = upto.withColumn("total", F.sum("c").over(Window.partitionBy(*by)))
    first = [F.min(F.when(F.col("upto") >= F.floor((F.col("total") * p + 99) / 100), F.col("bucket"))).alias(f"b{p}") for p in PERCENTILES]
    edges = counted.groupBy(*by).agg(*first)
    both = moments.join(edges, by) if by else moments.join(F.broadcast(edges))
    bound = lambda p: F.least(F.greatest(F.when(F.col(f"b{p}") == 0, 1.0).otherwise(F.pow(F.lit(2.0), F.col(f"b{p}") / 4)), F.col("least")), F.col("most"))
    return both.select(*by, "n", "mean", "deviation", "least", "most", *(bound(p).alias(f"p{p}") for p in PERCENTILES))
