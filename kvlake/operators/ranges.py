"""Ordered operations that stay distributed: global numbering, lower bounds and
interval joins, all by dealing keys to ranges with fixed boundaries.

The number of ranges follows the data: ``RANGE_ROWS`` rows each, or ``RANGE_INTERVALS``
intervals for joins with intervals, in which a row meets all intervals of its range.
The boundaries come from the keys with the smallest hashes, so they do not depend on
partitioning, and the range of a key is a plain expression: every pass over the data
gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_ROWS, RANGE_INTERVALS = 1 << 18, 64
MOST, PER_RANGE = 4096, 16  # ranges; sampled keys for each
UNROLLED = 64


def split_points(df: DataFrame, key: str, ranges: int | None = None, rows: int = RANGE_ROWS) -> list:
    """At most ``ranges`` - 1 keys that cut the data into like parts; without ``ranges``, into
    parts of about ``rows`` rows, ``MOST`` at most.  One scan counts, one takes keys by hash."""
    some = df.select(F.col(key).alias("k")).where("k is not null")
    total, keys = some.agg(F.count("*"), F.approx_count_distinct("k")).first()
    if ranges is None:
        ranges = min(MOST, -(-total // rows))
    if ranges <= 1 or not keys:
        return []
    share = min(1.0, 2 * ranges * PER_RANGE / keys)
    place = F.xxhash64("k")
    some = some.where(place.cast("double") <= (2 * share - 1) * 2.0**63).distinct().orderBy(place, "k").limit(ranges * PER_RANGE)
    points = sorted(r["k"] for r in some.collect())
    step = max(1, len(points) // ranges)
    return points[step::step][: ranges - 1]


def range_of(key: Column, points: list) -> Column:
    """Number of split points that are not above the key: a binary search unrolled, down to
    blocks of points that are counted through."""
    block = -(-max(1, len(points)) // UNROLLED)
    blocks = [points[k : k + block] for k in range(0, len(points), block)]

    def inside(k: int) -> Column:
        rest = blocks[k][1:]
        if not rest:
            return F.lit(k * block + 1)
        return F.lit(k * block + 1) + F.size(F.filter(F.array(*map(F.lit, rest)), lambda p: p <= key))

    def search(a: int, b: int) -> Column:
        """The key is not below the first points of the blocks before ``a``, and below those from ``b`` on."""
        if a == b:
            return inside(a - 1) if a else F.lit(0)
        m = (a + b) // 2
        return F.when(key >= F.lit(blocks[m][0]), search(m + 1, b)).otherwise(search(a, m))

    return search(0, len(blocks))


def global_index(df: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Adds ``idx`` (place in key order, from 0) and ``prev`` (the key before).  Each
    range is numbered on its own; a row for each range carries the offset."""
    points = split_points(df, key, ranges)
    rows = df.withColumn("_range", range_of(F.col(key), points))
    # a row for each range from here to the join
    per = rows.groupBy("_range").agg(F.count("*").alias("n"), F.max(key).alias("top"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"), F.max("top").over(before).alias("_top"))
    inside = Window.partitionBy("_range").orderBy(key)
    out = rows.withColumn("_rn", F.row_number().over(inside)).withColumn("_lag", F.lag(key).over(inside)).join(F.broadcast(per), "_range")
    return out.withColumn("idx", F.col("_offset") + F.col("_rn") - 1).withColumn("prev", F.coalesce("_lag", "_top")).drop("_range", "_rn", "_lag", "_offset", "_top")


def lower_bound(targets: DataFrame, key: str, stored: DataFrame, stored_key: str, by: list[str] | None = None, ranges: int | None = None) -> DataFrame:
    """For each target the smallest stored key that is not below it, as ``found``; with
    ``by``, one answer for each combination of these stored columns.

    Targets and stored keys of one range meet in one sort; a target above all stored
    keys of its range takes the first key of the next range that has one.
    """
    by = by or []
    points = split_points(stored, stored_key, ranges)
    groups = stored.select(*by).distinct() if by else None
    t = targets.select(F.col(key).alias("k")).distinct().withColumn("_range", range_of(F.col("k"), points))
    s = stored.select(*by, F.col(stored_key).alias("k")).withColumn("_range", range_of(F.col("k"), points))
    asked = t.join(F.broadcast(groups)) if by else t  # a row for each group, of which there are a handful (levels)
    both = asked.select(*by, "_range", "k", F.lit(1).alias("ask")).unionByName(s.select(*by, "_range", "k", F.lit(0).alias("ask")))
    down = Window.partitionBy(*by, "_range").orderBy(F.desc("k"), "ask").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_own", F.last(F.when(F.col("ask") == 0, F.col("k")), ignorenulls=True).over(down)).where("ask = 1")
    first = s.groupBy(*by, "_range").agg(F.min("k").alias("low"))
    names = [f"_{b}" for b in by]
    grid = first.select(*(F.col(b).alias(n) for b, n in zip(by, names)), F.col("_range").alias("_r"), "low")
    later = grid.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_r", "low"))).alias("_firsts"))  # a row for each range, MOST at most
    if by:
        cond = F.lit(True)
        for b, n in zip(by, names):
            cond = cond & (F.col(b) == F.col(n))
        both = both.join(F.broadcast(later), cond, "left")
    else:
        both = both.join(F.broadcast(later))
    nxt = F.get(F.filter("_firsts", lambda x: x["_r"] > F.col("_range")), F.lit(0))["low"]
    return both.select(*by, F.col("k").alias(key), F.coalesce("_own", nxt).alias("found"))


def within(points: DataFrame, key: str, intervals: DataFrame, lo: str, hi: str, how: str = "inner", ranges: int | None = None) -> DataFrame:
    """Joins points with the closed intervals that hold them.  Intervals are repeated
    once for each range that they reach into, and both sides meet on the range."""
    cuts = split_points(intervals, lo, ranges, RANGE_INTERVALS)
    p = points.withColumn("_range", range_of(F.col(key), cuts))
    i = intervals.withColumn("_range2", F.explode(F.sequence(range_of(F.col(lo), cuts), range_of(F.col(hi), cuts))))
    out = p.join(i, (F.col("_range") == F.col("_range2")) & (F.col(key) >= F.col(lo)) & (F.col(key) <= F.col(hi)), how)
    return out.drop("_range", "_range2")


def overlapping(a: DataFrame, b: DataFrame, lo: str, hi: str, lo2: str, hi2: str, also: Column, ranges: int | None = None) -> DataFrame:
    """Pairs of closed intervals that overlap, each once: in the first range that both
    reach into."""
    cuts = split_points(b, lo2, ranges, RANGE_INTERVALS)
    x = a.withColumn("_from", range_of(F.col(lo), cuts)).withColumn("_range", F.explode(F.sequence(F.col("_from"), range_of(F.col(hi), cuts))))
    y = b.withColumn("_from2", range_of(F.col(lo2), cuts)).withColumn("_range2", F.explode(F.sequence(F.col("_from2"), range_of(F.col(hi2), cuts))))
    meet = (F.col("_range") == F.col("_range2")) & (F.col("_range") == F.greatest("_from", "_from2"))
    out = x.join(y, meet & also & (F.col(lo) <= F.col(hi2)) & (F.col(lo2) <= F.col(hi)))
    return out.drop("_from", "_from2", "_range", "_range2")
