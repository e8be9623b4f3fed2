"""Compaction: what to keep, which level and file to take, where to cut the output."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import internal_key_parts
from ..model import DELETE
from .ranges import lower_bound, within

L0_FILES, L1_BYTES, LEVELS = 4, 10 * 1048576, 7


def retain(log: DataFrame, smallest_snapshot: int, deeper: DataFrame | None = None, order: Column | None = None, keep_tombstones: bool = False) -> DataFrame:
    """Entries that some read at ``smallest_snapshot`` or later may need.

    An entry goes if the next newer one of its key is visible at that snapshot; a
    tombstone visible there goes too, if no file of ``deeper`` (lo, hi) can hold its
    key.  Without ``deeper``, nothing lies below.  The ends of files are keys, or
    values of ``order``.
    """
    w = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("kind"))
    kept = log.withColumn("_newer", F.lag("seq").over(w)).where(F.coalesce(F.col("_newer") > smallest_snapshot, F.lit(True))).drop("_newer")
    if keep_tombstones:
        return kept
    dead = (F.col("kind") == DELETE) & (F.col("seq") <= smallest_snapshot)
    if deeper is None:
        return kept.where(~dead)
    asked = kept.where(dead).select("key", (F.col("key") if order is None else order).alias("_place")).distinct()
    held = within(asked, "_place", deeper.select("lo", "hi"), "lo", "hi").select("key", F.lit(True).alias("_held")).distinct()
    return kept.join(held, "key", "left").where(~dead | F.coalesce("_held", F.lit(False))).drop("_held")


def retain_raw(log: DataFrame, smallest_snapshot: int, deeper: DataFrame | None = None) -> DataFrame:
    """As ``retain``, on internal keys (internal, value): a key that cannot be parsed is kept
    as it is, so that a compaction destroys no evidence of damage."""
    parts = internal_key_parts(F.col("internal"))
    rows = log.select("internal", "value", *(c.alias(n) for n, c in parts.items()))
    good = retain(rows.where("valid").drop("valid"), smallest_snapshot, deeper).select("internal", "value")
    return good.unionByName(rows.where("not valid").select("internal", "value"))


def score(files: DataFrame) -> DataFrame:
    """Pressure of each level: files over 4 for level 0, bytes over budget below."""
    budget = F.lit(float(L1_BYTES)) * F.pow(F.lit(10.0), F.col("level") - 1)
    per = files.groupBy("level").agg(F.count("*").alias("n"), F.sum("file_size").cast("double").alias("b"))
    return per.select("level", F.when(F.col("level") == 0, F.col("n") / 4.0).otherwise(F.col("b") / budget).cast("double").alias("score"))


def level_to_compact(files: DataFrame) -> DataFrame:
    """The level with the largest score, the first of equals; the last level never."""
    return score(files).where(F.col("level") < LEVELS - 1).agg(F.max_by("level", F.struct("score", -F.col("level"))).alias("level"), F.max("score").alias("score"))


def pick_files(files: DataFrame, pointer) -> DataFrame:
    """Round robin: of each level the first file that ends after the pointer, else the first."""
    after = F.min_by("file_no", F.when(F.col("hi") > pointer, F.col("hi")))
    return files.where("level >= 1").groupBy("level").agg(F.coalesce(after, F.min_by("file_no", "lo")).alias("file_no"))


def allowed_seeks(files: DataFrame) -> DataFrame:
    return files.select("file_no", F.greatest(F.lit(100), F.floor(F.col("file_size") / 16384)).cast("long").alias("allowed_seeks"))


def greedy_cut(rows: DataFrame, group: str, order: list[str], size: str, limit: int, before: bool = False) -> DataFrame:
    """Adds ``part``: consecutive rows of a group share a part until its size reaches
    ``limit``; with ``before``, the row that takes the size beyond ``limit`` already
    begins the next part.  The sum starts again at each cut, which no window can say,
    so each group (a file, or a key range) is walked in Arrow batches."""
    kind = rows.select(*rows.columns, F.lit(0).cast("long").alias("part")).schema
    names = list(rows.columns)

    def walk(batches):
        part = total = 0
        last = object()
        for batch in batches:
            parts = []
            groups, sizes = (batch.column(names.index(c)).to_pylist() for c in (group, size))
            for g, s in zip(groups, sizes):
                if g != last:
                    part, total, last = 0, 0, g
                total += s
                if before and total > limit:
                    part, total = part + 1, 0
                parts.append(part)
                if not before and total >= limit:
                    part, total = part + 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64())], names=[*names, "part"])

    return rows.repartition(F.col(group)).sortWithinPartitions(group, *order).mapInArrow(walk, kind)


def grandparent_cut(rows: DataFrame, group: str, grandparents: DataFrame, limit: int) -> DataFrame:
    """Adds ``part`` to the output keys (strings) of compactions, one for each group: a
    part begins at the key before which more than ``limit`` bytes of grandparent files
    (lo, hi, file_size; disjoint) lie since the last cut.  A file counts at the first
    key above its end, but not at the first key of all."""
    ends = grandparents.select(F.concat("hi", F.lit("\x00")).alias("target"), "file_size")
    passed = ends.join(lower_bound(ends, "target", rows, "key"), "target").where("found is not null")
    passed = passed.groupBy(F.col("found").alias("key")).agg(F.sum("file_size").alias("_passed"))
    first = F.min("key").over(Window.partitionBy(group)) == F.col("key")
    one = rows.join(passed, "key", "left").withColumn("_passed", F.when(first, 0).otherwise(F.coalesce("_passed", F.lit(0))).cast("long"))
    return greedy_cut(one, group, ["key"], "_passed", limit, before=True).drop("_passed")
