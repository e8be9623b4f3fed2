"""File metadata: edits, live sets, lookups and overlaps, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import lower_bound, overlapping, within


def apply_edits(edits: DataFrame) -> DataFrame:
    """Live files after all edits (file_no, edit_no, op): the last edit of a file decides."""
    return edits.groupBy("file_no").agg(F.max_by("op", "edit_no").alias("op")).where(F.col("op") == "add").select("file_no")


def live_files(*versions: DataFrame) -> DataFrame:
    """Files that any of these versions needs."""
    out = versions[0].select("file_no")
    for v in versions[1:]:
        out = out.unionByName(v.select("file_no"))
    return out.distinct()


def obsolete(directory: DataFrame, live: DataFrame) -> DataFrame:
    """Files of the directory that are not live, each once: a number can stand in files of
    several levels."""
    return directory.join(live, "file_no", "left_anti").select("file_no").distinct()


def keep_files(names: DataFrame, live: DataFrame, log_number: int, previous_log: int, manifest: int) -> DataFrame:
    """What stays of a directory (name, number, kind): live tables and those being written,
    logs from the current one on and the previous one, the manifest in use and newer ones,
    and what is one of a kind; names that are not ours stay too."""
    held = live.select(F.col("file_no").alias("number"), F.lit(True).alias("_live")).distinct()
    k, n = F.col("kind"), F.col("number")
    stays = (
        F.when(k == "log", (n >= log_number) | (n == previous_log)).when(k == "manifest", n >= manifest)
        .when(k.isin("table", "temp"), F.coalesce("_live", F.lit(False))).otherwise(True)
    )
    return names.join(held, "number", "left").where(stays).select("name")


def internal_range(entries: DataFrame) -> DataFrame:
    """Smallest and largest internal key of each level: of equal user keys, the one with
    the largest sequence comes first."""
    lo, hi = F.struct("key", (-F.col("seq")).alias("s")), F.struct("key", (-F.col("seq")).alias("s"))
    per = entries.groupBy("level").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    return per.select("level", F.col("lo.key").alias("smallest"), (-F.col("lo.s")).alias("smallest_seq"), F.col("hi.key").alias("largest"), (-F.col("hi.s")).alias("largest_seq"))


def boundary_inputs(files: DataFrame) -> DataFrame:
    """(file_no, next_file_no): files of one level of which the second begins with older
    versions of the user key that the first ends with; who takes the first must take it.
    Files have lo, lo_seq, hi and hi_seq."""
    a = files.select("level", "file_no", F.col("hi").alias("key"), "hi_seq")
    b = files.select("level", F.col("file_no").alias("next_file_no"), F.col("lo").alias("key"), "lo_seq")
    first = F.row_number().over(Window.partitionBy("level", "file_no").orderBy(F.desc("lo_seq")))
    pairs = a.join(b, ["level", "key"]).where((F.col("lo_seq") < F.col("hi_seq")) & (F.col("file_no") != F.col("next_file_no")))
    return pairs.withColumn("_k", first).where("_k = 1").select("file_no", "next_file_no")


def newest_first(files: DataFrame) -> DataFrame:
    """The order in which files of level 0 are asked; the level holds a dozen by design."""
    order = Window.partitionBy("level").orderBy(F.desc("file_no"))
    return files.where("level = 0").select("level", "file_no", F.row_number().over(order).cast("long").alias("place")).select("file_no", "place")


def level_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("num_entries").alias("entries"), F.sum("file_size").alias("bytes"))


def key_range(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.min("lo").alias("smallest"), F.max("hi").alias("largest"))


def find_file(keys: DataFrame, files: DataFrame) -> DataFrame:
    """For each key and disjoint level, the first file that ends at or after the key."""
    deep = files.where("level >= 1").select("level", "hi", "file_no")
    found = lower_bound(keys, "key", deep, "hi", by=["level"]).where("found is not null")
    return found.join(deep.withColumnRenamed("hi", "found"), ["level", "found"]).select("key", "level", "file_no")


def files_for_key(keys: DataFrame, files: DataFrame) -> DataFrame:
    return within(keys.select("key"), "key", files.select("level", "file_no", "lo", "hi"), "lo", "hi").select("key", "level", "file_no")


def next_level_overlaps(files: DataFrame) -> DataFrame:
    """(level, file_no, next_file_no, file_size of the file below) of overlapping pairs."""
    below = files.select(F.col("level").alias("level2"), F.col("file_no").alias("next_file_no"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("file_size").alias("size2"))
    pairs = overlapping(files.select("level", "file_no", "lo", "hi"), below, "lo", "hi", "lo2", "hi2", F.col("level2") == F.col("level") + 1)
    return pairs.select("level", "file_no", "next_file_no", F.col("size2").alias("file_size"))


def overlap_in_level(files: DataFrame) -> DataFrame:
    return next_level_overlaps(files).select("file_no").distinct()


def max_next_level_overlap(files: DataFrame) -> DataFrame:
    per = next_level_overlaps(files).where("level >= 1").groupBy("file_no").agg(F.sum("file_size").alias("s"))
    return per.agg(F.max("s").alias("bytes"))


def trivial_moves(files: DataFrame) -> DataFrame:
    """Files that can move down a level by metadata alone."""
    return files.select("level", "file_no").join(next_level_overlaps(files).select("level", "file_no"), ["level", "file_no"], "left_anti")


def overlap_islands(files: DataFrame) -> DataFrame:
    """Closure of overlap among the files of level 0: files with the same ``island``
    reach one another.  Level 0 holds a dozen files by design."""
    w = Window.partitionBy("level").orderBy("lo", "file_no")
    high = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") > high, 1).otherwise(0)
    rows = files.where("level = 0").withColumn("_new", new)
    return rows.withColumn("island", F.sum("_new").over(w).cast("long")).select("file_no", "island")


def base_level_keys(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct keys that no file of these deeper levels can hold."""
    keys = entries.select("key").distinct()
    return keys.join(within(keys, "key", files.select("lo", "hi"), "lo", "hi").select("key").distinct(), "key", "left_anti")


def memtable_output_level(candidates: DataFrame, files: DataFrame, most_bytes: int, deepest: int = 2) -> DataFrame:
    """Level for each flushed key range (id, lo, hi): 0 if level 0 overlaps it, else the
    deepest level up to ``deepest`` that neither it nor the next level overlaps much."""
    below = files.select(F.col("level").alias("level2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("file_size").alias("size2"))
    met = overlapping(candidates.select("id", "lo", "hi"), below, "lo", "hi", "lo2", "hi2", F.lit(True))
    per = met.groupBy("id").agg(
        *(F.max(F.when(F.col("level2") == n, 1).otherwise(0)).alias(f"hit{n}") for n in range(deepest + 1)),
        *(F.sum(F.when(F.col("level2") == n, F.col("size2")).otherwise(0)).alias(f"bytes{n}") for n in range(2, deepest + 2)),
    )
    level = F.lit(deepest)
    for n in range(deepest - 1, -1, -1):
        stop = (F.col(f"hit{n + 1}") == 1) | (F.col(f"bytes{n + 2}") > most_bytes)
        level = F.when(stop, n).otherwise(level)
    level = F.when(F.col("hit0") == 1, 0).otherwise(level)
    return candidates.select("id").join(per, "id", "left").select("id", F.coalesce(level, F.lit(deepest)).cast("long").alias("level"))


def approximate_sizes(state: DataFrame, ranges: DataFrame) -> DataFrame:
    """Logical bytes of the rows in each range [lo, hi)."""
    size = (F.length("key") + F.length("value")).cast("long")
    held = within(state, "key", ranges, "lo", "hi").where("key < hi")
    per = held.groupBy("lo", "hi").agg(F.sum(size).alias("bytes"))
    return ranges.join(per, ["lo", "hi"], "left").select("lo", "hi", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))


def repair_metadata(entries: DataFrame) -> DataFrame:
    """What a manifest needs, from the entries themselves."""
    return entries.groupBy("file_no").agg(F.count("*").alias("entries"), F.min("key").alias("smallest"), F.max("key").alias("largest"), F.max("seq").alias("max_sequence"))
