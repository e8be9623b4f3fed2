"""Reads: the newest version of each key at a snapshot, and everything on top of it.

The one rule of visibility: of each key, the entry with the largest sequence that is
not above the snapshot decides; a tombstone there hides the key.  The filter on the
sequence stays below the aggregate, the filter on tombstones above it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import PUT
from .ranges import lower_bound


def at_snapshot(log: DataFrame, snapshot=None) -> DataFrame:
    return log if snapshot is None else log.where(F.col("seq") <= snapshot)


def newest(log: DataFrame, snapshot=None) -> DataFrame:
    """(key, seq, kind, value) of the deciding entry of each key.  ``max_by`` combines
    before the shuffle, so a hot key sends one row for each task."""
    entry = F.max_by(F.struct("kind", "value", "seq"), F.struct("seq", "kind")).alias("e")
    return at_snapshot(log, snapshot).groupBy("key").agg(entry).select("key", "e.seq", "e.kind", "e.value")


def visible_state(log: DataFrame, snapshot=None) -> DataFrame:
    """(key, value) of the visible rows.  Filters on the key written on top reach the
    scan, since it is the grouping key."""
    return newest(log, snapshot).where(F.col("kind") == PUT).select("key", "value")


def get(log: DataFrame, key, snapshot=None) -> DataFrame:
    """The row of one key, or none."""
    return visible_state(log.where(F.col("key") == key), snapshot)


def multi_get(log: DataFrame, keys: DataFrame, snapshot=None) -> DataFrame:
    """(key, value, found) for each distinct key asked for.  Entries of other keys are
    dropped before the aggregate; which side is broadcast is left to the optimiser,
    which knows their sizes."""
    asked = keys.select("key").distinct()
    state = visible_state(log.join(asked, "key", "left_semi"), snapshot)
    return asked.join(state.withColumn("found", F.lit(True)), "key", "left").select("key", "value", F.coalesce("found", F.lit(False)).alias("found"))


def missing(log: DataFrame, keys: DataFrame, snapshot=None) -> DataFrame:
    return multi_get(log, keys, snapshot).where(~F.col("found")).select("key")


def scan(log: DataFrame, snapshot=None, start=None, limit_key=None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Ordered scan of keys in [start, limit_key); ``limit`` makes it a top-k."""
    rows = log
    if start is not None:
        rows = rows.where(F.col("key") >= start)
    if limit_key is not None:
        rows = rows.where(F.col("key") < limit_key)
    out = visible_state(rows, snapshot).orderBy(F.desc("key") if reverse else "key")
    return out if limit is None else out.limit(limit)


def seek(log: DataFrame, target, snapshot=None) -> DataFrame:
    """The first visible row whose key is not below the target."""
    return scan(log, snapshot, start=target, limit=1)


def step(log: DataFrame, key, forward: bool = True, snapshot=None) -> DataFrame:
    """The row after (before) a key, whichever way the cursor moved until now."""
    rows = log.where(F.col("key") > key if forward else F.col("key") < key)
    return scan(rows, snapshot, reverse=not forward, limit=1)


def successor(prefix):
    """The smallest key above all keys with this prefix, or None."""
    if isinstance(prefix, str):
        return prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix and ord(prefix[-1]) < 0x10FFFF else None
    cut = bytes(prefix).rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def prefix_scan(log: DataFrame, prefix, snapshot=None) -> DataFrame:
    """As a range of keys, so that it is pushed to the scan for binary keys too."""
    rows = log.where(F.col("key") >= prefix)
    after = successor(prefix)
    return visible_state(rows if after is None else rows.where(F.col("key") < after), snapshot)


def multi_seek(log: DataFrame, targets: DataFrame, snapshot=None) -> DataFrame:
    """(target, found) for each distinct target."""
    return lower_bound(targets, "target", visible_state(log, snapshot), "key").select("target", "found")


def internal_scan(*parts: DataFrame) -> DataFrame:
    """The bag of all versions of several sources."""
    return reduce(DataFrame.unionByName, (p.select("key", "seq", "kind", "value") for p in parts))


INTERNAL_ORDER = ("key", "seq desc", "kind desc")


def internal_order() -> list[Column]:
    return [F.col("key"), F.desc("seq"), F.desc("kind")]


def merge_sorted(*parts: DataFrame) -> DataFrame:
    """Ordered merge of sources that keeps duplicates."""
    return internal_scan(*parts).orderBy(*internal_order())


def version_rank(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.desc("seq"), F.desc("kind"))
    return log.select("key", "seq", F.row_number().over(w).cast("long").alias("rn"))


def hidden_versions(log: DataFrame) -> DataFrame:
    """Entries with a newer one of the same key: one aggregate and one join on the key,
    instead of a join of all pairs of versions."""
    top = log.groupBy("key").agg(F.max("seq").alias("top"))
    return log.join(top, "key").where("seq < top").select("key", "seq")
