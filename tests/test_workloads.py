"""Workloads on a small store, streaming, and the ordered helpers."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from kvlake.model import OPS
from kvlake.operators import compaction, ranges, versions, visible
from kvlake.plans.workloads import DEFAULT, Setup, report
from kvlake.store import KVStore
from kvlake.streaming.ingest import into_store, ops_stream


def test_all_workloads(spark, capsys):
    names = [*DEFAULT, "fillbatch", "deleteseq", "fillrandom", "deleterandom", "readmissing", "readhot", "readrandomsmall", "seekrandom", "seekordered", "readwhilewriting", "stats", "sstables", "reopen"]
    out = report(spark, names, Setup(num=300))
    assert [n for n, _, _ in out] == names and "micros/op" in capsys.readouterr().out


def test_stream_into_store_twice(spark, tmp_path):
    rows = [(k + 1, int(k % 5 > 0), bytearray(b"k%d" % (k % 7)), bytearray(b"v%d" % k) if k % 5 else None) for k in range(60)]
    src = str(tmp_path / "src")
    for a in range(0, 60, 20):
        spark.createDataFrame(rows[a : a + 20], OPS).coalesce(1).write.mode("append").parquet(src)
    with KVStore.open(spark, str(tmp_path / "db"), create_if_missing=True) as db:
        for cp in ("cp1", "cp2"):  # the second run delivers everything again
            into_store(ops_stream(spark, src), db, str(tmp_path / cp)).trigger(availableNow=True).start().awaitTermination()
        assert db.ops().count() == 60
        want = visible.visible_state(spark.createDataFrame(rows, OPS))
        assert db.state().exceptAll(want).count() == 0 and db.state().count() == want.count()


@pytest.mark.parametrize("n", [None, 2, 64, 300])
def test_ranges(spark, n):
    rnd = random.Random(5)
    keys = sorted(rnd.sample(range(5000), 700))
    k = spark.createDataFrame([(f"{x:05d}", x) for x in keys], "key string, x int")
    rows = ranges.global_index(k, "key", n).orderBy("key").collect()
    assert [r.idx for r in rows] == list(range(700)) and [r.prev for r in rows] == [None, *(r.key for r in rows[:-1])]
    asked = [f"{rnd.randrange(5200):05d}" for _ in range(300)]
    got = {r.t: r.found for r in ranges.lower_bound(spark.createDataFrame([(a,) for a in asked], "t string"), "t", k, "key", ranges=n).collect()}
    assert got == {a: next((f"{x:05d}" for x in keys if f"{x:05d}" >= a), None) for a in asked}
    iv = sorted((a, a + rnd.randrange(400)) for a in rnd.sample(range(5000), 120))
    i = spark.createDataFrame([(f"{a:05d}", f"{b:05d}", m) for m, (a, b) in enumerate(iv)], "lo string, hi string, n int")
    got = sorted((r.x, r.n) for r in ranges.within(k, "key", i, "lo", "hi", ranges=n).collect())
    assert got == sorted((x, m) for x in keys for m, (a, b) in enumerate(iv) if a <= x <= b)
    j = i.select(*(F.col(c).alias(c + "2") for c in ("lo", "hi", "n")))
    got = sorted((r.n, r.n2) for r in ranges.overlapping(i, j, "lo", "hi", "lo2", "hi2", F.lit(True), ranges=n).collect())
    assert got == sorted((p, q) for p, (a, b) in enumerate(iv) for q, (c, d) in enumerate(iv) if a <= d and c <= b)


def test_range_of_many_points(spark):
    points = [f"{k:06d}" for k in range(7, 9000, 3)]
    keys = [f"{k:06d}" for k in range(0, 9100, 11)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.r for r in df.select("k", ranges.range_of(F.col("k"), points).alias("r")).collect()}
    assert got == {k: bisect.bisect_right(points, k) for k in keys}


def test_ranges_follow_the_data(spark):
    df = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("k"))
    points = ranges.split_points(df, "k", rows=100)
    assert 90 <= len(points) < 100
    held = df.groupBy(ranges.range_of(F.col("k"), points).alias("r")).count().agg(F.max("count")).first()[0]
    assert held < 400
    assert ranges.split_points(df, "k") == []


def test_retention_keeps_reads(spark):
    rnd = random.Random(3)
    rows = [(s, rnd.randrange(2), f"k{rnd.randrange(6)}", f"v{s}") for s in range(1, 120)]
    log = spark.createDataFrame(rows, "seq long, kind int, key string, value string")
    kept = compaction.retain(log, 60).cache()
    assert kept.count() < 119
    for at in (60, 75, 119):
        a, b = (sorted(map(tuple, visible.visible_state(x, at).collect())) for x in (log, kept))
        assert a == b
    deeper = spark.createDataFrame([("k0", "k2")], "lo string, hi string")
    more = compaction.retain(log, 119, deeper)
    newest = {r.key: r.kind for r in visible.newest(log).collect()}
    assert {r.key for r in more.collect()} == {k for k, kind in newest.items() if kind or k <= "k2"}


def test_greedy_and_grandparent_cuts(spark):
    rows = spark.createDataFrame([("g", f"{k:02d}", 40) for k in range(10)], "g string, key string, size int")
    got = [r.part for r in compaction.greedy_cut(rows, "g", ["key"], "size", 100).orderBy("key").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3]
    grand = spark.createDataFrame([("00", "01", 60), ("03", "04", 60), ("06", "06", 60), ("20", "30", 60)], "lo string, hi string, file_size int")
    got = [r.part for r in compaction.grandparent_cut(rows.select("g", "key"), "g", grand, 100).orderBy("key").collect()]
    assert got == [0, 0, 0, 0, 0, 1, 1, 1, 1, 1]  # 60 at 02, 120 at 05; 60 at 07


def test_edits(spark):
    edits = spark.createDataFrame([(1, 1, "add"), (1, 2, "remove"), (1, 3, "add"), (2, 1, "add"), (2, 4, "remove")], "file_no long, edit_no int, op string")
    assert [r.file_no for r in versions.apply_edits(edits).collect()] == [1]


def test_obsolete_files_once(spark):
    names, live = (spark.createDataFrame([(n,) for n in numbers], "file_no long") for numbers in ([1, 1, 2, 3, 3, 3], [2, 2]))
    assert sorted(r.file_no for r in versions.obsolete(names, live).collect()) == [1, 3]


def test_visibility_fixtures(spark):
    log = spark.createDataFrame(
        [(100, 1, "alpha", "new-alpha"), (90, 1, "alpha", "old-alpha"), (105, 0, "bravo", None), (100, 1, "bravo", "before"), (80, 1, "charlie", "c"), (120, 1, "delta", "future")],
        "seq long, kind int, key string, value string",
    )
    at = lambda s: {r.key: r.value for r in visible.visible_state(log, s).collect()}
    assert at(100) == {"alpha": "new-alpha", "bravo": "before", "charlie": "c"}
    assert at(110) == {"alpha": "new-alpha", "charlie": "c"} and at(79) == {}
    assert visible.seek(log, "bravo", 110).first()["key"] == "charlie"
    assert visible.successor(b"a\xff") == b"b" and visible.successor(b"\xff") is None and visible.successor("a") == "b"


def test_stream_with_late_sequences(spark, tmp_path):
    """Files out of order, one for each micro-batch: nothing is lost, and what a tombstone
    hides stays hidden when it comes after it."""
    src = str(tmp_path / "src")
    rows = [(k, 0 if k in (15, 20) else 1, bytearray(b"k%d" % (k % 5)), bytearray(b"v%d" % k)) for k in range(1, 21)]
    for part in (rows[10:], rows[:10]):
        spark.createDataFrame(part, OPS).coalesce(1).write.mode("append").parquet(src)
    with KVStore.open(spark, str(tmp_path / "db"), create_if_missing=True) as db:
        one = ops_stream(spark, src, files_per_trigger=1).where("seq > 10")
        into_store(one, db, str(tmp_path / "cp1")).trigger(availableNow=True).start().awaitTermination()
        db.compact()
        into_store(ops_stream(spark, src, files_per_trigger=1), db, str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
        assert db.version.last_seq == 20 and db.ops().where("seq <= 10").count() == 10
        want = visible.visible_state(spark.createDataFrame(rows, OPS))
        assert db.state().exceptAll(want).count() == 0 and db.state().count() == want.count()
        db.compact()
        assert db.state().count() == want.count()
