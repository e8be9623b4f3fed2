"""Store scenarios, and a model test against a dict at every snapshot."""

import random
import time

import pytest
from pyspark.sql import functions as F

from kvlake.model import Corruption, InvalidArgument, NotFound, NotSupported, StoreIOError
from kvlake.sources.batch import WriteBatch
from kvlake.sources.wal import LogWriter
from kvlake.store import KVStore, destroy, empty_state, failing_state, repair


def open_(spark, path, **options):
    return KVStore.open(spark, str(path), create_if_missing=True, **options)


def test_put_get_delete_reopen(spark, tmp_path):
    with open_(spark, tmp_path / "db") as db:
        db.put(b"k", b"v")
        assert db.get(b"k") == b"v"
        db.delete(b"k")
        assert db.get(b"k") is None
        db.put(b"other", b"")
        with pytest.raises(NotFound):
            db.get_or_raise(b"k")
    with KVStore.open(spark, str(tmp_path / "db")) as db:
        assert db.get(b"k") is None and db.get(b"other") == b""
        assert db.version.last_seq == 3


def test_snapshot_and_batches(spark, tmp_path):
    with open_(spark, tmp_path / "db") as db:
        db.put(b"key", b"v1")
        s = db.snapshot()
        db.put(b"key", b"v2")
        assert db.get(b"key", s) == b"v1" and db.get(b"key") == b"v2"
        db.compact()
        assert db.get(b"key", s) == b"v1" and db.get(b"key") == b"v2"
        db.release(s)
        db.put(b"key", b"v3")
        db.compact()
        assert db.ops().count() == 1
        db.write(WriteBatch().put(b"a", b"1").put(b"b", b"2").delete(b"a"))
        assert db.get(b"a") is None and db.get(b"b") == b"2"
        db.write(None)


def test_open_errors(spark, tmp_path):
    path = str(tmp_path / "db")
    with pytest.raises(InvalidArgument):
        KVStore.open(spark, path)
    with pytest.raises(NotSupported):
        open_(spark, path, comparator="mine")
    db = open_(spark, path)
    with pytest.raises(StoreIOError):
        KVStore.open(spark, path)
    with pytest.raises(StoreIOError):
        destroy(spark, path)
    db.close()
    with pytest.raises(InvalidArgument):
        open_(spark, path, error_if_exists=True)
    with pytest.raises(InvalidArgument):
        KVStore.open(spark, path, comparator="mine", sort_key=lambda c: c)
    destroy(spark, path)
    destroy(spark, path)
    assert not (tmp_path / "db").exists()


def test_a_lost_race_changes_nothing(spark, tmp_path):
    with open_(spark, tmp_path / "db") as db:
        db.put(b"a", b"1")
        old = db.version
        db.put(b"a", b"2")
        db.version = old  # as a writer that has not seen the last commit
        with pytest.raises(StoreIOError):
            db.put(b"a", b"3")
    with KVStore.open(spark, str(tmp_path / "db")) as db:
        assert db.get(b"a") == b"2"


def test_cursor_and_order(spark, tmp_path):
    with open_(spark, tmp_path / "db") as db:
        db.write(WriteBatch().put(b"a", b"1").put(b"\xff", b"4").put(b"b", b"2").put(b"b\0", b"3").put(b"c", b"x").delete(b"c"))
        c = db.iterator()
        c.seek_to_first()
        seen = []
        while c.valid():
            seen.append(c.key())
            c.next()
        assert seen == [b"a", b"b", b"b\0", b"\xff"]
        c.seek_to_last()
        c.prev()
        c.next()
        assert (c.key(), c.value()) == (b"\xff", b"4")
        c.seek(b"c")
        assert c.key() == b"\xff"
        c.prev()
        c.prev()
        assert c.key() == b"b"
        assert [bytes(r.key) for r in db.prefix(b"b").collect()] == [b"b", b"b\0"]
        assert [bytes(r.key) for r in db.scan(b"b", b"c", reverse=True).collect()] == [b"b\0", b"b"]


def test_custom_order(spark, tmp_path):
    """Keys ordered by length first."""
    order = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.length(c).cast("long")), 8, "0")), c)
    with open_(spark, tmp_path / "db", comparator="by-length", sort_key=order) as db:
        db.write(WriteBatch().put(b"bb", b"").put(b"c", b"").put(b"aaa", b""))
        assert [bytes(r.key) for r in db.scan().collect()] == [b"c", b"bb", b"aaa"]
        assert [bytes(r.key) for r in db.scan(start=b"bb").collect()] == [b"bb", b"aaa"]


def test_model(spark, tmp_path):
    rnd = random.Random(11)
    model, history = {}, {}
    with open_(spark, tmp_path / "db") as db:
        for step in range(14):
            batch = WriteBatch()
            for _ in range(rnd.randrange(1, 12)):
                key = b"k%02d" % rnd.randrange(15)
                if rnd.random() < 0.3:
                    batch.delete(key)
                    model.pop(key, None)
                else:
                    value = b"v%d" % rnd.randrange(1000)
                    batch.put(key, value)
                    model[key] = value
            db.write(batch)
            if step % 4 == 1:
                history[db.snapshot()] = dict(model)
            if step % 5 == 4:
                db.compact()
            if step % 6 == 5:
                db.maybe_compact()
        for s, want in [*history.items(), (None, model)]:
            assert {bytes(r.key): bytes(r.value) for r in db.state(s).collect()} == want
        keys = spark.createDataFrame([(bytearray(b"k%02d" % k),) for k in range(16)], "key binary")
        assert {bytes(r.key): bytes(r.value) for r in db.multi_get(keys).collect() if r.found} == model
        assert sum(db.approximate_sizes([(b"a", b"z")])) == sum(f.file_size for f in db.version.files)
        db.remove_obsolete()
        assert {bytes(r.key): bytes(r.value) for r in db.state().collect()} == model


def test_bulk_and_properties(spark, tmp_path):
    with open_(spark, tmp_path / "db", keep_versions=1) as db:
        rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 16, "0").cast("binary").alias("key"), F.lit(b"x").alias("value"))
        db.bulk_put(rows)
        assert db.ops().agg(F.countDistinct("seq"), F.min("seq"), F.max("seq")).first() == (1000, 1, 1000)
        for _ in range(4):
            db.bulk_delete(rows.limit(10))
        assert db.state().count() == 990
        assert db.property("kvlake.num-files-at-level0") == "5" and db.property("nothing") is None and db.property("num-files-at-level9") is None
        segments = tmp_path / "db/segments"
        assert len(list(segments.iterdir())) == 5
        assert db.maybe_compact() and db.property("num-files-at-level0") == "0"
        assert len(list(segments.iterdir())) == 1  # a compaction deletes what no kept version names
        assert "--- level 1 ---" in db.property("sstables") and "Compactions" in db.property("stats")
        assert db.property("approximate-memory-usage").isdigit()
        assert db.remove_obsolete() == [] and db.state().count() == 990
        assert db.ops().count() == 990  # nothing lies below, so tombstones went too


def test_trivial_move_is_metadata_alone(spark, tmp_path):
    with open_(spark, tmp_path / "db") as db:
        db.put(b"a", b"1")
        f = db.version.files[0]
        f.level, f.file_size = 1, 11 << 20
        assert db.maybe_compact()
        assert [(x.file_no, x.level) for x in db.version.files] == [(f.file_no, 2)] and db.get(b"a") == b"1"


def test_repair(spark, tmp_path):
    with open_(spark, tmp_path / "db") as db:
        db.put(b"a", b"1")
        db.put(b"b", b"2")
        db.delete(b"b")
    for p in (tmp_path / "db/manifest").iterdir():
        p.write_text("garbage")
    (tmp_path / "db/segments/000009").mkdir()
    (tmp_path / "db/segments/000009/part-0.parquet").write_text("garbage")
    lost = repair(spark, str(tmp_path / "db"))
    assert "000009" in lost
    with KVStore.open(spark, str(tmp_path / "db")) as db:
        assert (db.get(b"a"), db.get(b"b"), db.version.last_seq) == (b"1", None, 3)
        db.put(b"c", b"3")
        assert db.get(b"c") == b"3"


def test_key_predicates_reach_the_scan(spark, tmp_path):
    with open_(spark, tmp_path / "db") as db:
        db.put(b"a", b"1")
        plan = db.state().where(F.col("key") == F.lit(bytearray(b"a")))._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(key" in plan
        plan = db.scan(limit=5)._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan


def test_compaction_cuts_its_output(spark, tmp_path):
    """Files of about max_file_size with disjoint ranges; the next compaction takes one of
    them and what it meets, not the whole level."""
    with open_(spark, tmp_path / "db", max_file_size=1 << 20) as db:
        rows = spark.range(6000).select(F.lpad((F.col("id") * 7919 % 6000).cast("string"), 8, "0").cast("binary").alias("key"), F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("h"))
        rows = rows.select("key", F.concat(*(F.unhex(F.sha2(F.concat("h", F.lit(bytearray([k]))), 512)) for k in range(16))).alias("value"))
        want = {(bytes(r.key), bytes(r.value)) for r in rows.collect()}
        db.bulk_put(rows)
        db.compact()
        files = sorted(db.version.files, key=lambda f: f.smallest)
        assert len(files) >= 5 and len({f.file_no for f in files}) == len(files) and {f.level for f in files} == {1}
        assert all(a.largest < b.smallest for a, b in zip(files, files[1:])) and all(f.file_size < 2 << 20 for f in files)
        assert sum(f.num_entries for f in files) == 6000
        hit = files[2]
        key = bytes.fromhex(hit.smallest)
        assert db.get(key) is not None and len(db._may_hold(key, key)) == 1
        for f in files:
            f.file_size *= 3  # the level is too large now
        assert db.maybe_compact()
        assert sum(f.level == 2 for f in db.version.files) == 1 and len(db.version.files) == len(files)
        db.put(key, b"new")
        db.compact(key, key)
        untouched = [f.path for f in files if f not in (hit,)]
        assert sum(f.path in untouched for f in db.version.files) == len(files) - 1
        got = {(bytes(r.key), bytes(r.value)) for r in db.state().collect()}
        assert got == {(k, b"new" if k == key else v) for k, v in want}


def test_bulk_in_order(spark, tmp_path):
    with open_(spark, tmp_path / "db") as db:
        rows = [(k, 1 if k % 3 else 0, bytearray(b"k%d" % (k % 5)), bytearray(b"v%d" % k)) for k in range(500)]
        df = spark.createDataFrame(rows, "ord long, kind int, key binary, value binary").repartition(7)
        db.bulk_write(df)
        want = {}
        for _, kind, key, value in rows:
            want.pop(bytes(key), None)
            if kind:
                want[bytes(key)] = bytes(value)
        assert {bytes(r.key): bytes(r.value) for r in db.state().collect()} == want
        db.bulk_put(df.select("key", "value", "ord"))
        assert {bytes(r.key): bytes(r.value) for r in db.state().collect()} == {bytes(k): bytes(v) for _, _, k, v in rows}


def test_lease(spark, tmp_path):
    path = str(tmp_path / "db")
    db = open_(spark, path, lease_seconds=2.0)
    db.put(b"a", b"1")
    time.sleep(3)  # it is renewed while its process lives
    with pytest.raises(StoreIOError):
        KVStore.open(spark, path)
    db._lease._stop.set()  # as after a crash
    time.sleep(3)
    with KVStore.open(spark, path) as other:
        assert other.get(b"a") == b"1"
        with pytest.raises(StoreIOError):
            db.put(b"a", b"2")  # the old owner has lost its lease
        db.close()  # and leaves that of the new one alone
        other.put(b"a", b"3")
        assert other.get(b"a") == b"3"


def test_repair_from_logs(spark, tmp_path):
    """A log of one batch from sequence 10 on; the log goes to lost/."""
    batch = WriteBatch(seq=10).put(b"alpha", b"one").put(b"beta", b"two").delete(b"beta")
    log = LogWriter()
    log.add(batch.encode())
    logs = tmp_path / "db/logs"
    logs.mkdir(parents=True)
    (logs / "000005.log").write_bytes(log.getvalue())
    assert "000005.log" in repair(spark, str(tmp_path / "db"))
    with KVStore.open(spark, str(tmp_path / "db")) as db:
        assert (db.get(b"alpha"), db.get(b"beta"), db.version.last_seq, db.version.next_file) == (b"one", None, 12, 7)
        assert not list(logs.iterdir())


def test_custom_order_in_compaction(spark, tmp_path):
    """Keys ordered by length: what lies below is found in that order too."""
    order = lambda c: F.concat(F.unhex(F.lpad(F.hex(F.length(c).cast("long")), 8, "0")), c)
    with open_(spark, tmp_path / "db", comparator="by-length", sort_key=order) as db:
        db.write(WriteBatch().put(b"z", b"1").put(b"aaaa", b"2").put(b"mm", b"3"))
        db.compact()
        for f in db.version.files:
            f.level = 3
        db.write(WriteBatch().delete(b"mm").put(b"b", b"4"))
        db._merge([f for f in db.version.files if f.level == 0], 1)
        assert db.get(b"mm") is None and db.get(b"aaaa") == b"2"  # the tombstone is still needed
        db.compact()
        assert [bytes(r.key) for r in db.scan().collect()] == [b"b", b"z", b"aaaa"] and db.ops().count() == 3
        assert db.approximate_sizes([(b"a", b"zz")])[0] > 0


def test_groups_back_pressure_and_cache(spark, tmp_path):
    with open_(spark, tmp_path / "db", auto_compact=True, stop_files=3, cached_reads=2) as db:
        for k in range(6):
            db.write_group([WriteBatch().put(b"k", b"%d" % k), WriteBatch().put(b"j%d" % k, b"x").delete(b"j%d" % (k - 1))])
            assert sum(f.level == 0 for f in db.version.files) < 4
        assert db.version.last_seq == 18 and db.get(b"k") == b"5"
        assert sorted(bytes(r.key) for r in db.state().collect()) == [b"j5", b"k"]
        for _ in range(3):
            db.state().count()
        assert 0 < len(db._cached) <= 2 and int(db.property("approximate-memory-usage")) > 0


def test_failing_and_empty_state(spark):
    assert empty_state(spark).count() == 0
    with pytest.raises(Exception, match="Corruption: block"):
        failing_state(spark, Corruption("block")).collect()
