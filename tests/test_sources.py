"""Binary formats: round trips, damage, and the readers over Spark."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvlake.model import Corruption, InvalidArgument, OPS
from kvlake.sources import codec as C
from kvlake.sources import dump, edits, sst, wal
from kvlake.sources.batch import WriteBatch, encoded_size


def log(*recs):
    w = wal.LogWriter()
    for r in recs:
        w.add(r)
    return w.getvalue()


def test_log_records():
    recs = [b"foo", b"bar", b"", b"xxxx"]
    data = log(*recs)
    assert [r for _, r in wal.records(data)] == recs
    assert {k for _, k, _ in wal.fragments(data)} == {wal.FULL}
    recs = [b"small", b"medium" * 8000, b"large" * 20_000]
    assert [r for _, r in wal.records(log(*recs))] == recs
    edge = b"x" * (wal.BLOCK + 7)
    assert [(k, len(p)) for _, k, p in wal.fragments(log(edge))] == [(wal.FIRST, 32761), (wal.LAST, 14)]
    many = [b"%d." % k for k in range(10_000)]
    assert [r for _, r in wal.records(log(*many))] == many


def test_log_damage():
    recs = [b"a" * 100, b"b" * 40_000, b"c" * 10]
    data = bytearray(log(*recs))
    seen = []
    assert [r for _, r in wal.records(bytes(data[:-5]), report=lambda *x: seen.append(x))] == recs[:2] and not seen
    data[10] ^= 1  # the first block is lost from here
    assert [r for _, r in wal.records(bytes(data), report=lambda *x: seen.append(x))] == [b"c" * 10]
    assert seen[0][1] == "checksum mismatch"
    assert [r for _, r in wal.records(log(*recs), initial_offset=1)] == recs[1:]


OP = st.one_of(st.tuples(st.just(1), st.binary(max_size=9), st.binary(max_size=9)), st.tuples(st.just(0), st.binary(max_size=9), st.none()))


@given(st.lists(OP, max_size=9), st.integers(0, 2**56 - 1))
def test_batches(ops, seq):
    b = WriteBatch(ops, seq)
    again = WriteBatch.decode(b.encode())
    assert (again.seq, again.ops) == (seq, ops) and b.approximate_size() == len(b.encode())
    if ops:
        with pytest.raises(Corruption):
            WriteBatch.decode(b.encode()[:-1] if ops[-1][1] or ops[-1][2] else b.encode() + b"\x09")
    assert WriteBatch(ops).append(WriteBatch(ops)).count() == 2 * len(ops)


def test_batch_size_column(spark):
    b = WriteBatch([(1, b"k" * 200, b"v" * 20_000), (0, b"x", None), (1, b"", b"")])
    df = spark.createDataFrame([(k, *map(lambda x: x if x is None or isinstance(x, int) else bytearray(x), op)) for k, op in enumerate(b.ops)], OPS)
    assert encoded_size(df).first()["bytes"] == b.approximate_size()


def test_edits():
    key = C.put_internal(b"a", 5, 1)
    e = edits.VersionEdit("cmp", 1, 2, 300, 1 << 50, [(3, key)], [(1, 7)], [(0, 9, 1000, key, C.put_internal(b"z", 6, 0))])
    assert edits.VersionEdit.decode(e.encode()) == e
    with pytest.raises(Corruption):
        edits.VersionEdit.decode(b"\x0f")
    with pytest.raises(Corruption):
        edits.VersionEdit.decode(e.encode()[:-2])
    add = edits.VersionEdit(added=[(1, 7, 1, key, key)])
    assert set(edits.fold([add, e, add])["files"]) == {(1, 7), (0, 9)} and edits.fold([add, e])["last_seq"] == 1 << 50


@settings(deadline=None)
@given(st.dictionaries(st.binary(max_size=6), st.binary(max_size=30), max_size=60), st.sampled_from(["none", "snappy", "zstd"]), st.sampled_from([1, 60, 4096]), st.sampled_from([None, 10]))
def test_tables(rows, compression, block_size, bits):
    b = sst.TableBuilder(block_size, compression=compression, bits_per_key=bits)
    for k in sorted(rows):
        b.add(k, rows[k])
    t = sst.Table(b.finish())
    assert list(t) == sorted(rows.items())
    for k in rows:
        assert t.get(k) == rows[k] and t.seek(k) == (k, rows[k])
    assert t.get(b"absent-key") is None and t.seek(b"\xff" * 7) is None
    offsets = [t.approximate_offset(k) for k in sorted(rows)]
    assert offsets == sorted(offsets)


def test_block_prefixes_and_index():
    b = sst.BlockBuilder(2)
    for k, v in ((b"alpha1", b"v1"), (b"alpha2", b"v2"), (b"bravo", b"v3")):
        b.add(k, v)
    data = b.finish()
    assert (data[0], data[1], data[11], data[12], data[17], data[18]) == (0, 6, 5, 1, 0, 5) and b.restarts == [0, 17]
    t = sst.TableBuilder(1)
    for k in (b"alpha1", b"alpha3", b"bravo"):
        t.add(k, b"x")
    assert [k for k, _ in sst.Table(t.finish()).index] == [b"alpha2", b"alpha3", b"c"]


def test_table_damage():
    t = sst.TableBuilder(64)
    for k in range(50):
        t.add(b"k%02d" % k, b"v" * 9)
    data = bytearray(t.finish())
    for bad in (b"", bytes(data[:-1]), b"x" * 60):
        with pytest.raises(Corruption):
            sst.Table(bad)
    data[5] ^= 1
    with pytest.raises(Corruption):
        list(sst.Table(bytes(data)))
    with pytest.raises(InvalidArgument):
        t.add(b"z", b"")


def test_dumps():
    b = WriteBatch([(1, b"alpha", b"one"), (0, b"bravo", None)], 100)
    assert dump.dump("000001.log", log(b.encode())) == ["--- offset 0; sequence 100", "  put 'alpha' 'one'", "  del 'bravo'"]
    t = sst.TableBuilder(internal=True)
    t.add(C.put_internal(b"alpha", 7, 1), b"one\n")
    assert dump.dump("000002.sst", t.finish()) == ["'alpha' @ 7 : val => 'one\\x0a'"]
    assert "  LastSeq: 9" in dump.dump("MANIFEST-000001", log(edits.VersionEdit(last_seq=9).encode()))
    with pytest.raises(InvalidArgument):
        dump.dump("x.txt", b"")


def test_spark_readers(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(k + 1, rnd.randrange(2), bytearray(b"k%03d" % rnd.randrange(99)), None) for k in range(500)]
    rows = [(s, k, key, bytearray(b"v%d" % s) if k else None) for s, k, key, _ in rows]
    df = spark.createDataFrame(rows, OPS)
    same = lambda out: sorted((r.seq, r.kind, bytes(r.key), r.value and bytes(r.value)) for r in out.collect()) == [(s, k, bytes(x), v and bytes(v)) for s, k, x, v in rows]
    wal.write_wal(df, str(tmp_path / "wal"))
    assert same(wal.read_wal(spark, str(tmp_path / "wal"), paranoid=True))
    (tmp_path / "logs").mkdir()
    for k, content in enumerate(wal.log_of([(s, k, bytes(x), v and bytes(v)) for s, k, x, v in rows], limit=2000)):
        (tmp_path / f"logs/{k:06d}.log").write_bytes(content)
    assert same(wal.read_log_files(spark, str(tmp_path / "logs")))
    (tmp_path / "tables").mkdir()
    for r in sst.encode_tables(df, max_file_size=2000, block_size=256, compression="zstd", bits_per_key=10).collect():
        (tmp_path / "tables" / r["name"]).write_bytes(r["content"])
    assert len(list((tmp_path / "tables").iterdir())) > 2
    assert same(sst.read_tables(spark, str(tmp_path / "tables"), paranoid=True))
    (tmp_path / "tables/999999.sst").write_bytes(b"garbage")
    assert same(sst.read_tables(spark, str(tmp_path / "tables")))
    with pytest.raises(Exception, match="not a sorted table"):
        sst.read_tables(spark, str(tmp_path / "tables"), paranoid=True).count()


def test_data_sources(spark, tmp_path):
    from kvlake.sources.datasource import register

    register(spark)
    (tmp_path / "000001.log").write_bytes(log(WriteBatch([(1, b"a", b"1"), (0, b"b", None)], 7).encode()))
    t = sst.TableBuilder(internal=True)
    t.add(C.put_internal(b"c", 3, 1), b"3")
    (tmp_path / "000002.sst").write_bytes(t.finish())
    rows = lambda kind: [(r.seq, r.kind, bytes(r.key), r.value and bytes(r.value)) for r in spark.read.format(kind).load(str(tmp_path)).collect()]
    assert rows("kvlake-log") == [(7, 1, b"a", b"1"), (8, 0, b"b", None)]
    assert rows("kvlake-table") == [(3, 1, b"c", b"3")]


@settings(deadline=None)
@given(st.dictionaries(st.binary(max_size=4), st.binary(max_size=9), max_size=50), st.integers(1, 5), st.lists(st.binary(max_size=5), max_size=9), st.sampled_from([1, 60, 4096]))
def test_both_ways(rows, restart, targets, block_size):
    """Blocks and tables from any place, upwards and downwards."""
    order = sorted(rows.items())
    b = sst.BlockBuilder(restart)
    t = sst.TableBuilder(block_size, restart)
    for k, v in order:
        b.add(k, v)
        t.add(k, v)
    for x in (sst.Block(b.finish()), sst.Table(t.finish())):
        assert list(x) == order and list(reversed(x)) == order[::-1]
        for at in targets + list(rows):
            assert list(x.from_(at)) == [e for e in order if e[0] >= at]
            assert list(x.below(at)) == [e for e in order if e[0] < at][::-1]


@given(st.binary(max_size=300), st.integers(0, 30))
def test_crc_of_parts(data, times):
    from kvlake.functions.crc import TABLE, crc32c

    def plain(data):
        crc = 0xFFFFFFFF
        for x in data:
            crc = TABLE[(crc ^ x) & 0xFF] ^ crc >> 8
        return crc ^ 0xFFFFFFFF

    data *= times
    assert crc32c(data) == plain(data)
    assert crc32c(data[99:], crc32c(data[:99])) == plain(data)


def test_own_filter_policy():
    """A policy by first letters: tables name it, and other readers do without."""

    class Letters:
        name = "letters"

        def create(self, keys):
            return bytes(sorted({k[0] for k in keys})) + b"."

        def may_match(self, key, data):
            asked.append(key)
            return key[0] in data[:-1]

    asked = []
    t = sst.TableBuilder(64, policy=Letters())
    for k in range(40):
        t.add(b"k%02d" % k, b"v")
    data = t.finish()
    own, other = sst.Table(data, policy=Letters()), sst.Table(data)
    assert own.filter is not None and other.filter is None
    assert own.get(b"k07") == other.get(b"k07") == b"v" and own.get(b"a") is other.get(b"a") is None
    assert asked == [b"k07", b"a"]
