"""Known answers of the scalar functions."""

import random
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kvlake.functions import keys as K
from kvlake.functions import numbers as N
from kvlake.functions.crc import _column, crc32c
from kvlake.model import Corruption, InvalidArgument, NotFound
from kvlake.sources import codec as C
from kvlake.sources import sst
from kvlake.sources.dump import escaped


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def b(x):
    return F.lit(bytearray(x))


def test_separators(spark):
    cases = [(b"alpha1zz", b"alpha3", b"alpha2"), (b"alpha", b"alphabet", b"alpha"), (b"alpha1", b"alpha2", b"alpha1"), (b"", b"x", b""), (b"\xff", b"\xff\x01", b"\xff"), (b"a\xff", b"b", b"a\xff")]
    for a, z, want in cases:
        assert bytes(one(spark, x=K.shortest_separator(b(a), b(z)))["x"]) == want == sst.separator(a, z)
    for a, want in [(b"\xff\x01\x02", b"\xff\x02"), (b"\xff\xff", b"\xff\xff"), (b"", b""), (b"abc", b"b")]:
        assert bytes(one(spark, x=K.short_successor(b(a)))["x"]) == want == sst.successor(a)
    assert one(spark, x=K.compare(b(b"alpha"), b(b"alphabet")), y=K.compare(b(b"bravo"), b(b"alphabet"))) == (-1, 1)


def test_hashes(spark):
    for data, want in [(b"", 0xBC9F1D34), (b"hello", 0xF795964E), (bytes.fromhex("62c397e299a5"), 0x728A4AF8)]:
        assert one(spark, x=N.hash32(b(data)))["x"] == want == sst.hash32(data)
    assert crc32c(b"123456789") == 0xE3069283
    assert _column([b"123456789", None, b"", b"a" * 100]) == [0xE3069283, None, 0, crc32c(b"a" * 100)]
    for v in (0, 1, 0xE3069283, 0xFFFFFFFF):
        r = one(spark, m=N.crc_mask(F.lit(v)), u=N.crc_unmask(N.crc_mask(F.lit(v))))
        assert r == (C.mask(v), v) and C.unmask(C.mask(v)) == v


@given(st.binary(max_size=40))
def test_bloom(key):
    f = sst.bloom([b"alpha", b"beta", key])
    assert sst.may_match(key, f) and sst.may_match(b"alpha", f)
    assert len(sst.bloom([key])) == 9 and sst.may_match(b"x", b"\0\0\x1f") and not sst.may_match(b"x", b"")


def test_bloom_columns(spark):
    bits = one(spark, x=N.bloom_bits(b(b"alpha"), F.lit(64), 6))["x"]
    assert bits == list(sst._bits(b"alpha", 64, 6))
    f = sst.bloom([b"alpha", b"beta", b"delta", b"epsilon"])
    assert not sst.may_match(b"omega", f) and not sst.may_match(b"theta", f)


def test_filter_blocks():
    fb = sst.FilterBlock()
    for offset, keys in ((0, [b"a", b"b"]), (3000, [b"c"]), (9000, [b"z"])):
        fb.start_block(offset)
        for k in keys:
            fb.add_key(k)
    data = fb.finish()
    assert sst.filter_may_match(data, 100, b"a") and sst.filter_may_match(data, 3000, b"c") and sst.filter_may_match(data, 9000, b"z")
    assert not sst.filter_may_match(data, 3000, b"a") and not sst.filter_may_match(data, 5000, b"a")
    assert sst.filter_may_match(data, 99_000, b"a") and sst.filter_may_match(b"", 0, b"a")


def test_text_and_numbers(spark):
    assert one(spark, x=K.escape(b(bytes.fromhex("410a00ff7e"))), y=K.escape(b(b"")))[:2] == ("A\\x0a\\x00\\xff~", "")
    r = one(spark, a=N.consume_decimal(F.lit("12345tail"))[1], b=N.consume_decimal(F.lit("tail"))[1], c=N.consume_decimal(F.lit("18446744073709551615"))[1], d=N.consume_decimal(F.lit("184467440737095516150"))[1])
    assert (int(r.a), r.b, int(r.c), r.d) == (12345, None, 2**64 - 1, None)
    for v in (0, 1, 127, 128, 255, 300, 16384, 2**32 - 1):
        assert one(spark, x=N.varint_length(F.lit(v)))["x"] == len(C.put_varint(v))
        assert C.get_varint(C.put_varint(v), 0) == (v, len(C.put_varint(v)))
        assert one(spark, x=K.fixed_value(K.fixed(F.lit(v), 8), F.lit(0), 8))["x"] == v
    for bad in (b"", b"\x80", b"\xff" * 11):
        with pytest.raises(Corruption):
            C.get_varint(bad, 0)


def test_escape_of_all_bytes_and_long_values(spark):
    """In step with the Python dump, and in time in proportion to the length: 30,000 bytes
    took over a minute when each was looked up by its place."""
    rng = random.Random(1)
    cases = [bytes([k]) for k in range(256)] + [bytes(range(256)), b"", b"\\x41$0", b" ~\x7f\x1f", "é\n\u2028".encode()]
    cases += [rng.randbytes(rng.randrange(60)) for _ in range(200)]
    frame = lambda values: spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in enumerate(values)], "k int, v binary")
    got = [r.x for r in frame([*cases, None]).select("k", K.escape(F.col("v")).alias("x")).orderBy("k").collect()]
    assert got == [*map(escaped, cases), None]
    long = rng.randbytes(30_000)
    began = time.monotonic()
    assert frame([long]).select(K.escape(F.col("v"))).first()[0] == escaped(long)
    assert time.monotonic() - began < 20


def test_internal_keys(spark):
    raw = K.internal_key(b(b"alpha"), F.lit(123), F.lit(1))
    p = K.internal_key_parts(raw)
    r = one(spark, raw=raw, **p)
    assert (bytes(r.raw), bytes(r.key), r.seq, r.kind, r.valid) == (C.put_internal(b"alpha", 123, 1), b"alpha", 123, 1, True)
    for bad in (b"12345", b"alpha" + bytes([2]) + bytes(7)):
        r = one(spark, **K.internal_key_parts(b(bad)))
        assert (r.valid, r.key) == (False, None)
    assert one(spark, x=K.debug_string(b(b"user-key"), F.lit(77), F.lit(0)))["x"] == "'user-key' @77 : 0"
    assert one(spark, x=K.internal_key_parts(K.internal_key(b(b""), F.lit((1 << 56) - 1), F.lit(0)))["seq"])["x"] == (1 << 56) - 1


def test_names(spark):
    cases = {"000012.log": (12, "log"), "000012.sst": (12, "table"), "7.ldb": (7, "table"), "MANIFEST-000003": (3, "manifest"), "CURRENT": (0, "current"), "LOCK": (0, "lock"), "LOG": (0, "info"), "LOG.old": (0, "info"), "1.dbtmp": (1, "temp")}
    cases |= dict.fromkeys(["", "foo", "12", ".log", "MANIFEST-", "MANIFEST-3x", "x.log", "99999999999999999999.log"], (None, None))
    for name, want in cases.items():
        n, k = N.parse_file_name(F.lit(name))
        assert one(spark, n=n, k=k) == want
    assert str(NotFound("missing", "file")) == "NotFound: missing: file" and str(NotFound()) == "NotFound" and InvalidArgument("x").code == "InvalidArgument"
