"""Numbers, hashes and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import byte_at

MASK = 0xFFFFFFFF
MULTIPLIER, BLOOM_SEED = 0xC6A4A793, 0xBC9F1D34
FILE_KINDS = ("log", "table", "temp", "manifest", "current", "lock", "info")


def wrap32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def mul32(x: Column, factor: int) -> Column:
    """Product modulo 2**32; in halves, since ANSI arithmetic refuses to overflow."""
    high, low = factor >> 16, factor & 0xFFFF
    return wrap32(x * low + F.shiftleft((x * high).bitwiseAND(F.lit(0xFFFF)), 16))


def _fold(step, value: Column) -> Column:
    return F.transform(F.array(value), step)[0]


def hash32(data: Column, seed: int = BLOOM_SEED) -> Column:
    """The 32-bit hash behind the bloom filters: words of four bytes, little-endian,
    are added, multiplied and folded; up to three bytes remain for a last round."""
    n = F.length(data)
    start = F.lit(seed).cast("long").bitwiseXOR(mul32(n.cast("long"), MULTIPLIER))
    at = lambda k: byte_at(data, k).cast("long")

    def word(h: Column, i: Column) -> Column:
        k = i * 4
        w = at(k) + F.shiftleft(at(k + 1), 8) + F.shiftleft(at(k + 2), 16) + F.shiftleft(at(k + 3), 24)
        return _fold(lambda x: x.bitwiseXOR(F.shiftright(x, 16)), mul32(wrap32(h + w), MULTIPLIER))

    words = (n / 4).cast("int")
    body = F.when(words > 0, F.aggregate(F.sequence(F.lit(0), words - 1), start, word)).otherwise(start)
    rest, k = n % 4, words * 4
    tail = F.when(rest >= 1, at(k)).otherwise(F.lit(0).cast("long"))
    tail = tail + F.when(rest >= 2, F.shiftleft(at(k + 1), 8)).otherwise(0) + F.when(rest >= 3, F.shiftleft(at(k + 2), 16)).otherwise(0)
    last = _fold(lambda h: h.bitwiseXOR(F.shiftright(h, 24)), mul32(wrap32(body + tail), MULTIPLIER))
    return F.when(rest == 0, body).otherwise(last)


def bloom_probes(bits_per_key: int) -> int:
    return min(30, max(1, int(bits_per_key * 0.69)))


def bloom_size(keys: int, bits_per_key: int) -> int:
    """Bits of a filter: a whole number of bytes, 64 at least."""
    return -(-max(64, keys * bits_per_key) // 8) * 8


def bloom_bits(data: Column, bits: Column, probes: int) -> Column:
    """Bit positions of a key: the hash, moved on by its rotation for each probe."""
    def of(h: Column) -> Column:
        delta = F.shiftright(h, 17).bitwiseOR(wrap32(F.shiftleft(h, 15)))
        return F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda j: wrap32(h + delta * j) % bits)

    return _fold(of, hash32(data))


def crc_mask(crc: Column) -> Column:
    """Rotated right by 15 bits, plus a constant."""
    rotated = F.shiftright(crc, 15).bitwiseOR(wrap32(F.shiftleft(crc, 17)))
    return wrap32(rotated + F.lit(0xA282EAD8))


def crc_unmask(masked: Column) -> Column:
    x = wrap32(masked + F.lit((1 << 32) - 0xA282EAD8))
    return F.shiftright(x, 17).bitwiseOR(wrap32(F.shiftleft(x, 15)))


def varint_length(value: Column) -> Column:
    """Bytes of a base-128 integer of this value."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("long")


def consume_decimal(text: Column) -> tuple[Column, Column]:
    """Leading digits and their value; null if there are none or 64 bits do not hold it."""
    digits = F.regexp_extract(text, "^[0-9]+", 0)
    value = F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 20, digits).try_cast("decimal(38,0)")
    fits = (digits != "") & (value <= F.lit(str((1 << 64) - 1)).cast("decimal(38,0)"))
    return F.when(fits, digits), F.when(fits, value.cast("decimal(20,0)"))


def file_name(number: Column, kind: str) -> Column:
    if kind == "manifest":
        return F.format_string("MANIFEST-%06d", number)
    return F.format_string({"log": "%06d.log", "table": "%06d.sst", "temp": "%06d.dbtmp"}[kind], number)


def parse_file_name(name: Column) -> tuple[Column, Column]:
    """(number, kind) of a file name, both null if it is none of ours."""
    plain = F.regexp_extract(name, r"^([0-9]+)\.(log|sst|ldb|dbtmp)$", 1)
    suffix = F.regexp_extract(name, r"^([0-9]+)\.(log|sst|ldb|dbtmp)$", 2)
    manifest = F.regexp_extract(name, r"^MANIFEST-([0-9]+)$", 1)
    kind = (
        F.when(name == "CURRENT", "current").when(name == "LOCK", "lock").when(name.isin("LOG", "LOG.old"), "info")
        .when(manifest != "", "manifest").when(suffix == "log", "log").when(suffix.isin("sst", "ldb"), "table").when(suffix == "dbtmp", "temp")
    )
    number = F.when(kind.isin("current", "lock", "info"), F.lit(0)).otherwise(F.concat(plain, manifest).try_cast("long"))
    return F.when(number.isNotNull(), number).cast("long"), F.when(number.isNotNull(), kind)


def lehmer(seed: Column, steps: Column) -> Column:
    """The random number ``steps`` after a seed: 16807 x modulo 2**31 - 1."""
    start = seed.cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    start = F.when(start.isin(0, 2147483647), 1).otherwise(start).cast("long")
    return F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), steps), start, lambda x, _: x * 16807 % 2147483647)).otherwise(start)


def uniform(number: Column, n: int) -> Column:
    """A number of ``lehmer`` below n."""
    return number % n


def one_in(number: Column, n: int) -> Column:
    return number % n == 0


def skewed(number: Column, following: Column, max_log: int) -> Column:
    """Small numbers more often: one bit length of ``max_log`` or less, then a number of it."""
    return following % F.pow(F.lit(2), number % (max_log + 1)).cast("long")


def now_micros() -> Column:
    """Microseconds since 1970, one value for the whole query."""
    return F.unix_micros(F.current_timestamp())


def log_bucket(value: Column) -> Column:
    """Histogram bucket, four for each doubling."""
    return F.when(value <= 1, 0).otherwise(F.least(F.lit(127), F.ceil(F.log2(value) * 4))).cast("long")
