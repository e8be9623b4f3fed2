"""Byte-order functions on keys, as column expressions over BINARY."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in unsigned byte order."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def byte_at(key: Column, index: Column) -> Column:
    """Unsigned value of one byte, counted from 0."""
    return F.conv(F.hex(F.substring(key, index + 1, F.lit(1))), 16, 10).cast("int")


def byte_of(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading bytes that are equal."""
    n = F.least(F.length(a), F.length(b))
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.get(at, F.lit(0)) - 1, n)).cast("int")


def shortest_separator(start: Column, limit: Column) -> Column:
    """The shortest key in [start, limit) that raising one byte of ``start`` can give:
    its first byte that differs, if it stays below that of ``limit``; else ``start``."""
    k = common_prefix(start, limit)
    both = k < F.least(F.length(start), F.length(limit))
    low, high = byte_at(start, k), byte_at(limit, k)
    shorter = F.concat(F.substring(start, F.lit(1), k), byte_of(low + 1))
    return F.when(both & (low < 255) & (low + 1 < high), shorter).otherwise(start)


def short_successor(key: Column) -> Column:
    """A short key not below this one: the first byte other than FF is raised by one
    and ends the key; a key of FF bytes alone stays."""
    h = F.hex(key)
    head = F.regexp_extract(h, "^((?:FF)*)", 1)
    k = (F.length(head) / 2).cast("int")
    raised = F.concat(F.substring(key, F.lit(1), k), byte_of(byte_at(key, k) + 1))
    return F.when(k >= F.length(key), key).otherwise(raised)


def fixed(value: Column, width: int) -> Column:
    """Little-endian bytes of a non-negative integer; 4 or 8 bytes."""
    h = F.lpad(F.hex(value.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(width)))))


def fixed_value(data: Column, offset: Column, width: int) -> Column:
    """The integer whose little-endian bytes begin at ``offset``; 8 bytes must fit LONG."""
    parts = [F.hex(F.substring(data, offset + (k + 1), F.lit(1))) for k in reversed(range(width))]
    return F.conv(F.concat(*parts), 16, 10).cast("decimal(20,0)").cast("long")


def internal_key(key: Column, seq: Column, kind: Column) -> Column:
    """User key and 8 bytes of (seq << 8 | kind).  The tag is written in two halves, so
    that 56-bit sequences stay inside LONG."""
    return F.concat(key, byte_of(kind), F.substring(fixed(seq, 8), 1, 7))


def internal_key_parts(data: Column) -> dict[str, Column]:
    """``key``, ``seq``, ``kind`` and ``valid`` of an internal key: at least 8 bytes and a
    known kind."""
    n = F.length(data)
    kind = byte_at(data, n - 8)
    valid = (n >= 8) & F.coalesce(kind <= 1, F.lit(False))
    parts = [F.hex(F.substring(data, n - k, F.lit(1))) for k in range(7)]
    seq = F.conv(F.concat(*parts), 16, 10).cast("long")
    ok = lambda c: F.when(valid, c)
    return {"key": ok(F.substring(data, F.lit(1), n - 8)), "seq": ok(seq), "kind": ok(kind), "valid": valid}


def debug_string(key: Column, seq: Column, kind: Column) -> Column:
    return F.concat(F.lit("'"), escape(key), F.lit("' @"), seq.cast("string"), F.lit(" : "), kind.cast("string"))


def escape(data: Column) -> Column:
    """Printable ASCII as it is, all other bytes as a backslash, x and two hex digits."""
    text = F.decode(data, "ISO-8859-1")  # a character for each byte
    runs = F.regexp_extract_all(text, F.lit("[ -~]+|[^ -~]+"), F.lit(0))
    coded = lambda run: F.regexp_replace(F.lower(F.hex(F.encode(run, "ISO-8859-1"))), "..", r"\\x$0")
    parts = F.transform(runs, lambda run: F.when(F.substring(run, 1, 1).between(" ", "~"), run).otherwise(coded(run)))
    return F.when(text.rlike("[^ -~]"), F.array_join(parts, "")).otherwise(text)
