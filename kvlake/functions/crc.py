"""CRC-32C (Castagnoli): Spark has only the other polynomial."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_POLY = 0x82F63B78


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (_POLY if n & 1 else 0)
        out.append(n)
    return out


TABLE = _table()


_SPAN = 4096
_wide: list[np.ndarray] = []


def _shifted() -> np.ndarray:
    """Row k: what each byte adds to a CRC when k bytes follow it.  The CRC is linear, so
    those of all bytes of a span are looked up at once and their XOR is its own."""
    if not _wide:
        out = np.empty((_SPAN, 256), np.uint32)
        out[0] = TABLE
        for k in range(1, _SPAN):
            out[k] = out[0][out[k - 1] & 0xFF] ^ out[k - 1] >> np.uint32(8)
        _wide.append(out)
    return _wide[0]


def crc32c(data: bytes, crc: int = 0) -> int:
    crc ^= 0xFFFFFFFF
    at = 0
    while len(data) - at >= 64:  # the CRC so far goes into the first four bytes
        span = np.frombuffer(data, np.uint8, min(_SPAN, len(data) - at), at).copy()
        span[:4] ^= np.frombuffer(crc.to_bytes(4, "little"), np.uint8)
        n = len(span)
        crc = int(np.bitwise_xor.reduce(_shifted()[np.arange(n - 1, -1, -1), span]))
        at += n
    for b in data[at:]:
        crc = TABLE[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def _column(values: list[bytes | None]) -> list[int | None]:
    """All values at once, byte by byte: one table look-up for each position."""
    table = np.array(TABLE, np.uint32)
    size = np.array([len(v) if v is not None else 0 for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    data = np.frombuffer(b"".join(v or b"" for v in values), np.uint8)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])[order]
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    ordered = size[order]
    live = len(values)
    for k in range(int(ordered[0]) if len(ordered) else 0):
        live = int(np.searchsorted(-ordered, -k, "left"))  # those longer than k come first
        c = crc[:live]
        crc[:live] = table[(c ^ data[start[:live] + k]) & 0xFF] ^ (c >> np.uint32(8))
    out = np.empty(len(values), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return [None if v is None else int(x) for v, x in zip(values, out)]


@F.pandas_udf(T.LongType())
def crc32c_col(data: pd.Series) -> pd.Series:
    return pd.Series(_column(data.tolist()), dtype="Int64")
