"""Vectorised scans over the UTF-8 bytes of whole Arrow string batches.

Every character outside ASCII is made of bytes >= 0x80, so an ASCII character
class has the same runs on bytes as on code points.  Tokens of all texts of a
slice are found with a handful of numpy passes instead of a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20  # texts are scanned in slices of about this many bytes; arrays of a slice take some 50 times that
_TABLES: dict = {}
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the one of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_table(kind: str) -> np.ndarray:
    """Class of each byte, 0 being no part of a token.

    ``alnum``: 0-9 A-Z a-z and everything outside ASCII.  ``space``: whatever is
    not ASCII white space.  ``runs``: as ``space``, but letters and digits are
    one class and symbols another, so that ``word***`` gives two tokens.
    ``line``: whatever is not a line feed.
    """
    if kind not in _TABLES:
        t = np.zeros(256, np.uint8)
        alnum = np.r_[48:58, 65:91, 97:123, 128:256]
        if kind == "alnum":
            t[alnum] = 1
        elif kind == "space":
            t[:] = 1
            t[np.r_[9:14, 32]] = 0
        elif kind == "runs":
            t[:] = 2
            t[alnum] = 1
            t[np.r_[9:14, 32]] = 0
        elif kind == "line":
            t[:] = 1
            t[10] = 0
        else:
            raise ValueError(kind)
        _TABLES[kind] = t
    return _TABLES[kind]


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    if "fold" not in _TABLES:
        t = np.arange(256, dtype=np.uint8)
        t[65:91] = t[97:123]
        _TABLES["fold"] = t
    return _TABLES["fold"][data]


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


class Tokens:
    """Tokens of the texts of one slice: ``start``, ``end`` (byte offsets in the
    slice), ``doc`` (index of the text) and ``first`` (n + 1 token offsets)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        if len(data) == 0:
            self.start = self.end = self.doc = np.zeros(0, np.int64)
            self.first = np.zeros(self.n + 1, np.int64)
            return
        cls = word_table(kind)[data]
        cut = np.empty(len(data), bool)
        cut[0] = True
        np.not_equal(cls[1:], cls[:-1], out=cut[1:])
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        at = np.flatnonzero(cut)
        end = np.append(at[1:], len(data))
        keep = cls[at] != 0
        self.start, self.end = at[keep], end[keep]
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, fold: bool) -> np.ndarray:
        """64-bit hash of each token's bytes; with ``fold`` A-Z count as a-z."""
        return span_hashes(self.data, self.start, self.end, fold)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hash of the bytes of each span.

    The up to 16 bytes of a short span are taken as two whole numbers, which are
    mixed; longer ones go through xxh3.
    """
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    if "mask" not in _TABLES:
        _TABLES["mask"] = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    mask, n = _TABLES["mask"], len(data)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = folded(data) if fold else data
    eight = np.ndarray(n + 9, "<u8", padded, strides=(1,))  # the eight bytes that begin at each byte
    size = end - start
    low = eight[start] & mask[np.minimum(size, 8)]
    high = eight[np.minimum(start + 8, n)] & mask[np.clip(size - 8, 0, 8)]
    with np.errstate(over="ignore"):
        h = mix64(mix64(low ^ np.uint64(0x8EBC6AF09C88C6E3)) + mix64(high ^ np.uint64(0x589965CC75374CC3)) * _ODD + size.astype(np.uint64))
    long = np.flatnonzero(size > 16)
    if len(long):
        raw = memoryview(padded)
        h[long] = [xxhash.xxh3_64_intdigest(raw[x:y]) for x, y in zip(start[long].tolist(), end[long].tolist())]
    return h


def windows(tokens: Tokens, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first token and the hash of each window of ``width`` tokens inside a text."""
    m = len(hashes) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = tokens.doc[:m] == tokens.doc[width - 1 :]
    with np.errstate(over="ignore"):
        h = hashes[:m] * _ODD
        for j in range(1, width):
            h = (h + hashes[j : m + j]) * _ODD
    at = np.flatnonzero(inside)
    return at, mix64(h[at])


def per_doc(tokens: Tokens, values: np.ndarray) -> np.ndarray:
    """Sum over the tokens of each text of a value per token."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[tokens.first[1:]] - total[tokens.first[:-1]]


def bytes_per_doc(offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Number of set flags (one a byte) in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))
