"""Byte-level codecs: variable-length integers, length-prefixed bytes, CRC framing."""

from __future__ import annotations

from ..functions.crc import crc32c
from ..model import Corruption


class Fixed:
    """Little-endian integers of a fixed width."""

    def __init__(self, width: int):
        self.width = width

    def pack(self, value: int) -> bytes:
        return value.to_bytes(self.width, "little")

    def unpack_from(self, data: bytes, at: int = 0) -> tuple[int]:
        if at < 0 or at + self.width > len(data):
            raise Corruption("bytes are cut short")
        return (int.from_bytes(data[at : at + self.width], "little"),)

    unpack = unpack_from


U32, U64 = Fixed(4), Fixed(8)


def put_varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def get_varint(data: bytes, at: int, bits: int = 64) -> tuple[int, int]:
    """(value, next position); Corruption if it is cut short or too long."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > bits - 1 - (bits - 1) % 7:
            raise Corruption("bad varint")
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            if value >> bits:
                raise Corruption("varint too large")
            return value, at
        shift += 7


def put_slice(data: bytes) -> bytes:
    return put_varint(len(data)) + data


def get_slice(data: bytes, at: int) -> tuple[bytes, int]:
    n, at = get_varint(data, at, 32)
    if at + n > len(data):
        raise Corruption("bytes are cut short")
    return data[at : at + n], at + n


def mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def unmask(masked: int) -> int:
    x = (masked - 0xA282EAD8) & 0xFFFFFFFF
    return (x >> 17 | x << 15) & 0xFFFFFFFF


def checked(data: bytes, crc: int) -> bool:
    return unmask(crc) == crc32c(data)


def put_internal(key: bytes, seq: int, kind: int) -> bytes:
    return key + U64.pack(seq << 8 | kind)


def get_internal(data: bytes) -> tuple[bytes, int, int]:
    if len(data) < 8 or data[-8] > 1:
        raise Corruption("bad internal key")
    tag = U64.unpack(data[-8:])[0]
    return data[:-8], tag >> 8, tag & 0xFF
