"""Write batches: an ordered list of puts and deletes that take consecutive sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import varint_length
from ..model import DELETE, OPS, PUT, Corruption
from . import codec as C

HEADER = 12


class WriteBatch:
    def __init__(self, ops=(), seq: int = 0):
        self.ops: list[tuple[int, bytes, bytes | None]] = list(ops)
        self.seq = seq

    def put(self, key: bytes, value: bytes) -> WriteBatch:
        self.ops.append((PUT, bytes(key), bytes(value)))
        return self

    def delete(self, key: bytes) -> WriteBatch:
        self.ops.append((DELETE, bytes(key), None))
        return self

    def clear(self) -> None:
        self.ops.clear()

    def append(self, other: WriteBatch) -> WriteBatch:
        self.ops.extend(other.ops)
        return self

    def count(self) -> int:
        return len(self.ops)

    def approximate_size(self) -> int:
        return len(self.encode())

    def iterate(self, handler) -> None:
        """Calls ``handler.put(key, value)`` and ``handler.delete(key)`` in order."""
        for kind, key, value in self.ops:
            handler.put(key, value) if kind == PUT else handler.delete(key)

    def encode(self) -> bytes:
        parts = [C.U64.pack(self.seq), C.U32.pack(len(self.ops))]
        for kind, key, value in self.ops:
            parts += [bytes([kind]), C.put_slice(key)] + ([C.put_slice(value)] if kind == PUT else [])
        return b"".join(parts)

    @classmethod
    def decode(cls, data: bytes) -> WriteBatch:
        if len(data) < HEADER:
            raise Corruption("batch is too small")
        out, at = cls(seq=C.U64.unpack_from(data)[0]), HEADER
        while at < len(data):
            kind, (key, at) = data[at], C.get_slice(data, at + 1)
            if kind == PUT:
                value, at = C.get_slice(data, at)
                out.put(key, value)
            elif kind == DELETE:
                out.delete(key)
            else:
                raise Corruption("unknown tag in batch")
        if len(out.ops) != C.U32.unpack_from(data, 8)[0]:
            raise Corruption("batch has wrong count")
        return out


def encoded_size(ops: DataFrame) -> DataFrame:
    """Bytes of one batch of these operations (kind, key, value)."""
    part = lambda c: varint_length(F.length(c).cast("long")) + F.length(c)
    one = 1 + part("key") + F.when(F.col("kind") == PUT, part("value")).otherwise(0)
    return ops.agg((F.lit(HEADER) + F.coalesce(F.sum(one), F.lit(0))).cast("long").alias("bytes"))


def encode_batches(ops: DataFrame, by: str, order: str) -> DataFrame:
    """(``by``, content): one encoded batch of the ops (seq, kind, key, value) of each value
    of ``by``, in the order of ``order``; its first sequence is theirs."""

    def run(key, rows):
        rows = rows.sort_by(order)
        b = WriteBatch(zip(*(rows[c].to_pylist() for c in ("kind", "key", "value"))), rows["seq"][0].as_py())
        return pa.table({by: rows[by].slice(0, 1), "content": pa.array([b.encode()], pa.binary())})

    kind = T.StructType([ops.schema[by], T.StructField("content", T.BinaryType())])
    return ops.groupBy(by).applyInArrow(run, kind)


def batch_rows(batches: DataFrame, content: str = "content") -> DataFrame:
    """The ops of encoded batches as rows (seq, kind, key, value); a broken batch is an error."""

    def run(tables):
        for t in tables:
            for raw in t.column(0):
                b = WriteBatch.decode(raw.as_py())
                kind, key, value = zip(*b.ops) if b.ops else ((), (), ())
                seq = range(b.seq, b.seq + len(b.ops))
                yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(kind, pa.int8()), pa.array(key, pa.binary()), pa.array(value, pa.binary())], names=OPS.names)

    return batches.select(content).mapInArrow(run, OPS)
