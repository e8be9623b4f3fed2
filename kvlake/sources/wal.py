"""Write-ahead logs: records cut to fragments in blocks of 32 KiB.

A fragment has a header of 7 bytes (masked CRC of type and data, length, type) and is a
whole record or the first, a middle or the last part of one; fewer than 7 bytes at the
end of a block are zeros.  Reading skips what its checksum contradicts and reports how
many bytes that cost; a record without its end at the end of the log is no error.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.crc import crc32c
from ..model import OPS, Corruption
from . import codec as C
from .batch import WriteBatch

BLOCK, HEADER = 32768, 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4
LOG_BYTES = 4 << 20


class LogWriter:
    def __init__(self, start: int = 0):
        self.parts: list[bytes] = []
        self.size = start

    def add(self, record: bytes) -> None:
        at, begin = 0, True
        while begin or at < len(record):
            room = BLOCK - self.size % BLOCK
            if room < HEADER:
                self._emit(b"\0" * room)
                room = BLOCK
            piece = record[at : at + room - HEADER]
            at += len(piece)
            end = at == len(record)
            kind = (FULL if end else FIRST) if begin else (LAST if end else MIDDLE)
            crc = C.mask(crc32c(bytes([kind]) + piece))
            self._emit(C.U32.pack(crc) + len(piece).to_bytes(2, "little") + bytes([kind]) + piece)
            begin = False

    def _emit(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)

    def getvalue(self) -> bytes:
        return b"".join(self.parts)


def fragments(data: bytes, verify: bool = True, report=None):
    """(offset, type, bytes) of the physical fragments; ``report(bytes, reason)`` hears
    of what is dropped."""
    report = report or (lambda n, why: None)
    for block in range(0, len(data), BLOCK):
        end, at = min(block + BLOCK, len(data)), block
        while at + HEADER <= end:
            crc, n, kind = C.U32.unpack_from(data, at)[0], int.from_bytes(data[at + 4 : at + 6], "little"), data[at + 6]
            if kind == 0 and n == 0:
                break  # zeros that were allocated and not written
            if at + HEADER + n > end:
                if end < len(data) or end - block == BLOCK:
                    report(end - at, "bad record length")
                break  # at the end of the log: a write that did not finish
            if verify and not C.checked(data[at + 6 : at + HEADER + n], crc):
                report(end - at, "checksum mismatch")
                break
            yield at, kind, data[at + HEADER : at + HEADER + n]
            at += HEADER + n


def records(data: bytes, verify: bool = True, report=None, initial_offset: int = 0):
    """(offset, record) of the logical records that begin at or after ``initial_offset``."""
    report = report or (lambda n, why: None)
    parts, start = [], None
    for at, kind, piece in fragments(data, verify, report):
        if kind in (FULL, FIRST):
            if start is not None:
                report(sum(map(len, parts)), "partial record without end")
            parts, start = [piece], at
        elif kind in (MIDDLE, LAST):
            if start is None:
                if at >= initial_offset:
                    report(len(piece), "missing start of fragmented record")
                continue
            parts.append(piece)
        else:
            report(len(piece), "unknown record type")
            parts, start = [], None
        if kind in (FULL, LAST) and start is not None:
            if start >= initial_offset:
                yield start, b"".join(parts)
            parts, start = [], None


def reassemble(physical: DataFrame, by: str) -> DataFrame:
    """Logical records of fragments (offset, type, data) in a table: each fragment of
    type full or first begins an island of the fragments after it.  ``by`` names the
    log; a log is bounded by the write buffer, so its fragments fit a task."""
    w = Window.partitionBy(by).orderBy("offset")
    begins = F.col("type").isin(FULL, FIRST)
    rows = physical.withColumn("_island", F.sum(F.when(begins, 1).otherwise(0)).over(w)).where("_island > 0")
    part = F.struct("offset", "type", "data")
    got = rows.groupBy(by, "_island").agg(F.sort_array(F.collect_list(part)).alias("p"))
    whole = got.where(F.element_at("p", -1)["type"].isin(FULL, LAST))
    empty = F.lit("") if dict(physical.dtypes)["data"] == "string" else F.lit(b"")
    return whole.select(by, F.col("p")[0]["offset"].alias("offset"), F.aggregate("p", empty, lambda a, x: F.concat(a, x["data"])).alias("data"))


def log_of(ops, limit: int = LOG_BYTES):
    """Log contents for ops (seq, kind, key, value): runs of consecutive sequences are
    batches of up to a thousand; a log ends at ``limit`` bytes."""
    log, batch = LogWriter(), WriteBatch()
    for seq, kind, key, value in ops:
        if batch.ops and (seq != batch.seq + len(batch.ops) or len(batch.ops) >= 1000):
            log.add(batch.encode())
            batch = WriteBatch()
            if log.size >= limit:
                yield log.getvalue()
                log = LogWriter()
        if not batch.ops:
            batch.seq = seq
        batch.ops.append((kind, key, value))
    if batch.ops:
        log.add(batch.encode())
    if log.size:
        yield log.getvalue()


def write_wal(ops: DataFrame, path: str) -> None:
    """A folder of logs, as a table (name, content): Spark can write no loose binary
    files, and this form works in any store.  ``export`` makes plain files of it."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("seq", "kind", "key", "value"))))
        for k, content in enumerate(log_of(rows)):
            yield pa.RecordBatch.from_arrays([pa.array([f"{task * 100_000 + k + 1:06d}.log"]), pa.array([content], pa.binary())], names=["name", "content"])

    ops.select("seq", "kind", "key", "value").mapInArrow(run, "name string, content binary").write.parquet(path)


def decode_logs(files: DataFrame, paranoid: bool = False) -> DataFrame:
    """Ops of logs (content).  A broken batch is dropped as a whole, or is an error
    with ``paranoid``."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []

                def complain(n, why):
                    if paranoid:
                        raise Corruption(why, f"{n} bytes")

                for _, record in records(content.as_py(), report=complain):
                    try:
                        b = WriteBatch.decode(record)
                    except Corruption:
                        if paranoid:
                            raise
                        continue
                    out += [(b.seq + k, *op) for k, op in enumerate(b.ops)]
                seq, kind, key, value = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(kind, pa.int8()), pa.array(key, pa.binary()), pa.array(value, pa.binary())], names=OPS.names)

    return files.select("content").mapInArrow(run, OPS)


def read_wal(spark: SparkSession, path: str, paranoid: bool = False) -> DataFrame:
    """Ops of a folder that ``write_wal`` has written."""
    return decode_logs(spark.read.parquet(path), paranoid)


def read_log_files(spark: SparkSession, path: str, paranoid: bool = False) -> DataFrame:
    """Ops of plain log files below a path, in any file system that Spark reads."""
    return decode_logs(spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(path), paranoid)
