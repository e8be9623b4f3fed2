"""Text dumps of tables, logs and manifests, one line an entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import escape
from ..model import InvalidArgument
from . import codec as C
from .batch import WriteBatch
from .edits import VersionEdit
from .sst import Table
from .wal import records


def _quoted(c: str):
    return F.concat(F.lit("'"), escape(F.coalesce(F.col(c), F.lit(b""))), F.lit("'"))


def table_lines(ops: DataFrame) -> DataFrame:
    """Adds ``line`` to ops with binary key and value."""
    kind = F.when(F.col("kind") == 1, "val").otherwise("del")
    return ops.withColumn("line", F.concat(_quoted("key"), F.lit(" @ "), F.col("seq").cast("string"), F.lit(" : "), kind, F.lit(" => "), _quoted("value")))


def log_lines(ops: DataFrame) -> DataFrame:
    put = F.concat(F.lit("  put "), _quoted("key"), F.lit(" "), _quoted("value"))
    return ops.withColumn("line", F.when(F.col("kind") == 1, put).otherwise(F.concat(F.lit("  del "), _quoted("key"))))


def escaped(data: bytes) -> str:
    return "".join(chr(b) if 0x20 <= b <= 0x7E else f"\\x{b:02x}" for b in data)


def _edit_lines(e: VersionEdit):
    yield "VersionEdit {"
    labels = {"comparator": "Comparator", "log_number": "LogNumber", "prev_log_number": "PrevLogNumber", "next_file": "NextFile", "last_seq": "LastSeq"}
    yield from (f"  {label}: {getattr(e, n)}" for n, label in labels.items() if getattr(e, n) is not None)
    yield from (f"  CompactPointer: {level} {_tagged(key)}" for level, key in e.pointers)
    yield from (f"  RemoveFile: {level} {number}" for level, number in e.removed)
    yield from (f"  AddFile: {level} {number} {size} {_tagged(lo)} .. {_tagged(hi)}" for level, number, size, lo, hi in e.added)
    yield "}"


def _tagged(raw: bytes) -> str:
    try:
        key, seq, kind = C.get_internal(raw)
    except Exception:
        return f"(bad){escaped(raw)}"
    return f"'{escaped(key)}' @{seq} : {kind}"


def dump(name: str, content: bytes) -> list[str]:
    """Lines of one file, by the kind that its name tells."""
    if name.endswith(".log"):
        out = []
        for offset, record in records(content, report=lambda n, why: out.append(f"corruption: {n} bytes; {why}")):
            if len(record) < 12:
                out.append(f"--- offset {offset}; record of {len(record)} bytes is too small")
                continue
            b = WriteBatch.decode(record)
            out.append(f"--- offset {offset}; sequence {b.seq}")
            out += [f"  put '{escaped(k)}' '{escaped(v)}'" if kind else f"  del '{escaped(k)}'" for kind, k, v in b.ops]
        return out
    if name.startswith("MANIFEST-"):
        return [line for offset, r in records(content) for line in (f"--- offset {offset};", *_edit_lines(VersionEdit.decode(r)))]
    if name.endswith((".sst", ".ldb")):
        out = []
        for raw, value in Table(content):
            try:
                key, seq, kind = C.get_internal(raw)
                out.append(f"'{escaped(key)}' @ {seq} : {'val' if kind else 'del'} => '{escaped(value)}'")
            except Exception:
                out.append(f"badkey '{escaped(raw)}' => '{escaped(value)}'")
        return out
    raise InvalidArgument(name, "unknown file type")
