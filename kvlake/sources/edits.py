"""Version edits: the records of a manifest log."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ..model import Corruption
from . import codec as C

#: Tags of the single values, in the order in which they are written.
SCALARS = {"comparator": 1, "log_number": 2, "prev_log_number": 9, "next_file": 3, "last_seq": 4}
POINTER, REMOVED, ADDED = 5, 6, 7
LEVELS = 7


@dataclass
class VersionEdit:
    comparator: str | None = None
    log_number: int | None = None
    prev_log_number: int | None = None
    next_file: int | None = None
    last_seq: int | None = None
    pointers: list[tuple[int, bytes]] = field(default_factory=list)
    removed: list[tuple[int, int]] = field(default_factory=list)
    added: list[tuple[int, int, int, bytes, bytes]] = field(default_factory=list)  # level, number, size, smallest, largest

    def encode(self) -> bytes:
        v, out = C.put_varint, []
        for name, tag in SCALARS.items():
            value = getattr(self, name)
            if value is not None:
                out.append(v(tag) + (C.put_slice(value.encode()) if name == "comparator" else v(value)))
        out += [v(POINTER) + v(level) + C.put_slice(key) for level, key in self.pointers]
        out += [v(REMOVED) + v(level) + v(number) for level, number in self.removed]
        out += [v(ADDED) + v(level) + v(number) + v(size) + C.put_slice(lo) + C.put_slice(hi) for level, number, size, lo, hi in self.added]
        return b"".join(out)

    @classmethod
    def decode(cls, data: bytes) -> VersionEdit:
        out, at = cls(), 0
        names = {tag: name for name, tag in SCALARS.items()}

        def number() -> int:
            nonlocal at
            value, at = C.get_varint(data, at)
            return value

        def piece() -> bytes:
            nonlocal at
            value, at = C.get_slice(data, at)
            return value

        def level() -> int:
            n = number()
            if n >= LEVELS:
                raise Corruption("VersionEdit", "level")
            return n

        while at < len(data):
            tag = number()
            if tag in names:
                setattr(out, names[tag], piece().decode() if names[tag] == "comparator" else number())
            elif tag == POINTER:
                out.pointers.append((level(), piece()))
            elif tag == REMOVED:
                out.removed.append((level(), number()))
            elif tag == ADDED:
                out.added.append((level(), number(), number(), piece(), piece()))
            else:
                raise Corruption("VersionEdit", "unknown tag")
        return out


def fold(edits: list[VersionEdit]) -> dict:
    """Live files (level, number) and the last values after all edits; a file that is
    added again after its removal is live."""
    live: dict = {}
    last: dict = {}
    for e in edits:
        for key in e.removed:
            live.pop(key, None)
        for level, number, size, lo, hi in e.added:
            live[level, number] = (size, lo, hi)
        last |= {n: getattr(e, n) for n in SCALARS if getattr(e, n) is not None}
        last.setdefault("pointers", {}).update(e.pointers)
    return {"files": live, **last}


def encode_files(files: DataFrame) -> DataFrame:
    """(level, content): an edit that adds the files (level, file_no, file_size, lo, hi) of
    each level.  A level's metadata fits a task, as it fits the process that opens a store."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("file_no")
        e = VersionEdit(added=list(zip(*(rows[c].to_pylist() for c in ("level", "file_no", "file_size", "lo", "hi")))))
        return pa.table({"level": rows["level"].slice(0, 1), "content": pa.array([e.encode()], pa.binary())})

    return files.groupBy("level").applyInArrow(run, "level long, content binary")


def decode_files(edits: DataFrame) -> DataFrame:
    """Files that each edit leaves."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(0):
                rows = [(level, number, *rest) for (level, number), rest in fold([VersionEdit.decode(raw.as_py())])["files"].items()]
                cols = zip(*rows) if rows else ((), (), (), (), ())
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["level", "file_no", "file_size", "lo", "hi"])

    return edits.select("content").mapInArrow(run, "level long, file_no long, file_size long, lo binary, hi binary")
