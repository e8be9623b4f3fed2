"""``spark.read.format("kvlake-log")`` and ``"kvlake-table"``: op rows of foreign files.

Each file is one partition.  Paths are opened through ``pyarrow.fs``, so local paths and
the stores that pyarrow knows work; for any other file system use ``read_log_files`` and
``read_tables``, which let Spark open the files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..model import OPS, Corruption
from . import codec as C
from .batch import WriteBatch
from .sst import Table
from .wal import records


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _number(info) -> tuple[int, str]:
    """Files in the order of their numbers, as logs are replayed."""
    head = info.base_name.partition(".")[0]
    return (int(head) if head.isdigit() else -1), info.path


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffixes: tuple[str, ...], decode, paranoid: bool):
        self.path, self.suffixes, self.decode, self.paranoid = path, suffixes, decode, paranoid

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self):
        from pyarrow import fs

        at, path = self._fs()
        info = at.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else at.get_file_info(fs.FileSelector(path))
        return [_File(f.path) for f in sorted(found, key=_number) if f.type == fs.FileType.File and f.path.endswith(self.suffixes)]

    def read(self, part):
        if part is None:  # an empty folder
            return
        with self._fs()[0].open_input_stream(part.path) as f:
            content = f.read()
        try:
            yield from self.decode(content, self.paranoid)
        except Corruption:
            if self.paranoid:
                raise


def _log_rows(content: bytes, paranoid: bool):
    def complain(n, why):
        if paranoid:
            raise Corruption(why, f"{n} bytes")

    for _, record in records(content, report=complain):
        b = WriteBatch.decode(record)
        for k, (kind, key, value) in enumerate(b.ops):
            yield b.seq + k, kind, key, value


def _table_rows(content: bytes, paranoid: bool):
    for raw, value in Table(content):
        key, seq, kind = C.get_internal(raw)
        yield seq, kind, key, value if kind else None


class _Source(DataSource):
    suffixes: tuple[str, ...] = ()
    decode = None

    def schema(self):
        return OPS

    def reader(self, schema):
        return _Reader(self.options["path"], self.suffixes, type(self).decode, self.options.get("paranoid", "false") == "true")


class LogSource(_Source):
    suffixes, decode = (".log",), staticmethod(_log_rows)

    @classmethod
    def name(cls):
        return "kvlake-log"


class TableSource(_Source):
    suffixes, decode = (".sst", ".ldb"), staticmethod(_table_rows)

    @classmethod
    def name(cls):
        return "kvlake-table"


def register(spark: SparkSession) -> None:
    for source in (LogSource, TableSource):
        spark.dataSource.register(source)
