"""A key-value store on Parquet: segments of operations and a log of manifests.

``<path>/segments/NNNNNN-*/`` holds sorted Parquet files of one flush (one file number) or
of one compaction (a file number and a disjoint key range for each);
``<path>/manifest/N.json`` is the complete version N: live files with their key ranges,
the last sequence and the next file number.  A commit writes N + 1 beside its name and
renames it; the rename fails if another writer was first, so commits are atomic and
lost updates cannot happen.  The version with the largest number is the current one.

All file operations go through Hadoop's file system, so the store lives wherever Spark
reads and writes; an atomic rename is asked of the file system (HDFS and local have it).
Only metadata is on the driver: one record for each file.

A writer holds a lease: ``LOCK`` names its owner and until when, and is renewed while the
owner's process lives.  A lease that has run out is taken over by the next to open, so
clocks must agree to within a lease.
"""

from __future__ import annotations

import json
import logging
import re
import tempfile
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import COMPARATOR, DELETE, MAX_SEQ, OPS, PUT, STATE, Corruption, InvalidArgument, NotFound, NotSupported, StoreIOError
from .operators import compaction, visible
from .sources.batch import WriteBatch

log = logging.getLogger("kvlake")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:  # one machine, as in tests
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise InvalidArgument("spark.checkpoint.dir", "must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="kvlake-")
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Options:
    """Options that have no meaning on Spark are accepted and kept."""

    comparator: str = COMPARATOR
    sort_key: object = None  # Column -> Column of BINARY that orders as the comparator does
    create_if_missing: bool = False
    error_if_exists: bool = False
    paranoid_checks: bool = False
    write_buffer_size: int = 4 << 20
    max_open_files: int = 1000
    block_size: int = 4096
    block_restart_interval: int = 16
    max_file_size: int = 2 << 20
    compression: str = "snappy"
    zstd_compression_level: int = 1
    reuse_logs: bool = False
    bloom: bool = True
    keep_versions: int = 10  # old manifests that readers may still hold
    lease_seconds: float = 60.0
    auto_compact: bool = False  # compact after commits, and before them while level 0 is full
    stop_files: int = 12  # files of level 0 at which a commit waits for a compaction
    cached_reads: int = 0  # sets of files whose rows stay in executor memory, the last used ones

    def clipped(self) -> Options:
        clip = lambda v, lo, hi: max(lo, min(hi, v))
        return replace(
            self,
            max_open_files=clip(self.max_open_files, 74, 50_000),
            write_buffer_size=clip(self.write_buffer_size, 64 << 10, 1 << 30),
            max_file_size=clip(self.max_file_size, 1 << 20, 1 << 30),
            block_size=clip(self.block_size, 1 << 10, 4 << 20),
        )


@dataclass
class FileMeta:
    level: int
    file_no: int
    file_size: int
    num_entries: int
    smallest: str  # hex of the user key
    largest: str
    min_seq: int
    max_seq: int
    smallest_seq: int = 0
    largest_seq: int = 0
    path: str = ""  # below segments/; its own for every attempt to commit
    lo: str = ""  # hex of the ends in the store's order, where that is not the keys' own
    hi: str = ""

    @property
    def range(self) -> tuple[bytes, bytes]:
        return bytes.fromhex(self.lo or self.smallest), bytes.fromhex(self.hi or self.largest)

    def meets(self, lo: bytes | None, hi: bytes | None) -> bool:
        a, b = self.range
        return (hi is None or a <= hi) and (lo is None or b >= lo)


@dataclass
class Version:
    number: int = 0
    comparator: str = COMPARATOR
    last_seq: int = 0
    next_file: int = 1
    files: list[FileMeta] = field(default_factory=list)
    pointers: dict[str, str] = field(default_factory=dict)
    stats: dict[str, list[int]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)  # last batch of each stream that writes here


class Files:
    """Hadoop file system of one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = self.path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def size(self, p: str) -> int:
        return self.fs.getContentSummary(self.path(p)).getLength()

    def mkdirs(self, p: str) -> None:
        self.fs.mkdirs(self.path(p))

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def sizes(self, p: str) -> dict[str, int]:
        return {x.getPath().getName(): x.getLen() for x in self.fs.listStatus(self.path(p))}

    def create(self, p: str, text: str, replace: bool = False) -> None:
        """Fails if the file is there, unless it may be replaced."""
        stream = self.fs.create(self.path(p), replace)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()

    def rename(self, a: str, b: str) -> bool:
        return not self.exists(b) and self.fs.rename(self.path(a), self.path(b))

    def delete(self, p: str) -> bool:
        return self.fs.delete(self.path(p), True)


class Lease:
    """The right to write, as a file that is renewed in the background."""

    def __init__(self, fs: Files, path: str, seconds: float):
        self.fs, self.path, self.seconds, self.owner = fs, path, seconds, uuid.uuid4().hex
        if not self._create():
            if not self.expired(fs, path):
                raise StoreIOError(f"lock {path}", "already held")
            old = f"{path}.{self.owner}"  # of several that find it expired, one can move it away
            if not (fs.rename(path, old) and self._create()):
                raise StoreIOError(f"lock {path}", "already held")
            fs.delete(old)
        self._stop = threading.Event()
        threading.Thread(target=self._renew, daemon=True).start()

    @staticmethod
    def expired(fs: Files, path: str) -> bool:
        try:
            return json.loads(fs.read(path))["until"] < time.time()
        except (ValueError, KeyError, TypeError):
            return False  # being written, or not ours

    def _text(self) -> str:
        return json.dumps({"owner": self.owner, "until": time.time() + self.seconds})

    def _create(self) -> bool:
        try:
            self.fs.create(self.path, self._text())
            return True
        except Exception:
            return False

    def mine(self) -> bool:
        try:
            return json.loads(self.fs.read(self.path))["owner"] == self.owner
        except Exception:
            return False

    def _renew(self) -> None:
        while not self._stop.wait(self.seconds / 3):
            try:
                if not self.mine():
                    return
                self.fs.create(self.path, self._text(), replace=True)
            except Exception as e:
                log.warning("lease %s was not renewed: %s", self.path, e)

    def release(self) -> None:
        self._stop.set()
        if self.mine():
            self.fs.delete(self.path)


class KVStore:
    """Open with ``KVStore.open``; one writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, path: str, options: Options, version: Version, files: Files):
        self.spark, self.path, self.options, self.version, self._fs = spark, path.rstrip("/"), options, version, files
        self.snapshots: list[int] = []
        self._cached: dict[tuple[str, ...], DataFrame] = {}
        self.closed = False

    # Opening and closing

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None, **changes) -> KVStore:
        options = replace(options or Options(), **changes).clipped()
        if options.comparator != COMPARATOR and options.sort_key is None:
            raise NotSupported("a comparator needs an order-preserving sort_key", options.comparator)
        fs, root = Files(spark, path), path.rstrip("/")
        there = bool(cls._numbers(fs, root))
        if not there and not options.create_if_missing:
            raise InvalidArgument(path, "does not exist (create_if_missing is false)")
        if there and options.error_if_exists:
            raise InvalidArgument(path, "exists (error_if_exists is true)")
        fs.mkdirs(f"{root}/manifest")
        fs.mkdirs(f"{root}/segments")
        lease = Lease(fs, f"{root}/LOCK", options.lease_seconds)
        try:
            db = cls(spark, path, options, Version(comparator=options.comparator), fs)
            db._lease = lease
            if there:
                db.version = cls._read(fs, root, cls._numbers(fs, root)[-1])
                if db.version.comparator != options.comparator:
                    raise InvalidArgument(f"{db.version.comparator} does not match existing comparator", options.comparator)
                db._check_files()
            else:
                db._commit(db.version)
            db.remove_obsolete()
            return db
        except BaseException:
            lease.release()
            raise

    @staticmethod
    def _numbers(fs: Files, root: str) -> list[int]:
        return sorted(int(n[:-5]) for n in fs.names(f"{root}/manifest") if n.endswith(".json") and n[:-5].isdigit())

    @staticmethod
    def _read(fs: Files, root: str, number: int) -> Version:
        try:
            raw = json.loads(fs.read(f"{root}/manifest/{number:020d}.json"))
            return Version(**{**raw, "files": [FileMeta(**f) for f in raw["files"]]})
        except (ValueError, TypeError, KeyError) as e:
            raise Corruption("manifest", str(number)) from e

    def _check_files(self) -> None:
        have = set(self._fs.names(f"{self.path}/segments"))
        gone = [f.file_no for f in self.version.files if f.path.partition("/")[0] not in have]
        if gone:
            raise Corruption(f"{len(gone)} missing files", f"e.g. {gone[0]:06d}")

    def close(self) -> None:
        if not self.closed:
            for df in self._cached.values():
                df.unpersist()
            self._lease.release()
            self.closed = True

    def __enter__(self) -> KVStore:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def _commit(self, version: Version) -> None:
        version = replace(version, number=self.version.number + 1)
        if not self._lease.mine():
            raise StoreIOError(f"lock {self.path}/LOCK", "was taken over")
        temp, name = f"{self.path}/manifest/{uuid.uuid4().hex}.tmp", f"{self.path}/manifest/{version.number:020d}.json"
        self._fs.create(temp, json.dumps(asdict(version)))
        if not self._fs.rename(temp, name):
            self._fs.delete(temp)
            raise StoreIOError("another writer has committed version", str(version.number))
        self.version = version

    # Writing

    def write(self, batch: WriteBatch | None, sync: bool = False) -> None:
        """One atomic batch; None flushes, which a committed segment has already done."""
        if batch is None or not batch.ops:
            return
        last = self.version.last_seq
        rows = [(last + 1 + k, kind, bytearray(key), None if value is None else bytearray(value)) for k, (kind, key, value) in enumerate(batch.ops)]
        self._append(self.spark.createDataFrame(rows, OPS), last + len(rows))

    def write_group(self, batches: list[WriteBatch], sync: bool = False) -> None:
        """Several batches as one commit, in their order."""
        group = WriteBatch()
        for b in batches:
            group.append(b)
        self.write(group, sync)

    def put(self, key: bytes, value: bytes) -> None:
        self.write(WriteBatch().put(key, value))

    def delete(self, key: bytes) -> None:
        self.write(WriteBatch().delete(key))

    def flush(self) -> None:
        self.write(None)

    def bulk_put(self, rows: DataFrame) -> None:
        """All rows (key, value) as one atomic batch.  With a column ``ord`` the batch is in
        its order, so of equal keys the last one wins; without, any one does."""
        self._bulk(rows.select(F.col("key").cast("binary"), F.lit(PUT).cast("byte").alias("kind"), F.col("value").cast("binary"), *self._ord(rows)))

    def bulk_delete(self, keys: DataFrame) -> None:
        self._bulk(keys.select(F.col("key").cast("binary"), F.lit(DELETE).cast("byte").alias("kind"), F.lit(None).cast("binary").alias("value")))

    def bulk_write(self, ops: DataFrame) -> None:
        """Puts and deletes (kind, key, value, ord) as one atomic batch in the order of ``ord``."""
        self._bulk(ops.select(F.col("key").cast("binary"), F.col("kind").cast("byte").alias("kind"), F.col("value").cast("binary"), *self._ord(ops)))

    @staticmethod
    def _ord(rows: DataFrame) -> list[Column]:
        return [F.col("ord")] if "ord" in rows.columns else []

    def _bulk(self, rows: DataFrame) -> None:
        """Sequences are numbered by task: one count for each task makes the offsets, so no
        task sees all rows.  Tasks hold ranges of ``ord``, if it is there, in order."""
        staged = scratch(self.spark, "bulk")
        if "ord" in rows.columns:
            rows = rows.repartitionByRange("ord").sortWithinPartitions("ord").drop("ord")
        rows.withColumn("_id", F.monotonically_increasing_id()).write.parquet(staged)
        rows = self.spark.read.parquet(staged).withColumn("_task", F.shiftright("_id", 33))
        counts = sorted((r["_task"], r["count"]) for r in rows.groupBy("_task").count().collect())  # one row a task
        offsets, total = [], self.version.last_seq + 1
        for task, n in counts:
            offsets.append((task, total))
            total += n
        if not offsets:
            return
        start = self.spark.createDataFrame(offsets, "_task long, _start long")
        rows = rows.join(F.broadcast(start), "_task").select((F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("seq"), "kind", "key", "value")
        self._append(rows, total - 1)
        self._fs.delete(staged)

    def append_ops(self, ops: DataFrame, stream: tuple[str, int] | None = None) -> None:
        """Ops that carry their own sequences, all above the last one.  Those of a
        ``stream`` (its name and the number of the batch) may come late, with sequences
        below the last one; such a store keeps its tombstones, since what they hide may
        still arrive."""
        low, high = ops.agg(F.min("seq"), F.max("seq")).first()
        if high is None:
            return
        if stream is None and low <= self.version.last_seq or high > MAX_SEQ:
            raise InvalidArgument("sequences must follow the last one", f"{low} after {self.version.last_seq}")
        self._append(ops.select("seq", F.col("kind").cast("byte").alias("kind"), "key", "value"), max(high, self.version.last_seq), stream)

    def _append(self, ops: DataFrame, last: int, stream: tuple[str, int] | None = None) -> None:
        full = [f for f in self.version.files if f.level == 0]
        if self.options.auto_compact and len(full) >= self.options.stop_files:
            self._merge(self._closure(full, upto=1), 1)
        number = self.version.next_file
        metas = self._segment(ops, number, 0)
        streams = self.version.streams if stream is None else {**self.version.streams, stream[0]: stream[1]}
        self._commit(replace(self.version, last_seq=last, next_file=number + 1, files=self.version.files + metas, streams=streams))
        if self.options.auto_compact:
            self.maybe_compact()

    def _order(self, key: str = "key") -> Column:
        return F.col(key) if self.options.sort_key is None else self.options.sort_key(F.col(key))

    def _segment(self, ops: DataFrame, number: int, level: int, parts: int = 0) -> list[FileMeta]:
        """Writes ops sorted by key: under one file number, or with ``parts`` as at most so
        many files of disjoint key ranges, numbered from ``number`` on."""
        name = f"{number:06d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/segments/{name}"
        rows = ops.withColumn("_order", self._order())
        rows = (rows.repartitionByRange(parts, "_order") if parts else rows.repartitionByRange("_order")).sortWithinPartitions("_order", F.desc("seq"), F.desc("kind")).drop("_order")
        out = rows.write.option("compression", self.options.compression).option("parquet.page.size", self.options.block_size)
        if self.options.bloom:
            out = out.option("parquet.bloom.filter.enabled#key", "true")
        out.parquet(at)
        metas = self._metas(self.spark.read.schema(OPS).parquet(at), name, self._fs.sizes(at), number, level, bool(parts))
        if not metas:
            self._fs.delete(at)
        return metas

    def _metas(self, rows: DataFrame, name: str, sizes: dict[str, int], number: int, level: int, each: bool) -> list[FileMeta]:
        """What a manifest says of a folder of files, as one file or file by file."""
        own = self.options.sort_key is not None
        file = F.element_at(F.split(F.input_file_name(), "/"), -1) if each else F.lit("")
        lo, hi = (f(F.struct("_o", "key", (F.col("seq") * -1).alias("s"))).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi")))
        per = rows.withColumns({"_o": self._order(), "_file": file}).groupBy("_file").agg(F.count("*").alias("n"), F.min("seq").alias("a"), F.max("seq").alias("b"), lo, hi)
        out = []
        for k, r in enumerate(sorted(per.collect(), key=lambda r: bytes(r["lo"]["_o"]))):  # a row for each file
            path = f"{name}/{r['_file']}" if each else name
            size = sizes[r["_file"]] if each else sum(sizes.values())
            ends = [bytes(r[x]["_o"]).hex() if own else "" for x in ("lo", "hi")]
            out.append(FileMeta(level, number + k, size, r["n"], bytes(r["lo"]["key"]).hex(), bytes(r["hi"]["key"]).hex(), r["a"], r["b"], -r["lo"]["s"], -r["hi"]["s"], path, *ends))
        return out

    # Reading

    def _read_files(self, files: list[FileMeta]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], OPS)
        key = tuple(sorted(f.path for f in files))
        rows = self._cached.pop(key, None)
        if rows is None:
            rows = self.spark.read.schema(OPS).parquet(*(f"{self.path}/segments/{f.path}" for f in files))
        if self.options.cached_reads:  # executors hold what fits, and read the rest again
            self._cached[key] = rows.persist()
            while len(self._cached) > self.options.cached_reads:
                self._cached.pop(next(iter(self._cached))).unpersist()
        return rows

    def _ordered(self, keys: list[bytes | None]) -> list[bytes | None]:
        """The keys as the store orders them."""
        if self.options.sort_key is None or not any(k is not None for k in keys):
            return keys
        row = self.spark.range(1).select(*(self.options.sort_key(F.lit(None if k is None else bytearray(k)).cast("binary")).alias(f"k{n}") for n, k in enumerate(keys))).first()
        return [None if k is None else bytes(row[f"k{n}"]) for n, k in enumerate(keys)]

    def _may_hold(self, lo: bytes | None, hi: bytes | None) -> list[FileMeta]:
        """Files whose key range meets [lo, hi]."""
        lo, hi = self._ordered([lo, hi])
        return [f for f in self.version.files if f.meets(lo, hi)]

    def _at(self, snapshot: int | None) -> int:
        return self.version.last_seq if snapshot is None else snapshot

    def ops(self) -> DataFrame:
        return self._read_files(self.version.files)

    def state(self, snapshot: int | None = None) -> DataFrame:
        """(key, value) of all visible rows."""
        return visible.visible_state(self.ops(), self._at(snapshot))

    def get(self, key: bytes, snapshot: int | None = None) -> bytes | None:
        """The value, or None."""
        files = self._may_hold(key, key)
        rows = visible.get(self._read_files(files), F.lit(bytearray(key)), self._at(snapshot)).collect()
        return bytes(rows[0]["value"]) if rows else None

    def get_or_raise(self, key: bytes, snapshot: int | None = None) -> bytes:
        value = self.get(key, snapshot)
        if value is None:
            raise NotFound("", "")
        return value

    def multi_get(self, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
        """Each key with its value; only files that meet the keys' range are read."""
        files = self.version.files
        if len(files) > 1:
            order = F.struct(self._order().alias("o"), "key")
            lo, hi = keys.where("key is not null").select("key").agg(F.min(order), F.max(order)).first()
            files = self._may_hold(bytes(lo["key"]), bytes(hi["key"])) if lo else []
        return visible.multi_get(self._read_files(files), keys, self._at(snapshot))

    def scan(self, start: bytes | None = None, limit_key: bytes | None = None, reverse: bool = False, limit: int | None = None, snapshot: int | None = None) -> DataFrame:
        rows = self._read_files(self._may_hold(start, limit_key)).withColumn("_order", self._order())
        for bound, test in ((start, "__ge__"), (limit_key, "__lt__")):
            if bound is not None:
                edge = F.lit(bytearray(bound))
                rows = rows.where(getattr(self._order(), test)(edge if self.options.sort_key is None else self.options.sort_key(edge)))
        out = visible.visible_state(rows, self._at(snapshot))
        order = self._order()
        out = out.orderBy(order.desc() if reverse else order.asc())
        return out if limit is None else out.limit(limit)

    def prefix(self, prefix: bytes, snapshot: int | None = None) -> DataFrame:
        return self.scan(prefix, visible.successor(prefix), snapshot=snapshot)

    def iterator(self, snapshot: int | None = None) -> Cursor:
        return Cursor(self, self._at(snapshot))

    # Snapshots

    def snapshot(self) -> int:
        self.snapshots.append(self.version.last_seq)
        return self.version.last_seq

    def release(self, snapshot: int) -> None:
        self.snapshots.remove(snapshot)

    def smallest_snapshot(self) -> int:
        return min(self.snapshots, default=self.version.last_seq)

    # Maintenance

    def compact(self, begin: bytes | None = None, end: bytes | None = None) -> None:
        """Merges the files that meet [begin, end], and those that share keys with them,
        into the deepest level among them (level 1 at least)."""
        inputs = self._closure(self._may_hold(begin, end))
        if not inputs or len(inputs) == 1 and inputs[0].level > 0:
            return
        level = max(1, max(f.level for f in inputs))
        self._merge(inputs, level)

    def maybe_compact(self) -> bool:
        """One step of the automatic policy: the level with the largest score of one or
        more goes down by a file, or as a whole from level 0."""
        level, score = max(((n, s) for n, s in self._scores().items()), key=lambda x: (x[1], -x[0]), default=(0, 0.0))
        if score < 1:
            return False
        here = [f for f in self.version.files if f.level == level]
        if level:
            here.sort(key=lambda f: f.range)
            pointer = bytes.fromhex(self.version.pointers.get(str(level), ""))
            here = [next((f for f in here if f.range[1] > pointer), here[0])]
        inputs = self._closure(here, upto=level + 1)
        if inputs == here and len(here) == 1 and level:
            moved = replace(here[0], level=level + 1)  # nothing below: metadata alone
            self._commit(replace(self.version, files=[moved if f is here[0] else f for f in self.version.files], pointers={**self.version.pointers, str(level): moved.range[1].hex()}))
        else:
            self._merge(inputs, level + 1, {str(level): max(f.range[1] for f in here).hex()})
        return True

    def _scores(self) -> dict[int, float]:
        out = {}
        for n in range(compaction.LEVELS - 1):
            here = [f for f in self.version.files if f.level == n]
            if here:
                out[n] = len(here) / compaction.L0_FILES if n == 0 else sum(f.file_size for f in here) / (compaction.L1_BYTES * 10.0 ** (n - 1))
        return out

    def _closure(self, files: list[FileMeta], upto: int | None = None) -> list[FileMeta]:
        """These files and all that overlap them, transitively (up to a level)."""
        took = list(files)
        while True:
            if not took:
                return took
            lo, hi = min(f.range[0] for f in took), max(f.range[1] for f in took)
            more = [f for f in self.version.files if f not in took and (upto is None or f.level <= upto) and f.meets(lo, hi)]
            if not more:
                return took
            took += more

    def _merge(self, inputs: list[FileMeta], level: int, pointers: dict | None = None) -> None:
        """The inputs as files of disjoint key ranges of about ``max_file_size`` bytes, and
        so many that each meets about ten such files of the level below at most."""
        lo, hi = min(f.range[0] for f in inputs), max(f.range[1] for f in inputs)
        rest = [f for f in self.version.files if f not in inputs]
        deeper = [f for f in rest if f.meets(lo, hi)]
        below = self.spark.createDataFrame([tuple(map(bytearray, f.range)) for f in deeper], "lo binary, hi binary") if deeper else None
        order = None if self.options.sort_key is None else self._order()
        kept = compaction.retain(self._read_files(inputs), self.smallest_snapshot(), below, order, keep_tombstones=bool(self.version.streams))
        read, most = sum(f.file_size for f in inputs), self.options.max_file_size
        under = sum(f.file_size for f in deeper if f.level == level + 1)
        number = self.version.next_file
        metas = self._segment(kept, number, level, max(1, -(-read // most), -(-under // (10 * most))))
        wrote = sum(m.file_size for m in metas)
        old = self.version.stats.get(str(level), [0, 0, 0])
        stats = {**self.version.stats, str(level): [old[0] + 1, old[1] + read, old[2] + wrote]}
        self._commit(replace(self.version, next_file=number + max(1, len(metas)), files=rest + metas, stats=stats, pointers={**self.version.pointers, **(pointers or {})}))
        log.info("compacted %d files to %d of level %d: %d of %d bytes", len(inputs), len(metas), level, wrote, read)
        self.remove_obsolete()

    def remove_obsolete(self) -> list[str]:
        """Deletes segments that none of the last ``keep_versions`` versions names, and
        older manifests."""
        numbers = self._numbers(self._fs, self.path)
        keep = numbers[-max(1, self.options.keep_versions) :]
        live = {f.path.partition("/")[0] for n in keep for f in self._read(self._fs, self.path, n).files}
        gone = [n for n in self._fs.names(f"{self.path}/segments") if n not in live]
        for n in gone:
            self._fs.delete(f"{self.path}/segments/{n}")
        for n in numbers[: -len(keep)]:
            self._fs.delete(f"{self.path}/manifest/{n:020d}.json")
        for n in self._fs.names(f"{self.path}/manifest"):
            if n.endswith(".tmp"):
                self._fs.delete(f"{self.path}/manifest/{n}")
        return gone

    def property(self, name: str) -> str | None:
        """``num-files-at-level<N>``, ``stats``, ``sstables``, ``approximate-memory-usage``; a
        leading name and dot are ignored; None if unknown."""
        name = name.rpartition(".")[2]
        files = self.version.files
        if name.startswith("num-files-at-level"):
            n = name[len("num-files-at-level") :]
            return str(sum(f.level == int(n) for f in files)) if n.isdigit() and int(n) < compaction.LEVELS else None
        if name == "stats":
            lines = ["Level  Files  Size(MB)  Compactions  Read(MB)  Write(MB)"]
            for n in range(compaction.LEVELS):
                here, (c, r, w) = [f for f in files if f.level == n], self.version.stats.get(str(n), [0, 0, 0])
                if here or c:
                    lines.append(f"{n:5d}  {len(here):5d}  {sum(f.file_size for f in here) / 1048576:8.1f}  {c:11d}  {r / 1048576:8.1f}  {w / 1048576:9.1f}")
            return "\n".join(lines) + "\n"
        if name == "sstables":
            out = []
            for n in range(compaction.LEVELS):
                out.append(f"--- level {n} ---")
                out += [f" {f.file_no}:{f.file_size}['{f.smallest}' @ {f.smallest_seq} .. '{f.largest}' @ {f.largest_seq}]" for f in files if f.level == n]
            return "\n".join(out) + "\n"
        if name == "approximate-memory-usage":
            infos = self.spark._jsc.sc().getRDDStorageInfo()
            return str(sum(i.memSize() for i in infos))
        return None

    def approximate_sizes(self, ranges: list[tuple[bytes, bytes]]) -> list[int]:
        """Bytes of files in each range [start, limit), from metadata: a file that is
        partly inside counts by the share of its entries that are."""
        out = []
        for a, b in ranges:
            total = 0
            x, y = self._ordered([a, b])
            for f in self._may_hold(a, b):
                lo, hi = f.range
                if x <= lo and hi < y:
                    total += f.file_size
                else:
                    order = self._order()
                    inside = self._read_files([f]).where((order >= F.lit(bytearray(x))) & (order < F.lit(bytearray(y)))).count()
                    total += f.file_size * inside // f.num_entries
            out.append(total)
        return out


class Cursor:
    """A two-way cursor by keyset pagination: each step is a top-1 query at the same
    snapshot, for convenience; bulk reads should use ``scan``."""

    def __init__(self, db: KVStore, snapshot: int):
        self.db, self.snapshot, self._row, self._cleanups = db, snapshot, None, []

    def _take(self, **args) -> None:
        rows = self.db.scan(snapshot=self.snapshot, limit=1, **args).collect()
        self._row = (bytes(rows[0]["key"]), bytes(rows[0]["value"])) if rows else None

    def valid(self) -> bool:
        return self._row is not None

    def seek_to_first(self) -> None:
        self._take()

    def seek_to_last(self) -> None:
        self._take(reverse=True)

    def seek(self, target: bytes) -> None:
        self._take(start=target)

    def next(self) -> None:
        self._take(start=self.key() + b"\0")

    def prev(self) -> None:
        self._take(limit_key=self.key(), reverse=True)

    def key(self) -> bytes:
        return self._row[0]

    def value(self) -> bytes:
        return self._row[1]

    def register_cleanup(self, f) -> None:
        self._cleanups.append(f)

    def close(self) -> None:
        for f in self._cleanups:
            f()


def destroy(spark: SparkSession, path: str) -> None:
    """Deletes a store; no store is no error, a store that is open is one."""
    fs = Files(spark, path)
    if fs.exists(f"{path}/LOCK") and not Lease.expired(fs, f"{path}/LOCK"):
        raise StoreIOError(f"lock {path}/LOCK", "already held")
    fs.delete(path)


def repair(spark: SparkSession, path: str, options: Options | None = None) -> list[str]:
    """A new version from segments and logs alone: every readable segment goes to level 0,
    the ops of each readable log (``<path>/logs/N.log``) become one, and the logs, what is
    unreadable and the old manifests go to ``lost/``.  Returns the names in ``lost/``."""
    from .sources.wal import read_log_files

    options = (options or Options()).clipped()
    root, fs = path.rstrip("/"), Files(spark, path)
    fs.mkdirs(f"{root}/lost")
    fs.mkdirs(f"{root}/manifest")
    fs.mkdirs(f"{root}/segments")
    for n in fs.names(f"{root}/manifest"):
        fs.rename(f"{root}/manifest/{n}", f"{root}/lost/{n}")
    fs.delete(f"{root}/LOCK")
    db = KVStore(spark, root, options, Version(comparator=options.comparator), fs)
    number_of = lambda n: int(m[0]) if (m := re.match(r"[0-9]+", n)) else 0
    names, logs = fs.names(f"{root}/segments"), fs.names(f"{root}/logs")
    top, files = max(map(number_of, names + logs), default=0), []
    for n in names:
        at = f"{root}/segments/{n}"
        try:
            rows = spark.read.parquet(at)
            rows.agg(F.sum(F.length("value"))).collect()  # reads every page
            files += db._metas(rows.select(*OPS.names), n, fs.sizes(at), number_of(n), 0, False)
        except Exception as e:
            log.warning("segment %s goes to lost/: %s", n, e)
            fs.rename(at, f"{root}/lost/{n}")
    for n in logs:
        try:
            top += 1
            files += db._segment(read_log_files(spark, f"{root}/logs/{n}"), top, 0)
        except Exception as e:
            log.warning("log %s is unreadable: %s", n, e)
        fs.rename(f"{root}/logs/{n}", f"{root}/lost/{n}")
    version = Version(1, options.comparator, max((f.max_seq for f in files), default=0), top + 1, files)
    fs.create(f"{root}/manifest/{1:020d}.json", json.dumps(asdict(version)))
    return fs.names(f"{root}/lost")


def empty_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def failing_state(spark: SparkSession, error: Exception) -> DataFrame:
    """A state whose rows cannot be read: any action ends in the text of the error."""
    fail = F.raise_error(F.lit(str(error)))
    return spark.range(1).select(*(fail.cast(f.dataType).alias(f.name) for f in STATE))
