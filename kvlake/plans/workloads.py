"""Benchmark workloads of a key-value store, in batch form.

A workload does its whole work as one job or a few: N lookups are one join, N puts one
atomic segment.  ``report`` prints one line for each, with microseconds an operation.
"""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.visible import multi_seek
from ..sources.batch import WriteBatch
from ..store import KVStore, destroy, scratch


@dataclass
class Setup:
    num: int = 100_000
    reads: int | None = None
    value_size: int = 100
    batch: int = 1000
    seed: int = 301
    key_prefix: int = 0


def key(number, prefix: int = 0):
    """16 digits, after ``prefix`` letters."""
    return F.concat(F.lit("a" * prefix), F.lpad(number.cast("string"), 16, "0")).cast("binary")


def random_number(setup: Setup, of: int, salt: int = 0):
    """Uniform in 0..of-1, from the row number alone, so that runs agree."""
    return F.pmod(F.xxhash64("id", F.lit(setup.seed + salt)), F.lit(of))


class Bench:
    """Runs workloads by name on one store."""

    def __init__(self, spark: SparkSession, setup: Setup | None = None, path: str | None = None):
        self.spark, self.setup = spark, setup or Setup()
        self.path = path or scratch(spark, "bench")
        self.db: KVStore | None = None

    def fresh(self) -> KVStore:
        self.close()
        destroy(self.spark, self.path)
        return self.open()

    def open(self) -> KVStore:
        if self.db is None or self.db.closed:
            self.db = KVStore.open(self.spark, self.path, create_if_missing=True)
        return self.db

    def close(self) -> None:
        if self.db is not None:
            self.db.close()
        self.db = None

    # Writing

    def _rows(self, n: int, number, size: int | None = None) -> DataFrame:
        """Values are half random, so they compress to about half."""
        size = size or self.setup.value_size
        text = F.sha2(F.concat(F.col("id").cast("string"), F.lit("v")), 512)
        half = F.rpad(text, size // 2, "x") if size < 256 else F.rpad(F.repeat(text, size // 256 + 1), size // 2, "x")
        return self.spark.range(n).select(key(number, self.setup.key_prefix).alias("key"), F.rpad(half, size, "y").cast("binary").alias("value"))

    def _fill(self, fresh: bool, n: int, number, size: int | None = None) -> int:
        (self.fresh() if fresh else self.open()).bulk_put(self._rows(n, number, size))
        return n

    def fillseq(self):
        return self._fill(True, self.setup.num, F.col("id"))

    def fillbatch(self):
        """Commits of ``batch`` entries, one after the other."""
        db, n = self.fresh(), self.setup.num
        for a in range(0, n, self.setup.batch):
            rows = self._rows(min(self.setup.batch, n - a), F.col("id") + a)
            db.bulk_put(rows)
        return n

    def fillrandom(self):
        return self._fill(True, self.setup.num, random_number(self.setup, self.setup.num))

    def overwrite(self):
        return self._fill(False, self.setup.num, random_number(self.setup, self.setup.num, 1))

    def fillsync(self):
        """A durable commit for each entry."""
        db, n = self.fresh(), max(1, self.setup.num // 1000)
        for r in self._rows(n, random_number(self.setup, self.setup.num)).toLocalIterator():
            db.write(WriteBatch().put(r["key"], r["value"]), sync=True)
        return n

    def fill100K(self):
        return self._fill(True, max(1, self.setup.num // 1000), random_number(self.setup, self.setup.num), 100_000)

    def _delete(self, number):
        self.open().bulk_delete(self.spark.range(self.setup.num).select(key(number, self.setup.key_prefix).alias("key")))
        return self.setup.num

    def deleteseq(self):
        return self._delete(F.col("id"))

    def deleterandom(self):
        return self._delete(random_number(self.setup, self.setup.num, 2))

    # Reading

    def _reads(self) -> int:
        return self.setup.reads or self.setup.num

    @staticmethod
    def _run(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    def readseq(self):
        self._run(self.open().scan(limit=self._reads()))
        return self._reads()

    def readreverse(self):
        self._run(self.open().scan(reverse=True, limit=self._reads()))
        return self._reads()

    def _get(self, n: int, number, cut: bool = False) -> int:
        k = key(number, self.setup.key_prefix)
        k = F.substring(k, F.lit(1), F.length(k) - 1) if cut else k
        self._run(self.open().multi_get(self.spark.range(n).select(k.alias("key"))))
        return n

    def readrandom(self):
        return self._get(self._reads(), random_number(self.setup, self.setup.num, 3))

    def readrandomsmall(self):
        return self._get(max(1, self._reads() // 1000), random_number(self.setup, self.setup.num, 3))

    def readmissing(self):
        return self._get(self._reads(), random_number(self.setup, self.setup.num, 3), cut=True)

    def readhot(self):
        return self._get(self._reads(), random_number(self.setup, -(-self.setup.num // 100), 3))

    def _seek(self, number) -> int:
        targets = self.spark.range(self._reads()).select(key(number, self.setup.key_prefix).alias("target"))
        self._run(multi_seek(self.open().ops(), targets, self.open().version.last_seq))
        return self._reads()

    def seekrandom(self):
        return self._seek(random_number(self.setup, self.setup.num, 4))

    def seekordered(self):
        """Targets that rise by 50 on average, modulo the key space."""
        return self._seek((F.col("id") * 50 + random_number(self.setup, 100, 5)) % self.setup.num)

    def readwhilewriting(self):
        """Reads at a snapshot while another thread commits until they are done; they must
        not see what it writes."""
        db, stop = self.open(), threading.Event()
        at, wrote, errors = db.snapshot(), [], []

        def write():
            try:
                while not wrote or not stop.is_set():
                    db.bulk_put(self._rows(max(1, self.setup.num // 10), random_number(self.setup, self.setup.num, 7 + len(wrote))))
                    wrote.append(db.version.number)
            except Exception as e:
                errors.append(e)

        writer = threading.Thread(target=write)
        writer.start()
        try:
            self._run(db.multi_get(self.spark.range(self._reads()).select(key(random_number(self.setup, self.setup.num, 6)).alias("key")), at))
        finally:
            stop.set()
            writer.join()
            db.release(at)
        if errors:
            raise errors[0]
        return self._reads()

    # Maintenance

    def compact(self):
        self.open().compact()
        return 1

    def stats(self):
        print(self.open().property("stats"), end="")
        return 1

    def sstables(self):
        print(self.open().property("sstables"), end="")
        return 1

    def reopen(self):
        self.close()
        self.open()
        return 1


DEFAULT = ("fillseq", "fillsync", "fillrandom", "overwrite", "readrandom", "readrandom", "readseq", "readreverse", "compact", "readrandom", "readseq", "readreverse", "fill100K")


def report(spark: SparkSession, names=DEFAULT, setup: Setup | None = None) -> list[tuple[str, int, float]]:
    """(name, operations, seconds) of each workload, printed as they end."""
    bench, out = Bench(spark, setup), []
    for name in names:
        began = time.perf_counter()
        n = getattr(bench, name)()
        took = time.perf_counter() - began
        size = (100_000 if name == "fill100K" else bench.setup.value_size) + 16
        print(f"{name:<16}: {took * 1e6 / n:11.3f} micros/op; {n * size / 1048576 / took:6.1f} MB/s")
        out.append((name, n, took))
    bench.close()
    return out
