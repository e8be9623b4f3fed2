"""The op log as a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import OPS
from ..operators import visible
from ..store import KVStore, scratch


def ops_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Op segments below a path, as they arrive; ``files_per_trigger`` is the back-pressure."""
    reader = spark.readStream.schema(OPS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def into_store(stream: DataFrame, db: KVStore, checkpoint: str):
    """Appends every micro-batch as one atomic segment.  The number of the batch is part
    of the commit, so a batch that is delivered again after a failure is skipped.  Ops may
    arrive in any order of sequences; one whose sequence the store holds already, as by a
    second stream over the same files, is not added twice."""

    def add(batch: DataFrame, number: int) -> None:
        if number <= db.version.streams.get(checkpoint, -1):
            return
        last = db.version.last_seq
        low = batch.agg(F.min("seq")).first()[0]
        if low is not None and low <= last:  # only files with such sequences can hold them
            held = [f for f in db.version.files if f.max_seq >= low]
            batch = batch.join(db._read_files(held).select("seq"), "seq", "left_anti")
        db.append_ops(batch, (checkpoint, number))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def live_state(stream: DataFrame) -> DataFrame:
    """The newest entry of each key, kept as streaming state (update mode): rows with
    the key's present value and whether it is alive."""
    entry = F.max_by(F.struct("kind", "value", "seq"), F.struct("seq", "kind")).alias("e")
    return stream.groupBy("key").agg(entry).select("key", "e.seq", (F.col("e.kind") == 1).alias("alive"), F.when(F.col("e.kind") == 1, F.col("e.value")).alias("value"))


def replay(spark: SparkSession, ops: DataFrame, path: str, files_per_trigger: int = 4) -> DataFrame:
    """State after all ops went through a stream: every micro-batch writes the entries
    that it changed, and the newest of these decide."""
    changes, source = f"{path}/changes", f"{path}/source"
    ops.select("seq", F.col("kind").cast("byte").alias("kind"), "key", "value").write.parquet(source)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("kind", F.col("alive").cast("byte")).select("seq", "kind", "key", "value").write.mode("overwrite").parquet(f"{changes}/batch={number}")

    q = live_state(ops_stream(spark, source, files_per_trigger)).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return visible.visible_state(spark.read.schema(OPS).option("recursiveFileLookup", "true").parquet(changes))


__all__ = ["into_store", "live_state", "ops_stream", "replay", "scratch"]
