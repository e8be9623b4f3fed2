"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000  # rows of an Arrow batch; keeps a batch of long texts small


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset (tests on
    one machine) a temporary folder, which is then set as checkpoint folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="kvlake-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: later jobs start
    from files that survive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kvlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kv_path = path
    return out


def released(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later job reads.  Frames that were
    derived from one by a transformation are passed over."""
    for df in tables:
        path = getattr(df, "_kv_path", None) if isinstance(df, DataFrame) else None
        if isinstance(path, str):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches at ``BATCH_ROWS`` rows or fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
