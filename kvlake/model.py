"""Schemas, errors, and the op log that the queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1
MAX_SEQ = (1 << 56) - 1
COMPARATOR = "kvlake.bytewise"

OPS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("kind", T.ByteType(), False),
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType()),
])
STATE = T.StructType([T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType())])


class KvError(Exception):
    """Base of all errors; ``str()`` is the code, then message and detail."""

    code = "Unknown"

    def __init__(self, message: str = "", detail: str = ""):
        self.message = ": ".join(x for x in (message, detail) if x)
        super().__init__(": ".join(x for x in (self.code, self.message) if x))


class NotFound(KvError):
    code = "NotFound"


class Corruption(KvError):
    code = "Corruption"


class NotSupported(KvError):
    code = "NotSupported"


class InvalidArgument(KvError):
    code = "InvalidArgument"


class StoreIOError(KvError):
    code = "IOError"


def status(code: str, message: Column, detail: Column) -> Column:
    """The text of an error, as ``str()`` of its exception gives it."""
    return F.concat_ws(": ", F.lit(code), F.nullif(message, F.lit("")), F.nullif(detail, F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(number: Column) -> Column:
    return F.format_string("user%08d", number)


def ops_from_events(events: DataFrame) -> DataFrame:
    """The events as an op log: an event of type ``error`` deletes its user's key,
    any other puts its properties."""
    dead = F.col("event_type") == "error"
    return events.select(
        (F.col("event_id") + 1).alias("seq"),
        F.when(dead, DELETE).otherwise(PUT).cast("int").alias("kind"),
        user_key(F.col("user_id")).alias("key"),
        F.when(~F.coalesce(dead, F.lit(False)), F.col("props")).alias("value"),
    )


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops_from_events(table(spark, sf_dir, "events"))


def last_seq(log: DataFrame) -> int:
    """The largest sequence number: one aggregate, answered by Parquet statistics where
    the log is a plain table."""
    return log.agg(F.max("seq")).first()[0] or 0


def placed(log: DataFrame, last: int) -> DataFrame:
    """The op log dealt to files of three levels: files of level 0 hold the newest
    entries by age and overlap, those of deeper levels are disjoint key ranges."""
    uid = F.substring("key", 5, 20).cast("long")
    age = F.expr(f"seq * 10 div {last + 1}")
    rows = log.withColumn("uid", uid).withColumn("age", age)
    level = F.when(F.col("age") >= 7, 0).when(F.col("age") >= 4, 1).otherwise(2)
    number = F.when(F.col("age") >= 7, F.col("age") + 201).when(F.col("age") >= 4, F.expr("101 + uid div 50")).otherwise(F.expr("1 + uid div 25"))
    return rows.withColumn("level", level.cast("long")).withColumn("file_no", number.cast("long"))


def files_from(seg: DataFrame) -> DataFrame:
    """File metadata: key range, largest sequence, entries and logical bytes."""
    size = F.length("key") + 8 + F.coalesce(F.length("value"), F.lit(0))
    return seg.groupBy("level", "file_no").agg(
        F.count("*").alias("num_entries"),
        F.min("key").alias("lo"),
        F.max("key").alias("hi"),
        F.max("seq").alias("max_seq"),
        F.sum(size.cast("long")).alias("file_size"),
    )
