"""Every query with SQL against DuckDB."""

import pytest
from pyspark.sql import functions as F

from kvlake.plans import catalog
from tests.compare import check


class Entry:
    queries, oracle_sql = staticmethod(catalog.queries), staticmethod(catalog.oracle_sql)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    assert check(spark, Entry, name, "/root/testdata/sf0.01") > 0


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, "/root/testdata/sf0.01").count() > 0


@pytest.mark.parametrize("name", ["missing_files", "obsolete_files", "live_files"])
def test_numbers_in_several_levels(spark, tmp_path, name):
    """Users so far apart that levels use the same file numbers."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    events.withColumn("user_id", F.col("user_id") * 50).write.parquet(str(tmp_path / "events.parquet"))
    files = catalog.files(spark, str(tmp_path))
    assert files.where("file_no > 204").groupBy("file_no").count().where("count > 1").count() > 0
    assert check(spark, Entry, name, str(tmp_path)) > 0
