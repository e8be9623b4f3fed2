"""Workers need no copy of the library: the operators run where only the driver has it."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import corpus_pipeline
from kvlake.llm import queries
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
def lacks(_):
    try:
        import kvlake
        return [False]
    except ImportError:
        return [True]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(lacks).collect() == [True]
for name in ("op3_decontaminate", "op9_ce_difference", "op10_quality_rules", "op6_token_matrix"):
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
print("all ran")
"""


def test_workers_without_the_library(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in out.stdout, out.stderr[-2000:]
