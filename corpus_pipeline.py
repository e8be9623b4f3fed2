"""A corpus pipeline: five stages over ``documents``, each on what the one before kept.

1. quality rules: documents that the rules or the isolation forest reject go;
2. line dedup: repeated chunks of lines and passages of 50 words go, and documents without a word left;
3. MinHash near-dedup: one document of each class stays;
4. benchmark decontamination: benchmark passages are cut out, and documents of which
   they are a twentieth or more go;
5. packing: the rest is dealt to batches in optimal length buckets.

Every stage but the last returns the columns of ``documents``; ``n_chars`` follows the
text where a stage rewrites it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.llm import decontaminate, line_chunks, near_dup, packing, quality
from kvlake.llm.store import written

#: The stages need a forest, a suffix automaton and verified shingle sets: no SQL
#: gives their rows.  tests/llm/test_pipeline.py holds them against a brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """Brings ``n_chars`` in line with the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_chunks.dedup_lines(docs, passages=True).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage returns is written to the shared
    folder and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
