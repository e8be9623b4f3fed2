"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import base_columns, chat_format, decontaminate, license_scan, line_chunks, lm_score, near_dup, packing, pii, quality, token_matrix


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_chat_format(spark, sf_dir):
    turns = chat_format.with_probe(chat_format.canonical_rows(table(spark, sf_dir, "conversations")))
    turns = chat_format.canonical_records(chat_format.as_records(turns), "record").select("conv_id", "turns")
    return chat_format.read_back(chat_format.formatted(turns))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op5_pack_buckets(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_token_matrix(spark, sf_dir):
    return token_matrix.token_matrix(table(spark, sf_dir, "documents"))


def op7_line_chunks(spark, sf_dir):
    return line_chunks.report(table(spark, sf_dir, "documents"), passages=True)


def op8_probminhash(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_ce_difference(spark, sf_dir):
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_quality_rules(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def base_pii_columns(spark, sf_dir):
    return base_columns.pii_base(table(spark, sf_dir, "documents"))


def base_quality_columns(spark, sf_dir):
    return base_columns.quality_base(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_license_scan, op2_chat_format, op3_decontaminate, op4_pii, op5_pack_buckets, op6_token_matrix, op7_line_chunks, op8_probminhash, op9_ce_difference, op10_quality_rules, base_pii_columns, base_quality_columns)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op2_chat_format": chat_format.oracle(), "op3_decontaminate": decontaminate.oracle(), "base_pii_columns": base_columns.pii_sql(), "base_quality_columns": base_columns.quality_sql()}
