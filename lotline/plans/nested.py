"""Nested JSON queries (limits configuration, execution modes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotline.operators import nested
from lotline.sources import documents


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.parse_json_column(documents.limit_documents(spark, sf_dir), "json", documents.LIMITS_SCHEMA)
    return nested.flatten_limits(docs)


def modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.parse_json_column(documents.mode_documents(spark, sf_dir), "json", documents.MODES_SCHEMA)
    return nested.flatten_modes(docs)


def q_flatten_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(spark, sf_dir)


def q_leak_class_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.split_by_class(limits(spark, sf_dir))


def q_flatten_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modes(spark, sf_dir)


def q_mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.share_in_group(nested.mode_counts(modes(spark, sf_dir)))
