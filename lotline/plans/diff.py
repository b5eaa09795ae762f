"""Catalogue diff queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotline.operators import diff
from lotline.sources import adapters


def q_snapshot_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = adapters.snapshot_new(spark, sf_dir), adapters.snapshot_old(spark, sf_dir)
    return diff.rows_not_in(new, old, diff.common_columns(new, old, diff.CATALOGUE_COLUMNS))


def q_snapshot_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = adapters.snapshot_new(spark, sf_dir), adapters.snapshot_old(spark, sf_dir)
    return diff.rows_not_in(old, new, diff.common_columns(new, old, diff.CATALOGUE_COLUMNS))


def q_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.change_log(adapters.snapshot_new(spark, sf_dir), adapters.snapshot_old(spark, sf_dir))


def q_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_counts(adapters.snapshot_new(spark, sf_dir), adapters.snapshot_old(spark, sf_dir))


def q_diff_counts_dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_counts(adapters.snapshot_new(spark, sf_dir), adapters.snapshot_old(spark, sf_dir), dropna=True)
