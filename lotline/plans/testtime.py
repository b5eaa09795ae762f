"""Test-time analysis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotline.operators import testtime
from lotline.sources import adapters


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testtime.parse_durations(adapters.test_durations(spark, sf_dir))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of the commonest bin: two pruned scans of the packed texts."""
    return testtime.common_bin_durations(adapters.test_durations(spark, sf_dir))


def q_parse_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(spark, sf_dir)


def q_common_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testtime.most_common_bin(testtime.matching_rows(adapters.test_durations(spark, sf_dir)))


def q_avg_test_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testtime.avg_test_times(filtered(spark, sf_dir))


def q_lot_ttg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testtime.lot_ttg(filtered(spark, sf_dir), scope="group")


def q_lot_ttg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testtime.lot_ttg(filtered(spark, sf_dir), scope="global")


def q_program_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testtime.program_delta(filtered(spark, sf_dir))


def q_top_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testtime.top_delta(q_program_delta(spark, sf_dir))
