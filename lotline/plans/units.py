"""Daily lot report queries (E1 unit branch): extract, Pareto, exceptions, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.operators import pareto
from lotline.sources import adapters
from lotline.sources.extracts import unit_results_extract
from lotline.sources.tables import read_table


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All unit rows in extract shape (no DISTINCT: every consumer counts
    distinct units, so the extra shuffle would buy nothing)."""
    return unit_results_extract(adapters.unit_results_raw(spark, sf_dir), distinct=False)


def urgent_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requested lot list: lots holding an urgent order."""
    o = read_table(spark, sf_dir, "orders")
    lot = F.concat(F.lit("L"), F.lpad(F.floor(F.col("o_orderkey") / 25).cast("bigint").cast("string"), 5, "0"))
    return o.filter(F.col("o_orderpriority") == "1-URGENT").select(lot.alias("lot"))


def q_unit_results_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = adapters.unit_results_raw(spark, sf_dir)
    return unit_results_extract(raw, lots=urgent_lots(spark, sf_dir), distinct=True)


def q_bin_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.bin_pareto(units(spark, sf_dir))


def q_unit_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.unit_exceptions(units(spark, sf_dir)).select(
        "visual_id", "lot", "process_step", "devrevstep", "functional_bin", "interface_bin")


def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    table = pareto.bin_pareto(u, {"main": pareto.MAIN_FILTERS}, {"functional": "functional_bin"})
    return pareto.run_summary(table, u)
