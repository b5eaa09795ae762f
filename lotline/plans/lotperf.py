"""Lot performance queries (E1 lab branch and target comparison)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.functions.numbers import round_half_up
from lotline.operators import lotperf
from lotline.sources import adapters


def product_targets_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product-target sheets derived from the sessions: one sheet per
    operation, one row per (sub-flow step, device step) with yield, TTG and
    RCS targets, written the way people keep them in a spreadsheet: merged
    cells (the operation, and a repeated sub-flow step, left blank below
    their first row), operations of one product line typed as '6248.0',
    yield as a fraction, RCS as percent text. A sheet has one row per
    product key, so its size is bounded by the catalogue; every window is
    per sheet."""
    s = adapters.test_sessions(spark, sf_dir)
    g = s.groupBy("operation", "sub_flow_step", "devrevstep").agg(
        F.avg(F.when(F.col("goodbad_flag") == "G", 1).otherwise(0)).alias("y"),
        F.avg("test_time").alias("tt"),
        F.avg(F.when(F.col("within_lao_sfs_latest_flag") == "N", 1).otherwise(0)).alias("rc"))
    w = Window.partitionBy("operation").orderBy(F.col("sub_flow_step").asc_nulls_last(), F.col("devrevstep").asc_nulls_last())
    g = (g.withColumn("ordinal", F.row_number().over(w).cast("long"))
          .withColumn("_prev_sf", F.lag("sub_flow_step").over(w)))
    op_text = F.when(F.col("devrevstep").contains("AF"), F.concat(F.col("operation"), F.lit(".0"))) \
        .otherwise(F.col("operation"))
    first = F.col("ordinal") == 1
    return g.select(
        F.col("operation").alias("sheet"),
        "ordinal",
        F.when(first, op_text).alias("operation"),
        F.when(~first & F.col("_prev_sf").eqNullSafe(F.col("sub_flow_step")), F.lit(None))
         .otherwise(F.col("sub_flow_step")).alias("sub_flow_step"),
        "devrevstep",
        round_half_up(F.col("y"), 2).cast("decimal(10,2)").cast("string").alias("yield_target"),
        round_half_up(F.col("tt"), 1).alias("ttg_target"),
        F.concat(round_half_up(F.col("rc") * 100, 1).cast("decimal(10,1)").cast("string"), F.lit("%")).alias("rcs_target"),
    )


def product_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sheet with its merged cells filled down (operation, sub-flow step)."""
    return lotperf.forward_fill(product_targets_sheet(spark, sf_dir), ["operation", "sub_flow_step"],
                                order_col="ordinal", partition_cols=["sheet"])


def q_lot_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lotperf.lot_performance(adapters.test_sessions(spark, sf_dir))


def q_lot_performance_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lots of one facility that had a bad retest, as a lot list."""
    s = adapters.test_sessions(spark, sf_dir)
    lots = s.filter("goodbad_flag = 'B' AND within_lao_sfs_latest_flag = 'N' AND facility = 'F1'").select("lot")
    return lotperf.lot_performance(s, lots=lots)


def q_lab_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lotperf.lab_report(lotperf.lab_extract(q_lot_performance(spark, sf_dir)))


def q_product_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_targets(spark, sf_dir)


def q_target_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = product_targets(spark, sf_dir).withColumn("_order", F.struct("sheet", "ordinal"))
    return lotperf.target_compare(q_lot_performance(spark, sf_dir), targets, order_col="_order")
