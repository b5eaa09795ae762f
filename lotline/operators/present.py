"""Presentation orders (O4, O5, O6). Sorting is for reports only: the
results are complete without it, and ``orderBy`` is a distributed range
sort. Every order ends with the remaining columns as tie-breaks, so rows
with equal report keys (a hot lot, a hot bin) are still spread over range
partitions instead of landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rest(df: DataFrame, used: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in used]


def limits_order(df: DataFrame) -> DataFrame:
    """Category, then test name."""
    return df.orderBy("category", "test_name", *_rest(df, ("category", "test_name")))


def mode_order(df: DataFrame) -> DataFrame:
    """Config set name ascending, count descending."""
    return df.orderBy(F.col("config_set").asc(), F.col("count").desc(), *_rest(df, ("config_set", "count")))


def lot_order(df: DataFrame) -> DataFrame:
    """Lot ascending."""
    return df.orderBy("lot", *_rest(df, ("lot",)))


def pareto_order(df: DataFrame) -> DataFrame:
    """A9 display: per table, bins by row total descending (ties by bin),
    the total row last."""
    return df.orderBy("slice", "bin_kind", "process_step",
                      F.when(F.col("row_kind").isin("step_total", "grand_total"), 1).otherwise(0),
                      F.col("quantity").desc(), "bin", "devrevstep")


def rank_within(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``rank`` of each row in its group's report order, for readers that do not
    keep the order of files (a group is one report section)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def limits_rank(df: DataFrame) -> DataFrame:
    """O4 as a column: place of a test in its file and category."""
    return rank_within(df, ["file", "category"], F.col("test_name"))


def mode_rank(df: DataFrame) -> DataFrame:
    """O5 as a column: place of a mode in its config set, most frequent first."""
    return rank_within(df, ["config_set"], F.col("count").desc(), F.col("execution_mode"))


def lot_rank(df: DataFrame) -> DataFrame:
    """O6 as a column: place of a lot's row in its facility and operation."""
    rest = [F.col(c) for c in df.columns if c not in ("facility", "operation", "lot")]
    return rank_within(df, ["facility", "operation"], F.col("lot").asc_nulls_first(), *[c.asc_nulls_first() for c in rest])
