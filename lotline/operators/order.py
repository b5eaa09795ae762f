"""Sheet ordering operators.

A sheet (a request list, a result table) is ordered by an explicit integer ordinal. Sheets
are handled in parallel, and one sheet in chunks (``operators.segments``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.operators import segments


def group_by_first_seen(df: DataFrame, sheet: str, key: str, order_col: str) -> DataFrame:
    """Order rows so equal (trimmed) keys are adjacent, groups in the
    order of their first row, rows stable inside a group, null or blank keys
    last. Adds ``first_seen`` and the new ``position`` (1-based, per sheet).

    A row's position is the rows of the groups before its own, plus its place in its
    group; both are running totals in chunks, so a sheet may be one large file."""
    k = F.trim(F.col(key).cast("string"))
    rows = df.withColumn("_key", F.when(k != "", k))
    groups = rows.groupBy(sheet, "_key").agg(F.min(order_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    # blank keys are one group, behind all others
    named = segments.running_total(groups.filter("_key is not null"), [sheet], "_first", F.col("_n"), "_ahead")
    all_named = groups.filter("_key is not null").groupBy(sheet).agg(F.sum("_n").alias("_ahead"))
    blank = groups.filter("_key is null")
    totals, cond = segments.same(blank, all_named, [sheet])
    blank = blank.join(totals, cond, "left").select(*groups.columns, F.coalesce("_ahead", F.lit(0)).alias("_ahead"))
    placed = segments.place(rows, [sheet, "_key"], order_col, "_place")
    ahead, cond = segments.same(placed, named.unionByName(blank).drop("_n"), [sheet, "_key"])
    out = placed.join(ahead, cond)
    return out.select(*df.columns, F.when(F.col("_key").isNotNull(), F.col("_first")).alias("first_seen"),
                      (F.col("_ahead") + F.col("_place")).cast("long").alias("position"))


def run_spans(df: DataFrame, sheet: str, order_col: str, columns: Sequence[str]) -> DataFrame:
    """Per sheet and column, runs of consecutive equal values (compared
    as text; two nulls are equal) -> (sheet, column, start, length, value).
    ``merged`` marks the runs a report would merge: longer than one row
    and not null. Runs are found in chunks and joined over their borders."""
    long = df.select(sheet, order_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("_c")) \
        .select(sheet, order_col, "_c.column", "_c.value")
    return segments.runs(long, [sheet, "column"], order_col, "value").withColumn(
        "merged", (F.col("length") > 1) & F.col("value").isNotNull())


def status_table(df: DataFrame, ok: F.Column, reason: F.Column) -> DataFrame:
    """K5: every row with ``status`` 'ok' or 'rejected' and a reason."""
    return df.withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit("rejected"))) \
             .withColumn("reason", F.when(ok, F.lit(None).cast("string")).otherwise(reason))


def workflow_counts(status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total, ok and failed rows per run."""
    return status.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") != "ok").alias("failed"))
