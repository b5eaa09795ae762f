"""Ordered scans of one large sheet in chunks.

A sheet's order is an integer column, so a row's chunk is a division: windows run over
(sheet, chunk), one summary row per chunk carries what crosses a border, and only those
rows, one in CHUNK, are a window over the sheet. No sheet is a group of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column that one chunk takes.
CHUNK = 50_000


def chunk_of(order_col: str) -> Column:
    return F.floor(F.col(order_col) / CHUNK)


def same(a: DataFrame, b: DataFrame, keys: Sequence[str], mark: str = "_k") -> tuple[DataFrame, Column]:
    """``b`` with its keys renamed, and the null-safe condition that joins it to ``a``."""
    b = b.withColumnsRenamed({k: f"{mark}{i}" for i, k in enumerate(keys)})
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"{mark}{i}"))
    return b, cond


def running_total(df: DataFrame, keys: Sequence[str], order_col: str, value: Column, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of ``keys`` before this one.

    ``order_col`` is an integer that no two rows of ``keys`` share. Null keys are keys. Rows of
    one chunk are a window, earlier chunks come as one sum."""
    rows = df.withColumn("_c", chunk_of(order_col)).withColumn("_v", value)
    by = Window.partitionBy(*keys, "_c").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy(*keys, "_c").agg(F.sum("_v").alias("_s"))
    earlier = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    chunks, cond = same(rows, chunks.select(*keys, "_c", F.coalesce(earlier, F.lit(0)).alias("_before")), [*keys, "_c"])
    total = F.coalesce(F.sum("_v").over(by), F.lit(0))
    return rows.withColumn(out, total).join(chunks, cond).withColumn(out, F.col(out) + F.col("_before")).select(*df.columns, out)


def place(df: DataFrame, keys: Sequence[str], order_col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the place (from 1) of a row among those of ``keys``, by ``order_col``
    (an integer that no two of them share)."""
    return running_total(df, keys, order_col, F.lit(1), out).withColumn(out, F.col(out) + 1)


def runs(df: DataFrame, keys: Sequence[str], order_col: str, value: str) -> DataFrame:
    """Runs of consecutive equal values (two nulls are equal) within ``keys``: (keys, start, length, value).

    Runs are found chunk by chunk. A chunk's first run goes on from the chunk before where that
    ends with the same value, and through chunks that are one run: each run's owner is the chunk
    where it begins."""
    rows = df.withColumn("_c", chunk_of(order_col))
    by = Window.partitionBy(*keys, "_c").orderBy(order_col)
    begins = F.when(F.lag(value).over(by).eqNullSafe(F.col(value)) & F.lag(order_col).over(by).isNotNull(), 0).otherwise(1)
    rows = rows.withColumn("_b", begins).withColumn("_run", F.sum("_b").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    local = rows.groupBy(*keys, "_c", "_run").agg(F.min(order_col).alias("start"), F.count(F.lit(1)).alias("length"), F.first(value).alias("value"))
    edges = local.groupBy(*keys, "_c").agg(F.max("_run").alias("_last"), F.min_by(F.struct("value"), "_run").alias("_head"), F.max_by(F.struct("value"), "_run").alias("_tail"))
    order = Window.partitionBy(*keys).orderBy("_c")
    goes_on = F.coalesce(F.lag("_tail").over(order)["value"].eqNullSafe(F.col("_head")["value"]) & F.lag("_c").over(order).isNotNull(), F.lit(False))
    edges = edges.withColumn("_on", goes_on)
    owner = F.last(F.when(~((F.col("_last") == 1) & F.col("_on")), F.col("_c")), ignorenulls=True).over(order)
    edges = edges.withColumn("_owner", owner).withColumn("_from", F.lag("_owner").over(order))
    # a chunk's last run may be its first too; its place in the owner is that chunk's last
    edges, cond = same(local, edges.select(*keys, "_c", "_last", "_on", "_owner", "_from"), [*keys, "_c"])
    joined = local.join(edges, cond)
    head = (F.col("_run") == 1) & F.col("_on")
    tail = F.col("_run") == F.col("_last")
    joined = joined.withColumn("_o", F.when(head & tail, F.col("_owner")).when(head, F.col("_from")).otherwise(F.col("_c"))) \
                   .withColumn("_at", F.when(head | tail, F.lit(-1)).otherwise(F.col("_run")))
    return joined.groupBy(*keys, "_o", "_at").agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.first("value").alias("value")).drop("_o", "_at")
