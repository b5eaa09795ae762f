"""Snapshot diff.

Semantics of the reference's outer merge with indicator, kept exactly:
nulls equal nulls, a row of one side is "added"/"removed" when no equal row
exists on the other side, and every copy of such a row is kept.

Plan: both snapshots are united with a side flag and grouped by all columns
(grouping is null-safe) into the number of copies on each side: map-side
combine and one exchange, no join, and a row repeated a billion times
is one row of the shuffle. A row is added or removed where the other side has no copy.
Copies are restored in two steps of bounded arrays; counts need no copies at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Catalogue columns compared, and the count keys.
CATALOGUE_COLUMNS = ("program_name", "model_name", "ccb", "package", "device", "revision",
                     "stepping", "die_code_name", "test_name")
COUNT_KEYS = ("die_code_name", "program_name", "ccb", "package", "device", "revision", "stepping")


def common_columns(a: DataFrame, b: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Relevant columns present on both sides."""
    cols = [c for c in wanted if c in a.columns and c in b.columns]
    if not cols:
        raise ValueError("no column to compare")
    return cols


#: Copies that a row of the first step stands for, at most.
COPY_STEP = 100_000


def row_copies(new: DataFrame, old: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows with the number of copies on each side."""
    cols = list(columns)
    both = (new.select(*cols, F.lit(1).alias("_new"), F.lit(0).alias("_old"))
            .unionAll(old.select(*cols, F.lit(0).alias("_new"), F.lit(1).alias("_old"))))
    return both.groupBy(*cols).agg(F.sum("_new").alias("_new"), F.sum("_old").alias("_old"))


def expand_copies(rows: DataFrame, copies: str) -> DataFrame:
    """Every row as often as its column ``copies`` says, in two steps, so no
    array is longer than COPY_STEP or the number of steps."""
    n = F.col(copies)
    steps = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPY_STEP))
    left = F.least(F.lit(COPY_STEP).cast("long"), n - F.col("_step") * COPY_STEP)
    return (rows.withColumn("_step", F.explode(steps))
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), left.cast("int")))).drop("_step", "_copy", copies))


def rows_not_in(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``left`` with no null-safe-equal row in ``right`` (all copies kept)."""
    missing = row_copies(left, right, columns).filter(F.col("_old") == 0).drop("_old")
    return expand_copies(missing, "_new").select(*columns)


def change_copies(new: DataFrame, old: DataFrame, columns: Sequence[str] = CATALOGUE_COLUMNS) -> DataFrame:
    """Changed rows once each, with ``modify_flag`` and the number of copies (``_copies``)."""
    cols = common_columns(new, old, columns)
    g = row_copies(new, old, cols).filter((F.col("_new") == 0) | (F.col("_old") == 0))
    return g.select(F.when(F.col("_old") == 0, "Added").otherwise("Removed").alias("modify_flag"), *cols,
                    (F.col("_new") + F.col("_old")).alias("_copies"))


def change_log(new: DataFrame, old: DataFrame, columns: Sequence[str] = CATALOGUE_COLUMNS) -> DataFrame:
    """Added (in new, not in old) and removed (in old, not in new) rows
    with a ``modify_flag``."""
    return expand_copies(change_copies(new, old, columns), "_copies")


def diff_counts(new: DataFrame, old: DataFrame, keys: Sequence[str] = COUNT_KEYS, dropna: bool = False,
                columns: Sequence[str] = CATALOGUE_COLUMNS) -> DataFrame:
    """Changed rows per (flag, keys), summed from their copies. The reference
    silently loses rows with a null key; here they form their own group unless
    ``dropna=True``."""
    changes = change_copies(new, old, columns)
    keys = [k for k in keys if k in changes.columns]
    df = changes.dropna(subset=keys) if dropna else changes
    return df.groupBy("modify_flag", *keys).agg(F.sum("_copies").alias("row_count"))
