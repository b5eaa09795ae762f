"""Errors that no plan prunes.

``raise_error`` in a column disappears when the column is not read. Here the check decides
whether a row is there, so ``count()``, a projection and a join all run it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    """``df``, whose rows must all be ``ok`` (null: not); the first that is not fails the job with ``message``.

    ``rand`` (always at least 0) keeps the optimizer from moving the check: below a filter or a
    join that would take other rows, or into the expressions that ``ok`` is made of."""
    return df.filter(F.when(F.coalesce(ok, F.lit(False)) & (F.rand() >= 0), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def require_of(df: DataFrame, facts: DataFrame, ok: Column, message: Column) -> DataFrame:
    """``df``, where every row of ``facts`` must be ``ok``. The check is a branch beside ``df`` that
    adds no row, so it runs even where ``df`` is found empty."""
    failing = facts.filter(F.when(F.coalesce(ok, F.lit(False)), F.lit(False)).otherwise(F.raise_error(message).cast("boolean")))
    return df.unionByName(failing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``, which must have a row. The test reads up to the first row of each partition and
    adds no shuffle of ``df``."""
    found = df.select(F.lit(1).alias("one")).limit(1).agg(F.count("*").alias("n"))
    return require_of(df, found, F.col("n") > 0, F.lit(message))
