"""Warehouse extracts (S8, S9, J9): projection, coalesce, derive, filter.

The reference runs these as saved queries against a warehouse; here they
are DataFrame projections over any table with the warehouse columns, so
filters and the lot list reach the scan (parquet pushdown / JDBC pushdown).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.operators.clean import dedupe_rows, derive_device_parts, flag_in_set, prefer_substructure


def lot_filter(df: DataFrame, lots: DataFrame | None, lot_col: str = "lot") -> DataFrame:
    """The lot list as a left-semi join. No broadcast hint: the planner
    broadcasts the list when its estimated size is under the threshold and
    AQE does so at runtime once the real size is known; a list too large
    for that stays a shuffled semi join instead of failing."""
    if lots is None:
        return df
    return df.join(lots.select(F.col(lots.columns[0]).alias(lot_col)), lot_col, "left_semi")


def unit_results_extract(raw: DataFrame, lots: DataFrame | None = None, distinct: bool = True) -> DataFrame:
    """Unit results as the saved query returns them.

    * bins and good/bad flag prefer the substructure value (P10);
    * BOM / DLCP / stepping cut from the device step (P9);
    * rows whose operation latest flag (``coalesce(sub-flow, final)``) is Y or
      N (P23); the projected sub-flow and lato flags, the session totals, the
      tester ids and the temperature are '' when missing, numbers as text;
    * lot list as a semi join (J9); DISTINCT (P20) over the whole projection
      unless the caller only counts distinct units anyway.
    """
    latest = F.coalesce(F.col("operation_subflow_latest_flag"), F.col("operation_final_latest_flag"))
    df = lot_filter(raw.filter(flag_in_set(latest)), lots)

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    df = df.select(
        "visual_id", "substructure_id", "lot", "operation", "facility", "devrevstep",
        "program_name", "process_step",
        *prefer_substructure(),
        F.coalesce(F.col("substructure_subflow_latest_flag"), F.col("unit_subflow_latest_flag"), F.lit(""))
         .alias("subflow_latest_flag"),
        *[text(c) for c in ("lato_latest_flag", "total_tested", "total_good", "total_bad", "unit_tester_site_id",
                            "unit_tester_id", "tester_interface_unit_id", "lots_temperature")],
        "test_end_date",
    )
    df = derive_device_parts(df)
    return dedupe_rows(df) if distinct else df


def union_batches(batches: list[DataFrame]) -> DataFrame:
    """The per-batch extracts as one table; columns are matched by name
    and a column missing from a batch is null there. (Reading all batch
    files with one multi-path read is the cheaper form when they share a
    schema.)"""
    if not batches:
        raise ValueError("no batches")
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out
