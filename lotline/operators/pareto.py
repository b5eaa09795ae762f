"""Bin Pareto tables.

One job covers every process step, both bin kinds and both slices (main
and retest): the loop over steps in the reference becomes part of the
group key, and the bin kind is unpivoted in a narrow ``explode`` before
the aggregation, so the unit rows are scanned once and shuffled once.

Plan shape: scan -> project/filter -> explode(slice x bin kind)
-> count(distinct visual_id) by (slice, kind, step, bin, devrevstep)
(Spark plans this as partial aggregate on (key, visual_id) -> shuffle on
(key, visual_id) -> merge -> count -> shuffle on key; the second key
includes the unit id, so a pass bin holding a third of the rows is still
spread over all reducers) -> grouping sets over the small cell table for
row / column / grand totals -> windows over that small table for shares.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions.classify import severity
from lotline.functions.numbers import round_half_up, to_number
from lotline.operators.clean import apply_filters, exceptions, fill_unknown, require_columns

# The default slices of the daily report.
MAIN_FILTERS = {"subflow_latest_flag": "Y", "substructure_id": "U1.U2"}
RETEST_FILTERS = {"subflow_latest_flag": "N", "substructure_id": "U1.U2"}

ROW_KINDS = {0: "cell", 1: "bin_total", 2: "step_total", 3: "grand_total"}


def _cond(filters: Mapping[str, object], columns: Sequence[str]) -> Column:
    conds = [F.col(c) == F.lit(v) for c, v in filters.items() if c in columns]
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def bin_cells(units: DataFrame, keys: Sequence[str], bin_col: str = "bin",
              dev_col: str = "devrevstep", id_col: str = "visual_id",
              measure: str = "distinct") -> DataFrame:
    """Quantity per (keys, bin, device step).

    ``measure="distinct"`` counts distinct unit ids (the default).
    ``measure="sum"`` sums numeric unit ids: the reference does that on its
    own when every id is numeric; here it is only ever an explicit choice.
    """
    if measure == "distinct":
        q = F.countDistinct(id_col)
    elif measure == "sum":
        q = F.sum(to_number(id_col))
    else:
        raise ValueError(f"measure must be 'distinct' or 'sum', not {measure!r}")
    return units.groupBy(*keys, bin_col, dev_col).agg(q.alias("quantity"))


def pareto_totals(cells: DataFrame, keys: Sequence[str], bin_col: str = "bin",
                  dev_col: str = "devrevstep") -> DataFrame:
    """A8 + A9: add row totals, column totals and the grand total with
    grouping sets, then shares.

    Totals are sums of cell quantities (a unit in two bins counts twice),
    as in the reference. Share of a cell = cell / its column total (a zero
    total divides by 1); share of a row total = row / grand total (0 when
    the grand total is 0); total rows have share 1 (0 when empty).
    """
    keys = list(keys)
    sets = [keys + [bin_col, dev_col], keys + [bin_col], keys + [dev_col], keys]
    g = (cells.groupingSets(sets, *keys, bin_col, dev_col)
              .agg(F.sum("quantity").alias("quantity"), F.grouping_id().alias("_gid")))
    # keys are in every set, so only the two low bits vary
    gid = F.col("_gid").bitwiseAND(F.lit(3))
    kind = F.create_map(*[x for k, v in ROW_KINDS.items() for x in (F.lit(k), F.lit(v))])[gid]
    by_key = Window.partitionBy(*keys)
    by_col = Window.partitionBy(*keys, dev_col)
    col_total = F.max(F.when(gid == 2, F.col("quantity"))).over(by_col)
    grand = F.max(F.when(gid == 3, F.col("quantity"))).over(by_key)
    q = F.col("quantity").cast("double")
    share = (F.when(gid == 0, q / F.when(col_total == 0, F.lit(1)).otherwise(col_total))
              .when(gid == 1, F.when(grand == 0, F.lit(0.0)).otherwise(q / grand))
              .otherwise(F.when(q > 0, F.lit(1.0)).otherwise(F.lit(0.0))))
    return (g.withColumn("row_kind", kind)
             .withColumn("percentage", round_half_up(share, 6))
             .drop("_gid"))


def bin_pareto(units: DataFrame, slices: Mapping[str, Mapping[str, object]] | None = None,
               bin_kinds: Mapping[str, str] | None = None, id_col: str = "visual_id",
               dev_col: str = "devrevstep", step_col: str = "process_step",
               measure: str = "distinct") -> DataFrame:
    """A10 + A11: Pareto per (slice, bin kind, process step) in one job.

    ``slices`` maps a slice name to its ``col = value`` filters (P4; a row
    in several slices is counted in each). ``bin_kinds`` maps a kind name
    to its bin column; a kind whose column is absent is skipped. Nulls in
    bin, device step and process step become 'UNKNOWN' (P5) per slice, as
    in the reference. Without a process-step column the table is overall.
    """
    rows, keys = pareto_rows(units, slices, bin_kinds, id_col, dev_col, step_col)
    return pareto_table(bin_cells(rows, keys, "bin", dev_col, id_col, measure), keys, dev_col)


def pareto_rows(units: DataFrame, slices: Mapping[str, Mapping[str, object]] | None = None,
                bin_kinds: Mapping[str, str] | None = None, id_col: str = "visual_id",
                dev_col: str = "devrevstep", step_col: str = "process_step") -> tuple[DataFrame, list[str]]:
    """The rows that the Pareto counts, one per unit row, slice and bin kind, and the table's keys."""
    slices = dict(slices or {"main": MAIN_FILTERS, "retest": RETEST_FILTERS})
    bin_kinds = dict(bin_kinds or {"functional": "functional_bin", "interface": "interface_bin"})
    require_columns(units, [id_col, dev_col, bin_kinds.get("functional", "functional_bin")],
                    optional=[step_col, bin_kinds.get("interface", "interface_bin")])
    cols = units.columns
    kinds = {k: c for k, c in bin_kinds.items() if c in cols}
    has_step = step_col in cols
    slice_names = F.filter(F.array(*[F.when(_cond(f, cols), F.lit(name)) for name, f in slices.items()]),
                           lambda x: x.isNotNull())
    bins = F.array(*[F.struct(F.lit(k).alias("bin_kind"), F.col(c).cast("string").alias("bin"))
                     for k, c in kinds.items()])
    keep = [id_col, dev_col] + ([step_col] if has_step else [])
    # rows of no slice are left at the scan
    wanted = reduce(lambda a, b: a | b, [_cond(f, cols) for f in slices.values()])
    rows = (units.filter(wanted).select(*keep, F.explode(slice_names).alias("slice"), F.explode(bins).alias("_b"))
                 .select("slice", "_b.bin_kind", "_b.bin", *keep))
    rows = fill_unknown(rows, ["bin", dev_col] + ([step_col] if has_step else []))
    return rows, ["slice", "bin_kind"] + ([step_col] if has_step else [])


def pareto_table(cells: DataFrame, keys: Sequence[str], dev_col: str = "devrevstep") -> DataFrame:
    """The Pareto of its cells: totals, shares, severity."""
    out = pareto_totals(cells, keys, "bin", dev_col)
    is_total_row = F.col("row_kind").isin("step_total", "grand_total")
    return out.withColumn("severity", severity(F.col("percentage"), F.col("bin"), F.col("bin_kind"), is_total_row))


def normalized_units(units: DataFrame, filters: Mapping[str, object] | None = None) -> DataFrame:
    """The main slice as the report's Details table: filtered (P4) and filled (P5)."""
    df = apply_filters(units, filters or MAIN_FILTERS)
    return fill_unknown(df, ["functional_bin", "interface_bin", "devrevstep", "process_step"])


def unit_exceptions(units: DataFrame, filters: Mapping[str, object] | None = None,
                    required: Sequence[str] = ("lot", "functional_bin", "devrevstep", "visual_id")) -> DataFrame:
    """Rows of the normalized table with a null in a required column.
    Runs after the fill, so only lot and unit id can still be null."""
    return exceptions(normalized_units(units, filters), required)


def run_summary(pareto: DataFrame, units: DataFrame, filters: Mapping[str, object] | None = None,
                top_n: int = 3, step_col: str = "process_step") -> DataFrame:
    """A16 + O3: per process step of the main functional table: lot count,
    the top bins by row total (ties: smaller bin first), exception count and
    the grand total (counted once, not doubled).

    The top bins and the grand total come from one pass over the Pareto
    rows of each step (a step's table is bounded by its bins); the lot and
    exception counts are one aggregate over the normalized units."""
    main = pareto.filter((F.col("slice") == "main") & (F.col("bin_kind") == "functional"))
    is_row = F.col("row_kind") == "bin_total"
    w = Window.partitionBy(step_col).orderBy((~is_row).cast("int"), F.col("quantity").desc(), F.col("bin"))
    ranked = main.withColumn("_rn", F.row_number().over(w))
    top = F.array_sort(F.collect_list(F.when(is_row & (F.col("_rn") <= top_n), F.struct("_rn", "bin"))))
    per_table = ranked.groupBy(step_col).agg(
        F.max(F.when(F.col("row_kind") == "grand_total", F.col("quantity"))).alias("grand_total"),
        F.concat_ws(",", F.transform(top, lambda x: x["bin"])).alias("top_bins"))
    norm = normalized_units(units, filters)
    missing = F.col("lot").isNull() | F.col("visual_id").isNull()
    per_step = norm.groupBy(step_col).agg(F.countDistinct("lot").alias("lot_count"),
                                          F.count_if(missing).alias("exception_count"))
    return per_table.join(per_step, step_col, "left")
