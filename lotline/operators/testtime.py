"""Test-time analysis.

Plan notes
* The duration parse is two ``regexp_extract`` calls inside the scan's
  codegen span (no Python per row).
* The commonest bin is found by a scan of its own that reads only the bin and
  the packed text and shuffles one row per bin and task; it is applied as a
  left-semi join against that one-row result (broadcast: one row by
  construction) below the aggregate of the main scan. Nothing is stored
  between the two.
* Per-unit totals, per-(lot, program) TTG and the per-(DLCP, test) family
  comparison are hash aggregates keyed by what the reference loops over;
  the family comparison is two aggregation levels (program, then
  DLCP x test) so program means are unweighted as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.functions.classify import program_family
from lotline.functions.guards import require, require_of, require_rows
from lotline.functions.numbers import round_half_up
from lotline.operators.clean import require_columns

# Fixed value: the packed duration format.
DURATION_PATTERN = r"PRE_(\d+\.\d+)MS_MAIN_(\d+\.\d+)MS_ET_(\d+\.\d+)MS"
NO_DURATION = "no duration in any test result"
MIN_UNITS = 5
# Fixed value: columns a duration table must have.
REQUIRED = ("visual_id", "operation", "devrevstep", "program_name", "dlcp", "test_name", "test_result",
            "lot", "functional_bin")
TOP_DELTAS = 20


def _num(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("double")


def parse_durations(df: DataFrame, col: str = "test_result") -> DataFrame:
    """PRE and MAIN milliseconds from the packed text, searched anywhere
    in the value; ET must be present but is not used; total = PRE + MAIN.
    Rows without a match (or null) are dropped; a table without any match
    fails the job.

    The pattern is matched once per row (whole match), and the two numbers
    are cut out of the matched text with plain string functions."""
    return require_rows(_parsed(df, col), NO_DURATION)


def _parsed(df: DataFrame, col: str = "test_result") -> DataFrame:
    require_columns(df, REQUIRED)
    m = F.regexp_extract(F.col(col), DURATION_PATTERN, 0)
    parts = F.split(F.col("_m"), "_")          # PRE, <n>MS, MAIN, <n>MS, ET, <n>MS
    pre = _num(F.regexp_replace(F.element_at(parts, 2), "MS$", ""))
    main = _num(F.regexp_replace(F.element_at(parts, 4), "MS$", ""))
    return (df.withColumn("_m", m).filter(F.col("_m") != "")
              .withColumn("pre_time", pre).withColumn("main_time", main)
              .withColumn("total_time", F.col("pre_time") + F.col("main_time"))
              .drop(col, "_m"))


def matching_rows(df: DataFrame, col: str = "test_result") -> DataFrame:
    """The rows :func:`parse_durations` keeps, without the numbers."""
    return df.filter(F.col(col).rlike(DURATION_PATTERN))


def most_common_bin(parsed: DataFrame, bin_col: str = "functional_bin") -> DataFrame:
    """A2: one row, the bin with most rows (nulls ignored); a tie goes to the
    smaller bin. Without any the job fails."""
    return require(_top_bin(parsed, bin_col), F.col(bin_col).isNotNull(), F.lit(NO_DURATION))


def _top_bin(parsed: DataFrame, bin_col: str) -> DataFrame:
    counts = parsed.filter(F.col(bin_col).isNotNull()).groupBy(bin_col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.min_by(bin_col, F.struct(-F.col("_n"), F.col(bin_col))).alias(bin_col))


def common_bin_durations(df: DataFrame, bin_col: str = "functional_bin") -> DataFrame:
    """T1 for the rows of the commonest bin (semi join with the one-row winner)."""
    top = _top_bin(matching_rows(df), bin_col)
    out = _parsed(df.join(F.broadcast(top), bin_col, "left_semi"))
    return require_of(out, top, F.col(bin_col).isNotNull(), F.lit(NO_DURATION))


def avg_test_times(filtered: DataFrame) -> DataFrame:
    """A1: per (unit, test) mean PRE / MAIN / TOTAL; program, DLCP, lot and bin
    as the smallest non-null value (the reference takes the first in file
    order, which a distributed table does not have). Null keys are dropped."""
    return (filtered.filter(F.col("visual_id").isNotNull() & F.col("test_name").isNotNull())
                    .groupBy("visual_id", "test_name")
                    .agg(round_half_up(F.avg("pre_time"), 6).alias("pre_time"),
                         round_half_up(F.avg("main_time"), 6).alias("main_time"),
                         round_half_up(F.avg("total_time"), 6).alias("total_time"),
                         F.min("program_name").alias("program_name"),
                         F.min("dlcp").alias("dlcp"),
                         F.min("lot").alias("lot"),
                         F.min("functional_bin").alias("functional_bin")))


def lot_ttg(filtered: DataFrame, scope: str = "group") -> DataFrame:
    """A3 (+ J8): time per good unit per (lot, program).

    ``scope="group"``: a unit's time counts only the rows of that lot and
    program. ``scope="global"``: as the reference, a unit's time is its total
    over the whole filtered set, added in full to every (lot, program) it
    appears in. Null unit ids, lots and programs are left out.
    """
    base = filtered.filter(F.col("visual_id").isNotNull() & F.col("lot").isNotNull()
                           & F.col("program_name").isNotNull())
    if scope == "group":
        per_unit = base.groupBy("lot", "program_name", "visual_id").agg(
            F.sum("total_time").alias("unit_time"), F.min("dlcp").alias("dlcp"),
            F.min("functional_bin").alias("functional_bin"))
    elif scope == "global":
        unit_total = (filtered.filter(F.col("visual_id").isNotNull())
                              .groupBy("visual_id").agg(F.sum("total_time").alias("unit_time")))
        members = base.groupBy("lot", "program_name", "visual_id").agg(
            F.min("dlcp").alias("dlcp"), F.min("functional_bin").alias("functional_bin"))
        per_unit = members.join(unit_total, "visual_id")
    else:
        raise ValueError("scope must be 'group' or 'global'")
    g = per_unit.groupBy("lot", "program_name").agg(
        F.min("dlcp").alias("dlcp"), F.count(F.lit(1)).alias("unit_count"),
        F.sum("unit_time").alias("_t"), F.min("functional_bin").alias("functional_bin"))
    ttg = F.col("_t") / F.col("unit_count")
    return g.select("lot", "program_name", "dlcp", "unit_count",
                    round_half_up(F.col("_t"), 6).alias("total_time_ms"),
                    round_half_up(F.col("_t") / 1000, 6).alias("total_time_s"),
                    round_half_up(ttg, 6).alias("ttg_ms"),
                    round_half_up(ttg / 1000, 6).alias("ttg_s"),
                    "functional_bin")


def duration_cells(parsed: DataFrame) -> DataFrame:
    """Pre-aggregation for the family comparison: one row per (bin, DLCP,
    test, program, unit) with sums and the row count. Shuffles far fewer
    rows than the raw durations and keeps every later step exact (a mean is
    sum / count)."""
    return parsed.groupBy("functional_bin", "dlcp", "test_name", "program_name", "visual_id").agg(
        F.sum("pre_time").alias("pre_sum"), F.sum("main_time").alias("main_sum"),
        F.sum("total_time").alias("total_sum"), F.count(F.lit(1)).alias("n_rows"))


def program_delta(filtered: DataFrame, min_units: int = MIN_UNITS) -> DataFrame:
    """A4 on duration rows (already restricted to one bin)."""
    return program_delta_cells(duration_cells(filtered), min_units)


def program_delta_cells(cells: DataFrame, min_units: int = MIN_UNITS) -> DataFrame:
    """A4: per (DLCP, test), EDGE minus CCG mean total time.

    Needs >= ``min_units`` distinct units in the group, both families, and
    >= ``min_units`` units (summed per program) in each family. A family's
    mean is the unweighted mean of its programs' means.
    """
    base = cells.filter(F.col("dlcp").isNotNull() & F.col("test_name").isNotNull())
    per_prog = (base.filter(F.col("program_name").isNotNull())
                    .groupBy("dlcp", "test_name", "program_name")
                    .agg((F.sum("pre_sum") / F.sum("n_rows")).alias("pre"),
                         (F.sum("main_sum") / F.sum("n_rows")).alias("main"),
                         (F.sum("total_sum") / F.sum("n_rows")).alias("total"),
                         F.count("visual_id").alias("n"))
                    .withColumn("family", program_family(F.col("program_name"))))
    ccg, edge = F.col("family") == "CCG", F.col("family") == "EDGE"

    def names(cond: Column) -> Column:
        return F.concat_ws(", ", F.array_sort(F.collect_list(F.when(cond, F.col("program_name")))))

    fam = per_prog.groupBy("dlcp", "test_name").agg(
        F.avg(F.when(ccg, F.col("total"))).alias("ccg_avg"),
        F.avg(F.when(edge, F.col("total"))).alias("edge_avg"),
        F.coalesce(F.sum(F.when(ccg, F.col("n"))), F.lit(0)).alias("ccg_sample_count"),
        F.coalesce(F.sum(F.when(edge, F.col("n"))), F.lit(0)).alias("edge_sample_count"),
        (F.max("pre") - F.min("pre")).alias("pre_diff"),
        (F.max("main") - F.min("main")).alias("main_diff"),
        names(ccg).alias("ccg_programs"), names(edge).alias("edge_programs"),
        F.count(F.lit(1)).alias("program_count"))
    totals = base.groupBy("dlcp", "test_name").agg(
        F.countDistinct("visual_id").alias("total_sample_count"),
        F.min("functional_bin").alias("functional_bin"))
    out = (fam.join(totals, ["dlcp", "test_name"])
              .filter((F.col("total_sample_count") >= min_units) & F.col("ccg_avg").isNotNull()
                      & F.col("edge_avg").isNotNull() & (F.col("ccg_sample_count") >= min_units)
                      & (F.col("edge_sample_count") >= min_units)))
    return out.select(
        "dlcp", "test_name",
        round_half_up(F.col("pre_diff"), 6).alias("pre_time_diff"),
        round_half_up(F.col("main_diff"), 6).alias("main_time_diff"),
        round_half_up(F.col("edge_avg") - F.col("ccg_avg"), 6).alias("delta"),
        "ccg_programs", "edge_programs",
        round_half_up(F.col("ccg_avg"), 6).alias("ccg_avg_time"),
        round_half_up(F.col("edge_avg"), 6).alias("edge_avg_time"),
        "ccg_sample_count", "edge_sample_count", "total_sample_count", "program_count", "functional_bin")


def top_delta(deltas: DataFrame, n: int = TOP_DELTAS) -> DataFrame:
    """O1: the ``n`` rows with the largest |delta| (ties by DLCP, test)."""
    return deltas.orderBy(F.abs(F.col("delta")).desc(), "dlcp", "test_name").limit(n)
