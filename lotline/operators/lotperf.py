"""Lot performance (A12 / W1), the lab report (P3 P6 P20 P21 O2), product
targets (W2 forward fill, P18, J6 lookup) and target status (P17).

Plan notes
* A12 is written as one ``groupBy`` on the seven partition keys instead of
  seven whole-partition windows followed by DISTINCT: a hash aggregate with
  map-side partial aggregation, one shuffle. With one distinct measure
  (units) Spark first aggregates on (keys, visual_id), so a lot holding a
  third of the rows is still spread by unit id.
* The projected device step is not a key; the set of device steps of a
  group rides along as ``collect_set`` of a one-field struct (a null step is
  a row of the projection too; deduplicated map-side; bounded by the
  products in one lot, not by rows) and is exploded afterwards.
* The target lookup turns the reference's wildcard rule (a missing fact
  key matches anything) into an equi-join: every target row is listed once
  per key mask, reduced to the first target per (mask, keys), and facts join
  on (mask, masked keys) with null-safe equality. No theta or nested-loop
  join; the target side has at most 7 rows per target row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.functions.classify import normalise_rate, target_status
from lotline.functions.numbers import normalise_key, percent_text, round_half_up
from lotline.operators.clean import (
    ExactName,
    dedupe_rows,
    exclude_value_keep_nulls,
    optional_predicates,
    require_columns,
    resolve_by_rule,
    select_rename,
)

PERF_KEYS = ("facility", "operation", "sub_flow_step", "s_spec", "program_name", "prodgroup3", "lot")

# Sub-flow steps the saved query leaves out (SQL NOT IN).
EXCLUDED_SUB_FLOWS = ("SPH", "SPC", "SCC")
# Report order of sub-flow steps; others follow alphabetically.
STEP_ORDER = ("CLASSHOT", "CLASSCOLD", "PHMHOT", "PHMCOLD")


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)).cast("double"))


def lot_performance(sessions: DataFrame, keys: Sequence[str] = PERF_KEYS,
                    exclude_sub_flows: Sequence[str] | None = EXCLUDED_SUB_FLOWS,
                    lots: DataFrame | None = None) -> DataFrame:
    """Yield / test-time / retest measures per (facility, operation,
    sub-flow step, s_spec, program, product group, lot).

    Output: the projected columns of the saved query (lot, facility,
    operation, sub-flow step, device step, program) and its measures, with
    each percent text next to its number; DISTINCT over that projection.
    """
    require_columns(sessions, [*keys, "visual_id", "goodbad_flag", "within_lao_sfs_latest_flag",
                               "within_session_sequence_number", "test_time", "devrevstep"])
    df = sessions
    if exclude_sub_flows:
        df = optional_predicates(df, not_in={"sub_flow_step": exclude_sub_flows})
    if lots is not None:
        df = df.join(lots.select(F.col(lots.columns[0]).alias("lot")), "lot", "left_semi")
    good = F.col("goodbad_flag") == "G"
    bad = F.col("goodbad_flag") == "B"
    latest = F.col("within_lao_sfs_latest_flag") == "Y"
    retest = F.col("within_lao_sfs_latest_flag") == "N"
    t = F.col("test_time")
    g = df.groupBy(*keys).agg(
        F.countDistinct("visual_id").alias("total_tested"),
        F.count("visual_id").alias("tested_qty"),
        F.count_if(retest).alias("retested_qty"),
        F.count_if(F.col("within_session_sequence_number").isin(2, 3, 4) & good).alias("rcs_good_qty"),
        F.count_if(good & latest).alias("tested_good"),
        F.count_if(bad).alias("test_bad"),
        F.count_if(bad & latest).alias("final_tested_bad"),
        F.sum(t).alias("test_time_actual"),
        F.sum(F.when(latest & good, t)).alias("test_time_good"),
        F.sum(F.when(bad, t)).alias("test_time_bad"),
        F.collect_set(F.struct("devrevstep")).alias("_devrevsteps"),
    )
    y1 = round_half_up(_ratio(F.col("tested_good"), F.col("total_tested")), 8)
    r1 = round_half_up(_ratio(F.col("retested_qty"), F.col("total_tested")), 8)
    ttg = round_half_up(_ratio(F.col("test_time_good"), F.col("tested_good")), 2)
    ttb = round_half_up(F.when(F.col("final_tested_bad") > 0,
                               round_half_up(_ratio(F.col("test_time_bad"), F.col("test_bad")), 2))
                        .otherwise(F.lit(0.0)), 2)
    m = g.withColumns({"yield_ratio": y1, "rcs_ratio": r1, "ttg": ttg, "ttb": ttb})
    ett = round_half_up((F.col("ttg") * F.col("yield_ratio")
                         + F.col("ttb") * (1 - F.col("yield_ratio") + F.col("rcs_ratio")))
                        / (1 + F.col("rcs_ratio")), 2)
    recovery = _ratio(F.col("rcs_good_qty"), F.col("retested_qty"))
    out = (m.withColumns({
                "ett": ett,
                "yield_pct": percent_text(_ratio(F.col("tested_good"), F.col("total_tested"))),
                "rcs_pct": percent_text(_ratio(F.col("retested_qty"), F.col("total_tested"))),
                "recovery_rate": round_half_up(recovery * 100, 2),
                "recovery_rate_pct": percent_text(recovery)})
            .withColumn("_step", F.explode("_devrevsteps")).withColumn("devrevstep", F.col("_step.devrevstep")))
    return out.select(
        "lot", "facility", "operation", "sub_flow_step", "devrevstep", "program_name",
        "total_tested", "tested_good", "yield_ratio", "yield_pct", "ttg", "ttb", "ett",
        "rcs_ratio", "rcs_pct", "recovery_rate", "recovery_rate_pct",
    ).distinct()


def step_rank(step: Column) -> Column:
    """O2: CLASSHOT, CLASSCOLD, PHMHOT, PHMCOLD get 0-3 (trimmed, upper case),
    any other step 4, null 999."""
    key = F.upper(F.trim(step))
    pos = F.array_position(F.array(*[F.lit(s) for s in STEP_ORDER]), key)
    return F.when(step.isNull(), F.lit(999)).when(pos > 0, pos - 1).otherwise(F.lit(len(STEP_ORDER))).cast("int")


# Column-name rules of the lab report, in order: exact lower-case
# names, or substrings that must all be in the name.
LAB_RULES = (
    ("LOT", ExactName("lot")),
    ("Facility", ("facility",)),
    ("Operation", ("operation",)),
    ("Sub Flow Step", ("sub_flow",)),
    ("Sub Flow Step", ("sub flow",)),
    ("Devrevstep", ("devrevstep",)),
    ("Program Name", ("program", "name")),
    ("Total Tested", ("total", "test")),
    ("Tested Good", ("teste", "good")),
    ("Yield", ExactName("yield")),
    ("TTG", ExactName("ttg")),
    ("ETT", ExactName("ett")),
    ("RCS", ExactName("rcs")),
    ("Recovery Rate", ("recovery",)),
)
LAB_COLUMNS = tuple(dict.fromkeys(t for t, _ in LAB_RULES))


# Header names of the lab extract.
LAB_HEADERS = {
    "lot": "lot", "facility": "facility", "operation": "operation", "sub_flow_step": "sub_flow_step",
    "devrevstep": "devrevstep", "program_name": "program_name", "total_tested": "Total_Tested",
    "tested_good": "Teste_Good", "yield_pct": "Yield", "ttg": "TTG", "ett": "ETT", "rcs_pct": "RCS",
    "recovery_rate_pct": "Recovery_Rate",
}


def lab_extract(perf: DataFrame) -> DataFrame:
    """The lot performance under the lab extract's header names."""
    return perf.select(*[F.col(c).alias(h) for c, h in LAB_HEADERS.items()])


def lab_report(perf: DataFrame, sort: bool = True) -> DataFrame:
    """Lab branch: map columns by name rules (P3, LOT optional), select and
    rename (P21), drop duplicate rows (P20), drop sub-flow 'SCS' in any case
    but keep nulls (P6), order by the step rank (O2), device step, program."""
    mapping = resolve_by_rule(perf, LAB_RULES)
    missing = [c for c in LAB_COLUMNS if c != "LOT" and c not in mapping]
    if missing:
        raise KeyError(f"lab report: no column for {missing}; columns: {perf.columns}")
    out = dedupe_rows(select_rename(perf, mapping, LAB_COLUMNS))
    out = exclude_value_keep_nulls(out, "Sub Flow Step", "SCS")
    out = out.withColumn("step_rank", step_rank(F.col("Sub Flow Step")))
    if sort:
        # the report order, then every other column as a tie-break: equal
        # report keys are spread by the range partitioner instead of landing
        # in one task
        rest = [c for c in out.columns if c not in ("step_rank", "Sub Flow Step", "Devrevstep", "Program Name")]
        out = out.orderBy("step_rank", F.upper(F.trim(F.col("Sub Flow Step"))), "Devrevstep", "Program Name", *rest)
    return out


def forward_fill(df: DataFrame, columns: Sequence[str], order_col: str = "ordinal",
                 partition_cols: Sequence[str] = ("sheet",)) -> DataFrame:
    """Carry the last non-null value down in sheet order (merged cells),
    per sheet (a sheet is one ordered group; sheets run in parallel)."""
    if not partition_cols:
        raise ValueError("forward_fill needs the sheet/file column(s) to partition by")
    w = Window.partitionBy(*partition_cols).orderBy(order_col).rowsBetween(Window.unboundedPreceding,
                                                                          Window.currentRow)
    out = df
    for c in columns:
        out = out.withColumn(c, F.last(F.col(c), ignorenulls=True).over(w))
    return out


TARGET_KEYS = ("operation", "sub_flow_step", "devrevstep")


def _masks(n: int) -> list[int]:
    return list(range(1, 2 ** n))


def target_lookup(facts: DataFrame, targets: DataFrame, keys: Sequence[str] = TARGET_KEYS,
                  target_cols: Sequence[str] = ("yield_target", "ttg_target", "rcs_target"),
                  order_col: str = "ordinal") -> DataFrame:
    """Attach the first matching target row to each fact row.

    Keys are compared as trimmed text with float-written whole numbers
    normalised ('6248.0' = '6248'). A null or blank fact key matches any
    target value; a fact with no key at all matches nothing. Among matches
    the target with the smallest ordinal wins.
    """
    keys = list(keys)
    n = len(keys)

    def norm(c: Column) -> Column:
        v = normalise_key(c)
        return F.when(v == "", F.lit(None)).otherwise(v)

    fk = [norm(F.col(k)) for k in keys]
    fmask = sum(((F.when(fk[i].isNotNull(), F.lit(1 << i)).otherwise(F.lit(0))) for i in range(n)), F.lit(0))
    f = facts.withColumn("_mask", fmask)
    for i, k in enumerate(keys):
        f = f.withColumn(f"_k{i}", fk[i])

    tk = [norm(F.col(k)) for k in keys]
    masks = F.array(*[F.lit(m) for m in _masks(n)])
    t = targets.select(*[tk[i].alias(f"_t{i}") for i in range(n)], order_col, *target_cols) \
        .withColumn("_mask", F.explode(masks))
    masked = [F.when((F.col("_mask").bitwiseAND(F.lit(1 << i))) > 0, F.col(f"_t{i}")) for i in range(n)]
    # a target with a null key cell cannot match a fact that has that key
    usable = F.lit(True)
    for i in range(n):
        usable = usable & ~(((F.col("_mask").bitwiseAND(F.lit(1 << i))) > 0) & F.col(f"_t{i}").isNull())
    t = t.filter(usable).select("_mask", *[masked[i].alias(f"_k{i}") for i in range(n)], order_col, *target_cols)
    first = (t.groupBy("_mask", *[f"_k{i}" for i in range(n)])
              .agg(F.min_by(F.struct(*target_cols), F.col(order_col)).alias("_t")))
    cond = [f["_mask"] == first["_mask"]] + [f[f"_k{i}"].eqNullSafe(first[f"_k{i}"]) for i in range(n)]
    joined = f.join(first, cond, "left")
    return joined.select(*[f[c] for c in facts.columns], *[F.col(f"_t.{c}").alias(c) for c in target_cols])


def target_compare(perf: DataFrame, targets: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """Lot performance with product targets and status (J6 + P18 + P17).

    Yield and RCS targets are normalised to percent numbers (a value in
    [0, 1] is a fraction, shown with two decimals); ETT is judged against
    the TTG target.
    """
    joined = target_lookup(perf, targets, order_col=order_col)
    yt = round_half_up(normalise_rate(F.col("yield_target")), 2)
    rt = round_half_up(normalise_rate(F.col("rcs_target")), 2)
    tt = F.col("ttg_target").cast("string").try_cast("double")
    y = round_half_up(F.col("yield_ratio") * 100, 2)
    r = round_half_up(F.col("rcs_ratio") * 100, 2)
    return (joined.withColumn("yield_target_pct", yt).withColumn("rcs_target_pct", rt)
                  .withColumn("ttg_target_value", tt)
                  .withColumn("yield_status", target_status(y, F.col("yield_target_pct"), True))
                  .withColumn("ttg_status", target_status(F.col("ttg"), F.col("ttg_target_value"), False))
                  .withColumn("ett_status", target_status(F.col("ett"), F.col("ttg_target_value"), False))
                  .withColumn("rcs_status", target_status(r, F.col("rcs_target_pct"), False))
                  .drop("yield_target", "rcs_target", "ttg_target"))
