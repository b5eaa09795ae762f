"""Joins (J1-J4, J7) and template defaults.

No join here carries a broadcast hint for data whose size is not bounded:
the planner broadcasts a side whose estimated size is under
``spark.sql.autoBroadcastJoinThreshold`` and AQE converts a shuffled join
to a broadcast one at runtime once the real size is known, so a limits
table that turns out large stays a sort-merge join instead of failing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.functions.guards import require_rows
from lotline.functions.numbers import round_half_up
from lotline.operators import segments
from lotline.operators.clean import first_non_null, prefix_from_source
from lotline.session import written

LIMIT_KEYS = ("test_type", "configuration")
#: Left rows of one key that one split takes, and keys at most that are dealt over splits.
HEAVY_ROWS = 100_000
HEAVY_KEYS = 64


def limits_left_join(left: DataFrame, limits: DataFrame, keys: Sequence[str] = LIMIT_KEYS,
                     right_keys: Mapping[str, str] | None = None, suffix: str = "_leakage") -> DataFrame:
    """Every left row with every limits row of equal keys (null equals
    null, as the reference's merge does); unmatched left rows kept once.
    Right key columns may be named differently (``right_keys`` maps left
    name -> right name). Other right columns whose names clash with left
    columns get ``suffix``. A key with very many left rows is dealt over tasks.
    ``left`` is worked out once, when this is called, and written: its rows are read for the heavy
    keys and for the join."""
    right_keys = dict(right_keys or {})
    left = written(left, "left")
    r = limits
    for k in keys:
        src = right_keys.get(k, k)
        r = r.withColumnRenamed(src, f"_rk_{k}")
    clash = {c for c in r.columns if c in left.columns}
    for c in clash:
        r = r.withColumnRenamed(c, c + suffix)
    left, r = _dealt(left, r, keys)
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_rk_{k}"]) for k in keys]) & (left["_split"] == r["_split"])
    # the limits of a key are read in a row by a merge, and looked up one by one in a hashed table
    out = left.join(r.hint("merge"), cond, "left")
    names = [c for c in left.columns if c not in ("_split", *[f"_hot_{k}" for k in keys])]
    return out.select(*[left[c] for c in names], *[r[c] for c in r.columns if not c.startswith(("_rk_", "_split"))])


def _dealt(left: DataFrame, r: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_split``: the rows of a heavy left key are dealt over as many splits as it
    has HEAVY_ROWS, its limits rows are copied to each of them; all others are split 0. A key is
    heavy with 1/HEAVY_KEYS of all left rows and HEAVY_ROWS, so the list of them is short."""
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    heavy = counts.join(F.broadcast(total), (F.col("_n") >= HEAVY_ROWS) & (F.col("_n") * HEAVY_KEYS >= F.col("_all")))
    heavy = heavy.select(*[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("_n") / HEAVY_ROWS).cast("int").alias("_of"))
    at = reduce(lambda a, b: a & b, [left[k].eqNullSafe(heavy[f"_hot_{k}"]) for k in keys])
    dealt = left.join(F.broadcast(heavy), at, "left").withColumn("_split", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_of")).cast("int"), F.lit(0)))
    copied = r.join(F.broadcast(heavy), reduce(lambda a, b: a & b, [r[f"_rk_{k}"].eqNullSafe(heavy[f"_hot_{k}"]) for k in keys]), "left")
    copied = copied.withColumn("_split", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_of"), F.lit(1)) - 1)))
    return dealt.drop("_of"), copied.drop("_of", *[f"_hot_{k}" for k in keys])


def match_rate(left: DataFrame, limits: DataFrame, keys: Sequence[str] = LIMIT_KEYS) -> DataFrame:
    """Share of left rows that have at least one limits row (null-safe
    keys). Counted on a left join to the distinct right keys, so it can
    never pass 100 %; an empty left side gives a null rate."""
    rk = limits.select(*[F.col(k).alias(f"_rk_{k}") for k in keys]).distinct().withColumn("_hit", F.lit(1))
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(rk[f"_rk_{k}"]) for k in keys])
    g = left.join(rk, cond, "left").agg(F.count(F.lit(1)).alias("total_rows"),
                                        F.count("_hit").alias("matched_rows"))
    return g.withColumn("match_rate", round_half_up(F.try_divide(F.col("matched_rows").cast("double"),
                                                                 F.col("total_rows").cast("double")), 6))


def _limit_groups(limits: DataFrame, group_col: str) -> DataFrame:
    return limits.select(F.col(group_col).alias("pin_group")).filter(F.col("pin_group").isNotNull()).distinct()


def semi_join_groups(pins: DataFrame, limits: DataFrame, group_col: str = "pin_group",
                     file_col: str = "file") -> DataFrame:
    """J3 (+ P22): pin rows whose group is one of the limits' groups, with
    the pin name prefixed by the source file's IP prefix. No match at all fails the job."""
    kept = pins.join(_limit_groups(limits, group_col), "pin_group", "left_semi")
    return require_rows(kept.select(file_col, "pin_group", prefix_from_source(F.upper(F.col(file_col)), F.col("pin_name")).alias("pin_name")),
                        "no pin group of the limits is among the pins")


def group_match_counts(pins: DataFrame, limits: DataFrame, group_col: str = "pin_group") -> DataFrame:
    """One row per limits group with the number of matching pin rows (0 when none)."""
    counts = pins.groupBy("pin_group").agg(F.count(F.lit(1)).alias("pin_count"))
    return (_limit_groups(limits, group_col).join(counts, "pin_group", "left")
            .select("pin_group", F.coalesce(F.col("pin_count"), F.lit(0)).cast("bigint").alias("pin_count")))


def positional_zip(rows: DataFrame, ids: DataFrame, group: str, row_order: str, id_order: str,
                   id_col: str = "id", newest_first: bool = True) -> DataFrame:
    """Per group, the i-th row (by ``row_order``) gets the i-th id. Ids
    are listed newest first, so the list is reversed (oldest first) before
    pairing; both orders are integers, counted in chunks. Rows without an id get ''; ids without a row are dropped."""
    r = segments.place(rows, [group], row_order, "_pos")
    i = ids.select(group, F.col(id_col).alias("_id"), (-F.col(id_order) if newest_first else F.col(id_order)).alias("_order"))
    i = segments.place(i, [group], "_order", "_pos").drop("_order")
    return (r.join(i, [group, "_pos"], "left")
             .withColumn(id_col, F.coalesce(F.col("_id"), F.lit("")))
             .drop("_id", "_pos"))


def template_row(template: DataFrame, group: str, order_col: str, columns: Sequence[str]) -> DataFrame:
    """Per sheet, the template row with the most non-null cells among
    ``columns`` (ties: the first by ``order_col``); one row per sheet."""
    score = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    best = (template.withColumn("_score", score)
                    .groupBy(group)
                    .agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in columns]),
                                  F.struct(F.col("_score"), (-F.col(order_col)).alias("_o"))).alias("_t")))
    return best.select(group, *[F.col("_t")[c].alias(c) for c in columns])


def fill_template(rows: DataFrame, defaults: DataFrame, group: str,
                  mapped: Mapping[str, Sequence[str]], columns: Sequence[str]) -> DataFrame:
    """P7 + P8: every row becomes a template row. A mapped column takes the
    first non-null of its candidate columns in the row (newlines to spaces,
    trimmed; it stays null when none is present); every other template
    column takes the sheet's default. Defaults join on the sheet key."""
    d = defaults.select(group, *[F.col(c).alias(f"_d_{c}") for c in columns if c in defaults.columns])
    j = rows.join(d, group, "left")
    out = []
    for c in columns:
        if c in mapped:
            out.append(first_non_null(mapped[c], rows.columns).alias(c))
        elif c in defaults.columns:
            out.append(F.col(f"_d_{c}").alias(c))
        else:
            out.append(F.lit(None).cast("string").alias(c))
    return j.select(group, *[c for c in rows.columns if c not in columns and c != group], *out)
