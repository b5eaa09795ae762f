"""Column checks, predicates, fills and derived columns.

Everything here is a narrow transformation: it runs inside the scan's
whole-stage-codegen span and its filters reach the parquet reader.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)

UNKNOWN = "UNKNOWN"


class MissingColumnsError(KeyError):
    pass


def require_columns(df: DataFrame, required: Iterable[str], optional: Iterable[str] = ()) -> DataFrame:
    """Fail before any job runs when a required column is absent."""
    have = set(df.columns)
    missing = [c for c in required if c not in have]
    if missing:
        raise MissingColumnsError(f"missing columns {missing}; present: {df.columns}")
    for c in optional:
        if c not in have:
            LOG.warning("optional column %s not present", c)
    return df


def resolve_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """For each target name, the first column (in frame order) whose
    trimmed upper-case name is in the target's alias list is renamed to the
    target. Other columns stay."""
    out = df
    for target, names in aliases.items():
        wanted = {n.strip().upper() for n in names}
        src = next((c for c in df.columns if c.strip().upper() in wanted), None)
        if src is not None and src != target:
            out = out.withColumnRenamed(src, target)
    return out


class ExactName(str):
    """A rule of :func:`resolve_by_rule` that the whole name must equal."""


def resolve_by_rule(df: DataFrame, rules: Sequence[tuple[str, Sequence[str]]]) -> dict[str, str]:
    """Ordered rules on trimmed lower-case column names.

    ``rules`` is ``[(target, rule), ...]``; a rule is an :class:`ExactName`, or
    substrings that must all be in the name. Rules are tried in order per
    column and the first hit names the column. Two columns for one target are
    an error (the reference silently takes the later one). Returns
    ``{target: source}``.
    """
    found: dict[str, str] = {}
    for col_name in df.columns:
        low = col_name.strip().lower()
        for target, rule in rules:
            if low == rule if isinstance(rule, ExactName) else all(p in low for p in rule):
                if target in found:
                    raise ValueError(f"columns {found[target]!r} and {col_name!r} both match {target!r}")
                found[target] = col_name
                break
    return found


def select_rename(df: DataFrame, mapping: Mapping[str, str], order: Sequence[str] | None = None) -> DataFrame:
    """``{target: source}`` -> projection in the given target order."""
    order = list(order or mapping.keys())
    return df.select(*[F.col(mapping[t]).alias(t) for t in order if t in mapping])


def apply_filters(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """AND of ``col = value``; a column not in the frame is skipped with a
    warning; a null never equals a value."""
    if not filters:
        return df
    conds = []
    for name, value in filters.items():
        if name in df.columns:
            conds.append(F.col(name) == F.lit(value))
        else:
            LOG.warning("filter column %s not present, skipped", name)
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def optional_predicates(df: DataFrame, *, like: Mapping[str, str] | None = None,
                        like_any: Mapping[str, Sequence[str]] | None = None,
                        equals: Mapping[str, object] | None = None,
                        isin: Mapping[str, Sequence[object]] | None = None,
                        not_in: Mapping[str, Sequence[object]] | None = None,
                        since_days: Mapping[str, int] | None = None,
                        today: Column | None = None) -> DataFrame:
    """P24 (+ the SQL form of P6): predicate forms of the saved queries,
    each switched on by passing it. ``not_in`` is SQL three-valued: null rows
    are dropped. ``since_days`` counts back from ``today`` (the current date)."""
    conds: list[Column] = []
    for c, pat in (like or {}).items():
        conds.append(F.col(c).like(pat))
    for c, pats in (like_any or {}).items():
        conds.append(reduce(lambda a, b: a | b, [F.col(c).like(p) for p in pats]))
    for c, v in (equals or {}).items():
        conds.append(F.col(c) == F.lit(v))
    for c, vs in (isin or {}).items():
        conds.append(F.col(c).isin(list(vs)))
    for c, vs in (not_in or {}).items():
        conds.append(~F.col(c).isin(list(vs)))
    for c, days in (since_days or {}).items():
        conds.append(F.col(c) >= F.date_sub(F.current_date() if today is None else today, int(days)))
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def exclude_value_keep_nulls(df: DataFrame, column: str, value: str) -> DataFrame:
    """P6 (lab form): case-insensitive ``<> value`` that keeps null rows."""
    return df.filter(F.upper(F.coalesce(F.col(column).cast("string"), F.lit(""))) != value.upper())


def fill_unknown(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """P5: null -> 'UNKNOWN' in the given string columns that exist."""
    cols = [c for c in columns if c in df.columns]
    return df.fillna(UNKNOWN, subset=cols) if cols else df


def derive_device_parts(df: DataFrame, devrevstep: str = "devrevstep") -> DataFrame:
    """BOM = char 1, DLCP = chars 5-6, stepping = chars 7-8."""
    d = F.col(devrevstep)
    return (df.withColumn("bom", F.substring(d, 1, 1))
              .withColumn("dlcp", F.substring(d, 5, 2))
              .withColumn("stepping", F.substring(d, 7, 2)))


def prefer_substructure(prefix_sub: str = "substructure_", prefix_unit: str = "unit_",
                        names: Sequence[str] = ("interface_bin", "functional_bin", "data_bin", "good_bad_flag")
                        ) -> list[Column]:
    """P10: ``coalesce(substructure_x, unit_x) AS x`` for each name."""
    return [F.coalesce(F.col(prefix_sub + n), F.col(prefix_unit + n)).cast("string").alias(n) for n in names]


def flag_in_set(flag: Column, values: Sequence[str] = ("Y", "N")) -> Column:
    """A flag that is one of ``values``; null or anything else drops the row."""
    return flag.isin(list(values))


def exceptions(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows with a null in any of ``required``."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required]))


def dedupe_rows(df: DataFrame) -> DataFrame:
    """P20: drop exact duplicate rows (one hash aggregate on all columns)."""
    return df.dropDuplicates()


def first_non_null(candidates: Sequence[str], present: Sequence[str]) -> Column:
    """First non-null among the candidate columns that exist; newlines
    become spaces and the result is trimmed."""
    cols = [F.col(c).cast("string") for c in candidates if c in present]
    if not cols:
        return F.lit(None).cast("string")
    return F.regexp_replace(F.regexp_replace(F.coalesce(*cols), "\n", " "), r"^\s+|\s+\z", "")


def prefix_from_source(file_col: Column, name_col: Column) -> Column:
    """Prefix chosen from the source file name (``IP_CPU`` checked before
    ``IP_CD``; default ``IP_CD::``) put before the pin name."""
    prefix = (F.when(file_col.contains("IP_CPU"), F.lit("IP_CPU::"))
               .when(file_col.contains("IP_CD"), F.lit("IP_CD::"))
               .otherwise(F.lit("IP_CD::")))
    return F.concat(prefix, name_col)
