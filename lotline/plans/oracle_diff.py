"""Reference SQL (DuckDB dialect) for the catalogue diff."""

from __future__ import annotations

from lotline.operators.diff import CATALOGUE_COLUMNS, COUNT_KEYS
from lotline.sources.adapters import snapshot_sql

COLS = ", ".join(CATALOGUE_COLUMNS)


def _not_in(a: str, b: str) -> str:
    cond = " AND ".join(f"x.{c} IS NOT DISTINCT FROM y.{c}" for c in CATALOGUE_COLUMNS)
    return f"SELECT {COLS} FROM {a} x WHERE NOT EXISTS (SELECT 1 FROM {b} y WHERE {cond})"


BASE = f"""{snapshot_sql()},
added AS ({_not_in('snap_new', 'snap_old')}),
removed AS ({_not_in('snap_old', 'snap_new')}),
changes AS (SELECT 'Added' AS modify_flag, * FROM added UNION ALL SELECT 'Removed', * FROM removed)"""

KEYS = ", ".join(COUNT_KEYS)

SQL = {
    "snapshot_added": f"WITH {BASE} SELECT * FROM added",
    "snapshot_removed": f"WITH {BASE} SELECT * FROM removed",
    "change_log": f"WITH {BASE} SELECT * FROM changes",
    "diff_counts": f"WITH {BASE} SELECT modify_flag, {KEYS}, count(*) AS row_count FROM changes GROUP BY modify_flag, {KEYS}",
    "diff_counts_dropna": (f"WITH {BASE} SELECT modify_flag, {KEYS}, count(*) AS row_count FROM changes WHERE "
                           + " AND ".join(f"{k} IS NOT NULL" for k in COUNT_KEYS)
                           + f" GROUP BY modify_flag, {KEYS}"),
}
