"""Reference SQL (DuckDB dialect) for the sheet queries, from the source table without any file."""

from __future__ import annotations

from lotline.plans import oracle_units
from lotline.plans.files import BROKEN_CELL, DAMAGED
from lotline.plans.ingest import OBSERVATIONS
from lotline.sources.adapters import view_sql

# a cell of blanks only is not empty, an empty one is null
_REST = "quantity, operation, eng_id, mir, hri"
_LINES = "row_number() OVER (PARTITION BY sheet ORDER BY ordinal)"

SHEET_LAYOUTS = f"""
WITH {view_sql('requests')}
SELECT ordinal, sheet, source_lot, part_type || 'é' AS part_type, {_REST}, {_LINES} AS line, 'ok' AS status FROM requests
"""

SHEET_LINE_BREAKS = f"""
WITH {view_sql('requests')}
SELECT ordinal, sheet, source_lot, {BROKEN_CELL} AS part_type, {_REST}, 3 * {_LINES} - 2 AS line, 'ok' AS status FROM requests
"""

SHEET_REJECTS = f"""
WITH {view_sql('requests')},
r AS (
  SELECT *, {_LINES} AS line, {DAMAGED} AS record,
         CASE WHEN ordinal % 10 = 1 THEN 'short row' WHEN ordinal % 10 = 2 THEN 'long row' WHEN ordinal % 10 = 3 THEN 'bad quantity'
              WHEN ordinal % 10 = 4 THEN 'misplaced quote' WHEN ordinal % 50 = 49 THEN 'unclosed quote' END AS reason
  FROM requests
)
SELECT {', '.join(f"CASE WHEN reason IS NULL THEN {e} END AS {c}" for c, e in (
    ('ordinal', 'ordinal'), ('sheet', 'sheet'), ('source_lot', 'source_lot'), ('part_type', "part_type || 'é'"), ('quantity', 'CAST(quantity AS INTEGER)'),
    ('operation', 'operation'), ('eng_id', 'eng_id'), ('mir', 'mir'), ('hri', 'hri')))},
       line, CASE WHEN reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, reason, CASE WHEN reason IS NOT NULL THEN record END AS record, sheet AS file_sheet
FROM r
"""

TABLE_FORMS = " UNION ALL ".join(f"SELECT c_custkey, c_name, c_nationkey, c_mktsegment, '{f}' AS form FROM customer" for f in ("csv", "tsv", "jsonl", "parquet"))

# a poll counts by its place in a run of equal sizes among those that find the fresh file
EXPORT_VERDICTS = f"""
WITH o AS (SELECT {', '.join(OBSERVATIONS)}, event_id FROM events),
early AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY polled) AS poll FROM o WHERE polled < TIMESTAMP '2024-01-12 00:00:00'),
fresh AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY polled) AS nth FROM early WHERE size IS NOT NULL AND modified >= TIMESTAMP '2024-01-03 00:00:00'),
still AS (
  SELECT name, poll, size, nth, lag(size, 1) OVER w = size AND lag(size, 2) OVER w = size AND lag(size, 3) OVER w = size AS ok
  FROM fresh WINDOW w AS (PARTITION BY name ORDER BY nth)
),
ready AS (SELECT name, min(poll) AS polls, arg_min(size, poll) AS size FROM still WHERE ok GROUP BY name),
ended AS (SELECT DISTINCT name FROM o WHERE polled >= TIMESTAMP '2024-01-12 00:00:00')
SELECT n.name, CASE WHEN r.name IS NOT NULL THEN 'ready' WHEN EXISTS (SELECT 1 FROM fresh f WHERE f.name = n.name) THEN 'late'
                    WHEN EXISTS (SELECT 1 FROM early f WHERE f.name = n.name AND size IS NOT NULL) THEN 'stale' ELSE 'absent' END AS verdict,
       r.size, COALESCE(r.polls, (SELECT count(*) FROM early f WHERE f.name = n.name)) AS polls
FROM (SELECT DISTINCT name FROM o) n LEFT JOIN ready r ON r.name = n.name
WHERE r.name IS NOT NULL OR n.name IN (SELECT name FROM ended)
"""

SQL = {
    "export_verdicts": EXPORT_VERDICTS,
    "pareto_batches": oracle_units.BIN_PARETO,
    "sheet_layouts": SHEET_LAYOUTS, "sheet_line_breaks": SHEET_LINE_BREAKS, "sheet_rejects": SHEET_REJECTS, "table_forms": TABLE_FORMS}
