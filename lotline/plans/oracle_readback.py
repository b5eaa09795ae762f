"""Reference SQL (DuckDB dialect) for the read-back queries: what was landed must
come back, so each is written from the source tables without any file."""

from __future__ import annotations

from lotline.plans import oracle_diff, oracle_lotperf, oracle_nested, oracle_requests, oracle_textjobs, oracle_units
from lotline.sources.adapters import view_sql

UNION_BATCHES = f"""
WITH {oracle_units.UNITS_CTE}
SELECT visual_id, lot, facility, functional_bin, CASE WHEN facility <> 'F2' THEN unit_tester_id END AS unit_tester_id,
       CASE WHEN facility = 'F0' THEN lots_temperature END AS lots_temperature
FROM units WHERE facility IN ('F0', 'F1', 'F2')
"""

LATEST_SNAPSHOT = f"WITH {view_sql('requests')} SELECT ordinal, mir FROM requests WHERE ordinal % 3 = 0"

_SHOWN = "visual_id, lot, process_step, devrevstep, functional_bin, interface_bin"
REPORT_BUNDLE = f"""
SELECT 'pareto' AS part, * FROM ({oracle_units.BIN_PARETO})
UNION ALL BY NAME
SELECT * FROM (WITH {oracle_units.UNITS_CTE}, {oracle_units.NORMALIZED_CTE} SELECT 'details' AS part, {_SHOWN} FROM norm)
UNION ALL BY NAME
SELECT * FROM (WITH {oracle_units.UNITS_CTE}, {oracle_units.NORMALIZED_CTE}
               SELECT 'exceptions' AS part, {_SHOWN} FROM norm WHERE lot IS NULL OR visual_id IS NULL)
"""

STATUS_TABLES = f"""
WITH {oracle_requests.IDS_CTE}
SELECT sheet, position, ordinal, id, source_lot, CASE WHEN id <> '' AND first_seen IS NOT NULL THEN 'ok' ELSE 'rejected' END AS status,
       CASE WHEN id = '' THEN 'no id' WHEN first_seen IS NULL THEN 'no source lot' END AS reason, 'zip' AS step
FROM zipped
"""

_FORMS = {
    "like": "sub_flow_step LIKE 'CLASS%'",
    "like_any": "sub_flow_step LIKE '%HOT' OR sub_flow_step LIKE 'PHM%'",
    "equals": "goodbad_flag = 'B'",
    "isin": "program_name IN ('PRG0', 'PRG9')",
    "not_in": "sub_flow_step NOT IN ('SPH', 'SCS')",
    "since": "test_end_date >= DATE '2025-06-30' - INTERVAL 600 DAY",
    "all": "sub_flow_step LIKE 'CLASS%' AND goodbad_flag = 'G' AND program_name IN ('PRG0')",
}
PREDICATE_FORMS = f"WITH {view_sql('test_sessions')} " + " UNION ALL ".join(
    f"SELECT '{n}' AS form, operation, count(*) AS rows FROM test_sessions WHERE {c} GROUP BY operation" for n, c in _FORMS.items())

LIMITS_RANK = f"""
SELECT file, category, test_name, CAST(row_number() OVER (PARTITION BY file, category ORDER BY test_name) AS INTEGER) AS rank
FROM ({oracle_textjobs.EXTRACT_LIMITS})
"""

MODE_RANK = f"""
SELECT config_set, execution_mode, count,
       CAST(row_number() OVER (PARTITION BY config_set ORDER BY count DESC, execution_mode) AS INTEGER) AS rank
FROM ({oracle_nested.SQL['mode_counts']})
"""

LOT_RANK = f"""
WITH x AS (SELECT DISTINCT lot, facility, operation, sub_flow_step, devrevstep, program_name FROM ({oracle_lotperf.LOT_PERFORMANCE}))
SELECT *, CAST(row_number() OVER (PARTITION BY facility, operation ORDER BY lot NULLS FIRST, sub_flow_step NULLS FIRST,
                                  devrevstep NULLS FIRST, program_name NULLS FIRST) AS INTEGER) AS rank
FROM x
"""

SQL = {
    "limits_files": oracle_nested.FLATTEN_LIMITS,
    "program_files": oracle_textjobs.PROGRAM_LINES,
    "union_batches": UNION_BATCHES,
    "latest_snapshot": LATEST_SNAPSHOT,
    "report_csv": oracle_units.BIN_PARETO,
    "class_tables": oracle_nested.LEAK_CLASS_LIMITS,
    "report_bundle": REPORT_BUNDLE,
    "snapshot_rotation": oracle_diff.SQL["change_log"],
    "status_tables": STATUS_TABLES,
    "predicate_forms": PREDICATE_FORMS,
    "limits_rank": LIMITS_RANK,
    "mode_rank": MODE_RANK,
    "lot_rank": LOT_RANK,
}
