"""Reference SQL (DuckDB dialect) for the unit-report queries."""

from __future__ import annotations

from lotline.sources.adapters import view_sql

UNITS_CTE = view_sql("unit_results_raw") + """,
units AS (
  SELECT visual_id, substructure_id, lot, operation, facility, devrevstep, program_name, process_step,
         COALESCE(substructure_interface_bin, unit_interface_bin) AS interface_bin,
         COALESCE(substructure_functional_bin, unit_functional_bin) AS functional_bin,
         COALESCE(substructure_data_bin, unit_data_bin) AS data_bin,
         COALESCE(substructure_good_bad_flag, unit_good_bad_flag) AS good_bad_flag,
         COALESCE(substructure_subflow_latest_flag, unit_subflow_latest_flag, '') AS subflow_latest_flag,
         COALESCE(lato_latest_flag, '') AS lato_latest_flag,
         COALESCE(CAST(total_tested AS VARCHAR), '') AS total_tested, COALESCE(CAST(total_good AS VARCHAR), '') AS total_good,
         COALESCE(CAST(total_bad AS VARCHAR), '') AS total_bad, COALESCE(unit_tester_site_id, '') AS unit_tester_site_id,
         COALESCE(unit_tester_id, '') AS unit_tester_id, COALESCE(tester_interface_unit_id, '') AS tester_interface_unit_id,
         COALESCE(CAST(lots_temperature AS VARCHAR), '') AS lots_temperature,
         test_end_date,
         substr(devrevstep, 1, 1) AS bom, substr(devrevstep, 5, 2) AS dlcp, substr(devrevstep, 7, 2) AS stepping
  FROM unit_results_raw
  WHERE COALESCE(operation_subflow_latest_flag, operation_final_latest_flag) IN ('Y', 'N')
)"""

UNIT_RESULTS_EXTRACT = f"""
WITH {UNITS_CTE},
lots AS (
  SELECT 'L' || lpad(CAST(CAST(floor(o_orderkey / 25) AS BIGINT) AS STRING), 5, '0') AS lot
  FROM orders WHERE o_orderpriority = '1-URGENT'
)
SELECT DISTINCT * FROM units WHERE lot IN (SELECT lot FROM lots)
"""

PARETO_CTE = UNITS_CTE + """,
sliced AS (
  SELECT CASE WHEN subflow_latest_flag = 'Y' THEN 'main' ELSE 'retest' END AS slice, *
  FROM units WHERE substructure_id = 'U1.U2' AND subflow_latest_flag IN ('Y', 'N')
),
rows_ AS (
  SELECT slice, 'functional' AS bin_kind, COALESCE(functional_bin, 'UNKNOWN') AS bin,
         COALESCE(devrevstep, 'UNKNOWN') AS devrevstep, COALESCE(process_step, 'UNKNOWN') AS process_step, visual_id
  FROM sliced
  UNION ALL
  SELECT slice, 'interface', COALESCE(interface_bin, 'UNKNOWN'),
         COALESCE(devrevstep, 'UNKNOWN'), COALESCE(process_step, 'UNKNOWN'), visual_id
  FROM sliced
),
cells AS (
  SELECT slice, bin_kind, process_step, bin, devrevstep, count(DISTINCT visual_id) AS quantity
  FROM rows_ GROUP BY slice, bin_kind, process_step, bin, devrevstep
),
g AS (
  SELECT slice, bin_kind, process_step, bin, devrevstep, CAST(sum(quantity) AS BIGINT) AS quantity,
         GROUPING(bin, devrevstep) AS gid
  FROM cells
  GROUP BY GROUPING SETS ((slice, bin_kind, process_step, bin, devrevstep), (slice, bin_kind, process_step, bin),
                          (slice, bin_kind, process_step, devrevstep), (slice, bin_kind, process_step))
),
w AS (
  SELECT *,
         max(CASE WHEN gid = 2 THEN quantity END) OVER (PARTITION BY slice, bin_kind, process_step, devrevstep) AS col_total,
         max(CASE WHEN gid = 3 THEN quantity END) OVER (PARTITION BY slice, bin_kind, process_step) AS grand
  FROM g
),
pareto AS (
  SELECT slice, bin_kind, process_step, bin, devrevstep, quantity,
         CASE gid WHEN 0 THEN 'cell' WHEN 1 THEN 'bin_total' WHEN 2 THEN 'step_total' ELSE 'grand_total' END AS row_kind,
         CAST(round(CAST(CASE WHEN gid = 0 THEN quantity / CASE WHEN col_total = 0 THEN 1 ELSE col_total END
                              WHEN gid = 1 THEN CASE WHEN grand = 0 THEN 0.0 ELSE quantity / grand END
                              ELSE CASE WHEN quantity > 0 THEN 1.0 ELSE 0.0 END END AS DECIMAL(38, 10)), 6) AS DOUBLE) AS percentage
  FROM w
)"""

BIN_PARETO = f"""
WITH {PARETO_CTE}
SELECT *,
       CASE WHEN row_kind IN ('step_total', 'grand_total') THEN NULL
            WHEN (bin_kind = 'functional' AND bin = '100') OR (bin_kind = 'interface' AND bin = '1') THEN 'green'
            WHEN percentage > 0.05 THEN 'red'
            WHEN percentage >= 0.02 THEN 'yellow'
            ELSE 'green' END AS severity
FROM pareto
"""

NORMALIZED_CTE = """
norm AS (
  SELECT visual_id, lot, COALESCE(process_step, 'UNKNOWN') AS process_step,
         COALESCE(devrevstep, 'UNKNOWN') AS devrevstep,
         COALESCE(functional_bin, 'UNKNOWN') AS functional_bin,
         COALESCE(interface_bin, 'UNKNOWN') AS interface_bin
  FROM units WHERE subflow_latest_flag = 'Y' AND substructure_id = 'U1.U2'
)"""

UNIT_EXCEPTIONS = f"""
WITH {UNITS_CTE}, {NORMALIZED_CTE}
SELECT * FROM norm
WHERE lot IS NULL OR functional_bin IS NULL OR devrevstep IS NULL OR visual_id IS NULL
"""

RUN_SUMMARY = f"""
WITH {PARETO_CTE}, {NORMALIZED_CTE},
main AS (SELECT * FROM pareto WHERE slice = 'main' AND bin_kind = 'functional'),
ranked AS (
  SELECT process_step, bin,
         row_number() OVER (PARTITION BY process_step ORDER BY quantity DESC, bin) AS rn
  FROM main WHERE row_kind = 'bin_total'
),
top AS (
  SELECT process_step, string_agg(bin, ',' ORDER BY rn) AS top_bins FROM ranked WHERE rn <= 3 GROUP BY process_step
),
grand AS (SELECT process_step, quantity AS grand_total FROM main WHERE row_kind = 'grand_total'),
per_step AS (
  SELECT process_step, count(DISTINCT lot) AS lot_count,
         count(*) FILTER (WHERE lot IS NULL OR visual_id IS NULL) AS exception_count
  FROM norm GROUP BY process_step
)
SELECT g.process_step, g.grand_total, t.top_bins, p.lot_count, p.exception_count
FROM grand g LEFT JOIN top t ON g.process_step = t.process_step
LEFT JOIN per_step p ON g.process_step = p.process_step
"""

INGEST_EXTRACTS = f"""
WITH {UNITS_CTE}
SELECT lot, visual_id, process_step, devrevstep, functional_bin, interface_bin, subflow_latest_flag FROM units
"""

SQL = {
    "ingest_extracts": INGEST_EXTRACTS,
    "unit_results_extract": UNIT_RESULTS_EXTRACT,
    "bin_pareto": BIN_PARETO,
    "unit_exceptions": UNIT_EXCEPTIONS,
    "run_summary": RUN_SUMMARY,
}
