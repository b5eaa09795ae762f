"""Reference SQL (DuckDB dialect) for the test-time queries."""

from __future__ import annotations

from lotline.plans.oracle_lotperf import r
from lotline.sources.adapters import view_sql

PAT = r"PRE_(\d+\.\d+)MS_MAIN_(\d+\.\d+)MS_ET_(\d+\.\d+)MS"

BASE = view_sql("test_durations") + f""",
p0 AS (
  SELECT * EXCLUDE (test_result),
         CAST(NULLIF(regexp_extract(test_result, '{PAT}', 1), '') AS DOUBLE) AS pre_time,
         CAST(NULLIF(regexp_extract(test_result, '{PAT}', 2), '') AS DOUBLE) AS main_time
  FROM test_durations
),
parsed AS (SELECT *, pre_time + main_time AS total_time FROM p0 WHERE pre_time IS NOT NULL),
common AS (
  SELECT functional_bin FROM parsed WHERE functional_bin IS NOT NULL
  GROUP BY functional_bin ORDER BY count(*) DESC, functional_bin LIMIT 1
),
filtered AS (SELECT * FROM parsed WHERE functional_bin IN (SELECT functional_bin FROM common))"""

PARSE_DURATIONS = f"WITH {BASE} SELECT * FROM parsed"
COMMON_BIN = f"WITH {BASE} SELECT * FROM common"

AVG_TEST_TIMES = f"""
WITH {BASE}
SELECT visual_id, test_name, {r('avg(pre_time)', 6)} AS pre_time, {r('avg(main_time)', 6)} AS main_time,
       {r('avg(total_time)', 6)} AS total_time, min(program_name) AS program_name, min(dlcp) AS dlcp,
       min(lot) AS lot, min(functional_bin) AS functional_bin
FROM filtered WHERE visual_id IS NOT NULL AND test_name IS NOT NULL
GROUP BY visual_id, test_name
"""


def _ttg(per_unit: str) -> str:
    return f"""
g AS (
  SELECT lot, program_name, min(dlcp) AS dlcp, count(*) AS unit_count, sum(unit_time) AS t,
         min(functional_bin) AS functional_bin
  FROM {per_unit} GROUP BY lot, program_name
)
SELECT lot, program_name, dlcp, unit_count, {r('t', 6)} AS total_time_ms, {r('t / 1000', 6)} AS total_time_s,
       {r('t / unit_count', 6)} AS ttg_ms, {r('t / unit_count / 1000', 6)} AS ttg_s, functional_bin
FROM g"""


LOT_TTG = f"""
WITH {BASE},
per_unit AS (
  SELECT lot, program_name, visual_id, sum(total_time) AS unit_time, min(dlcp) AS dlcp, min(functional_bin) AS functional_bin
  FROM filtered WHERE visual_id IS NOT NULL AND lot IS NOT NULL AND program_name IS NOT NULL
  GROUP BY lot, program_name, visual_id
),
{_ttg('per_unit')}
"""

LOT_TTG_GLOBAL = f"""
WITH {BASE},
unit_total AS (SELECT visual_id, sum(total_time) AS unit_time FROM filtered WHERE visual_id IS NOT NULL GROUP BY visual_id),
members AS (
  SELECT lot, program_name, visual_id, min(dlcp) AS dlcp, min(functional_bin) AS functional_bin
  FROM filtered WHERE visual_id IS NOT NULL AND lot IS NOT NULL AND program_name IS NOT NULL
  GROUP BY lot, program_name, visual_id
),
per_unit AS (SELECT m.*, u.unit_time FROM members m JOIN unit_total u ON m.visual_id = u.visual_id),
{_ttg('per_unit')}
"""

DELTA_CTE = BASE + f""",
base AS (SELECT * FROM filtered WHERE dlcp IS NOT NULL AND test_name IS NOT NULL),
per_prog AS (
  SELECT dlcp, test_name, program_name, avg(pre_time) AS pre, avg(main_time) AS main, avg(total_time) AS total,
         count(DISTINCT visual_id) AS n,
         CASE WHEN substr(program_name, 10, 1) = 'H' THEN 'CCG' ELSE 'EDGE' END AS family
  FROM base WHERE program_name IS NOT NULL GROUP BY dlcp, test_name, program_name
),
fam AS (
  SELECT dlcp, test_name,
         avg(total) FILTER (WHERE family = 'CCG') AS ccg_avg,
         avg(total) FILTER (WHERE family = 'EDGE') AS edge_avg,
         COALESCE(sum(n) FILTER (WHERE family = 'CCG'), 0) AS ccg_sample_count,
         COALESCE(sum(n) FILTER (WHERE family = 'EDGE'), 0) AS edge_sample_count,
         max(pre) - min(pre) AS pre_diff, max(main) - min(main) AS main_diff,
         COALESCE(string_agg(program_name, ', ' ORDER BY program_name) FILTER (WHERE family = 'CCG'), '') AS ccg_programs,
         COALESCE(string_agg(program_name, ', ' ORDER BY program_name) FILTER (WHERE family = 'EDGE'), '') AS edge_programs,
         count(*) AS program_count
  FROM per_prog GROUP BY dlcp, test_name
),
totals AS (
  SELECT dlcp, test_name, count(DISTINCT visual_id) AS total_sample_count, min(functional_bin) AS functional_bin
  FROM base GROUP BY dlcp, test_name
),
deltas AS (
  SELECT f.dlcp, f.test_name, {r('pre_diff', 6)} AS pre_time_diff, {r('main_diff', 6)} AS main_time_diff,
         {r('edge_avg - ccg_avg', 6)} AS delta, ccg_programs, edge_programs,
         {r('ccg_avg', 6)} AS ccg_avg_time, {r('edge_avg', 6)} AS edge_avg_time,
         CAST(ccg_sample_count AS BIGINT) AS ccg_sample_count, CAST(edge_sample_count AS BIGINT) AS edge_sample_count,
         total_sample_count, program_count, functional_bin
  FROM fam f JOIN totals t ON f.dlcp = t.dlcp AND f.test_name = t.test_name
  WHERE total_sample_count >= 5 AND ccg_avg IS NOT NULL AND edge_avg IS NOT NULL
    AND ccg_sample_count >= 5 AND edge_sample_count >= 5
)"""

PROGRAM_DELTA = f"WITH {DELTA_CTE} SELECT * FROM deltas"
TOP_DELTA = f"WITH {DELTA_CTE} SELECT * FROM deltas ORDER BY abs(delta) DESC, dlcp, test_name LIMIT 20"

SQL = {
    "parse_durations": PARSE_DURATIONS,
    "common_bin": COMMON_BIN,
    "avg_test_times": AVG_TEST_TIMES,
    "lot_ttg": LOT_TTG,
    "lot_ttg_global": LOT_TTG_GLOBAL,
    "program_delta": PROGRAM_DELTA,
    "top_delta": TOP_DELTA,
}
