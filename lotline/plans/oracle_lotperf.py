"""Reference SQL (DuckDB dialect) for the lot-performance queries."""

from __future__ import annotations

from lotline.sources.adapters import view_sql


def r(expr: str, n: int) -> str:
    """Decimal half-up rounding of a double, as ``round_half_up``."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 10)), {n}) AS DOUBLE)"


def pct(expr: str) -> str:
    return (f"CASE WHEN ({expr}) IS NULL THEN NULL ELSE "
            f"CAST(CAST(round(CAST(({expr}) * 100 AS DECIMAL(38, 10)), 2) AS DECIMAL(38, 2)) AS VARCHAR) || '%' END")


KEYS = "facility, operation, sub_flow_step, s_spec, program_name, prodgroup3, lot"

PERF_CTE = view_sql("test_sessions") + f""",
s AS (SELECT * FROM test_sessions WHERE sub_flow_step NOT IN ('SPH', 'SPC', 'SCC')),
g AS (
  SELECT {KEYS},
         count(DISTINCT visual_id) AS total_tested,
         count(*) FILTER (WHERE within_lao_sfs_latest_flag = 'N') AS retested_qty,
         count(*) FILTER (WHERE within_session_sequence_number IN (2, 3, 4) AND goodbad_flag = 'G') AS rcs_good_qty,
         count(*) FILTER (WHERE goodbad_flag = 'G' AND within_lao_sfs_latest_flag = 'Y') AS tested_good,
         count(*) FILTER (WHERE goodbad_flag = 'B') AS test_bad,
         count(*) FILTER (WHERE goodbad_flag = 'B' AND within_lao_sfs_latest_flag = 'Y') AS final_tested_bad,
         sum(CASE WHEN within_lao_sfs_latest_flag = 'Y' AND goodbad_flag = 'G' THEN test_time END) AS test_time_good,
         sum(CASE WHEN goodbad_flag = 'B' THEN test_time END) AS test_time_bad
  FROM s GROUP BY {KEYS}
),
m AS (
  SELECT *,
         {r("tested_good / NULLIF(total_tested, 0)", 8)} AS yield_ratio,
         {r("retested_qty / NULLIF(total_tested, 0)", 8)} AS rcs_ratio,
         {r("test_time_good / NULLIF(tested_good, 0)", 2)} AS ttg,
         {r("CASE WHEN final_tested_bad > 0 THEN " + r("test_time_bad / NULLIF(test_bad, 0)", 2) + " ELSE 0.0 END", 2)} AS ttb
  FROM g
),
steps AS (SELECT DISTINCT {KEYS}, devrevstep FROM s),
perf AS (
  SELECT DISTINCT m.lot, m.facility, m.operation, m.sub_flow_step, steps.devrevstep, m.program_name,
         total_tested, tested_good, yield_ratio,
         {pct("tested_good / NULLIF(total_tested, 0)")} AS yield_pct,
         ttg, ttb,
         {r("(ttg * yield_ratio + ttb * (1 - yield_ratio + rcs_ratio)) / (1 + rcs_ratio)", 2)} AS ett,
         rcs_ratio,
         {pct("retested_qty / NULLIF(total_tested, 0)")} AS rcs_pct,
         {r("rcs_good_qty / NULLIF(retested_qty, 0) * 100", 2)} AS recovery_rate,
         {pct("rcs_good_qty / NULLIF(retested_qty, 0)")} AS recovery_rate_pct
  FROM m LEFT JOIN steps
    ON m.facility IS NOT DISTINCT FROM steps.facility AND m.operation IS NOT DISTINCT FROM steps.operation
   AND m.sub_flow_step IS NOT DISTINCT FROM steps.sub_flow_step AND m.s_spec IS NOT DISTINCT FROM steps.s_spec
   AND m.program_name IS NOT DISTINCT FROM steps.program_name AND m.prodgroup3 IS NOT DISTINCT FROM steps.prodgroup3
   AND m.lot IS NOT DISTINCT FROM steps.lot
)"""

LOT_PERFORMANCE = f"WITH {PERF_CTE} SELECT * FROM perf"

LOT_PERFORMANCE_LOTS = f"""
WITH {PERF_CTE},
lots AS (SELECT lot FROM test_sessions WHERE goodbad_flag = 'B' AND within_lao_sfs_latest_flag = 'N' AND facility = 'F1')
SELECT * FROM perf WHERE lot IN (SELECT lot FROM lots)
"""

LAB_REPORT = f"""
WITH {PERF_CTE},
lab AS (
  SELECT DISTINCT lot AS "LOT", facility AS "Facility", operation AS "Operation", sub_flow_step AS "Sub Flow Step",
         devrevstep AS "Devrevstep", program_name AS "Program Name", total_tested AS "Total Tested",
         tested_good AS "Tested Good", yield_pct AS "Yield", ttg AS "TTG", ett AS "ETT", rcs_pct AS "RCS",
         recovery_rate_pct AS "Recovery Rate"
  FROM perf
)
SELECT *,
       CASE WHEN "Sub Flow Step" IS NULL THEN 999
            WHEN upper(trim("Sub Flow Step")) = 'CLASSHOT' THEN 0
            WHEN upper(trim("Sub Flow Step")) = 'CLASSCOLD' THEN 1
            WHEN upper(trim("Sub Flow Step")) = 'PHMHOT' THEN 2
            WHEN upper(trim("Sub Flow Step")) = 'PHMCOLD' THEN 3
            ELSE 4 END AS step_rank
FROM lab WHERE upper(COALESCE("Sub Flow Step", '')) <> 'SCS'
"""

TARGETS_CTE = f"""
tg AS (
  SELECT operation, sub_flow_step, devrevstep,
         avg(CASE WHEN goodbad_flag = 'G' THEN 1 ELSE 0 END) AS y, avg(test_time) AS tt,
         avg(CASE WHEN within_lao_sfs_latest_flag = 'N' THEN 1 ELSE 0 END) AS rc
  FROM test_sessions GROUP BY operation, sub_flow_step, devrevstep
),
tgo AS (
  SELECT *, row_number() OVER (PARTITION BY operation ORDER BY sub_flow_step NULLS LAST, devrevstep NULLS LAST) AS ordinal,
         lag(sub_flow_step) OVER (PARTITION BY operation ORDER BY sub_flow_step NULLS LAST, devrevstep NULLS LAST) AS prev_sf
  FROM tg
),
sheet AS (
  SELECT operation AS sheet, ordinal,
         CASE WHEN ordinal = 1 THEN CASE WHEN devrevstep LIKE '%AF%' THEN operation || '.0' ELSE operation END END
           AS operation,
         CASE WHEN ordinal > 1 AND prev_sf IS NOT DISTINCT FROM sub_flow_step THEN NULL ELSE sub_flow_step END
           AS sub_flow_step,
         devrevstep,
         CAST(CAST(round(CAST(y AS DECIMAL(38, 10)), 2) AS DECIMAL(10, 2)) AS VARCHAR) AS yield_target,
         {r("tt", 1)} AS ttg_target,
         CAST(CAST(round(CAST(rc * 100 AS DECIMAL(38, 10)), 1) AS DECIMAL(10, 1)) AS VARCHAR) || '%' AS rcs_target
  FROM tgo
),
targets AS (
  SELECT sheet, ordinal,
         last_value(operation IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY ordinal
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS operation,
         last_value(sub_flow_step IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY ordinal
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sub_flow_step,
         devrevstep, yield_target, ttg_target, rcs_target
  FROM sheet
)"""

PRODUCT_TARGETS = f"WITH {view_sql('test_sessions')}, {TARGETS_CTE} SELECT * FROM targets"


def nk(x: str) -> str:
    """normalise_key + blank -> NULL."""
    return f"NULLIF(regexp_replace(trim(CAST({x} AS VARCHAR)), '^([+-]?[0-9]+)[.]0+$', '\\1'), '')"


def rate(x: str) -> str:
    n = f"TRY_CAST(trim(replace(CAST({x} AS VARCHAR), '%', '')) AS DOUBLE)"
    return r(f"CASE WHEN {n} BETWEEN 0 AND 1 THEN {n} * 100 ELSE {n} END", 2)


def status(v: str, t: str, higher_is_good: bool) -> str:
    above, below = ("'good'", "'bad'") if higher_is_good else ("'bad'", "'good'")
    return f"CASE WHEN {v} IS NULL OR {t} IS NULL THEN NULL WHEN abs({v}) > abs({t}) THEN {above} ELSE {below} END"


TARGET_COMPARE = f"""
WITH {PERF_CTE}, {TARGETS_CTE},
f AS (SELECT row_number() OVER () AS _fid, *, {nk('operation')} AS k0, {nk('sub_flow_step')} AS k1, {nk('devrevstep')} AS k2 FROM perf),
t AS (SELECT {nk('operation')} AS k0, {nk('sub_flow_step')} AS k1, {nk('devrevstep')} AS k2, sheet, ordinal,
             yield_target, ttg_target, rcs_target FROM targets),
hits AS (
  SELECT f._fid, t.*, row_number() OVER (PARTITION BY f._fid ORDER BY t.sheet, t.ordinal) AS rn
  FROM f JOIN t
    ON (f.k0 IS NULL OR f.k0 = t.k0) AND (f.k1 IS NULL OR f.k1 = t.k1) AND (f.k2 IS NULL OR f.k2 = t.k2)
   AND (f.k0 IS NOT NULL OR f.k1 IS NOT NULL OR f.k2 IS NOT NULL)
),
j AS (
  SELECT f.* EXCLUDE (_fid, k0, k1, k2), h.yield_target, h.ttg_target, h.rcs_target
  FROM f LEFT JOIN (SELECT * FROM hits WHERE rn = 1) h ON f._fid = h._fid
),
j2 AS (SELECT *, {rate('yield_target')} AS yield_target_pct, {rate('rcs_target')} AS rcs_target_pct,
              ttg_target AS ttg_target_value FROM j)
SELECT * EXCLUDE (yield_target, rcs_target, ttg_target),
       {status(r('yield_ratio * 100', 2), 'yield_target_pct', True)} AS yield_status,
       {status('ttg', 'ttg_target_value', False)} AS ttg_status,
       {status('ett', 'ttg_target_value', False)} AS ett_status,
       {status(r('rcs_ratio * 100', 2), 'rcs_target_pct', False)} AS rcs_status
FROM j2
"""

SQL = {
    "lot_performance": LOT_PERFORMANCE,
    "lot_performance_lots": LOT_PERFORMANCE_LOTS,
    "lab_report": LAB_REPORT,
    "product_targets": PRODUCT_TARGETS,
    "target_compare": TARGET_COMPARE,
}
