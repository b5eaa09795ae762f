"""Reference SQL (DuckDB dialect) for the nested JSON queries.

The oracle does not parse JSON: it derives the flat rows straight from the
source tables, so a match shows that the documents round-trip and the
explodes lose and invent nothing.
"""

from __future__ import annotations

from lotline.sources.documents import LIMIT_DOC_EXPRS as E
from lotline.sources.documents import MODE_DOC_EXPRS as M


def fmt(x: str) -> str:
    def fixed(scale: int) -> str:
        return f"regexp_replace(regexp_replace(CAST(CAST({x} AS DECIMAL(38, {scale})) AS VARCHAR), '0+$', ''), '\\.$', '')"
    return (f"CASE WHEN {x} IS NULL THEN '' WHEN abs({x}) < 1e-10 THEN {fixed(15)} "
            f"WHEN abs({x}) < 1 THEN {fixed(10)} ELSE {fixed(8)} END")


def after_sep(x: str) -> str:
    return f"CASE WHEN strpos({x}, '::') > 0 THEN substr({x}, strpos({x}, '::') + 2) ELSE {x} END"


P = f"p AS (SELECT {', '.join(f'{v} AS {k}' for k, v in E.items())} FROM part)"

LIMITS_CTE = P + f""",
settings AS (
  SELECT doc_id, name, s1_vss_high AS vh, s1_vss_low AS vl, s1_vcc_high AS ch, s1_vcc_low AS cl, s1_el1 AS el FROM p
  UNION ALL SELECT doc_id, name, s1_vss_high, s1_vss_low, s1_vcc_high, s1_vcc_low, s1_el2 FROM p
  UNION ALL SELECT doc_id, name, s2_vss_high, NULL, NULL, s2_vcc_low, s2_el1 FROM p
),
flat AS (
  SELECT doc_id, name AS configuration, {after_sep('el')} AS pin_group,
         {fmt('vh')} AS vss_limit_high, {fmt('vl')} AS vss_limit_low,
         {fmt('ch')} AS vcc_limit_high, {fmt('cl')} AS vcc_limit_low
  FROM settings
)"""

FLATTEN_LIMITS = f"WITH {LIMITS_CTE} SELECT * FROM flat"

LEAK_CLASS_LIMITS = f"""
WITH {LIMITS_CTE},
c AS (
  SELECT *, upper(configuration) AS u FROM flat
),
k AS (
  SELECT *,
    CASE WHEN u LIKE '%HOT%' AND (u LIKE '%LEAKHI%' OR u LIKE '%HIGH%' OR u LIKE '%HI%') THEN 'HOT_HI'
         WHEN u LIKE '%HOT%' AND (u LIKE '%LEAKLO%' OR u LIKE '%LOW%' OR u LIKE '%LO%') THEN 'HOT_LO'
         WHEN u LIKE '%COLD%' AND (u LIKE '%LEAKHI%' OR u LIKE '%HIGH%' OR u LIKE '%HI%') THEN 'COLD_HI'
         WHEN u LIKE '%COLD%' AND (u LIKE '%LEAKLO%' OR u LIKE '%LOW%' OR u LIKE '%LO%') THEN 'COLD_LO' END AS leak_class
  FROM c
)
SELECT leak_class, configuration, pin_group,
       CASE WHEN leak_class LIKE '%_HI' THEN vss_limit_high ELSE vcc_limit_high END AS limit_high,
       CASE WHEN leak_class LIKE '%_HI' THEN vss_limit_low ELSE vcc_limit_low END AS limit_low,
       CASE WHEN leak_class LIKE '%_HI' THEN 'VSS' ELSE 'VCC' END AS test_type
FROM k WHERE leak_class IS NOT NULL
"""

MODES_CTE = f"""ev AS (SELECT {', '.join(f'{v} AS {k}' for k, v in M.items())} FROM events),
flat AS (SELECT doc_id, config_set, mode AS execution_mode FROM ev)"""

FLATTEN_MODES = f"WITH {MODES_CTE} SELECT * FROM flat"

MODE_COUNTS = f"""
WITH {MODES_CTE},
c AS (
  SELECT config_set, execution_mode, count(*) AS count FROM flat
  WHERE config_set IS NOT NULL AND config_set <> '' AND execution_mode IS NOT NULL AND execution_mode <> ''
  GROUP BY config_set, execution_mode
),
t AS (SELECT *, sum(count) OVER (PARTITION BY config_set) AS total_count FROM c)
SELECT config_set, execution_mode, count, CAST(total_count AS BIGINT) AS total_count,
       CAST(round_even(CAST(count * 100.0 / total_count AS DECIMAL(38, 10)), 6) AS DOUBLE) AS percentage,
       CAST(CAST(round_even(CAST(count * 100.0 / total_count AS DECIMAL(38, 10)), 1) AS DECIMAL(38, 1)) AS VARCHAR) || '%'
         AS percentage_text
FROM t
"""

SQL = {
    "flatten_limits": FLATTEN_LIMITS,
    "leak_class_limits": LEAK_CLASS_LIMITS,
    "flatten_modes": FLATTEN_MODES,
    "mode_counts": MODE_COUNTS,
}
