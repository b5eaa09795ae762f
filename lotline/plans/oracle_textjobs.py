"""Reference SQL (DuckDB dialect) for the program-text queries.

The oracle builds the same lines as the Spark job, but finds each test
block's window with a range join over the ending lines instead of the
running windows the Spark job uses, so the two formulations check each
other.
"""

from __future__ import annotations

from lotline.operators import textjobs as T
from lotline.plans.oracle_nested import LIMITS_CTE
from lotline.sources.programs import template_sql


# Fixed values of the input format, typed here so that the reference does not follow the operator:
# the line that begins a wanted test, and the line that ends a block.
HEAD = r"^Test\s+(PrimeDcLeakageTestMethod|TraceAnalyticsDcLeakage)\s+(\S+)"
END = r"^\s*Test "


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+\\z', '', 'g')"


def ext(x: str, pat: str, g: int = 1) -> str:
    return f"CASE WHEN regexp_matches({x}, {q(pat)}) THEN regexp_extract({x}, {q(pat)}, {g}) END"


IL = template_sql("instance_program")

CAND = f"""
multi_src AS (
  SELECT * FROM instance_program_lines
  WHERE strpos(line, 'Configuration') > 0 AND NOT (strpos(line, '=') > 0 AND strpos(line, ';') > 0)
),
semi_ AS (
  SELECT a.file, a.line_no, min(b.line_no) AS semi_line
  FROM multi_src a JOIN instance_program_lines b
    ON b.file = a.file AND b.line_no > a.line_no AND strpos(b.line, ';') > 0
  GROUP BY a.file, a.line_no
),
joined AS (
  SELECT a.file, a.line_no, string_agg(b.line, ' ' ORDER BY b.line_no) AS txt
  FROM multi_src a JOIN semi_ s ON s.file = a.file AND s.line_no = a.line_no
  JOIN instance_program_lines b
    ON b.file = a.file AND b.line_no BETWEEN a.line_no AND s.semi_line
  WHERE NOT EXISTS (SELECT 1 FROM instance_program_lines e WHERE e.file = a.file AND e.line_no > a.line_no
                    AND e.line_no < s.semi_line AND regexp_matches(e.line, {q(END)}))
  GROUP BY a.file, a.line_no
),
cand AS (
  SELECT l.file, l.line_no,
         {ext('l.line', T.TEST_TYPE_RE)} AS c_test_type,
         {strip(ext('l.line', T.BYPASS_RE))} AS c_bypass,
         {strip("CASE WHEN strpos(l.line, 'Configuration') > 0 AND strpos(l.line, '=') > 0 AND strpos(l.line, ';') > 0 THEN "
                + ext('l.line', T.CONFIG_RE) + " ELSE " + ext('j.txt', T.CONFIG_RE) + " END")} AS c_config
  FROM instance_program_lines l LEFT JOIN joined j ON j.file = l.file AND j.line_no = l.line_no
)"""


def heads_cte(first_end_offset: int) -> str:
    return f"""
heads AS (
  SELECT file, line_no AS head_line,
         regexp_extract(line, {q(HEAD)}, 2) AS test_instance_name,
         regexp_extract(line, {q(HEAD)}, 1) AS test_method
  FROM instance_program_lines WHERE regexp_matches(line, {q(HEAD)})
),
ends AS (SELECT file, line_no FROM instance_program_lines WHERE regexp_matches(line, {q(END)})),
first_end AS (
  SELECT h.file, h.head_line, min(e.line_no) AS end_line
  FROM heads h LEFT JOIN ends e ON e.file = h.file AND e.line_no >= h.head_line + {first_end_offset}
  GROUP BY h.file, h.head_line
),
bounds AS (
  SELECT h.*, COALESCE(x.end_line, 2147483647) AS last_line
  FROM heads h JOIN first_end x ON x.file = h.file AND x.head_line = h.head_line
)"""


INSTANCES_CTE = IL + "," + CAND + "," + heads_cte(2) + f""",
fields AS (
  SELECT b.file, b.head_line,
         arg_min(c.c_test_type, c.line_no) FILTER (WHERE c.c_test_type IS NOT NULL) AS test_type,
         arg_min(c.c_bypass, c.line_no) FILTER (WHERE c.c_bypass IS NOT NULL) AS bypass_port,
         arg_min(c.c_config, c.line_no) FILTER (WHERE c.c_config IS NOT NULL) AS raw_config
  FROM bounds b JOIN cand c ON c.file = b.file AND c.line_no BETWEEN b.head_line + 1 AND b.last_line
  GROUP BY b.file, b.head_line
),
inst0 AS (
  SELECT b.file, b.head_line, b.test_instance_name, b.test_method,
         f.test_type, f.bypass_port, COALESCE(f.raw_config, 'UNKNOWN') AS raw
  FROM bounds b LEFT JOIN fields f ON f.file = b.file AND f.head_line = b.head_line
),
inst1 AS (
  SELECT *, strpos(raw, {q(T.RULE_MARKER)}) > 0 AS is_rule,
         CASE WHEN strpos(raw, {q(T.RULE_MARKER)}) > 0 THEN regexp_extract_all(raw, {q(T.PARAM_RE)}, 1)
              ELSE []::VARCHAR[] END AS params
  FROM inst0
),
instances AS (
  SELECT file, head_line, test_instance_name,
         CASE WHEN is_rule AND len(params) > 0 THEN params[1] WHEN is_rule THEN raw
              ELSE {strip("replace(raw, '\"', '')")} END AS configuration,
         COALESCE(test_type, 'UNKNOWN') AS test_type, test_method,
         COALESCE(bypass_port, 'UNKNOWN') AS bypass_port,
         COALESCE(params[1], 'UNKNOWN') AS hot_config, COALESCE(params[2], 'UNKNOWN') AS cold_config,
         COALESCE(params[3], 'UNKNOWN') AS phmhot_config, COALESCE(params[4], 'UNKNOWN') AS all_config,
         CASE WHEN is_rule THEN 'rule' ELSE 'hardcoded' END AS config_kind
  FROM inst1
)"""

EXTRACT_INSTANCES = f"WITH {INSTANCES_CTE} SELECT * FROM instances"

EXTRACT_INSTANCES_LITE = f"""
WITH {IL}, {heads_cte(1)},
cand AS (SELECT file, line_no, {strip(ext('line', T.BYPASS_RE))} AS c_bypass FROM instance_program_lines),
first_ AS (
  SELECT b.file, b.head_line, arg_min(c.c_bypass, c.line_no) FILTER (WHERE c.c_bypass IS NOT NULL) AS bypass_port
  FROM bounds b JOIN cand c ON c.file = b.file AND c.line_no BETWEEN b.head_line + 1 AND b.last_line
  GROUP BY b.file, b.head_line
)
SELECT b.file, b.head_line, b.test_instance_name AS instance_name, b.test_method,
       COALESCE(f.bypass_port, 'UNKNOWN') AS bypass_port
FROM bounds b LEFT JOIN first_ f ON f.file = b.file AND f.head_line = b.head_line
"""

INSTANCE_COUNTS = f"""
WITH {INSTANCES_CTE},
b AS (SELECT test_method, CASE WHEN bypass_port IN ('1', '-1') THEN bypass_port ELSE 'other' END AS _bucket FROM instances),
g AS (
  SELECT test_method, _bucket, count(*) AS instances, GROUPING(test_method, _bucket) AS gid
  FROM b GROUP BY GROUPING SETS ((test_method), (_bucket))
)
SELECT CASE WHEN gid = 1 THEN 'test_method' ELSE 'bypass_port' END AS dimension,
       CASE WHEN gid = 1 THEN test_method ELSE _bucket END AS value, instances
FROM g
"""

INSTANCE_CROSSTAB = f"""
WITH {INSTANCES_CTE}
SELECT config_kind, bypass_port, test_type, count(*) AS instances FROM instances
GROUP BY config_kind, bypass_port, test_type
"""

PROGRAM_LINES = f"WITH {IL} SELECT * FROM instance_program_lines"

# ---------------------------------------------------------------- limits

LL = template_sql("limits_program")
_HEAD = r"^(#?)\s*Test\s+iCShopsTest(.*)$"
_NAME = r"^\s*(\S+)"
_BOUND = r"^\s*(?:#\s*)?Test\s+iCShopsTest"


def _val(side: int, i: int) -> str:
    """Value ``i`` of the chosen pair's high (side 0) or low (side 1) pattern."""
    branches = []
    for k, pair in enumerate(T.LIMIT_PATTERNS, start=1):
        pat = pair[side]
        v = f"regexp_replace(regexp_extract(body, {q(pat)}, {i}), {q(chr(94) + '[\"' + chr(39) + ']+|[\"' + chr(39) + ']+' + chr(92) + 'z')}, '', 'g')"
        v = strip(v)
        branches.append(f"WHEN pair = {k} AND regexp_matches(body, {q(pat)}) THEN {v}")
    return f"CASE {' '.join(branches)} ELSE {q(T.LIMIT_DEFAULT)} END"


_PAIR = "COALESCE(" + ", ".join(
    f"CASE WHEN regexp_matches(body, {q(hi)}) OR regexp_matches(body, {q(lo)}) THEN {k} END"
    for k, (hi, lo) in enumerate(T.LIMIT_PATTERNS, start=1)) + ")"

_VALUES = ",\n".join(
    [f"{_val(0, i + 1)} AS {c}_high" for i, c in enumerate(T.CONDITIONS)]
    + [f"{_val(1, i + 1)} AS {c}_low" for i, c in enumerate(T.CONDITIONS)])

LIMITS_WIDE_CTE = LL + f""",
lb AS (
  SELECT *, regexp_matches(line, {q(_BOUND)}) AS is_bound, regexp_matches(line, {q(_HEAD)}) AS is_head,
         last_value(nullif({strip('line')}, '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM limits_program_lines
),
lb2 AS (
  SELECT *, sum(CASE WHEN is_bound THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS blk
  FROM lb
),
blocks AS (
  SELECT file, blk, min(line_no) AS block_line, bool_or(is_head AND is_bound) AS has_head,
         bool_or(is_bound AND (regexp_extract(line, {q(_HEAD)}, 1) = '#' OR COALESCE(above = '#', false))) AS commented,
         string_agg(CASE WHEN is_head AND is_bound THEN regexp_extract(line, {q(_HEAD)}, 2) ELSE line END, chr(10)
                    ORDER BY line_no) AS txt
  FROM lb2 WHERE blk > 0 GROUP BY file, blk
),
named AS (
  SELECT file, block_line, regexp_extract(txt, {q(_NAME)}, 1) AS test_name, commented,
         regexp_replace(txt, {q(_NAME)}, '') AS body
  FROM blocks WHERE has_head
),
kept AS (SELECT *, {_PAIR} AS pair FROM named WHERE NOT commented AND NOT suffix(test_name, '_FF')),
vals AS (
  SELECT file, block_line,
         CASE WHEN strpos(test_name, 'UPPERDIODE') > 0 THEN 'UPPERDIODE'
              WHEN strpos(test_name, 'LOWERDIODE') > 0 THEN 'LOWERDIODE' ELSE 'OTHER' END AS category,
         test_name,
         {_VALUES}
  FROM kept
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file, category, test_name ORDER BY block_line DESC) AS rn FROM vals
),
limits_wide AS (SELECT * EXCLUDE (block_line, rn) FROM ranked WHERE rn = 1)"""

EXTRACT_LIMITS = f"WITH {LIMITS_WIDE_CTE} SELECT * FROM limits_wide"

LIMITS_LONG = f"""
WITH {LIMITS_WIDE_CTE}
""" + " UNION ALL ".join(
    f"SELECT file, category, test_name, '{c}' AS condition, {c}_high AS high_limit, {c}_low AS low_limit FROM limits_wide"
    for c in T.CONDITIONS)

# ---------------------------------------------------------------- pins

PL = template_sql("pin_program")
PINS_CTE = PL + f""",
p0 AS (
  SELECT file, line_no, {strip('line')} AS s FROM pin_program_lines
),
p1 AS (
  SELECT *,
         CASE WHEN regexp_matches(s, {q(T.GROUP_RE)}) THEN {{'open': true, 'g': regexp_extract(s, {q(T.GROUP_RE)}, 1)}}
              WHEN strpos(s, '}}') > 0 THEN {{'open': false, 'g': NULL::VARCHAR}} END AS ev
  FROM p0
),
p2 AS (
  SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st
  FROM p1
),
pins AS (
  SELECT file, line_no, st.g AS pin_group, regexp_extract(s, {q(T.PIN_RE)}, 1) AS pin_name
  FROM p2 WHERE ev IS NULL AND s <> '' AND st.open AND regexp_matches(s, {q(T.PIN_RE)})
)"""

PIN_GROUPS = f"WITH {PINS_CTE} SELECT * FROM pins"

PINS_PER_GROUP = f"""
WITH {PINS_CTE}
SELECT file, pin_group, count(*) AS pin_count, min(line_no) AS first_line FROM pins GROUP BY file, pin_group
"""

GROUPS_CTE = LIMITS_CTE + ", " + PINS_CTE + """,
lgroups AS (SELECT DISTINCT pin_group FROM flat WHERE pin_group IS NOT NULL)"""

PIN_GROUP_MATCH = f"""
WITH {GROUPS_CTE}
SELECT file, pin_group,
       CASE WHEN strpos(upper(file), 'IP_CPU') > 0 THEN 'IP_CPU::' WHEN strpos(upper(file), 'IP_CD') > 0 THEN 'IP_CD::'
            ELSE 'IP_CD::' END || pin_name AS pin_name
FROM pins WHERE pin_group IN (SELECT pin_group FROM lgroups)
"""

GROUP_MATCH_COUNTS = f"""
WITH {GROUPS_CTE},
c AS (SELECT pin_group, count(*) AS pin_count FROM pins GROUP BY pin_group)
SELECT g.pin_group, CAST(COALESCE(c.pin_count, 0) AS BIGINT) AS pin_count
FROM lgroups g LEFT JOIN c ON c.pin_group = g.pin_group
"""

# ---------------------------------------------------------------- resources

RL = template_sql("resource_program")
_T = strip("regexp_replace(raw, '\\[.*?\\]', '', 'g')")
RESOURCES = f"""
WITH {RL},
r1 AS (
  SELECT *, last_value({ext('line', T.RESOURCE_RE)} IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS res
  FROM resource_program_lines
),
r2 AS (
  SELECT file, line_no, COALESCE(res, '') AS resource,
         regexp_extract(line, {q(T.RESOURCE_PIN_RE)}, 1) AS pin_name,
         regexp_extract(line, {q(T.RESOURCE_PIN_RE)}, 2) AS raw
  FROM r1 WHERE regexp_matches(line, {q(T.RESOURCE_PIN_RE)})
),
r3 AS (SELECT *, {_T} AS t FROM r2),
r4 AS (SELECT *, TRY_CAST(t AS DOUBLE) AS num FROM r3)
SELECT file, line_no, resource, pin_name, raw AS value_raw,
       CASE WHEN regexp_matches(t, {q(T.PLAIN_NUMBER_RE)}) AND num IS NOT NULL AND num <> 0 AND num < 100
            THEN CAST(CAST(round_even(num * 1000, 0) AS BIGINT) AS VARCHAR) ELSE '' END AS distinctive_value
FROM r4
"""

# ---------------------------------------------------------------- page ids

PAGE_IDS = f"""
WITH x AS (
  SELECT page_id, regexp_extract_all(html, {q('href="/' + chr(92) + 's*(' + T.ID_CHARS + ')')}, 1) AS ids FROM pages
),
u AS (SELECT page_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM x),
f AS (SELECT page_id, id, min(pos) AS first_pos FROM u GROUP BY page_id, id),
s AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) AS seq FROM f)
SELECT * FROM s
"""

# ---------------------------------------------------------------- limits join

CLASS_CTE = """
cls0 AS (SELECT *, upper(configuration) AS u FROM flat),
cls1 AS (
  SELECT *,
    CASE WHEN u LIKE '%HOT%' AND (u LIKE '%LEAKHI%' OR u LIKE '%HIGH%' OR u LIKE '%HI%') THEN 'HOT_HI'
         WHEN u LIKE '%HOT%' AND (u LIKE '%LEAKLO%' OR u LIKE '%LOW%' OR u LIKE '%LO%') THEN 'HOT_LO'
         WHEN u LIKE '%COLD%' AND (u LIKE '%LEAKHI%' OR u LIKE '%HIGH%' OR u LIKE '%HI%') THEN 'COLD_HI'
         WHEN u LIKE '%COLD%' AND (u LIKE '%LEAKLO%' OR u LIKE '%LOW%' OR u LIKE '%LO%') THEN 'COLD_LO' END AS leak_class
  FROM cls0
),
classlimits AS (
  SELECT leak_class, configuration, pin_group,
         CASE WHEN leak_class LIKE '%_HI' THEN vss_limit_high ELSE vcc_limit_high END AS limit_high,
         CASE WHEN leak_class LIKE '%_HI' THEN vss_limit_low ELSE vcc_limit_low END AS limit_low,
         CASE WHEN leak_class LIKE '%_HI' THEN 'VSS' ELSE 'VCC' END AS test_type
  FROM cls1 WHERE leak_class IS NOT NULL
)"""

JOIN_CTE = INSTANCES_CTE + ", " + LIMITS_CTE + ", " + CLASS_CTE

LIMITS_JOIN = f"""
WITH {JOIN_CTE}
SELECT i.*, c.leak_class, c.pin_group, c.limit_high, c.limit_low
FROM instances i LEFT JOIN classlimits c
  ON i.test_type IS NOT DISTINCT FROM c.test_type AND i.configuration IS NOT DISTINCT FROM c.configuration
"""

MATCH_RATE = f"""
WITH {JOIN_CTE},
m AS (
  SELECT count(*) AS total_rows,
         count(*) FILTER (WHERE EXISTS (SELECT 1 FROM classlimits c WHERE i.test_type IS NOT DISTINCT FROM c.test_type
                                        AND i.configuration IS NOT DISTINCT FROM c.configuration)) AS matched_rows
  FROM instances i
)
SELECT total_rows, matched_rows,
       CAST(round(CAST(matched_rows / total_rows AS DECIMAL(38, 10)), 6) AS DOUBLE) AS match_rate
FROM m
"""

SQL = {
    "program_lines": PROGRAM_LINES,
    "extract_instances": EXTRACT_INSTANCES,
    "extract_instances_lite": EXTRACT_INSTANCES_LITE,
    "instance_counts": INSTANCE_COUNTS,
    "instance_crosstab": INSTANCE_CROSSTAB,
    "extract_limits": EXTRACT_LIMITS,
    "limits_long": LIMITS_LONG,
    "pin_groups": PIN_GROUPS,
    "pins_per_group": PINS_PER_GROUP,
    "pin_group_match": PIN_GROUP_MATCH,
    "group_match_counts": GROUP_MATCH_COUNTS,
    "resources": RESOURCES,
    "page_ids": PAGE_IDS,
    "limits_join": LIMITS_JOIN,
    "match_rate": MATCH_RATE,
}
