"""Reference SQL (DuckDB dialect) for the request-sheet queries and lot lists."""

from __future__ import annotations

from lotline.sources.adapters import view_sql
from lotline.sources.programs import template_sql

ORDER_CTE = view_sql("requests") + """,
r1 AS (SELECT *, NULLIF(trim(source_lot), '') AS _k FROM requests),
r2 AS (SELECT * EXCLUDE (_k), CASE WHEN _k IS NOT NULL THEN min(ordinal) OVER (PARTITION BY sheet, _k) END AS first_seen FROM r1),
ordered AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY first_seen NULLS LAST, ordinal) AS position FROM r2)"""

REQUEST_ORDER = f"WITH {ORDER_CTE} SELECT * FROM ordered"

REQUEST_SPANS = f"""
WITH {ORDER_CTE},
long AS (
  SELECT sheet, position, 'source_lot' AS "column", source_lot AS value FROM ordered
  UNION ALL SELECT sheet, position, 'part_type', part_type FROM ordered
  UNION ALL SELECT sheet, position, 'operation', operation FROM ordered
),
chg AS (
  SELECT *, CASE WHEN lag(position) OVER w IS NOT NULL AND lag(value) OVER w IS NOT DISTINCT FROM value THEN 0 ELSE 1 END AS c
  FROM long WINDOW w AS (PARTITION BY sheet, "column" ORDER BY position)
),
isl AS (
  SELECT *, sum(c) OVER (PARTITION BY sheet, "column" ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM chg
)
SELECT sheet, "column", min(position) AS start, count(*) AS length, min(value) AS value,
       count(*) > 1 AND min(value) IS NOT NULL AS merged
FROM isl GROUP BY sheet, "column", island
"""

IDS_CTE = ORDER_CTE + """,
x AS (SELECT page_id, regexp_extract_all(html, 'href="/\\s*([A-Za-z0-9_-]+)', 1) AS ids FROM pages),
u AS (SELECT page_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM x),
f AS (SELECT page_id, id, min(pos) AS first_pos FROM u GROUP BY page_id, id),
s AS (SELECT page_id AS sheet, id, row_number() OVER (PARTITION BY page_id ORDER BY first_pos) AS seq FROM f),
ip AS (SELECT sheet, id, row_number() OVER (PARTITION BY sheet ORDER BY seq DESC) AS pos FROM s),
zipped AS (
  SELECT o.*, COALESCE(ip.id, '') AS id
  FROM ordered o LEFT JOIN ip ON ip.sheet = o.sheet AND ip.pos = o.position
)"""

REQUEST_IDS = f"WITH {IDS_CTE} SELECT * FROM zipped"


def _fnn(cols: list[str]) -> str:
    return ("regexp_replace(replace(CAST(COALESCE(" + ", ".join(cols) + ") AS VARCHAR), chr(10), ' '), "
            "'^\\s+|\\s+\\z', '', 'g')")


REQUEST_FILL = f"""
WITH {IDS_CTE},
scored AS (
  SELECT *, (CASE WHEN part_type IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN quantity IS NOT NULL THEN 1 ELSE 0 END
           + CASE WHEN eng_id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN hri IS NOT NULL THEN 1 ELSE 0 END) AS score
  FROM requests
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY score DESC, ordinal) AS rn FROM scored) WHERE rn = 1
)
SELECT z.sheet, z.ordinal, z.operation, z.first_seen, z.position, z.id,
       {_fnn(['z.id'])} AS vpo_number,
       {_fnn(['z.operation'])} AS location_code,
       {_fnn(['z.source_lot'])} AS source_lot,
       {_fnn(['z.mir'])} AS mir,
       b.part_type, b.quantity, b.eng_id, b.hri
FROM zipped z LEFT JOIN best b ON b.sheet = z.sheet
"""

REQUEST_STATUS = f"""
WITH {IDS_CTE}
SELECT sheet, count(*) AS total,
       count(*) FILTER (WHERE id <> '' AND first_seen IS NOT NULL) AS ok,
       count(*) FILTER (WHERE NOT (id <> '' AND first_seen IS NOT NULL)) AS failed
FROM zipped GROUP BY sheet
"""

LOT_CTE = template_sql("lot_list") + """,
ids AS (
  SELECT file, line_no, trim(line, ' ' || chr(9)) AS lot FROM lot_list_lines
  WHERE trim(line, ' ' || chr(9)) <> '' AND NOT starts_with(trim(line, ' ' || chr(9)), '#')
),
lots AS (SELECT file, lot, min(line_no) AS ordinal FROM ids GROUP BY file, lot)"""

LOT_LIST = f"WITH {LOT_CTE} SELECT * FROM lots"
LOT_BATCHES = f"""
WITH {LOT_CTE}
SELECT *, CAST(floor((row_number() OVER (PARTITION BY file ORDER BY ordinal) - 1) / 3) AS INTEGER) AS batch_id FROM lots
"""

REQUEST_FILES = f"""
WITH {view_sql("requests")}
SELECT ordinal, sheet, source_lot, part_type || 'é' AS part_type, quantity, operation, eng_id, mir, hri FROM requests
"""

SQL = {
    "request_files": REQUEST_FILES,
    "request_order": REQUEST_ORDER,
    "request_spans": REQUEST_SPANS,
    "request_ids": REQUEST_IDS,
    "request_fill": REQUEST_FILL,
    "request_status": REQUEST_STATUS,
    "lot_list": LOT_LIST,
    "lot_batches": LOT_BATCHES,
}
