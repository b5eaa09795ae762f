"""DuckDB SQL for the queries that SQL can express, written the plain way: all pairs, all
shingles, one sort."""

from __future__ import annotations

OP1_GRID_JOIN = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.usable AND b.usable AND list_cosine_similarity(a.e, b.e) >= 0.9
),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a),
out AS (
  SELECT v.vec_id, CAST(COALESCE(d.n, 0) AS BIGINT) AS n_links, least(v.vec_id, COALESCE(m.b, v.vec_id)) AS component_id
  FROM v LEFT JOIN degree d ON d.a = v.vec_id LEFT JOIN least_id m ON m.a = v.vec_id
)
SELECT *, vec_id = component_id AS kept FROM out
"""

_WORDS = r"""regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

OP10_PARTITION_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(s) AS shingle FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
),
link AS (
  SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * common >= 90 * (p.n_shingles + q.n_shingles - common)
),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, COALESCE(m.b, n.doc_id)) AS component_id
FROM n LEFT JOIN least_id m ON m.a = n.doc_id
"""

# crc32 byte by byte over the UTF-8 text, by its table of 256 remainders
OP4_INTERLEAVE_SHARDS = """
WITH t AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
),
d AS (
  SELECT doc_id, source, CAST(octet_length(encode(COALESCE(text, ''))) + 1 AS BIGINT) AS size,
         list_transform(regexp_extract_all(hex(encode(COALESCE(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bytes,
         md5('lot:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
),
c AS (
  SELECT doc_id, COALESCE('=' || source, '') AS stratum, size, key, CAST('0x' || substr(key, 1, 4) AS BIGINT) % 1024 AS prefix,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM d, t
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY prefix, key, doc_id, size, text_crc32) AS rank,
         count(*) OVER (PARTITION BY stratum) AS total
  FROM c
),
g AS (
  SELECT *, row_number() OVER (ORDER BY CAST(2 * rank - 1 AS DOUBLE) / CAST(2 * total AS DOUBLE), key, stratum, doc_id, size, text_crc32) - 1 AS pos,
         count(*) OVER () AS n
  FROM r
),
p AS (SELECT *, CAST(pos * 8 // n AS INTEGER) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(pos - (shard * n + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""

OP11_EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, COALESCE(text, '') AS t, regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
),
g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM g
"""

# crc32 of a short text byte by byte, by its table of 256 remainders
_CRC32 = """
rem AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS rem
)"""


def _crc32(text: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c >> 8, rem[(xor(c, b) & 255) + 1])), 4294967295)"


OP12_PREFIX_TRIE = f"""
WITH {_CRC32},
t AS (
  SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(octet_length(encode(COALESCE(role, ''))) || ':' || COALESCE(role, '') || COALESCE(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), rem),
x AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth,
             octet_length(encode(role)) || ':' || role || sha256(text) AS turn, octet_length(encode(text)) AS bytes FROM x),
n AS (SELECT c.conv_id, COALESCE(max(r.depth), 0) AS n FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (
  SELECT conv_id, depth, bytes, string_agg(turn, chr(10)) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
),
node AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM p GROUP BY depth, path),
up AS (SELECT DISTINCT a.depth, a.path, b.path AS parent FROM p a JOIN p b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n FROM up GROUP BY depth, parent),
ends AS (SELECT p.depth, p.path, string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) AS ids
         FROM p JOIN n ON n.conv_id = p.conv_id AND n.n = p.depth GROUP BY p.depth, p.path),
below AS (
  SELECT a.depth, a.path, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum((d.n_convs - 1) * d.bytes) AS saved
  FROM node d LEFT JOIN kids k ON k.depth = d.depth AND k.path = d.path JOIN p a ON a.conv_id = d.conv_id AND a.depth <= d.depth
  GROUP BY a.depth, a.path
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, v.n_convs, COALESCE(k.n, 0) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(COALESCE(e.ids, '')) AS ends_sha256
FROM node v LEFT JOIN up u ON u.depth = v.depth AND u.path = v.path LEFT JOIN node q ON q.depth = v.depth - 1 AND q.path = u.parent
LEFT JOIN kids k ON k.depth = v.depth AND k.path = v.path LEFT JOIN ends e ON e.depth = v.depth AND e.path = v.path
JOIN below b ON b.depth = v.depth AND b.path = v.path
"""

# rows are never inserted: deleting the partner instead is always cheaper
OP13_STRUCTURE_REPAIR = rf"""
WITH RECURSIVE {_CRC32},
k AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
             {_crc32("COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ')")} % 20 AS f FROM conversations, rem),
d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
             CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM k JOIN (VALUES (0), (1)) AS copies(copy) ON copy = 0 OR f = 3 WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS i FROM d),
t AS (
  SELECT conv_id, turn, i, role, text, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM o
),
e(q, x, z) AS (VALUES ('^', 's', 's'), ('^', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
way AS (
  SELECT conv_id, i, 'D' AS letter, q, q AS z, 2 AS cost, NULL AS line FROM t, (VALUES ('^'), ('s'), ('u'), ('a')) AS s(q)
  UNION ALL SELECT conv_id, i, 'K', q, z, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, role || ':' || text
  FROM t JOIN e ON e.x = t.x WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, 'R', q, z, CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, CASE e.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text
  FROM t JOIN e ON e.x <> 's' WHERE fault NOT IN ('blank', 'duplicate')
),
dp AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, '^' AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM t
  UNION ALL
  SELECT conv_id, i, z, b.cost, b.audit, b.lines FROM (
    SELECT dp.conv_id, way.i, way.z, min({{'cost': dp.cost + way.cost, 'audit': dp.audit || way.letter,
             'lines': CASE WHEN way.line IS NULL THEN dp.lines ELSE list_append(dp.lines, way.line) END}}) AS b
    FROM dp JOIN way ON way.conv_id IS NOT DISTINCT FROM dp.conv_id AND way.i = dp.i + 1 AND way.q = dp.q GROUP BY dp.conv_id, way.i, way.z)
),
n AS (SELECT conv_id, max(i) AS i, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND y || x NOT IN ('su', 'ua', 'au')) AS illegal
      FROM t GROUP BY conv_id),
best AS (SELECT n.conv_id, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS b
         FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.i WHERE q IN ('^', 'a') GROUP BY n.conv_id)
SELECT c.conv_id, COALESCE(gaps, 0) AS gaps, COALESCE(blank, 0) AS blank, COALESCE(duplicate, 0) AS duplicate, COALESCE(truncated, 0) AS truncated,
       COALESCE(illegal, 0) AS illegal, COALESCE(b.cost, 0) AS cost, COALESCE(b.audit, '') AS audit,
       sha256(COALESCE(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""

SQL = {
    "op1_grid_join": OP1_GRID_JOIN,
    "op4_interleave_shards": OP4_INTERLEAVE_SHARDS,
    "op10_partition_join": OP10_PARTITION_JOIN,
    "op11_exact_dedup": OP11_EXACT_DEDUP,
    "op12_prefix_trie": OP12_PREFIX_TRIE,
    "op13_structure_repair": OP13_STRUCTURE_REPAIR,
}
