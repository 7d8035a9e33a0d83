"""DuckDB SQL for those operator queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {}

SQL["op3_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, 13 AS size, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)
  UNION SELECT DISTINCT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 12),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
  FROM (SELECT rid, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT g.rid, g.i, g.size, win.item_id FROM grams g JOIN win ON g.size = win.size AND g.gram = win.gram),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT rid, i, size FROM hit)) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(items.n_items, 0) AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256,
  coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON d.rid = pos.rid LEFT JOIN items ON d.rid = items.rid
"""

SQL["op4_nearest_neighbours"] = """
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_cosine_similarity(q.e, c.e) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_RECORD = (
    "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')"
    " || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)"
    " || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)"
)
#: CRC-32 of a short text, bit by bit, as DuckDB has no such function.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(t) + 1), lambda i: ascii(t[i])::UBIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), [0,0,0,0,0,0,0,0]::UBIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)),"
    " 4294967295::UBIGINT)"
)
SQL["op7_warc_fixity"] = f"""
WITH r AS (SELECT page_id, html, CAST(page_id AS VARCHAR) AS t, {_RECORD} AS rec FROM pages WHERE page_id IS NOT NULL),
d AS (SELECT page_id, CAST(floor(page_id / 1024) AS BIGINT) AS file, CAST(strlen(rec) AS BIGINT) AS length, sha256(rec) AS digest,
  NOT ({_CRC} % 101 = 0 AND length(coalesce(html, '')) > 0) AS intact FROM r)
SELECT page_id, file, row_number() OVER w - 1 AS position,
  CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
  length, digest, CAST(1 AS BIGINT) AS n_records, CASE WHEN intact THEN 'same' ELSE 'changed' END AS status, intact
FROM d WINDOW w AS (PARTITION BY file ORDER BY page_id, digest)
"""

SQL["op8_preference_pairs"] = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, max(turn) AS last, min(struct_pack(turn := turn, text := text)) AS first FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
p AS (
  SELECT t.*, own.last, row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn, t.role, t.text) - 1 AS k,
    CASE WHEN role = 'assistant' AND t.turn = own.last THEN CASE WHEN own.first.turn = own.last THEN '' ELSE own.first.text END ELSE t.text END AS other
  FROM t LEFT JOIN own ON t.conv_id = own.conv_id),
n AS (SELECT conv_id, coalesce(min(k) FILTER (WHERE text <> other), count(*)) AS n FROM p GROUP BY conv_id),
q AS (
  SELECT p.conv_id, k, role, n.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS a, '<|im_start|>' || role || chr(10) || other || '<|im_end|>' || chr(10) AS b,
    length(text) AS la, length(other) AS lb FROM p JOIN n ON p.conv_id = n.conv_id),
o AS (
  SELECT *, coalesce(sum(length(a)) FILTER (WHERE k >= n) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS sa,
    coalesce(sum(length(b)) FILTER (WHERE k >= n) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 13 + length(role) AS sb FROM q)
SELECT conv_id AS pair_id, CAST(max(n) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(a, '' ORDER BY k) FILTER (WHERE k < n), '') AS prompt,
  coalesce(string_agg(a, '' ORDER BY k) FILTER (WHERE k >= n), '') AS chosen,
  coalesce(string_agg(CAST(sa AS BIGINT) || ':' || CAST(sa + la AS BIGINT), ',' ORDER BY k) FILTER (WHERE k >= n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(b, '' ORDER BY k) FILTER (WHERE k >= n), '') AS rejected,
  coalesce(string_agg(CAST(sb AS BIGINT) || ':' || CAST(sb + lb AS BIGINT), ',' ORDER BY k) FILTER (WHERE k >= n AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY conv_id
"""


def _licenses() -> str:
    from tailspark.llm.licenses import SHINGLE, TEMPLATES

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    ws = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT name, {ws} AS w FROM (VALUES {values}) v(name, text)),
s AS (SELECT DISTINCT name, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT name, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM t)),
z AS (SELECT name, count(*) AS n, greatest(4, CAST(pow(2, ceil(log2(2 * count(*)))) AS BIGINT)) AS size FROM s GROUP BY name),
d AS (SELECT row_number() OVER () AS rid, doc_id, {ws} AS w FROM documents),
h AS (
  SELECT rid, i, s.name, s.g, z.n, z.size, CAST(floor(i / (z.size / 2)) AS BIGINT) AS k
  FROM (SELECT rid, i - 1 AS i, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM d)) x
  JOIN s ON x.g = s.g JOIN z ON s.name = z.name),
m AS (SELECT rid, name, n, k, g FROM h UNION SELECT rid, name, n, greatest(k - 1, 0), g FROM h),
f AS (SELECT rid, name FROM m GROUP BY rid, name, n, k HAVING count(DISTINCT g) / n >= 0.8),
a AS (SELECT rid, string_agg(name, ',' ORDER BY name) AS licenses, count(*) AS n FROM (SELECT DISTINCT rid, name FROM f) GROUP BY rid)
SELECT d.doc_id, coalesce(a.licenses, '') AS licenses, coalesce(a.n, 0) AS n_licenses FROM d LEFT JOIN a ON d.rid = a.rid
"""


SQL["op1_license_scan"] = _licenses()
