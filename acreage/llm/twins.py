"""SQL twins of the near-duplicate and the passage query: plain definitions, for a second engine on small tables."""

from __future__ import annotations

from acreage.llm.url_filter import LOWER as L
from acreage.llm.url_filter import UPPER as U

N = 200

NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{U}', '{L}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)
), e AS (
  SELECT x AS i, y AS o FROM l UNION ALL SELECT y, x FROM l
), r AS (
  SELECT doc_id, doc_id AS m FROM documents UNION SELECT r.doc_id, e.o FROM r JOIN e ON r.m = e.i
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.m) AS component_id, doc_id = min(r.m) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

REPEATS = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, s, md5(substr(h, 2 * s + 1, {2 * N})) AS k FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - {N - 1}, 0))) AS s FROM d)
), f AS (
  SELECT doc_id, s FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)
), m AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {N} THEN 0 ELSE 1 END AS fresh FROM f
), i AS (
  SELECT doc_id, min(s) AS a, max(s) + {N} AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM m) GROUP BY doc_id, run
), g AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM i
), k AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
