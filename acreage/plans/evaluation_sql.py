"""SQL twins of label matching, of the whole evaluation, of hulls and of facing: the walk row by row, everything else from plain definitions."""

from __future__ import annotations

from acreage.plans.sql import VIEWS, r2

_TEXTS = f"""
parts AS (SELECT p_partkey // 400 AS project_id, p_partkey AS ord, 'Plot ' || p_partkey || ' ' || p_name AS t, p_size FROM part),
gt AS (SELECT project_id, ord AS g_ord, t AS raw, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') AS norm, row_number() OVER (PARTITION BY project_id ORDER BY ord) AS i FROM parts),
pr AS (SELECT *, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS norm FROM (
  SELECT project_id, ord AS p_ord, p_size, CASE WHEN p_size = 7 THEN 'Plat ' || substr(t, 6) WHEN p_size % 10 = 3 THEN upper(t) ELSE t END AS raw FROM parts WHERE p_size <> 13)),
wishes AS MATERIALIZED (SELECT project_id, i, list({{'d': levenshtein(g.norm, p.norm), 'p': p_ord}} ORDER BY levenshtein(g.norm, p.norm), p_ord) AS w FROM gt g JOIN pr p USING (project_id) GROUP BY ALL),
walk AS (
  SELECT DISTINCT project_id, 0::BIGINT AS i, []::BIGINT[] AS used, {{'d': 0::BIGINT, 'p': 0::BIGINT}} AS pick FROM gt
  UNION ALL
  SELECT project_id, i, list_append(used, pick.p), pick FROM (
    SELECT k.project_id, w.i, k.used, list_filter(w.w, lambda x: NOT list_contains(k.used, x.p))[1] AS pick FROM walk k JOIN wishes w ON w.project_id = k.project_id AND w.i = k.i + 1)
  WHERE pick IS NOT NULL
),
texts AS (
  SELECT g.project_id, g.g_ord, k.pick.p AS p_ord, coalesce(k.pick.d, length(g.norm)) AS distance, coalesce(g.raw = p.raw, false) AS exact, coalesce(k.pick.d = 0, false) AS normalized, length(g.norm) AS size
  FROM gt g LEFT JOIN walk k ON k.project_id = g.project_id AND k.i = g.i LEFT JOIN pr p ON p.project_id = g.project_id AND p.p_ord = k.pick.p
)"""


def _r4(x: str) -> str:
    return f"floor(({x}) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE"


_STEPS = f"""
plots AS (
  SELECT project_id, count(*) AS n_gt, count(iou) AS n_pred, count(iou) AS matched, count(*) - count(iou) AS missing, 0::BIGINT AS extra, count(*) - count(iou) AS merged, 0::BIGINT AS duplicated,
    coalesce({_r4('CAST(sum(CAST(iou AS DECIMAL(20,12))) AS DOUBLE) / count(iou)')}, 0) AS mean_iou, coalesce({_r4('median(iou)')}, 0) AS median_iou,
    coalesce({_r4('CAST(sum(CAST(ce AS DECIMAL(24,9))) AS DOUBLE) / count(ce)')}, 0) AS mean_centroid_error, coalesce({r2('CAST(sum(CAST(ae AS DECIMAL(24,9))) AS DOUBLE) / count(ae)')}, 0) AS mean_area_error_pct
  FROM (SELECT project_id, CASE WHEN seen THEN i / (w * h + w * (h + ord % 3) - i) END AS iou, CASE WHEN seen THEN w * (ord % 3) * 100.0::DOUBLE / (w * h) END AS ae,
    CASE WHEN seen THEN sqrt((p_size % 5) * (p_size % 5) + (ord % 3) * (ord % 3) / 4.0::DOUBLE) END AS ce FROM (SELECT *, (w - p_size % 5) * h AS i, plot_id % 11 <> 0 AS seen FROM v_rects)) GROUP BY 1
), rim AS (
  SELECT project_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(x1) - (project_id % 7) * 30 AS s1 FROM v_rects GROUP BY project_id
), boundary AS (
  SELECT project_id, {_r4('i / (a + b - i)')} AS boundary_iou, {r2('abs(a - b) * 100.0::DOUBLE / a')} AS area_error_pct, {r2('abs((x1 - x0) - abs(s1 - x0)) * 100.0::DOUBLE / (x1 - x0 + y1 - y0)')} AS perimeter_error_pct,
    true AS boundary_valid, CASE WHEN i / (a + b - i) < 0.95::DOUBLE THEN 1 ELSE 0 END AS containment_failures FROM (
    SELECT *, (x1 - x0) * (y1 - y0) AS a, abs(s1 - x0) * (y1 - y0) AS b, greatest(0, least(x1, greatest(x0, s1)) - greatest(x0, least(x0, s1))) * (y1 - y0) AS i FROM rim)
), roads AS (
  SELECT project_id, 1::BIGINT AS gt_roads, CASE WHEN project_id % 3 <> 0 THEN 1 ELSE 0 END::BIGINT AS pred_roads, CASE WHEN project_id % 3 <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS road_iou,
    CASE WHEN project_id % 3 <> 0 THEN 0.0 ELSE 100.0 END::DOUBLE AS length_error_pct FROM rim
), read AS (
  SELECT project_id, count(*) AS n, count(*) FILTER (exact) AS n_exact, count(*) FILTER (normalized) AS n_norm, sum(distance)::DOUBLE AS far, sum(size)::DOUBLE AS size FROM texts GROUP BY 1
), linked AS (
  SELECT project_id, count(*) AS total_labels, count(*) FILTER (p_size % 9 <> 0) AS correct, 0::BIGINT AS incorrect, count(*) FILTER (p_size % 9 = 0) AS unassociated FROM pr GROUP BY 1
), ocr AS (
  SELECT project_id, coalesce({_r4('n_norm::DOUBLE / total_labels')}, 0) AS precision, {_r4('n_norm::DOUBLE / n')} AS recall, {_r4('2.0::DOUBLE * n_norm / (n + coalesce(total_labels, 0))')} AS f1, {_r4('n_exact::DOUBLE / n')} AS exact_ratio,
    {r2('far / n')} AS mean_edit_distance, {_r4('far / size')} AS wer, coalesce(total_labels, n) AS total_labels, coalesce(correct, 0) AS correct, coalesce(incorrect, 0) AS incorrect, coalesce(unassociated, 0) AS unassociated,
    coalesce({_r4('correct::DOUBLE / total_labels')}, 0) AS association_accuracy FROM read LEFT JOIN linked USING (project_id)
), everything AS (
  SELECT *, road_iou AS connectivity, recall AS normalized_ratio FROM boundary JOIN plots USING (project_id) JOIN roads USING (project_id) JOIN ocr USING (project_id)
)"""

def _chain(name: str, side: str, sign: str) -> str:
    """Edges of the lower (sign +) or upper hull: pairs of rim points with no rim point beyond their line, nor on it outside the pair."""
    cross = "((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))"
    return f"""{name} AS (SELECT p.project_id, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM {side} p JOIN {side} q ON q.project_id = p.project_id AND p.x < q.x
  WHERE NOT EXISTS (SELECT 1 FROM {side} r WHERE r.project_id = p.project_id AND ({sign}{cross} < 0 OR ({cross} = 0 AND (r.x < p.x OR r.x > q.x)))))"""


_HULL = f"""lo AS MATERIALIZED (SELECT project_id, x, min(y) AS y FROM v_points GROUP BY 1, 2), hi AS MATERIALIZED (SELECT project_id, x, max(y) AS y FROM v_points GROUP BY 1, 2),
{_chain('lower_edges', 'lo', '')}, {_chain('upper_edges', 'hi', '-')},
ends AS (SELECT l.project_id, count(*) FILTER (l.y <> h.y) AS sides FROM lo l JOIN hi h ON h.project_id = l.project_id AND h.x = l.x JOIN (SELECT project_id, min(x) AS a, max(x) AS b FROM lo GROUP BY 1) e ON e.project_id = l.project_id AND l.x IN (a, b) GROUP BY 1),
area AS (SELECT project_id, sum(s) AS area, count(*) AS n FROM (SELECT project_id, -(qx - px) * (py + qy) / 2 AS s FROM lower_edges UNION ALL SELECT project_id, (qx - px) * (py + qy) / 2 FROM upper_edges) GROUP BY 1)"""

def _away(ax0: str, ay0: str, ax1: str, ay1: str) -> str:
    """Distance of an upright segment, box or point to the line l."""
    return f"sqrt(pow(greatest({ax0} - l.x1, l.x0 - {ax1}, 0), 2) + pow(greatest({ay0} - l.y1, l.y0 - {ay1}, 0), 2))"


# a drawing's y grows to the south
_FACING = f"""lines AS (SELECT project_id, ord, CASE WHEN ord < 2 THEN x0 ELSE (x0 + x1) / 2 END AS x0, CASE WHEN ord < 2 THEN (y0 + y1) / 2 ELSE y0 END AS y0, CASE WHEN ord < 2 THEN x1 ELSE (x0 + x1) / 2 END AS x1, CASE WHEN ord < 2 THEN (y0 + y1) / 2 ELSE y1 END AS y1 FROM v_roads),
nearest AS (SELECT r.project_id, plot_id, r.x0, r.y0, r.x1, r.y1, l.ord, {_away('r.x0', 'r.y0', 'r.x1', 'r.y1')} AS d FROM v_rects r JOIN lines l USING (project_id) QUALIFY row_number() OVER (PARTITION BY plot_id ORDER BY d, l.ord) = 1),
sides AS (SELECT project_id, plot_id, ord, d, unnest([{{'i': 0, 'f': 'N', 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y0}}, {{'i': 1, 'f': 'E', 'x0': x1, 'y0': y0, 'x1': x1, 'y1': y1}}, {{'i': 2, 'f': 'S', 'x0': x0, 'y0': y1, 'x1': x1, 'y1': y1}}, {{'i': 3, 'f': 'W', 'x0': x0, 'y0': y0, 'x1': x0, 'y1': y1}}], recursive := true) FROM nearest),
rated AS (SELECT s.*, {_away('s.x0', 's.y0', 's.x1', 's.y1')} + {_away('(s.x0 + s.x1) / 2', '(s.y0 + s.y1) / 2', '(s.x0 + s.x1) / 2', '(s.y0 + s.y1) / 2')} * 0.001::DOUBLE AS k FROM sides s JOIN lines l ON l.project_id = s.project_id AND l.ord = s.ord)"""

ORACLE = {
    "facing8": f"WITH v_rects AS ({VIEWS['v_rects']}), v_roads AS ({VIEWS['v_roads']}), {_FACING} SELECT plot_id, CASE WHEN min(d) <= 500 THEN arg_min(f, (k, i)) ELSE 'UNKNOWN' END AS facing8 FROM rated GROUP BY plot_id",
    "convex_hull": f"WITH v_points AS ({VIEWS['v_points']}), {_HULL} SELECT project_id, n + sides AS corners, area FROM area JOIN ends USING (project_id)",
    "label_match": f"WITH RECURSIVE {_TEXTS} SELECT project_id, g_ord, p_ord, distance, exact, normalized FROM texts",
    "evaluate_projects": f"""WITH RECURSIVE v_rects AS ({VIEWS['v_rects']}), {_TEXTS}, {_STEPS}
SELECT *, concat_ws(',', CASE WHEN boundary_iou < 0.9 THEN 'BROKEN_BOUNDARY' END, CASE WHEN merged > 0 THEN 'MERGED_PLOTS' END, CASE WHEN missing > 0 THEN 'MISSING_PLOTS' END, CASE WHEN recall < 0.8 THEN 'OCR_FAILURE' END,
  CASE WHEN road_iou < 0.5 THEN 'ROAD_FAILURE' END, CASE WHEN association_accuracy < 0.85 THEN 'LABEL_ASSOCIATION_FAILURE' END) AS failures,
  boundary_iou >= 0.9 AND mean_iou >= 0.85 AND recall >= 0.8 AND association_accuracy >= 0.85 AS is_acceptable FROM everything""",
}
