"""SQL twins of the layout queries. Rectangles have closed forms; set areas use a grid of cuts."""

from __future__ import annotations

from acreage.functions import text as T
from acreage.operators import norms
from acreage.plans.sql import r2, with_views


def rn(x: str, digits: int) -> str:
    s = f"{10 ** digits}.0::DOUBLE"
    return f"floor(({x}) * {s} + 0.5::DOUBLE) / {s}"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def common(a: str, b: str) -> str:
    """Overlap area of two rectangles with columns x0…y1."""
    return (
        f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0))"
    )


def gap(a: str, b: str) -> str:
    dx = f"greatest({a}.x0 - {b}.x1, {b}.x0 - {a}.x1, 0)"
    dy = f"greatest({a}.y0 - {b}.y1, {b}.y0 - {a}.y1, 0)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


_TEXT = """
texts AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_extendedprice AS DECIMAL(18,2)) AS label_id,
  CASE l_linenumber WHEN 1 THEN 'PLOT NO. ' || l_partkey WHEN 2 THEN CAST(l_quantity AS INT) || '''0" X 40''6"' WHEN 3 THEN CAST(l_quantity AS INT) || 'O SQ. FT.'
  WHEN 4 THEN CAST(l_quantity AS INT) || ' FT WIDE ROAD' WHEN 5 THEN '~P-l' || l_partkey || 'O|' WHEN 6 THEN 'SURVEY NO ' || l_partkey || '/1' ELSE 'Garden' END AS t FROM lineitem)"""
_D = q(T.DIMENSION)
_CLEAN = f"""{_TEXT},
tok AS (SELECT label_id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(trim(t), {q(T.NOISE_HEAD)}, ''), {q(T.NOISE_TAIL)}, ''), '\\s+'), lambda x: x <> '') AS w FROM texts),
z AS (SELECT label_id, list_transform(w, lambda x: CASE WHEN regexp_matches(x, {q("^[0-9]+[Oo0-9.,']+$")}) THEN translate(x, 'Oo', '00') ELSE x END) AS w FROM tok),
o AS (SELECT label_id, list_transform(w, lambda x: CASE WHEN regexp_matches(x, {q("^[0-9]+[lI0-9.,']+$")}) THEN translate(x, 'lI', '11') ELSE x END) AS w FROM z),
p AS (SELECT label_id, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z]+-[Oo0-9lI]+$') THEN regexp_extract(x, '^([A-Za-z]+-)', 1) || translate(regexp_extract(x, '-([Oo0-9lI]+)$', 1), 'OolI', '0011') ELSE x END) AS w FROM o),
c AS (SELECT label_id, trim(regexp_replace(array_to_string(w, ' '), '\\s*[×*X]\\s*', ' x ', 'g')) AS clean FROM p),
u AS (SELECT *, upper(clean) AS up FROM c),
g AS (SELECT *, CASE WHEN regexp_matches(clean, {_D}) AND NOT regexp_matches(up, '{T.ROAD_WORDS}') THEN
    [try_cast(regexp_extract(clean, {_D}, 1) AS DOUBLE), coalesce(try_cast(regexp_extract(clean, {_D}, 2) AS DOUBLE), 0), try_cast(regexp_extract(clean, {_D}, 3) AS DOUBLE), coalesce(try_cast(regexp_extract(clean, {_D}, 4) AS DOUBLE), 0)] END AS d,
  try_cast(nullif(regexp_extract(up, {q(T.AREA)}, 1), '') AS DOUBLE) AS area_value, try_cast(nullif(regexp_extract(up, {q(T.ROAD)}, 1), '') AS DOUBLE) AS road_width,
  coalesce(nullif(regexp_extract(up, {q(T.PLOT)}, 1), ''), CASE WHEN regexp_matches(clean, {q(T.BARE_NUMBER)}) THEN clean END) AS plot_number FROM u)"""

_ROADS_U = "(SELECT a.project_id, a.plot_id, a.w * a.h AS area, sum(" + common("a", "r") + ") - sum(CASE WHEN r.ord < 2 THEN " + (
    "greatest(least(a.x1, 630) - greatest(a.x0, 600), 0) * greatest(least(a.y1, r.y1) - greatest(a.y0, r.y0), 0)"
) + " ELSE 0 END) AS c FROM v_rects a JOIN v_roads r USING (project_id) GROUP BY ALL)"

_PAIRS = f"""pairs AS (SELECT a.project_id, a.plot_id AS a_id, b.plot_id AS b_id, {common('a', 'b')} AS o, {gap('a', 'b')} AS gap, a.w * a.h AS aa, b.w * b.h AS ba
  FROM v_rects a JOIN v_rects b ON a.project_id = b.project_id AND a.plot_id < b.plot_id)"""
_REL = f"""{_PAIRS}, rel AS (SELECT *, {r2('gap')} AS distance, CASE WHEN o >= ba * (1.0::DOUBLE - 1e-9) THEN 'CONTAINS' WHEN o >= aa * (1.0::DOUBLE - 1e-9) THEN 'INSIDE' WHEN o > 1 THEN 'OVERLAPS'
  WHEN gap = 0 THEN 'TOUCHES' WHEN {r2('gap')} < 50 THEN 'NEIGHBOR' END AS relation FROM pairs)"""

_FOUND = f"""{_PAIRS}, acc AS (SELECT a.project_id, a.plot_id, min({gap('a', 'r')}) AS gap FROM v_rects a JOIN v_roads r USING (project_id) GROUP BY 1, 2),
sheet AS (SELECT *, greatest(least(x1, 2400) - greatest(x0, 0), 0) * greatest(least(y1, 460) - greatest(y0, 0), 0) AS inb,
  greatest(least(x1, 2390) - greatest(x0, 10), 0) * greatest(least(y1, 450) - greatest(y0, 10), 0) AS ins FROM v_rects),
found AS (
  SELECT project_id, 'RULE_01' AS rule_id FROM sheet WHERE w * h - inb > greatest(3.5, w * h * 0.005)
  UNION ALL SELECT project_id, 'RULE_02' FROM {_ROADS_U} WHERE c > greatest(3.5, area * 0.005)
  UNION ALL SELECT project_id, 'RULE_03' FROM v_rects WHERE greatest(least(x1, 420) - greatest(x0, 300), 0) * greatest(least(y1, 260) - greatest(y0, 200), 0) > greatest(3.5, w * h * 0.005)
  UNION ALL SELECT project_id, 'RULE_04' FROM v_rects WHERE greatest(least(x1, 1260) - greatest(x0, 1200), 0) * greatest(least(y1, 200) - greatest(y0, 150), 0) > greatest(3.5, w * h * 0.005)
  UNION ALL SELECT project_id, 'RULE_05' FROM pairs WHERE o > greatest(3.5, least(aa, ba) * 0.005)
  UNION ALL SELECT project_id, 'RULE_06' FROM v_rects WHERE w * h < 1400 * 0.9::DOUBLE
  UNION ALL SELECT project_id, 'RULE_07' FROM v_rects WHERE least(w, h) < 34
  UNION ALL SELECT project_id, 'RULE_08' FROM acc WHERE gap > 5
  UNION ALL SELECT project_id, 'RULE_11' FROM sheet WHERE w * h - ins > 5
  UNION ALL SELECT project_id, 'RULE_12' FROM v_roads WHERE width_ft < 23)"""

_RULE_IDS = ", ".join(f"('RULE_{i:02d}')" for i in range(1, 13))


def _cuts(rows: str) -> str:
    """Cells of the grid of all rectangle rims, with what covers each. ``rows``: project_id, side, x0…y1."""
    return f"""src AS ({rows}), xs AS (SELECT project_id, x, lead(x) OVER (PARTITION BY project_id ORDER BY x) AS x2 FROM (SELECT DISTINCT project_id, unnest([x0, x1]) AS x FROM src)),
ys AS (SELECT project_id, y, lead(y) OVER (PARTITION BY project_id ORDER BY y) AS y2 FROM (SELECT DISTINCT project_id, unnest([y0, y1]) AS y FROM src)),
cells AS (SELECT DISTINCT s.project_id, s.side, x, x2, y, y2 FROM src s JOIN xs ON xs.project_id = s.project_id AND x >= x0 AND x2 <= x1 JOIN ys ON ys.project_id = s.project_id AND y >= y0 AND y2 <= y1),
cover AS (SELECT project_id, x, y, (x2 - x) * (y2 - y) AS area, bool_or(side = 'A') AS a, bool_or(side = 'B') AS b FROM cells GROUP BY ALL)"""


_AUTH = ", ".join(f"({i + 1}, '{a[0]}', {a[2]}::DOUBLE)" for i, a in enumerate(norms.AUTHORITIES))
_SQ, _MF = "10.7639104::DOUBLE", "3.2808399::DOUBLE"
_NORMS = f"""auth(n, id, threshold) AS (VALUES {_AUTH}),
base AS (SELECT parcel_id, coalesce(id, '{norms.STATEWIDE}') AS authority_id, coalesce(threshold, 2.0::DOUBLE) AS threshold, is_congested AS k, land_use, greatest(100.0::DOUBLE, land_area_sqm) AS a
  FROM v_parcels LEFT JOIN auth ON jurisdiction_id = 'AUTH_' || n),
n AS (SELECT *, a / 10000.0::DOUBLE AS ha FROM base),
m AS (SELECT *, (CASE WHEN k THEN 5 WHEN ha < 0.4::DOUBLE THEN 0 ELSE 10 END)::DOUBLE AS op, (CASE WHEN k THEN 200 WHEN ha < 0.4::DOUBLE THEN 0 WHEN ha < 1 THEN 400 ELSE 1000 END)::DOUBLE AS cl,
  (CASE WHEN k THEN 6 WHEN ha < 0.4::DOUBLE THEN 0 WHEN ha < 1 THEN 7.5 ELSE 10 END)::DOUBLE AS ow, (CASE WHEN k THEN 0 WHEN ha >= threshold THEN 5 ELSE 0 END)::DOUBLE AS am,
  (CASE WHEN ha >= 0.4::DOUBLE THEN 1.0 ELSE 0.5 END)::DOUBLE AS ut, (CASE WHEN k THEN 6 ELSE 9 END)::DOUBLE AS ir, (CASE WHEN k THEN 9 ELSE 12 END)::DOUBLE AS mr, (CASE WHEN k THEN 1.5 ELSE 3 END)::DOUBLE AS sb,
  (CASE land_use WHEN 'EWS' THEN 50 WHEN 'COMMERCIAL' THEN 150 ELSE CASE WHEN k THEN 50 ELSE 100 END END)::DOUBLE AS mp,
  (CASE land_use WHEN 'EWS' THEN 4.5 WHEN 'COMMERCIAL' THEN 9 ELSE CASE WHEN k THEN 4.5 ELSE 6 END END)::DOUBLE AS mf,
  (CASE land_use WHEN 'EWS' THEN 10 WHEN 'COMMERCIAL' THEN 15 ELSE CASE WHEN k THEN 10 ELSE 12 END END)::DOUBLE AS md FROM n)"""

_TOTALS = """tot AS (SELECT o_orderkey AS layout_id, o_custkey AS project_id, o_orderkey AS ord, o_orderpriority AS strategy, 12000.0::DOUBLE AS gross, coalesce(n, 0) AS n, coalesce(pa, 0) AS pa,
  coalesce(na, 0) AS na, coalesce(r1, 0) AS r1, coalesce(rr2, 0) AS rr2, coalesce(nc, 0) AS nc, o_orderkey % 30 * 100.0::DOUBLE AS ra, o_orderkey % 20 + 15.0::DOUBLE AS rw,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 15 * 100.0::DOUBLE ELSE 0 END AS oa, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 15 * 100.0::DOUBLE ELSE 0 END AS aa
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity * 48) AS pa, count(*) FILTER (l_returnflag <> 'R' AND w >= 15) AS na,
    sum(CASE WHEN asp <= 2.2::DOUBLE THEN 10 WHEN asp <= 3 THEN 6 ELSE 2 END) AS r1, sum(CASE WHEN asp <= 2.5::DOUBLE THEN 10 WHEN asp <= 3.5::DOUBLE THEN 5 ELSE 0 END) AS rr2,
    count(*) FILTER (l_partkey % 7 = 0) AS nc FROM (SELECT *, l_quantity + 10 AS w, greatest((l_quantity + 10) / (l_partkey % 40 + 20.0::DOUBLE), (l_partkey % 40 + 20.0::DOUBLE) / (l_quantity + 10)) AS asp FROM lineitem) GROUP BY 1) ON l_orderkey = o_orderkey)"""
_V1 = f"""{_TOTALS}, v1 AS (SELECT *, na / greatest(1, n)::DOUBLE * 100.0::DOUBLE AS acc, r1 * 10.0::DOUBLE / greatest(1, n) AS pr, pa / gross * 100.0::DOUBLE AS u, pa / greatest(1.0::DOUBLE, ra) AS ratio,
  oa / gross * 100.0::DOUBLE + aa / gross * 100.0::DOUBLE AS pub, greatest(0, gross - (pa + ra + oa + aa)) / gross * 100.0::DOUBLE AS res FROM tot),
s1 AS (SELECT *, CASE WHEN u BETWEEN 50 AND 65 THEN 100.0::DOUBLE WHEN u < 50 THEN greatest(0, u / 50.0::DOUBLE * 100.0::DOUBLE) ELSE greatest(50, 100.0::DOUBLE - (u - 65.0::DOUBLE) * 3.0::DOUBLE) END AS ut,
  CASE WHEN ratio BETWEEN 2 AND 3.5::DOUBLE THEN 100.0::DOUBLE WHEN ratio < 2 THEN greatest(40, ratio / 2.0::DOUBLE * 100.0::DOUBLE) ELSE greatest(60, 100.0::DOUBLE - (ratio - 3.5::DOUBLE) * 10.0::DOUBLE) END AS re,
  CASE WHEN pub >= 10 THEN 100.0::DOUBLE WHEN pub >= 5 THEN 75.0::DOUBLE + (pub - 5.0::DOUBLE) * 5.0::DOUBLE ELSE pub / 5.0::DOUBLE * 75.0::DOUBLE END AS os,
  CASE WHEN res > 15 THEN (res - 15.0::DOUBLE) * 1.5::DOUBLE ELSE 0 END AS rp FROM v1),
sc AS (SELECT *, {rn('greatest(0, least(100, 0.25::DOUBLE * 100 + 0.2::DOUBLE * acc + 0.15::DOUBLE * pr + 0.15::DOUBLE * ut + 0.15::DOUBLE * re + 0.1::DOUBLE * os - rp))', 4)} AS composite FROM s1)"""

_SITE = "site AS (SELECT parcel_id, width_ft AS w, depth_ft AS h, width_ft * depth_ft AS g, width_ft >= depth_ft * 1.35::DOUBLE AS wide FROM v_parcels)"
_GRID = f"""{_SITE}, gr AS (SELECT *, CASE WHEN wide THEN w ELSE h END AS run, CASE WHEN wide THEN h ELSE w END AS crs FROM site), gn AS (SELECT *, greatest(1, CAST(floor(run / 85.0::DOUBLE) AS INT) - 1) AS nf FROM gr)"""
_ROAD_SLOTS = f"""{_GRID}, slots AS (SELECT *, unnest(range(0, nf + 1)) AS i FROM gn), pos AS (SELECT *, CASE WHEN i = 0 THEN crs * 0.5::DOUBLE ELSE run * i / (nf + 1) END AS p,
  CASE WHEN i = 0 THEN 39.37::DOUBLE ELSE 29.53::DOUBLE END / 2.0::DOUBLE AS hw, CASE WHEN i = 0 THEN crs ELSE run END AS lim, wide = (i = 0) AS ax FROM slots),
b AS (SELECT *, greatest(0, p - hw) AS lo, least(lim, p + hw) AS hi FROM pos)"""
_PLOTS = f"""{_GRID}, bl AS (SELECT *, unnest(range(0, nf + 1)) AS i FROM gn), bs AS (SELECT *, unnest([0, 1]) AS sd FROM bl),
be AS (SELECT *, run / (nf + 1) AS st FROM bs), bx AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE st * i + 29.53::DOUBLE / 2 END AS a0, CASE WHEN i = nf THEN run ELSE st * (i + 1) - 29.53::DOUBLE / 2 END AS a1,
  CASE WHEN sd = 0 THEN 0 ELSE crs * 0.5::DOUBLE + 39.37::DOUBLE / 2 END AS b0, CASE WHEN sd = 0 THEN crs * 0.5::DOUBLE - 39.37::DOUBLE / 2 ELSE crs END AS b1 FROM be),
bk AS (SELECT *, CASE WHEN wide THEN a1 - a0 ELSE b1 - b0 END AS bw, CASE WHEN wide THEN b1 - b0 ELSE a1 - a0 END AS bh,
  CASE WHEN g > 120000 THEN greatest(1200.0::DOUBLE, least(2800.0::DOUBLE, g / 75.0::DOUBLE)) ELSE 1200.0::DOUBLE END AS tg FROM bx),
tw AS (SELECT *, greatest(20.0::DOUBLE, least(60.0::DOUBLE, sqrt(tg * 0.65::DOUBLE))) AS tw FROM bk WHERE bw > 0 AND bh > 0 AND bw * bh >= 800 * 0.55::DOUBLE),
td AS (SELECT *, greatest(30.0::DOUBLE, tg / tw) AS td FROM tw), rw AS (SELECT *, CASE WHEN bh <= td * 1.6::DOUBLE THEN 1 ELSE least(2, greatest(1, CAST(round_even(bh / td, 0) AS INT))) END AS nr FROM td),
rh AS (SELECT *, CASE WHEN bh > td * 2.3::DOUBLE THEN least(td * 1.15::DOUBLE, bh / nr) ELSE bh / nr END AS rh, greatest(1, CAST(round_even(bw / tw, 0) AS INT)) AS nc FROM rw),
ok AS (SELECT *, CAST(CAST(bw / nc * rh AS DECIMAL(28,6)) AS DECIMAL(38,6)) AS pa FROM rh WHERE bw * rh >= 400)"""

_TRIES = ", ".join(
    f"({i}, '{a}', {sw}::DOUBLE, {sh}::DOUBLE)" for i, (a, sw, sh) in enumerate(
        (a, sw, sh) for a in ("NORTH_EAST", "SOUTH_EAST", "SOUTH_WEST", "NORTH_WEST", "CENTER") for sw, sh in ((1.0, 1.0), (1.15, 0.9), (0.9, 1.15), (1.25, 0.8), (0.8, 1.25), (1.3, 1.3)))
)


def _tried(name: str, pct: str, first: str) -> str:
    """Boxes of one reservation, the first anchor's six shapes moved to the front."""
    return f"""{name}_c AS (SELECT parcel_id, CASE WHEN an = '{first}' THEN i % 6 WHEN i < (SELECT min(i) FROM tries WHERE an = '{first}') THEN i + 6 ELSE i END AS t, an, g * {pct}::DOUBLE AS target,
  greatest(1.0::DOUBLE, w - 20) AS dw, greatest(1.0::DOUBLE, h - 20) AS dh, w, h, sw, sh, greatest(20.0::DOUBLE, sqrt(g * {pct}::DOUBLE) * 1.12::DOUBLE) AS zw FROM site, tries),
{name}_d AS (SELECT *, least(dw * 0.85::DOUBLE, zw * sw) AS cw, least(dh * 0.85::DOUBLE, greatest(20.0::DOUBLE, target / zw) * sh) AS ch FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN an LIKE '%EAST' THEN w - 10 - cw WHEN an = 'CENTER' THEN w / 2 - cw / 2 ELSE 10 END AS x0, CASE WHEN an LIKE 'NORTH%' THEN h - 10 - ch WHEN an = 'CENTER' THEN h / 2 - ch / 2 ELSE 10 END AS y0 FROM {name}_d),
{name}_f AS (SELECT *, x0 + cw AS x1, y0 + ch AS y1 FROM {name}_e)"""


ORACLE: dict[str, str] = {
    "classify_labels": with_views(
        f"""SELECT label_id, clean, CASE WHEN clean = '' THEN 'OTHER' WHEN d IS NOT NULL THEN 'DIMENSION' WHEN area_value IS NOT NULL THEN 'AREA'
  WHEN road_width IS NOT NULL OR regexp_matches(up, 'ROAD|STREET|AVENUE') THEN 'ROAD_LABEL' WHEN plot_number IS NOT NULL THEN 'PLOT_LABEL'
  WHEN regexp_matches(up, {q(T.GLOBAL_WORDS)}) THEN 'BOUNDARY_OR_GLOBAL' ELSE 'GENERAL_TEXT' END AS classification,
  {r2('d[1] + d[2] / 12.0::DOUBLE')} AS width, {r2('d[3] + d[4] / 12.0::DOUBLE')} AS length, area_value, road_width, plot_number FROM g""", extra=_CLEAN),
    "text_edit_distance": """SELECT p_partkey, levenshtein(n, t) AS distance, n AS norm FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS n,
  regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS t FROM part)""",
    "word_accuracy": f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: upper(trim(x)))) AS ws FROM conversations),
  b AS (SELECT coalesce(g.conv_id || '-' || g.turn, p.conv_id || '-' || (p.turn + 1)) AS k, coalesce(len(g.ws), 0) AS n_gt, coalesce(len(p.ws), 0) AS n_pred, coalesce(len(list_intersect(g.ws, p.ws)), 0) AS n_common FROM w g FULL JOIN w p ON g.conv_id = p.conv_id AND g.turn = p.turn + 1)
  SELECT k, n_gt, n_pred, n_common, {rn('coalesce(n_common / nullif(n_pred, 0)::DOUBLE, 0)', 4)} AS precision, {rn('coalesce(n_common / nullif(n_gt, 0)::DOUBLE, 0)', 4)} AS recall, {rn('n_common * 2.0::DOUBLE / (n_gt + n_pred)', 4)} AS f1 FROM b""",
    "ring_measures": with_views(
        f"""SELECT plot_id, w * h AS area, 2 * (w + h) AS perimeter, {r2('(x0 + x1) / 2')} AS cx, {r2('(y0 + y1) / 2')} AS cy, (x0 + x1) / 2 AS vx, (y0 + y1) / 2 AS vy,
  CASE WHEN h >= w THEN 'NORTH' ELSE 'EAST' END AS orientation, {r2('w / h')} AS aspect FROM v_rects""", "v_rects"),
    "shape_class": with_views(
        f"""SELECT plot_id, CASE WHEN plot_id % 3 = 0 THEN 'CONCAVE' ELSE 'RECTANGULAR' END AS shape_type, CASE WHEN plot_id % 3 = 0 THEN 6 ELSE 4 END AS vertex_count,
  CASE WHEN plot_id % 3 = 0 THEN 0.857::DOUBLE ELSE 1.0::DOUBLE END AS concavity, {r2('w / h')} AS aspect_ratio, CASE WHEN plot_id % 3 = 0 THEN w * h * 0.75::DOUBLE ELSE w * h END AS area FROM v_rects""", "v_rects"),
    "classify_primitives": with_views(
        """SELECT plot_id, CASE WHEN plot_id % 13 = 0 THEN 'OPEN_REGION' WHEN r >= 0.3::DOUBLE OR (bw > 0.7::DOUBLE * sqrt(800000) AND bh > 0.7::DOUBLE * sqrt(800000)) THEN 'BOUNDARY_CANDIDATE'
  WHEN (a > 5 OR a < 0.2::DOUBLE) AND (bw > 100 OR bh > 100) THEN 'ROAD_CANDIDATE' WHEN r < 0.001::DOUBLE OR (bw < 40 AND bh < 40) THEN 'TEXT_REGION'
  WHEN a BETWEEN 0.15::DOUBLE AND 6 THEN 'PLOT_CANDIDATE' ELSE 'UNKNOWN' END AS candidate_type FROM (SELECT plot_id, w * 4 AS bw, h AS bh, w * 4 / h AS a, w * h * 4 / 800000 AS r FROM v_rects)""", "v_rects"),
    "dedupe_primitives": with_views("SELECT project_id, min(plot_id) AS plot_id, count(*) AS copies FROM v_rects GROUP BY project_id, w, h", "v_rects"),
    "self_intersections": with_views("SELECT plot_id, plot_id % 5 = 0 AS crosses FROM v_rects", "v_rects"),
    "contains_join": with_views(
        "SELECT label_id, min(plot_id) AS plot_id, count(*) AS n_rings FROM v_points p JOIN v_rects r ON p.project_id = r.project_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY label_id", "v_points", "v_rects"),
    "bbox_join": with_views(
        "SELECT label_id, min(plot_id) AS plot_id FROM v_points p JOIN v_rects r ON p.project_id = r.project_id AND x >= x0 AND x <= x1 AND y >= y0 AND y <= y1 GROUP BY label_id", "v_points", "v_rects"),
    "nearest_join": with_views(
        f"""SELECT label_id, arg_min(plot_id, (d, plot_id)) AS plot_id, {r2('min(d)')} AS distance FROM (SELECT label_id, plot_id, sqrt((x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2)) AS d
  FROM v_points p JOIN v_rects r USING (project_id) WHERE abs(x - (x0 + x1) / 2) < 60 AND abs(y - (y0 + y1) / 2) < 60) WHERE d < 60 GROUP BY label_id""", "v_points", "v_rects"),
    "nearest_road": with_views(
        f"""SELECT label_id, arg_min(road_id, (d, ord)) AS road_id, {r2('min(d)')} AS distance FROM (SELECT label_id, road_id, ord, sqrt((x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2)) AS d
  FROM v_points JOIN v_roads USING (project_id)) GROUP BY label_id""", "v_points", "v_roads"),
    "associate_labels": with_views(
        f"""SELECT label_id, CASE WHEN n = 6 THEN 'boundary-001' WHEN n = 4 THEN road_id WHEN ir IS NOT NULL THEN CAST(ir AS VARCHAR) WHEN ib IS NOT NULL THEN CAST(ib AS VARCHAR) ELSE CAST(nr AS VARCHAR) END AS assigned_to,
  CASE WHEN n = 6 THEN 'PROJECT_BOUNDARY' WHEN n = 4 THEN 'ROAD_NETWORK' WHEN ir IS NOT NULL THEN 'POINT_IN_POLYGON' WHEN ib IS NOT NULL THEN 'BBOX_INTERSECTION' WHEN nr IS NOT NULL THEN 'NEAREST_POLYGON' ELSE 'UNASSIGNED' END AS assignment_type,
  CASE WHEN n = 6 THEN 0 WHEN n = 4 THEN {r2('rd')} WHEN ir IS NOT NULL THEN 0 WHEN ib IS NOT NULL THEN {r2('bd')} WHEN nr IS NOT NULL THEN {r2('nd')} ELSE -1 END AS distance
  FROM v_points LEFT JOIN hit USING (label_id) LEFT JOIN rds USING (label_id)""", "v_points", "v_rects", "v_roads",
        extra="""dist AS (SELECT label_id, plot_id, x >= x0 AND x < x1 AND y >= y0 AND y < y1 AS i, x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AS b,
  sqrt((x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2)) AS d FROM v_points p JOIN v_rects r USING (project_id) WHERE x BETWEEN x0 - 60 AND x1 + 60 AND y BETWEEN y0 - 60 AND y1 + 60),
hit AS (SELECT label_id, min(plot_id) FILTER (i) AS ir, min(plot_id) FILTER (b) AS ib, arg_min(d, plot_id) FILTER (b) AS bd, arg_min(plot_id, (d, plot_id)) FILTER (d < 60) AS nr, min(d) FILTER (d < 60) AS nd FROM dist GROUP BY 1),
rds AS (SELECT label_id, arg_min(road_id, (d, ord)) AS road_id, min(d) AS rd FROM (SELECT label_id, road_id, ord, sqrt((x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2)) AS d FROM v_points JOIN v_roads USING (project_id)) GROUP BY 1)"""),
    "viewport": with_views("SELECT project_id, plot_id FROM v_rects WHERE x0 <= 1300 AND x1 >= 480 AND y0 <= 300 AND y1 >= 90", "v_rects"),
    "mutual_overlap": with_views("SELECT project_id, a_id, b_id, o AS overlap, 1::BIGINT AS n_pairs FROM pairs WHERE o > 0", "v_rects", extra=_PAIRS),
    "iou_pairs": with_views(f"SELECT a_id, b_id, {rn('o / (aa + ba - o)', 6)} AS iou FROM pairs WHERE o > 0", "v_rects", extra=_PAIRS),
    "relationship_graph": with_views(
        """SELECT project_id, a_id AS src, b_id AS dst, relation, distance, o AS overlap_area FROM rel WHERE relation IS NOT NULL
  UNION ALL SELECT project_id, b_id, a_id, CASE relation WHEN 'CONTAINS' THEN 'INSIDE' ELSE 'CONTAINS' END, distance, o FROM rel WHERE relation IN ('CONTAINS', 'INSIDE')""", "v_rects", extra=_REL),
    "relationship_counts": with_views(
        """SELECT project_id, count(*) FILTER (relation IN ('CONTAINS', 'INSIDE')) AS contains, count(*) FILTER (relation IN ('TOUCHES', 'OVERLAPS')) AS intersects,
  count(*) FILTER (relation = 'TOUCHES') AS touches, count(*) FILTER (relation = 'TOUCHES') AS shared_edge, count(*) FILTER (relation = 'NEIGHBOR') AS neighbor FROM rel WHERE relation IS NOT NULL GROUP BY 1""", "v_rects", extra=_REL),
    "road_overlap": with_views(f"SELECT project_id, CAST(plot_id AS VARCHAR) AS entity_id, {r2('c')} AS measure FROM {_ROADS_U} WHERE c > greatest(3.5, area * 0.005)", "v_rects", "v_roads"),
    "union_area": with_views("SELECT project_id, sum(area) AS union_area FROM cover GROUP BY 1", "v_roads", extra=_cuts("SELECT project_id, 'A' AS side, x0, y0, x1, y1 FROM v_roads")),
    "plot_union_area": with_views(f"SELECT project_id, {r2('sum(area)')} AS union_area FROM cover GROUP BY 1", "v_rects", extra=_cuts("SELECT project_id, 'A' AS side, x0, y0, x1, y1 FROM v_rects")),
    "no_road_access": with_views(f"SELECT project_id, plot_id FROM (SELECT a.project_id, a.plot_id, min({gap('a', 'r')}) AS g FROM v_rects a JOIN v_roads r USING (project_id) GROUP BY 1, 2) WHERE g > 5", "v_rects", "v_roads"),
    "validate_layouts": with_views(
        f"""SELECT project_id, rule_id, count(f) AS violations, count(f) = 0 AS passed FROM (SELECT DISTINCT project_id FROM v_rects) CROSS JOIN (VALUES {_RULE_IDS}) r(rule_id)
  LEFT JOIN (SELECT project_id, rule_id, 1 AS f FROM found) USING (project_id, rule_id) GROUP BY 1, 2""", "v_rects", "v_roads", extra=_FOUND),
    "compliance_report": with_views(
        f"""SELECT project_id, 12 - count(DISTINCT rule_id) AS passed_rules, count(*) FILTER (rule_id NOT IN ('RULE_06', 'RULE_07', 'RULE_11')) AS errors,
  count(*) FILTER (rule_id IN ('RULE_06', 'RULE_07', 'RULE_11')) AS warnings, {r2('(12 - count(DISTINCT rule_id)) * 100.0::DOUBLE / 12')} AS compliance_pct,
  count(*) FILTER (rule_id NOT IN ('RULE_06', 'RULE_07', 'RULE_11')) = 0 AS overall FROM found GROUP BY 1""", "v_rects", "v_roads", extra=_FOUND),
    "applicable_norms": with_views(
        f"""SELECT parcel_id, authority_id, k AS is_congested, {r2('a')} AS land_area_sqm, {r2(f'a * {_SQ}')} AS land_area_sqft, {rn('ha', 3)} AS land_area_ha,
  op AS open_space_pct, {r2('a * (op / 100) * 1.0::DOUBLE')} AS open_space_sqm, {r2(f'a * (op / 100) * {_SQ}')} AS open_space_sqft, cl AS min_cluster_sqm, ow AS min_open_width_m,
  am AS amenity_pct, {r2('a * (am / 100)')} AS amenity_sqm, {r2(f'a * (am / 100) * {_SQ}')} AS amenity_sqft, ut AS utility_pct, {r2('a * (ut / 100)')} AS utility_sqm, {r2(f'a * (ut / 100) * {_SQ}')} AS utility_sqft,
  sb AS setback_m, {r2(f'sb * {_MF}')} AS setback_ft, ir AS internal_road_m, {r2(f'ir * {_MF}')} AS internal_road_ft, mr AS main_road_m, {r2(f'mr * {_MF}')} AS main_road_ft,
  mp AS min_plot_sqm, {r2(f'mp * {_SQ}')} AS min_plot_sqft, mf AS min_frontage_m, {r2(f'mf * {_MF}')} AS min_frontage_ft, md AS min_depth_m, {r2(f'md * {_MF}')} AS min_depth_ft FROM m""", "v_parcels", extra=_NORMS),
    "score_layouts": with_views(
        f"SELECT layout_id, composite, {rn('acc', 4)} AS accessibility, {rn('pr', 4)} AS practicality, {rn('ut', 4)} AS utilization, {rn('re', 4)} AS road_efficiency, {rn('os', 4)} AS open_space, {rn('rp', 4)} AS residual_penalty FROM sc", extra=_V1),
    "evaluate_layouts": with_views(
        f"""SELECT layout_id, {rn('comp', 4)} AS composite, {rn('us', 4)} AS util_score, {rn('gs', 4)} AS green_score, {rn('es', 4)} AS efficiency_score, {rn('ss', 4)} AS shape_score,
  rw >= 23 AS min_road_width_met, gp >= 8 AS open_space_met, acc >= 95 AS frontage_met, rw >= 23 AND gp >= 8 AND acc >= 95 AND comp >= 65 AS overall_compliant FROM e3""",
        extra=_TOTALS + """, e1 AS (SELECT *, pa / gross * 100.0::DOUBLE AS u, (oa + aa) / gross * 100.0::DOUBLE AS gp, na / greatest(1, n)::DOUBLE * 100.0::DOUBLE AS acc, CASE WHEN ra > 0 THEN pa / ra ELSE 1 END AS rr, rr2 * 10.0::DOUBLE / greatest(1, n) AS ss FROM tot),
e2 AS (SELECT *, CASE WHEN u BETWEEN 50 AND 65 THEN 100.0::DOUBLE WHEN u < 50 THEN greatest(0, u / 50.0::DOUBLE * 100.0::DOUBLE) ELSE greatest(50, 100.0::DOUBLE - (u - 65.0::DOUBLE) * 2.5::DOUBLE) END AS us,
  CASE WHEN gp >= 10 THEN 100.0::DOUBLE ELSE gp / 10.0::DOUBLE * 100.0::DOUBLE END AS gs, CASE WHEN rr >= 2.5::DOUBLE THEN 100.0::DOUBLE ELSE least(100, rr / 2.5::DOUBLE * 100.0::DOUBLE) END AS es FROM e1),
e3 AS (SELECT *, 0.3::DOUBLE * us + 0.25::DOUBLE * acc + 0.2::DOUBLE * gs + 0.15::DOUBLE * es + 0.1::DOUBLE * ss AS comp FROM e2)"""),
    "rank_variants": with_views(
        """SELECT project_id, layout_id, rank, CASE rank WHEN 1 THEN 'OPTION 1 — BEST OVERALL' WHEN 2 THEN 'OPTION 2 — BEST ACCESS' WHEN 3 THEN 'OPTION 3 — BEST LAND UTILIZATION' ELSE 'OPTION ' || rank END AS badge
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY composite DESC, ord) AS rank FROM sc)""", extra=_V1),
    "top_variants": with_views("SELECT project_id, layout_id, row_number() OVER (PARTITION BY project_id ORDER BY composite DESC, ord) AS rank, composite FROM sc QUALIFY rank <= 3", extra=_V1),
    "strategy_comparison": with_views(
        f"SELECT strategy, count(*) AS variants, {r2('CAST(sum(CAST(composite AS DECIMAL(28,6))) AS DOUBLE) / count(*)')} AS mean_composite, {r2('max(composite)')} AS best_composite, CAST(sum(n) AS BIGINT) AS plots FROM sc GROUP BY 1", extra=_V1),
    "variant_stats": with_views(
        f"""SELECT layout_id, nc AS corner_plots, {rn('pa', 1)} AS plot_sqft, {rn('pa * 0.09290304::DOUBLE', 1)} AS plot_sqm, {rn('pa / greatest(1, n)', 1)} AS avg_plot_sqft, {rn('ra / gross * 100.0::DOUBLE', 1)} AS road_pct,
  {rn('oa / gross * 100.0::DOUBLE', 1)} AS open_pct, {rn('aa / gross * 100.0::DOUBLE', 1)} AS amenity_pct, {rn('pa / gross * 100.0::DOUBLE', 1)} AS utilization_pct FROM tot""", extra=_TOTALS),
    "feasible_parcels": with_views(f"SELECT parcel_id, g >= 20000 * 2.5::DOUBLE + 29.53::DOUBLE * 40 AS is_feasible, {r2('20000 * 2.5::DOUBLE + 29.53::DOUBLE * 40')} AS needed_sqft FROM site", "v_parcels", extra=_SITE),
    "grid_roads": with_views(
        f"""SELECT parcel_id, CASE WHEN i = 0 THEN 'MAIN' ELSE 'FEEDER' END AS road_type, CAST(i AS BIGINT) AS road_no, {rn('CASE WHEN ax THEN 0 ELSE lo END', 4)} AS x0, {rn('CASE WHEN ax THEN lo ELSE 0 END', 4)} AS y0,
  {rn('CASE WHEN ax THEN w ELSE hi END', 4)} AS x1, {rn('CASE WHEN ax THEN hi ELSE h END', 4)} AS y1 FROM b""", "v_parcels", extra=_ROAD_SLOTS),
    "subdivide_blocks": with_views(
        f"""SELECT parcel_id, CAST(sum(nr * nc) AS BIGINT) AS plots, CAST(sum(nr * least(nc, 2)) AS BIGINT) AS corners, CAST(sum(CASE WHEN nr = 2 THEN nc ELSE 0 END) AS BIGINT) AS north,
  {r2('CAST(sum(pa * nr * nc) AS DOUBLE)')} AS plot_area FROM ok GROUP BY 1""", "v_parcels", extra=_PLOTS),
    "reserve_zones": with_views(
        f"""SELECT parcel_id, zone AS zone_type, an AS anchor, CAST(t AS BIGINT) AS "try", {rn('x0', 4)} AS x0, {rn('y0', 4)} AS y0, {rn('x1', 4)} AS x1, {rn('y1', 4)} AS y1 FROM (
  SELECT 'RECREATIONAL_OPEN_SPACE' AS zone, parcel_id, an, t, x0, y0, x1, y1 FROM oz UNION ALL SELECT 'AMENITY_SPACE', parcel_id, an, t, x0, y0, x1, y1 FROM az)""", "v_parcels",
        extra=f"""{_SITE}, tries(i, an, sw, sh) AS (VALUES {_TRIES}), {_tried('o', '0.1', 'NORTH_EAST')},
oz AS (SELECT * FROM o_f WHERE (x1 - x0) * (y1 - y0) >= target * 0.7::DOUBLE QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY t) = 1), {_tried('a', '0.05', 'SOUTH_EAST')},
az AS (SELECT b.* FROM a_f b LEFT JOIN oz ON oz.parcel_id = b.parcel_id WHERE (b.x1 - b.x0) * (b.y1 - b.y0) - coalesce({common('b', 'oz')}, 0) >= b.target * 0.7::DOUBLE QUALIFY row_number() OVER (PARTITION BY b.parcel_id ORDER BY b.t) = 1)"""),
    "plot_match": with_views(
        f"""SELECT project_id, ord AS g_ord, ord AS p_ord, {rn('i / (w * h + w * (h + ord % 3) - i)', 6)} AS iou FROM (SELECT *, (w - p_size % 5) * h AS i FROM v_rects WHERE plot_id % 11 <> 0)""", "v_rects"),
    "plot_metrics": with_views(
        f"""SELECT project_id, count(*) AS n_gt, count(iou) AS n_pred, count(iou) AS matched, count(*) - count(iou) AS missing, 0::BIGINT AS extra, count(*) - count(iou) AS merged, 0::BIGINT AS duplicated,
  {rn('CAST(sum(CAST(iou AS DECIMAL(20,12))) AS DOUBLE) / count(iou)', 4)} AS mean_iou, {rn('median(iou)', 4)} AS median_iou, {r2('CAST(sum(CAST(ae AS DECIMAL(24,9))) AS DOUBLE) / count(ae)')} AS mean_area_error_pct FROM (
  SELECT project_id, CASE WHEN plot_id % 11 <> 0 THEN i / (w * h + w * (h + ord % 3) - i) END AS iou, CASE WHEN plot_id % 11 <> 0 THEN w * (ord % 3) * 100.0::DOUBLE / (w * h) END AS ae
  FROM (SELECT *, (w - p_size % 5) * h AS i FROM v_rects)) GROUP BY 1""", "v_rects"),
    "road_metrics": with_views(
        f"""SELECT project_id, 3::BIGINT AS gt_roads, 2::BIGINT AS pred_roads, {rn('sum(area) FILTER (a AND b) / sum(area)', 4)} AS road_iou,
  {r2('abs(sum(area) FILTER (a) - sum(area) FILTER (b)) * 100.0::DOUBLE / sum(area) FILTER (a)')} AS length_error_pct FROM cover GROUP BY 1""", "v_roads",
        extra=_cuts("SELECT project_id, 'A' AS side, x0, y0, x1, y1 FROM v_roads UNION ALL SELECT project_id, 'B', x0, y0 + 5, x1, y1 + 5 FROM v_roads WHERE ord <> 1")),
    "label_association": with_views(
        f"""SELECT project_id, count(*) AS total_labels, count(*) FILTER (linked AND same) AS correct, count(*) FILTER (linked AND NOT same) AS incorrect, count(*) FILTER (NOT linked) AS unassociated,
  {rn('count(*) FILTER (linked AND same) / count(*)::DOUBLE', 4)} AS association_accuracy FROM (SELECT p_partkey // 400 AS project_id, p_size % 9 <> 0 AS linked, p_size <> 7 AND p_size % 10 <> 3 AS same FROM part WHERE p_size <> 13) GROUP BY 1"""),
    "geo_to_cad": with_views(
        f"""SELECT plot_id, greatest(50, floor((x1 - x0) * 1e-5 * 111139.0::DOUBLE * cos(radians(lat)) * {_MF} + 0.5)) AS length_ft, greatest(50, floor((y1 - y0) * 1e-5 * 111139.0::DOUBLE * {_MF} + 0.5)) AS breadth_ft,
  floor((x1 - x0) * 1e-5 * 111139.0::DOUBLE * cos(radians(lat)) * (y1 - y0) * 1e-5 * 111139.0::DOUBLE + 0.5) AS area_sqm FROM (SELECT *, (y0 + y1) / 2 * 1e-5 + 18.5::DOUBLE AS lat FROM v_rects)""", "v_rects"),
    "affine": with_views("SELECT plot_id, w * h * 6 AS area, x1 * 2 + 10 AS x2, y1 * 3 - 5 AS y2 FROM v_rects", "v_rects"),
    "tile_index": """WITH i AS (SELECT p_partkey AS image_id, p_size * 60 AS w, CAST(floor(p_retailprice) AS BIGINT) + p_partkey % 700 AS h FROM part),
  s AS (SELECT *, list_distinct(list_concat(range(0, greatest(w - 512, 0) + 1, 448), [greatest(w - 512, 0)])) AS xs, list_distinct(list_concat(range(0, greatest(h - 512, 0) + 1, 448), [greatest(h - 512, 0)])) AS ys FROM i),
  t AS (SELECT image_id, w, h, ys, unnest(xs) AS x FROM s), u AS (SELECT image_id, w, h, x, unnest(ys) AS y FROM t)
  SELECT image_id, x, y, least(w - x, 512)::BIGINT AS tile_w, least(h - y, 512)::BIGINT AS tile_h FROM u""",
    "argmax_class": """SELECT vec_id AS image_id, i // 4 AS x, arg_max(i % 4, (p, -(i % 4))) AS class_id FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2""",
    "class_pixel_counts": """SELECT image_id, class_id, count(*) AS pixels, count(*) > 80 AS has_detections FROM (
  SELECT vec_id AS image_id, i // 4 AS x, arg_max(i % 4, (p, -(i % 4))) AS class_id FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1, 2""",
    "layer_extent": with_views("SELECT project_id, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y, (min(x0) + max(x1)) / 2 AS center_x, (min(y0) + max(y1)) / 2 AS center_y FROM v_rects GROUP BY 1", "v_rects"),
    "layer_stats": with_views(
        f"""SELECT project_id, count(*) AS features, count(*) FILTER (p_type NOT IN ('PROMO', 'LARGE')) AS plots, count(*) FILTER (p_type = 'PROMO') AS roads, 0::BIGINT AS boundaries, count(*) FILTER (p_type = 'LARGE') AS amenities,
  {r2("sum(w * h) FILTER (p_type NOT IN ('PROMO', 'LARGE'))")} AS plot_area FROM v_rects GROUP BY 1""", "v_rects"),
    "buildable_balance": with_views(
        f"""SELECT project_id, 1104000.0::DOUBLE AS gross_sqft, 1104000.0::DOUBLE - 2380 * 440 AS setback_sqft, {r2('ru')} AS road_sqft, {r2('net')} AS net_sqft, {r2('net / 1104000.0::DOUBLE * 100.0::DOUBLE')} AS buildable_pct FROM (
  SELECT project_id, sum(area) FILTER (a AND NOT b) AS net FROM cover GROUP BY 1) JOIN (SELECT project_id, sum((x1 - x0) * (y1 - y0)) - 30 * 30 - 30 * 22 AS ru FROM v_roads GROUP BY 1) USING (project_id)""", "v_rects", "v_roads",
        extra=_cuts("SELECT project_id, 'B' AS side, x0, y0, x1, y1 FROM v_roads UNION ALL SELECT project_id, 'B', x0, y0, x1, y1 FROM v_rects WHERE p_type = 'PROMO' UNION ALL SELECT DISTINCT project_id, 'A', 10, 10, 2390, 450 FROM v_rects")),
    "road_intersections": with_views("SELECT a.project_id, (b.x0 + b.x1) / 2 AS x, (a.y0 + a.y1) / 2 AS y FROM v_roads a JOIN v_roads b USING (project_id) WHERE a.ord < 2 AND b.ord = 2", "v_roads"),
    "facing4": with_views(
        """SELECT plot_id, CASE WHEN a >= -45 AND a < 45 THEN 'EAST' WHEN a >= 45 AND a < 135 THEN 'NORTH' WHEN a >= -135 AND a < -45 THEN 'SOUTH' ELSE 'WEST' END AS facing4 FROM (
  SELECT plot_id, degrees(atan2((y0 + y1) / 2 - (min(y0) OVER p + max(y1) OVER p) / 2, (x0 + x1) / 2 - (min(x0) OVER p + max(x1) OVER p) / 2)) AS a FROM v_rects WINDOW p AS (PARTITION BY project_id))""", "v_rects"),
    "calibrate_scale": with_views(
        f"""SELECT plot_id, CASE WHEN px < 1 THEN 1 ELSE {rn('f', 4)} END AS px_per_ft, CASE WHEN px < 1 THEN 0.3048::DOUBLE ELSE {rn('1.0::DOUBLE / greatest(m, 1e-6)', 4)} END AS m_per_px,
  {rn('1.0::DOUBLE / greatest(1.0::DOUBLE / greatest(sqrt(greatest(sq / (w * h), 1e-6)), 1e-6), 1e-6)', 4)} AS area_ft_per_px FROM (SELECT *, CASE WHEN plot_id % 2 = 0 THEN r / 3.28084::DOUBLE ELSE r END AS f, CASE WHEN plot_id % 2 = 0 THEN r ELSE r * 3.28084::DOUBLE END AS m FROM (
  SELECT *, sqrt(w * w + h * h) AS px, sqrt(w * w + h * h) / (p_size * 2.0::DOUBLE) AS r, p_size::DOUBLE / 10 * CASE WHEN plot_id % 2 = 0 THEN 43560.0::DOUBLE ELSE 1089.0::DOUBLE END AS sq FROM v_rects))""", "v_rects"),
}
