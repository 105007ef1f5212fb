"""SQL twin of the candidate sweep: roads, free rectangles, zones, blocks, scores and ranks as tables."""

from __future__ import annotations

from acreage.plans.layouts_sql import _TRIES, rn
from acreage.plans.sql import VIEWS, r2

_MAIN, _FEED = "39.37::DOUBLE", "29.53::DOUBLE"
_PIECES = """[{'x0': f.x0, 'y0': f.y0, 'x1': f.x1, 'y1': T.y0}, {'x0': f.x0, 'y0': T.y1, 'x1': f.x1, 'y1': f.y1},
    {'x0': f.x0, 'y0': greatest(f.y0, T.y0), 'x1': T.x0, 'y1': least(f.y1, T.y1)}, {'x0': T.x1, 'y0': greatest(f.y0, T.y0), 'x1': f.x1, 'y1': least(f.y1, T.y1)}]"""


def _cut(taken: str) -> str:
    """Rectangles left of ``f`` without the box in alias ``taken``."""
    meets = f"least(f.x1, {taken}.x1) > greatest(f.x0, {taken}.x0) AND least(f.y1, {taken}.y1) > greatest(f.y0, {taken}.y0)"
    return f"CASE WHEN {meets} THEN list_filter({_PIECES.replace('T.', taken + '.')}, lambda p: p.x1 > p.x0 AND p.y1 > p.y0) ELSE [{{'x0': f.x0, 'y0': f.y0, 'x1': f.x1, 'y1': f.y1}}] END"


def _across(kind: str, y: str, x0: str, x1: str, width: str) -> str:
    return f"{x0}, {y} - {width} / 2, {x1}, {y} + {width} / 2, {width}, '{kind}'"


def _down(kind: str, x: str, y0: str, y1: str, width: str) -> str:
    return f"{x} - {width} / 2, {y0}, {x} + {width} / 2, {y1}, {width}, '{kind}'"


def _roads() -> str:
    x1, x2, y1, y2 = "w * 0.5::DOUBLE - rw", "w * 0.5::DOUBLE + rw", "h * 0.5::DOUBLE - rh", "h * 0.5::DOUBLE + rh"
    loop = [
        _down("ARTERIAL", "w * 0.5::DOUBLE", "0", "h * 0.4::DOUBLE", _MAIN), _across("FEEDER", "i", "i", "w - i", _FEED), _down("FEEDER", "w - i", "i", "h - i", _FEED),
        _across("FEEDER", "h - i", "i", "w - i", _FEED), _down("FEEDER", "i", "i", "h - i", _FEED),
    ]
    court = [
        _across("PERIMETER", y1, x1, x2, _FEED), _down("PERIMETER", x2, y1, y2, _FEED), _across("PERIMETER", y2, x1, x2, _FEED), _down("PERIMETER", x1, y1, y2, _FEED),
        _down("MAIN", "w * 0.5::DOUBLE", "0", y1, _MAIN), _across("FEEDER", "h * 0.5::DOUBLE", "0", x1, _FEED), _across("FEEDER", "h * 0.5::DOUBLE", x2, "w", _FEED),
    ]
    parts = [
        f"SELECT parcel_id, w, h, 'efficiency' AS st, 0 AS k, {_across('MAIN', 'h * 0.5::DOUBLE', '0', 'w', _MAIN)} FROM dims WHERE wide", f"SELECT parcel_id, w, h, 'efficiency', 0, {_down('MAIN', 'w * 0.5::DOUBLE', '0', 'h', _MAIN)} FROM dims WHERE NOT wide",
        f"SELECT parcel_id, w, h, 'efficiency', j, {_down('FEEDER', 'w * j / (n + 1)', '0', 'h', _FEED)} FROM feeders WHERE wide", f"SELECT parcel_id, w, h, 'efficiency', j, {_across('FEEDER', 'h * j / (n + 1)', '0', 'w', _FEED)} FROM feeders WHERE NOT wide",
        *[f"SELECT parcel_id, w, h, 'loop', {k}, {road} FROM dims" for k, road in enumerate(loop)], *[f"SELECT parcel_id, w, h, 'quality', {k}, {road} FROM dims" for k, road in enumerate(court)],
    ]
    return " UNION ALL ".join(parts)


def _zone(name: str, before: str, first: str, share: str, least: float) -> str:
    """Placement of one zone in the rectangles ``before``, and what it leaves, ``f_name``."""
    order = f"CASE WHEN an = {first} THEN i % 6 WHEN i < fi THEN i + 6 ELSE i END"
    return f"""{name}_t AS MATERIALIZED (SELECT parcel_id, st, an, {order} AS t, target, dw, dh, w, h, greatest(20, sqrt(target) * 1.12::DOUBLE) AS zw, sw, sh FROM (
    SELECT d.parcel_id, s.st, d.w, d.h, d.g * {share} / 100 AS target, greatest(1, d.w - 20) AS dw, greatest(1, d.h - 20) AS dh, t.*, (SELECT min(i) FROM tries u WHERE u.an = {first}) AS fi FROM dims d, strategies s, tries t) WHERE target >= {least}),
{name}_b AS (SELECT *, x0 + cw AS x1, y0 + ch AS y1 FROM (SELECT *, CASE WHEN an LIKE '%EAST' THEN w - 10 - cw WHEN an = 'CENTER' THEN (10 + (w - 10)) / 2 - cw / 2 ELSE 10 END AS x0, CASE WHEN an LIKE 'NORTH%' THEN h - 10 - ch WHEN an = 'CENTER' THEN (10 + (h - 10)) / 2 - ch / 2 ELSE 10 END AS y0
    FROM (SELECT *, least(dw * 0.85::DOUBLE, zw * sw) AS cw, least(dh * 0.85::DOUBLE, greatest(20, target / zw) * sh) AS ch FROM {name}_t))),
{name}_z AS MATERIALIZED (SELECT parcel_id, st, an, t, x0, y0, x1, y1 FROM (
    SELECT b.parcel_id, b.st, b.an, b.t, b.target, greatest(b.x0, f.x0) AS x0, greatest(b.y0, f.y0) AS y0, least(b.x1, f.x1) AS x1, least(b.y1, f.y1) AS y1 FROM {name}_b b JOIN {before} f USING (parcel_id, st)
    WHERE least(b.x1, f.x1) > greatest(b.x0, f.x0) AND least(b.y1, f.y1) > greatest(b.y0, f.y0))
  WHERE {rn('(x1 - x0) * (y1 - y0)', 4)} >= greatest(target * 0.7::DOUBLE, 30) QUALIFY row_number() OVER (PARTITION BY parcel_id, st ORDER BY t, {rn('(x1 - x0) * (y1 - y0)', 4)} DESC, x0, y0) = 1),
f_{name} AS MATERIALIZED (SELECT parcel_id, st, unnest(p, recursive := true) FROM (SELECT f.parcel_id, f.st, unnest(CASE WHEN z.st IS NULL THEN [{{'x0': f.x0, 'y0': f.y0, 'x1': f.x1, 'y1': f.y1}}] ELSE {_cut('z')} END) AS p FROM {before} f LEFT JOIN {name}_z z USING (parcel_id, st)))"""


_LAND = f"""v_parcels AS ({VIEWS['v_parcels']}), strategies(st, ord) AS (VALUES ('efficiency', 1), ('loop', 2), ('quality', 3)), tries(i, an, sw, sh) AS (VALUES {_TRIES}),
dims AS (SELECT parcel_id, width_ft AS w, depth_ft AS h, width_ft * depth_ft AS g, width_ft >= depth_ft * 1.35::DOUBLE AS wide, greatest(40, least(width_ft, depth_ft) * 0.22::DOUBLE) AS i,
  least(width_ft * 0.25::DOUBLE, 75) AS rw, least(depth_ft * 0.25::DOUBLE, 60) AS rh, greatest(1, CAST(floor(CASE WHEN width_ft >= depth_ft * 1.35::DOUBLE THEN width_ft ELSE depth_ft END / 85) AS INT) - 1) AS n FROM v_parcels),
feeders AS (SELECT *, unnest(range(1, n + 1)) AS j FROM dims),
laid(parcel_id, w, h, st, k, x0, y0, x1, y1, width, kind) AS ({_roads()}),
roads AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY parcel_id, st ORDER BY k) AS n FROM (
  SELECT parcel_id, st, k, greatest(0, x0) AS x0, greatest(0, y0) AS y0, least(w, x1) AS x1, least(h, y1) AS y1, width FROM laid) WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) >= 200),
pieces AS (
  SELECT parcel_id, st, 0 AS n, 10.0::DOUBLE AS x0, 10.0::DOUBLE AS y0, w - 10 AS x1, h - 10 AS y1 FROM dims, strategies
  UNION ALL SELECT parcel_id, st, n, p.x0, p.y0, p.x1, p.y1 FROM (SELECT f.parcel_id, f.st, CAST(f.n + 1 AS INT) AS n, unnest({_cut('r')}) AS p FROM pieces f JOIN roads r ON r.parcel_id = f.parcel_id AND r.st = f.st AND r.n = f.n + 1)
),
f_road AS MATERIALIZED (SELECT p.* EXCLUDE (n) FROM pieces p JOIN (SELECT parcel_id, st, max(n) AS n FROM roads GROUP BY ALL) USING (parcel_id, st, n)),
{_zone('o', 'f_road', "CASE WHEN st = 'quality' THEN 'CENTER' ELSE 'NORTH_EAST' END", '10.0::DOUBLE', 100)},
{_zone('a', 'f_o', "'SOUTH_EAST'", '5.0::DOUBLE', 100)},
{_zone('u', 'f_a', "'NORTH_WEST'", '1.0::DOUBLE', 50)},
zones AS (SELECT 'RECREATIONAL_OPEN_SPACE' AS zone_type, * FROM o_z UNION ALL SELECT 'AMENITY_SPACE', * FROM a_z UNION ALL SELECT 'UTILITY_SERVICE', * FROM u_z)"""

_D = "CAST({} AS DECIMAL(28,6))"
_SWEEP = f"""{_LAND}, passes(pass_no, pw) AS (VALUES (0, 1.0::DOUBLE), (1, 0.95::DOUBLE), (2, 1.05::DOUBLE)),
b1 AS (SELECT f.parcel_id, f.st, pass_no, g, x0, y0, x1 - x0 AS bw, y1 - y0 AS bh, greatest(24 * pw, least(45, sqrt(tg * 0.65::DOUBLE))) AS tw, tg FROM f_u f
  JOIN (SELECT parcel_id, g, CASE WHEN g > 120000 THEN greatest(1200, least(2800, g / 75)) ELSE 1200 END AS tg FROM dims) USING (parcel_id), passes WHERE (x1 - x0) * (y1 - y0) >= 800 * 0.55::DOUBLE),
b2 AS (SELECT *, greatest(30, tg / tw) AS td FROM b1), b3 AS (SELECT *, CASE WHEN bh <= td * 1.6::DOUBLE THEN 1 ELSE least(2, greatest(1, CAST(round_even(bh / td, 0) AS INT))) END AS nr, greatest(1, CAST(round_even(bw / tw, 0) AS INT)) AS c0 FROM b2),
b4 AS (SELECT *, CASE WHEN bh > td * 2.3::DOUBLE THEN least(td * 1.15::DOUBLE, bh / nr) ELSE bh / nr END AS rh FROM b3), b5 AS (SELECT *, CASE WHEN bw / c0 * rh < 800 * 0.7::DOUBLE THEN 1 ELSE c0 END AS nc FROM b4 WHERE bw * rh >= 400),
b6 AS (SELECT *, bw / nc AS p FROM b5), blocks AS (SELECT *, nr * nc AS n, p * rh AS pa FROM b6 WHERE p * rh >= 400 AND greatest(1, p) / greatest(1, rh) BETWEEN 0.1::DOUBLE AND 9),
plots AS (SELECT parcel_id, st, pass_no, any_value(g) AS gross, sum(n) AS n, CAST(sum(CAST({_D.format('pa')} AS DECIMAL(38,6)) * n) AS DOUBLE) AS pa, sum(CASE WHEN p >= 15 THEN n ELSE 0 END) AS na,
  sum(n * CASE WHEN sl <= 2.2::DOUBLE THEN 10 WHEN sl <= 3 THEN 6 ELSE 2 END) AS r1, sum(n * CASE WHEN sl <= 2.5::DOUBLE THEN 10 WHEN sl <= 3.5::DOUBLE THEN 5 ELSE 0 END) AS r2,
  sum(CASE WHEN pa < 720 THEN n ELSE 0 END) AS w6, sum(CASE WHEN least(p, rh) < 24 * 0.85::DOUBLE THEN n ELSE 0 END) AS w7 FROM (SELECT *, greatest(p / rh, rh / p) AS sl FROM blocks) GROUP BY ALL),
tot AS (SELECT *, coalesce(oa_, 0) AS oa, coalesce(aa_, 0) AS aa FROM plots JOIN (SELECT parcel_id, st, CAST(sum({_D.format('(x1 - x0) * (y1 - y0)')}) AS DOUBLE) AS ra FROM roads GROUP BY ALL) USING (parcel_id, st)
  LEFT JOIN (SELECT parcel_id, st, CAST(sum({_D.format('(x1 - x0) * (y1 - y0)')}) FILTER (zone_type <> 'AMENITY_SPACE') AS DOUBLE) AS oa_, CAST(sum({_D.format('(x1 - x0) * (y1 - y0)')}) FILTER (zone_type = 'AMENITY_SPACE') AS DOUBLE) AS aa_ FROM zones GROUP BY ALL) USING (parcel_id, st)),
e1 AS (SELECT *, pa / gross * 100 AS u, (oa + aa) / gross * 100 AS gp, na / n::DOUBLE * 100 AS acc, pa / ra AS ratio, oa / gross * 100 + aa / gross * 100 AS pub, greatest(0, gross - (pa + ra + oa + aa)) / gross * 100 AS res FROM tot),
e2 AS (SELECT *, CASE WHEN u BETWEEN 50 AND 65 THEN 100 WHEN u < 50 THEN greatest(0, u / 50 * 100) ELSE greatest(50, 100 - (u - 65) * 2.5::DOUBLE) END AS us, CASE WHEN gp >= 10 THEN 100 ELSE gp / 10 * 100 END AS gs, CASE WHEN ratio >= 2.5::DOUBLE THEN 100 ELSE least(100, ratio / 2.5::DOUBLE * 100) END AS es FROM e1),
e3 AS (SELECT *, 0.3::DOUBLE * us + 0.25::DOUBLE * acc + 0.2::DOUBLE * gs + 0.15::DOUBLE * es + 0.1::DOUBLE * (r2 * 10.0::DOUBLE / n) AS first FROM e2),
best AS (SELECT * FROM e3 QUALIFY row_number() OVER (PARTITION BY parcel_id, st ORDER BY CASE WHEN pass_no = 0 AND n >= 4 AND first >= 60 THEN 0 ELSE 1 END, {rn('first', 1)} DESC, pass_no) = 1),
s1 AS (SELECT *, w6 + w7 AS warnings, CASE WHEN u BETWEEN 50 AND 65 THEN 100 WHEN u < 50 THEN greatest(0, u / 50 * 100) ELSE greatest(50, 100 - (u - 65) * 3) END AS ut,
  CASE WHEN ratio BETWEEN 2 AND 3.5::DOUBLE THEN 100 WHEN ratio < 2 THEN greatest(40, ratio / 2 * 100) ELSE greatest(60, 100 - (ratio - 3.5::DOUBLE) * 10) END AS re, CASE WHEN pub >= 10 THEN 100 WHEN pub >= 5 THEN 75 + (pub - 5) * 5 ELSE pub / 5 * 75 END AS os,
  CASE WHEN res > 15 THEN (res - 15) * 1.5::DOUBLE ELSE 0 END AS rp FROM best),
s2 AS (SELECT *, {rn('greatest(0, least(100, 0.25::DOUBLE * greatest(70, 100 - warnings * 3) + 0.2::DOUBLE * acc + 0.15::DOUBLE * (r1 * 10.0::DOUBLE / n) + 0.15::DOUBLE * ut + 0.15::DOUBLE * re + 0.1::DOUBLE * os - warnings * 2 - rp))', 4)} AS composite FROM s1)"""

ORACLE = {
    "layout_zones": f"""WITH RECURSIVE {_LAND} SELECT parcel_id, st AS strategy, zone_type, an AS anchor, {rn('x0', 4)} AS x0, {rn('y0', 4)} AS y0, {rn('x1', 4)} AS x1, {rn('y1', 4)} AS y1 FROM zones""",
    "candidate_sweep": f"""WITH RECURSIVE {_SWEEP}
SELECT parcel_id, st AS strategy, pass_no::BIGINT AS pass_no, n::BIGINT AS n_plots, {r2('pa')} AS plot_area, {r2('ra')} AS road_area, {r2('oa')} AS open_area, {r2('aa')} AS amenity_area, warnings::BIGINT AS warnings, {r2('composite')} AS composite, rank,
  CASE rank WHEN 1 THEN 'OPTION 1 — BEST OVERALL' WHEN 2 THEN 'OPTION 2 — BEST ACCESS' ELSE 'OPTION 3 — BEST LAND UTILIZATION' END AS badge
FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY composite DESC, ord) AS rank FROM s2 JOIN strategies USING (st))""",
}
