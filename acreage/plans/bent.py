"""Registered queries on shapes the business tables lack: concave ones at any angle, far and slanted roads. Twins are in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.functions.rings import floor_round
from acreage.operators import detection as D
from acreage.operators import rules as Q
from acreage.operators import spatial as P
from acreage.plans import views as v
from acreage.plans.sql import r2, with_views
from acreage.sources.tables import read_table

SETBACK = 10.0


def _setback(s, d):
    return D.setback(v.bent(s, d), SETBACK, ("plot_id",)).select("plot_id", floor_round("setback_area").alias("setback_area"))


def _box(b, *sides):
    return b.select("project_id", v.turned_box(*sides).alias("ring"))


def _balance(s, d):
    b = v.bent(s, d)
    road, green, pond = _box(b, 0, 30, F.col("w"), 50), _box(b, 20, 60, 40, 80), _box(b, 45, 60, 55, 75)
    return D.buildable_balance(b, road, green, pond, SETBACK)


def _hits(s, d):
    """Plots well inside, at the concave corner, over the left rim, across the notch, and just clear of it."""
    b = v.bent(s, d)
    x, y = F.col("vx"), F.col("vy")
    boxes = [(20, 20, 40, 40), (x - 20, y - 20, x, y), (5, 40, 25, 60), (x - 5, y + 20, x + 15, y + 40), (x - 30, y + 20, x - 10, y + 40)]
    plots = b.select("project_id", F.posexplode(F.array(*[v.turned_box(*box) for box in boxes])).alias("i", "ring"))
    plots = plots.select("project_id", (F.col("project_id") * 10 + F.col("i")).alias("plot_id"), "ring")
    return Q.rule_setback(plots, b, {"setback_ft": SETBACK}).select("project_id", "entity_id", "measure")


def _far_road(s, d):
    """Labels whose roads lie 50,000 away and more."""
    roads = D.road_facts(v.sheet_roads(s, d).withColumn("ring", R.box_ring(F.col("x0") + 50000, F.col("y0") + F.col("ord") * 40000, F.col("x1") + 50000, F.col("y1") + F.col("ord") * 40000)))
    return P.nearest_road(v.points(s, d), roads).select("label_id", "road_id", floor_round("distance").alias("distance"))


def _slanted(s, d):
    """Ten straight roads per sheet, 50,000 long, each crossing all others."""
    k = F.col("p_partkey")
    line = F.array(R.point(F.lit(0.0), (k % 400 * 100).cast("double")), R.point(F.lit(50000.0), (40000 - (k % 400) * (k % 400) / 10).cast("double")))
    roads = read_table(s, d, "part").filter(k % 40 == 0).select(F.floor(k / v.BLOCK).alias("project_id"), k.alias("road_id"), line.alias("centerline"))
    return P.road_intersections(roads)


def _odd(s, d):
    """Boxes, bow ties, slivers and triangles under the rules on validity and slivers."""
    k = F.col("plot_id")
    w, h = F.col("w"), F.col("h")
    kinds = [[(0, 0), (w, 0), (w, h), (0, h)], [(0, 0), (w, h), (w, 0), (0, h / 2)], [(0, 0), (0.5, 0), (0.5, 1.5), (0, 1.5)], [(0, 0), (w, 0), (0, h)]]
    ring = F.when(F.lit(False), F.array().cast(R.RING))
    for i, points in enumerate(kinds):
        ring = ring.when(k % 4 == i, v._turned(points, F.lit(False)))
    odd = v.bent(s, d).withColumn("ring", ring)
    return Q.rule_validity(odd).unionByName(Q.rule_sliver(odd)).select("project_id", "rule_id", "entity_id", "measure")


QUERIES = {"odd_rings": _odd, "far_road": _far_road, "slanted_crossings": _slanted, "bent_setback": _setback, "bent_balance": _balance, "bent_setback_hits": _hits}

# the fan of a concave corner: 16 chords of a quarter circle
_FAN = "(8 * 100 * sin(pi() / 32))"
_BENT = f"""bent AS (SELECT *, (w - 20) * (h - 20) - CASE WHEN is_l THEN m * n ELSE (m + 20) * n END + CASE WHEN is_l THEN 1 ELSE 2 END * (100 - {_FAN}) AS inset, w * h - m * n AS gross FROM (
  SELECT *, w / 4 AS m, h / 2 AS n FROM (SELECT p_partkey AS plot_id, p_partkey % 2 = 0 AS is_l, (p_size * 6 + 200)::DOUBLE AS w, (p_partkey % 5 * 20 + 180)::DOUBLE AS h FROM part)))"""

ORACLE = {
    "odd_rings": """SELECT p_partkey AS project_id, CASE p_partkey % 4 WHEN 1 THEN 'RULE_09' ELSE 'RULE_10' END AS rule_id, p_partkey::VARCHAR AS entity_id, CASE p_partkey % 4 WHEN 1 THEN 0 ELSE 0.75 END::DOUBLE AS measure
  FROM part WHERE p_partkey % 4 IN (1, 2)""",
    "far_road": with_views(
        f"""SELECT label_id, arg_min(road_id, (d, ord)) AS road_id, {r2('min(d)')} AS distance FROM (SELECT label_id, road_id, ord, sqrt(pow(x - (x0 + x1) / 2 - 50000, 2) + pow(y - (y0 + y1) / 2 - ord * 40000, 2)) AS d
  FROM v_points JOIN v_roads USING (project_id)) GROUP BY label_id""", "v_points", "v_roads"),
    "slanted_crossings": f"""WITH l AS (SELECT p_partkey // 400 AS project_id, p_partkey AS id, (p_partkey % 400 * 100)::DOUBLE AS a, 40000 - (p_partkey % 400) * (p_partkey % 400) / 10.0::DOUBLE AS b FROM part WHERE p_partkey % 40 = 0),
  c AS (SELECT l.project_id, (r.a - l.a) / (r.a - l.a + l.b - r.b) AS t, l.a, l.b FROM l JOIN l r ON r.project_id = l.project_id AND l.id < r.id)
SELECT DISTINCT project_id, {r2('t * 50000')} AS x, {r2('a + t * (b - a)')} AS y FROM c""",
    "bent_setback": f"WITH {_BENT} SELECT plot_id, {r2('gross - inset')} AS setback_area FROM bent",
    "bent_balance": f"""WITH {_BENT}, net AS (SELECT *, inset - 20 * (w - 20) - 400 - 150 AS net FROM bent)
SELECT plot_id AS project_id, {r2('gross')} AS gross_sqft, {r2('gross - inset')} AS setback_sqft, 20 * w AS road_sqft, 400.0::DOUBLE AS green_sqft, 150.0::DOUBLE AS obstacle_sqft, {r2('net')} AS net_sqft, {r2('net / gross * 100')} AS buildable_pct FROM net""",
    "bent_setback_hits": f"SELECT p_partkey AS project_id, CAST(p_partkey * 10 + i AS VARCHAR) AS entity_id, CASE i WHEN 1 THEN {r2(_FAN)} WHEN 2 THEN 100 ELSE 400 END::DOUBLE AS measure FROM part, (VALUES (1), (2), (3)) t(i)",
}
