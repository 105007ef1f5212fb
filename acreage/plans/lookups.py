"""Registered lookups, merges and small geometry operators, each with a twin in plain SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.functions import scalars as S
from acreage.functions.rings import floor_round
from acreage.operators import candidates as N
from acreage.operators import crm as C
from acreage.operators import detection as D
from acreage.operators import evaluate as E
from acreage.operators import inventory as I
from acreage.operators import labels as L
from acreage.operators import rules as Q
from acreage.operators import spatial as P
from acreage.operators import versions as V
from acreage.plans import layouts as lay
from acreage.plans import views as v
from acreage.plans.sql import r2, with_views
from acreage.sources.tables import read_table


def _find(s, d):
    return I.find_plot(v.plots(s, d), 7, "B-162").select("plot_id", "plot_number", "status")


def _facings(s, d):
    return I.distinct_facings(v.plots(s, d))


def _summaries(s, d):
    """Variants with models that lack one part or another."""
    o, k = read_table(s, d, "orders"), F.col("o_orderkey")
    parts = {
        0: '{{"optionBadge": "TOP", "statistics": {{"totalPlots": {0}, "compositeScore": 61.5}}}}', 1: '{{"statistics": {{"optionBadge": "MID", "compositeScore": 44.25}}, "evaluation": {{"compositeScore": 70.0}}}}',
        2: '{{"evaluation": {{"optionBadge": "LOW"}}}}', 3: "not json",
    }
    model = F.lit(parts[3])
    for i in (0, 1, 2):
        before, _, after = parts[i].replace("{{", "{").replace("}}", "}").partition("{0}")
        text = F.concat(F.lit(before), (k % 90).cast("string"), F.lit(after)) if after else F.lit(before)
        model = F.when(k % 4 == i, text).otherwise(model)
    rows = o.select(
        F.col("o_custkey").alias("project_id"), k.alias("variant_id"), k.alias("variant_number"), F.col("o_orderpriority").alias("strategy"),
        (k % 50).cast("int").alias("total_plots"), model.alias("model_json"), (k % 3 == 0).alias("is_selected"),
    )
    return I.variant_summaries(rows).select("variant_id", F.col("total_plots").cast("long").alias("total_plots"), "composite_score", "option_badge")


def _georef(s, d):
    """Projects with coordinates, a third of them patched, some with one field only."""
    p, k = v.projects(s, d), F.col("project_id")
    models = p.select("project_id", (k * 0.5).cast("double").alias("lat"), (k * 0.25).cast("double").alias("lng"))
    patches = p.filter(k % 3 == 0).select("project_id", F.when(k % 2 == 0, 18.5).alias("lat"), F.lit(73.75).alias("lng"))
    return V.merge_georef(models, patches, ["lat", "lng"])


def _approve(s, d):
    """Layouts of all projects, every second review passed, whose parts go into the inventory."""
    p, k = v.projects(s, d), F.col("project_id")
    layouts = p.select("project_id", (k * 10).alias("layout_id"), F.lit("DRAFT").alias("layout_status"))
    review = layouts.select("project_id", "layout_id", (k % 2 == 0).alias("can_approve"))
    existing = v.plots(s, d).filter(F.col("order_id") % 2 == 0).dropDuplicates(["project_id", "plot_number"]).select("project_id", "plot_number", "status", F.lit(1.0).alias("area_sqft"))
    incoming = v.plots(s, d).dropDuplicates(["project_id", "plot_number"]).select("project_id", "plot_number", F.lit(2.0).alias("area_sqft"))
    states, plots = Q.approve_layouts(layouts, review, incoming, existing)
    merged = plots.groupBy("project_id").agg(F.count(F.lit(1)).alias("plots"), F.sum("area_sqft").alias("area"))
    return states.join(merged, "project_id", "left").select("project_id", "layout_status", F.coalesce("plots", F.lit(0)).alias("plots"), F.coalesce("area", F.lit(0.0)).alias("area"))


def _assemble(s, d):
    plots = v.rects(s, d).select(
        "project_id", "plot_id", "ring", (F.col("w") * F.col("h")).alias("area"), F.when(F.col("plot_id") % 3 == 0, F.lit("P")).alias("plot_number"), F.lit(None).cast("string").alias("area_label")
    )
    roads = v.sheet_roads(s, d).withColumn("road_name", F.when(F.col("ord") == 1, F.lit("High Street")))
    return D.assemble_layout(plots, roads).select("project_id", "entity_type", "entity_id", "area", "name", "label")


def _missing(s, d):
    gt, pred = lay._approved(s, d), lay._detected(s, d).filter(F.col("ord") % 5 != 0).unionByName(lay._approved(s, d).filter(F.col("ord") % 100 == 7).withColumn("ord", F.col("ord") + 1000000))
    found = gt.join(pred.select("project_id", F.col("ord")), ["project_id", "ord"]).select("project_id", F.col("ord").alias("g_ord"), F.col("ord").alias("p_ord"))
    pred = pred.join(found.select("project_id", F.col("p_ord").alias("ord")), ["project_id", "ord"], "left_semi").unionByName(pred.filter("ord > 1000000"))
    return E.missing_extra(gt, found, pred)


def _road_names(s, d):
    li = read_table(s, d, "lineitem")
    said = li.filter("l_linenumber = 4").groupBy(F.floor(F.col("l_partkey") / v.BLOCK).alias("project_id"), (F.col("l_partkey") % 4).alias("n")).agg(F.max("l_orderkey").alias("ord"))
    labels = said.select("project_id", F.concat(F.lit("road-"), F.col("n").cast("string")).alias("assigned_to"), F.lit("ROAD_NETWORK").alias("assignment_type"), F.concat(F.lit("Lane "), F.col("ord").cast("string")).alias("text"), "ord")
    earlier = labels.withColumn("ord", F.col("ord") - 1).withColumn("text", F.lit("old"))
    return L.name_roads(v.sheet_roads(s, d), labels.unionByName(earlier)).select("project_id", "road_id", "road_name")


def _back(s, d):
    """Rings brought to local feet and back to the globe."""
    lat, lng = (lambda y: F.col(y) * 1e-5 + 18.5), (lambda x: F.col(x) * 1e-5 + 73.8)
    ring = F.array(R.point(lng("x0"), lat("y0")), R.point(lng("x1"), lat("y0")), R.point(lng("x1"), lat("y1")), R.point(lng("x0"), lat("y1")))
    g = v.rects(s, d).withColumn("g", S.geo_to_cad(ring)).withColumn("back", S.cad_to_geo("g.ring", "g"))
    at = lambda i, c: floor_round(F.get("back", F.lit(i))[c], 5)
    return g.select("plot_id", at(0, "x").alias("west"), at(0, "y").alias("south"), at(2, "x").alias("east"), at(2, "y").alias("north"))


def _snap(s, d):
    """Labels snapped to the corners of the rectangles."""
    corner = F.explode(F.array(R.point("x0", "y0"), R.point("x1", "y0"), R.point("x1", "y1"), R.point("x0", "y1"))).alias("c")
    vertices = v.rects(s, d).select("project_id", "ord", F.posexplode(F.array(R.point("x0", "y0"), R.point("x1", "y0"), R.point("x1", "y1"), R.point("x0", "y1"))).alias("i", "c"))
    vertices = vertices.select("project_id", (F.col("ord") * 4 + F.col("i")).alias("ord"), "c.x", "c.y")
    return P.snap_points(v.points(s, d), vertices).select("label_id", "snapped", "sx", "sy")


def _stable(s, d):
    r = v.rects(s, d)
    return r.select("plot_id", S.stable_plot_id((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("w") * F.col("h")).alias("stable_id"))


def _boxes(s, d):
    return v.rects(s, d).select("plot_id", R.rich_bbox("ring").alias("b")).select("plot_id", "b.minX", "b.minY", "b.maxX", "b.maxY", "b.width", "b.height", "b.area", "b.centerX", "b.centerY")


def _gaps(s, d):
    """Distance of two boxes turned by the same angle, and whether they stay apart."""
    b, k = v.bent(s, d), F.col("plot_id")
    near, far = v.turned_box(0, 0, 20, 20), v.turned_box((k % 7 * 5).cast("double"), (k % 5 * 10).cast("double"), (k % 7 * 5 + 9).cast("double"), (k % 5 * 10 + 6).cast("double"))
    return b.select("plot_id", floor_round(R.ring_distance(near, far), 4).alias("distance"), floor_round(R.overlap_area(near, far), 4).alias("common"))


def _corridors(s, d):
    k = F.col("p_partkey")
    p = read_table(s, d, "part").select(k.alias("road_id"), (k % 90).cast("double").alias("x"), (k % 70 + 3).cast("double").alias("y"), (k % 9 + 6).cast("double").alias("wide"))
    ring = N.corridor(F.lit(0.0), F.lit(0.0), "x", "y", "wide")
    c = R.area_centroid(ring)
    return p.select("road_id", floor_round(R.ring_area(ring), 4).alias("area"), floor_round(c["x"], 4).alias("cx"), floor_round(c["y"], 4).alias("cy"))


def _entries(s, d):
    """Two entries on every third parcel, none on the others."""
    k = F.col("parcel_id")
    entry = lambda edge, off, wide: F.struct(F.lit(edge).alias("edge"), F.lit(off).cast("double").alias("offset_pct"), F.lit(wide).cast("double").alias("width_ft"))
    two = F.array(entry("west", 25, 20), entry("NORTH", None, None))
    box = F.struct(F.lit(0.0).alias("minX"), F.lit(0.0).alias("minY"), F.col("width_ft").alias("maxX"), F.col("depth_ft").alias("maxY"))
    p = v.parcels(s, d).select("parcel_id", box.alias("bbox"), F.when(k % 3 == 0, two).alias("entries"))
    return N.entry_points(p).select("parcel_id", "edge", "x", "y", "width_ft")


def _adjacent(s, d):
    roads = v.sheet_roads(s, d)
    edges = P.relationship_graph(roads.withColumn("plot_id", F.col("road_id")))
    return P.road_adjacency(edges, roads).select("project_id", "road_id", F.array_join("neighbours", ",").alias("neighbours"))


def _plot_search(s, d):
    return C.search_plots(v.owned_plots(s, d), v.customers(s, d), v.brokers(s, d), " NATION_1 ").select("plot_id", "broker_name")


QUERIES = {
    "find_plot": _find, "distinct_facings": _facings, "variant_summaries": _summaries, "merge_georef": _georef, "approve_layouts": _approve, "assemble_layout": _assemble, "missing_extra": _missing,
    "name_roads": _road_names, "cad_to_geo": _back, "snap_points": _snap, "stable_plot_ids": _stable, "rich_boxes": _boxes, "turned_gaps": _gaps, "road_corridors": _corridors, "entry_points": _entries,
    "road_adjacency": _adjacent, "plot_search": _plot_search,
}


def _r(x: str, digits: int) -> str:
    k = f"{10 ** digits}.0::DOUBLE"
    return f"floor(({x}) * {k} + 0.5::DOUBLE) / {k}"


_D = "(CASE WHEN {0} > {1} THEN {0} - {1} WHEN {2} < 0 THEN -{2} ELSE 0 END)"
ORACLE = {
    "find_plot": with_views("SELECT plot_id, plot_number, status FROM v_plots WHERE project_id = 7 AND plot_number = 'B-162'", "v_plots"),
    "distinct_facings": "SELECT DISTINCT ['NORTH','EAST','SOUTH','WEST'][CAST(l_linenumber % 4 + 1 AS INT)] AS facing FROM lineitem",
    "variant_summaries": """SELECT o_orderkey AS variant_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 90 ELSE o_orderkey % 50 END AS total_plots, [61.5, 70.0, 0.0, 0.0][CAST(o_orderkey % 4 + 1 AS INT)]::DOUBLE AS composite_score,
  CASE o_orderkey % 4 WHEN 0 THEN 'TOP' WHEN 1 THEN 'MID' WHEN 2 THEN 'LOW' ELSE 'OPTION ' || o_orderkey END AS option_badge FROM orders""",
    "merge_georef": "SELECT s_suppkey AS project_id, CASE WHEN s_suppkey % 6 = 0 THEN 18.5 ELSE s_suppkey * 0.5 END::DOUBLE AS lat, CASE WHEN s_suppkey % 3 = 0 THEN 73.75 ELSE s_suppkey * 0.25 END::DOUBLE AS lng FROM supplier",
    "approve_layouts": with_views(
        """SELECT s_suppkey AS project_id, CASE WHEN s_suppkey % 2 = 0 THEN 'APPROVED' ELSE 'DRAFT' END AS layout_status, CASE WHEN s_suppkey % 2 = 0 THEN coalesce(n, 0) ELSE coalesce(old, 0) END AS plots,
  CASE WHEN s_suppkey % 2 = 0 THEN coalesce(n, 0) * 2 ELSE coalesce(old, 0) END::DOUBLE AS area FROM supplier
  LEFT JOIN (SELECT project_id, count(DISTINCT plot_number) AS n, count(DISTINCT plot_number) FILTER (order_id % 2 = 0) AS old FROM v_plots GROUP BY 1) ON project_id = s_suppkey""", "v_plots"),
    "assemble_layout": with_views(
        f"""SELECT project_id, 'PLOT' AS entity_type, CAST(plot_id AS VARCHAR) AS entity_id, w * h AS area, CASE WHEN plot_id % 3 = 0 THEN 'P' ELSE left(CAST(plot_id AS VARCHAR), 8) END AS name, {_r('w * h', 1)} || ' sq ft' AS label FROM v_rects
  UNION ALL SELECT project_id, 'ROAD', road_id, (x1 - x0) * (y1 - y0), CASE WHEN ord = 1 THEN 'High Street' ELSE 'ROAD-' || right(road_id, 3) END, NULL FROM v_roads""", "v_rects", "v_roads"),
    "missing_extra": with_views(
        "SELECT project_id, ord, 'MISSING' AS kind FROM v_rects WHERE ord % 11 = 0 OR ord % 5 = 0 UNION ALL SELECT project_id, ord + 1000000, 'EXTRA' FROM v_rects WHERE ord % 100 = 7", "v_rects"),
    "name_roads": with_views(
        """SELECT r.project_id, road_id, coalesce('Lane ' || o, 'ROAD-' || right(road_id, 3)) AS road_name FROM v_roads r
  LEFT JOIN (SELECT l_partkey // 400 AS p, l_partkey % 4 AS n, max(l_orderkey) AS o FROM lineitem WHERE l_linenumber = 4 GROUP BY 1, 2) ON p = project_id AND n = ord""", "v_roads"),
    "cad_to_geo": with_views(
        f"SELECT plot_id, {_r('x0 * 1e-5 + 73.8::DOUBLE', 5)} AS west, {_r('y0 * 1e-5 + 18.5::DOUBLE', 5)} AS south, {_r('x1 * 1e-5 + 73.8::DOUBLE', 5)} AS east, {_r('y1 * 1e-5 + 18.5::DOUBLE', 5)} AS north FROM v_rects", "v_rects"),
    "snap_points": with_views(
        """SELECT label_id, d IS NOT NULL AS snapped, coalesce(v.x, floor(p.x / 8 + 0.5::DOUBLE) * 8) AS sx, coalesce(v.y, floor(p.y / 8 + 0.5::DOUBLE) * 8) AS sy FROM v_points p LEFT JOIN (
  SELECT label_id, arg_min({'x': c.x, 'y': c.y}, (sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)), c.o)) AS v, min(sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y))) AS d
  FROM v_points p JOIN (SELECT project_id, unnest([{'x': x0, 'y': y0, 'o': ord * 4}, {'x': x1, 'y': y0, 'o': ord * 4 + 1}, {'x': x1, 'y': y1, 'o': ord * 4 + 2}, {'x': x0, 'y': y1, 'o': ord * 4 + 3}]) AS c FROM v_rects) c
  ON c.project_id = p.project_id AND abs(p.x - c.c.x) < 12 AND abs(p.y - c.c.y) < 12 WHERE sqrt((p.x - c.c.x) * (p.x - c.c.x) + (p.y - c.c.y) * (p.y - c.c.y)) < 12 GROUP BY 1) USING (label_id)""".replace("c.x", "c.c.x").replace("c.y", "c.c.y").replace("c.o)", "c.c.o)").replace("c.c.c.", "c.c."),
        "v_points", "v_rects"),
    "stable_plot_ids": with_views(f"SELECT plot_id, sha256(({_r('(x0 + x1) / 2', 1)})::VARCHAR || '-' || ({_r('(y0 + y1) / 2', 1)})::VARCHAR || '-' || (floor(w * h + 0.5))::DOUBLE::VARCHAR) AS stable_id FROM v_rects", "v_rects"),
    "rich_boxes": with_views(
        f"SELECT plot_id, x0 AS \"minX\", y0 AS \"minY\", x1 AS \"maxX\", y1 AS \"maxY\", w AS width, h AS height, {r2('w * h')} AS area, {r2('x0 + w / 2')} AS \"centerX\", {r2('y0 + h / 2')} AS \"centerY\" FROM v_rects", "v_rects"),
    "turned_gaps": f"""SELECT plot_id, {_r('sqrt(dx * dx + dy * dy)', 4)} AS distance, {_r('greatest(least(20, x + 9) - x, 0) * greatest(least(20, y + 6) - y, 0)', 4)} AS common FROM (
  SELECT *, greatest(x - 20, 0) AS dx, greatest(y - 20, 0) AS dy FROM (SELECT p_partkey AS plot_id, (p_partkey % 7 * 5)::DOUBLE AS x, (p_partkey % 5 * 10)::DOUBLE AS y FROM part))""",
    "road_corridors": f"SELECT p_partkey AS road_id, {_r('sqrt(x * x + y * y) * wide', 4)} AS area, {_r('x / 2', 4)} AS cx, {_r('y / 2', 4)} AS cy FROM (SELECT p_partkey, (p_partkey % 90)::DOUBLE AS x, (p_partkey % 70 + 3)::DOUBLE AS y, p_partkey % 9 + 6 AS wide FROM part)",
    "entry_points": with_views(
        """SELECT parcel_id, edge, CASE edge WHEN 'WEST' THEN 0 ELSE width_ft / 2 END::DOUBLE AS x, CASE edge WHEN 'WEST' THEN depth_ft / 4 WHEN 'NORTH' THEN depth_ft ELSE 0 END::DOUBLE AS y, CASE edge WHEN 'WEST' THEN 20 ELSE 30 END::DOUBLE AS width_ft
  FROM (SELECT *, unnest(CASE WHEN parcel_id % 3 = 0 THEN ['WEST', 'NORTH'] ELSE ['SOUTH'] END) AS edge FROM v_parcels)""", "v_parcels"),
    "road_adjacency": with_views("SELECT project_id, road_id, CASE ord WHEN 2 THEN 'road-0,road-1' ELSE 'road-2' END AS neighbours FROM v_roads", "v_roads"),
    "plot_search": with_views(
        """SELECT plot_id, coalesce(n_name, '') AS broker_name FROM v_owned LEFT JOIN nation ON n_nationkey = broker_id JOIN customer ON c_custkey = customer_id
  WHERE contains(lower(coalesce(n_name, '')), 'nation_1') OR contains(lower(plot_number), 'nation_1') OR contains(lower(c_name), 'nation_1')""", "v_owned"),
}
