"""Registered queries on the remaining operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.functions import text as T
from acreage.functions.rings import floor_round
from acreage.operators import crm as C
from acreage.operators import detection as D
from acreage.operators import evaluate as E
from acreage.operators import imaging as M
from acreage.operators import inventory as I
from acreage.operators import overlay as Y
from acreage.operators import rules as Q
from acreage.operators import spatial as P
from acreage.plans import layouts as lay
from acreage.plans import views as v
from acreage.plans.layouts_sql import _PAIRS, _REL, rn
from acreage.plans.sql import money, r2, with_views
from acreage.sources import exports
from acreage.sources.files import check_uploads
from acreage.sources.tables import read_table


def _directory(s, d):
    c = v.customers(s, d)
    held = F.transform(F.sequence(F.lit(0), F.col("customer_id") % 3), lambda i: i.cast("string"))
    return C.customer_directory(c.withColumn("assigned_plots", held))


def _documents(s, d):
    doc = read_table(s, d, "documents")
    status = F.when(F.col("n_chars") % 3 == 0, "Verified").when(F.col("n_chars") % 3 == 1, "signed").otherwise("Draft")
    return C.document_counts(doc.select((F.col("doc_id") % 50).alias("project_id"), status.alias("status")))


def _sequence(s, d):
    p = v.plots(s, d).select("project_id", "plot_id", "created_at", "base_price")
    order = [F.asc("created_at"), F.asc("plot_id"), F.asc("base_price")]
    return C.with_seq(p, ["project_id"], order, F.date_trunc("month", "created_at"), "P-", 2).select("plot_id", "seq_id")


def _review(s, d):
    b = v.sheet_boundaries(s, d)
    plots = v.rects(s, d).withColumn("plot_number", F.concat(F.lit("P-"), (F.col("plot_id") % 390).cast("string")))
    layouts = b.select("project_id", F.col("project_id").alias("layout_id"))
    return Q.review_drafts(layouts, b, plots).drop("layout_id")


def _copied(s, d):
    """Plot rectangles of which every tenth occurs twice in its sheet."""
    r = v.rects(s, d).select("project_id", "plot_id", "ring")
    return r.unionByName(r.filter(F.col("plot_id") % 10 == 0).withColumn("plot_id", F.col("plot_id") + 10**9))


def _neighbours_of_copies(s, d):
    r = _copied(s, d)
    return P.neighbours(P.expand_edges(P.relationship_graph(r), r)).select("plot_id", F.array_join("neighbours", ",").alias("neighbours"))


def _neighbours(s, d):
    return P.neighbours(P.relationship_graph(v.rects(s, d))).select("plot_id", F.array_join("neighbours", ",").alias("neighbours"))


def _boundary(s, d):
    return D.pick_boundary(v.rects(s, d).withColumn("source", F.col("p_type"))).select("project_id", "source", "area")


def _hull(s, d):
    pts = v.points(s, d).select("project_id", "x", "y")
    return Y.convex_hull(pts, ["project_id"]).select("project_id", F.size("ring").cast("long").alias("corners"), R.ring_area("ring").alias("area"))


def _confirm(s, d):
    return D.confirm_boundaries(v.rects(s, d)).select("plot_id", "area_sqft", "area_sqm", "perimeter_ft", "length_ft", "breadth_ft", "shape_type", "is_confirmable")


def _setback(s, d):
    return D.setback(v.rects(s, d), 5.0, ("plot_id",)).select("plot_id", floor_round("setback_area").alias("setback_area"))


def _layers(s, d):
    return D.layers_of(v.rects(s, d).withColumn("layer", F.col("p_type"))).select("project_id", F.array_join("layers", ",").alias("layers"))


def _shifted(s, d):
    prim = v.rects(s, d).select("project_id", "plot_id", "ring", (F.col("w") * F.col("h")).alias("area"))
    big = prim.withColumn("ring", F.when(F.col("project_id") % 2 == 0, R.affine("ring", F.array(*[F.lit(x) for x in (100.0, 0.0, 0.0, 100.0, 7.0, 9.0)]))).otherwise(F.col("ring")))
    out = D.normalize_drawing(big)
    return out.select("plot_id", floor_round(F.col("ring")[0]["x"], 3).alias("x"), floor_round(F.col("ring")[0]["y"], 3).alias("y"), floor_round("area", 6).alias("area"), "scale")


def _counts(s, d):
    r = v.rects(s, d)
    pts = F.when(F.col("plot_id") % 3 == 0, F.slice("ring", 1, 2)).when(F.col("plot_id") % 3 == 1, F.col("ring")).otherwise(F.slice("ring", 1, 3))
    prim = r.select("project_id", "plot_id", pts.alias("points"), (F.col("plot_id") % 3 == 1).alias("is_closed"))
    return D.primitive_counts(D.normalize_primitives(prim))


def _blend(s, d):
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "p"))
    probs = e.select(
        "image_id", (F.floor(F.col("i") / 8) * 4).alias("tile_x"), F.lit(0).alias("tile_y"), (F.col("i") % 8).alias("dx"), F.lit(3).alias("dy"), F.lit(0).alias("class_id"), F.col("p").cast("double").alias("prob")
    )
    return M.blend_tiles(probs, 8).select("image_id", "x", floor_round("prob", 6).alias("prob"))


def _images(s, d):
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "p"))
    level = lambda k: F.floor(F.abs(F.col("p").cast("double")) * k) % 256
    px = e.select("image_id", level(1000).alias("gray"), level(700).alias("sat"), (F.col("i") % 180).alias("hue"), level(1000).alias("val"))
    return M.classify_images(px).select("image_id", floor_round("white_ratio", 6).alias("white_ratio"), floor_round("dark_ratio", 6).alias("dark_ratio"), floor_round("green_ratio", 6).alias("green_ratio"), "input_type")


def _blocks(s, d):
    b = v.rects(s, d).select("project_id", F.col("plot_id").alias("block_no"), (F.col("w") * F.col("h")).alias("area"))
    return D.rank_blocks(b, 1500.0).select("project_id", "block_no", F.col("rank").cast("long").alias("rank"))


def _road_facts(s, d):
    return D.road_facts(v.rects(s, d)).select("plot_id", "road_width", "road_length", F.col("centerline")[0]["x"].alias("cx0"), F.col("centerline")[1]["y"].alias("cy1"))


def _locations(s, d):
    cities = [(f"nation_{i}", i, i * 2) for i in range(25)]
    p = v.projects(s, d).select("project_id", "name", "location").withColumn("latitude", F.when(F.col("project_id") % 5 == 0, 18.5)).withColumn("longitude", F.when(F.col("project_id") % 5 == 0, 73.8))
    return I.resolve_location(p, cities).select("project_id", "lat", "lng", "source")


def _uploads(s, d):
    doc = read_table(s, d, "documents")
    suffix = F.element_at(F.array(*map(F.lit, ["PDF", "png", "docx"])), (F.col("doc_id") % 3 + 1).cast("int"))
    f = doc.select("doc_id", F.concat(F.lit("site plan "), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("file_name"), (F.col("n_chars") * 20000).alias("size_bytes"))
    return check_uploads(f).select("doc_id", "safe_name", F.col("error").isNull().alias("accepted"))


def _schedule(s, d):
    p = v.plots(s, d).select("plot_id", "project_id", "plot_number", "status", "area_sqft", F.lit(30.25).alias("width_ft"), F.lit(40.0).alias("depth_ft"), "facing", F.lit(None).cast("string").alias("road_name"), "is_corner", F.col("base_price").alias("price"))
    out = exports.plot_schedule(p)
    return out.groupBy("project_id", F.col("Status").alias("status"), F.col("Corner Plot").alias("corner"), F.col("Area (Sq Ft)").alias("area"), F.col("Road Access").alias("road")).agg(F.count(F.lit(1)).alias("n"))


def _label_match(s, d):
    return E.match_labels(*lay._text_pairs(s, d)).select("project_id", "g_ord", "p_ord", "distance", "exact", "normalized")


def _detect(s, d):
    r = v.rects(s, d)
    prim = D.classify_primitives(lay._prims(s, d)).select("project_id", "plot_id", "ord", "ring", "candidate_type")
    none = r.filter(F.lit(False)).select("project_id", "plot_id")
    cands = D.plot_candidates(prim, none, none)
    out = D.detect_plots(cands, P.relationship_graph(r), r)
    return out.select("plot_id", "area", "perimeter", "orientation", "aspect_ratio", F.size("neighbours").cast("long").alias("n_neighbours"))


QUERIES = {
    "customer_directory": _directory, "document_counts": _documents, "sequence_labels": _sequence, "review_drafts": _review, "neighbours": _neighbours, "neighbours_of_copies": _neighbours_of_copies,
    "pick_boundary": _boundary, "convex_hull": _hull, "confirm_boundaries": _confirm, "setback_area": _setback, "drawing_layers": _layers,
    "normalize_drawing": _shifted, "primitive_counts": _counts, "blend_tiles": _blend, "classify_images": _images, "rank_blocks": _blocks, "road_facts": _road_facts,
    "resolve_location": _locations, "check_uploads": _uploads, "plot_schedule": _schedule, "label_match": _label_match, "detect_plots": _detect,
}

_PX = "px AS (SELECT vec_id AS image_id, floor(abs(p) * 1000)::BIGINT % 256 AS gray, floor(abs(p) * 700)::BIGINT % 256 AS sat, i % 180 AS hue FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"
_NEAR = _REL + ", near AS (SELECT a_id AS p, b_id AS o FROM rel WHERE relation IN ('TOUCHES', 'OVERLAPS', 'NEIGHBOR') UNION SELECT b_id, a_id FROM rel WHERE relation IN ('TOUCHES', 'OVERLAPS', 'NEIGHBOR'))"

ORACLE = {
    "customer_directory": with_views(f"SELECT count(*) AS customers, {money('total_invested')} AS invested, CAST(sum(customer_id % 3 + 1) AS BIGINT) AS assigned FROM v_customers", "v_customers"),
    "document_counts": "SELECT doc_id % 50 AS project_id, count(*) AS documents, count(*) FILTER (n_chars % 3 < 2) AS settled FROM documents GROUP BY 1",
    "sequence_labels": with_views(
        """SELECT plot_id, 'P-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n AS seq_id FROM (SELECT plot_id, row_number() OVER (PARTITION BY project_id ORDER BY created_at, plot_id, base_price) AS n FROM v_plots)""", "v_plots"),
    "review_drafts": with_views(
        """SELECT t.project_id, n AS total_plots, n AS valid_plots, coalesce(o.n_o, 0) AS overlapping_pairs, coalesce(dn, 0) AS duplicate_numbers, coalesce(w, 0) AS warnings,
  coalesce(o.n_o, 0) + CASE WHEN coalesce(dn, 0) > 0 THEN 1 ELSE 0 END AS errors, coalesce(o.n_o, 0) = 0 AND coalesce(dn, 0) = 0 AS can_approve
  FROM (SELECT project_id, count(*) AS n, count(*) FILTER (greatest(least(x1, 2400) - x0, 0) * greatest(least(y1, 460) - y0, 0) / (w * h) < 0.85::DOUBLE) AS w FROM v_rects GROUP BY 1) t
  LEFT JOIN (SELECT project_id, count(*) AS n_o FROM pairs WHERE o > 1 GROUP BY 1) o ON o.project_id = t.project_id
  LEFT JOIN (SELECT project_id, count(*) AS dn FROM (SELECT project_id, plot_id % 390 FROM v_rects GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1) x ON x.project_id = t.project_id""", "v_rects", extra=_PAIRS),
    "neighbours": with_views("SELECT p AS plot_id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS neighbours FROM near GROUP BY 1", "v_rects", extra=_NEAR),
    "neighbours_of_copies": with_views(
        """SELECT plot_id, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS neighbours FROM (
  SELECT p + f.k AS plot_id, n.o + g.k AS o FROM near n, (VALUES (0), (1000000000)) f(k), (VALUES (0), (1000000000)) g(k) WHERE (f.k = 0 OR p % 10 = 0) AND (g.k = 0 OR n.o % 10 = 0)) GROUP BY 1""",
        "v_rects", extra=_NEAR),
    "pick_boundary": with_views("SELECT project_id, arg_max(p_type, (w * h, -ord)) AS source, max(w * h) AS area FROM v_rects GROUP BY 1 HAVING max(w * h) > 2000", "v_rects"),
    "confirm_boundaries": with_views(
        f"""SELECT plot_id, w * h AS area_sqft, {r2('w * h / 10.7639104::DOUBLE')} AS area_sqm, 2 * (w + h) AS perimeter_ft, greatest(20, w) AS length_ft, greatest(20, h) AS breadth_ft, 'RECTANGULAR' AS shape_type, true AS is_confirmable FROM v_rects""", "v_rects"),
    "setback_area": with_views("SELECT plot_id, w * h - (w - 10) * (h - 10) AS setback_area FROM v_rects", "v_rects"),
    "drawing_layers": with_views("SELECT project_id, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS layers FROM v_rects GROUP BY 1", "v_rects"),
    "normalize_drawing": with_views(
        f"""SELECT plot_id, {rn('(k * x0 - k * min(x0) OVER p) * sc + 50', 3)} AS x, {rn('(k * y0 - k * min(y0) OVER p) * sc + 50', 3)} AS y, {rn('w * h * sc * sc', 6)} AS area, sc AS scale FROM (
  SELECT *, CASE WHEN project_id % 2 = 0 THEN 100 ELSE 1 END AS k, CASE WHEN project_id % 2 = 0 THEN 0.001::DOUBLE ELSE 1 END AS sc FROM v_rects) WINDOW p AS (PARTITION BY project_id)""", "v_rects"),
    "primitive_counts": with_views(
        """SELECT project_id, count(*) FILTER (plot_id % 3 = 0) AS "LINE", count(*) FILTER (plot_id % 3 = 2) AS "POLYLINE", 0::BIGINT AS "POLYGON", count(*) FILTER (plot_id % 3 = 1) AS "RECTANGLE" FROM v_rects GROUP BY 1""", "v_rects"),
    "blend_tiles": f"""WITH e AS (SELECT vec_id AS image_id, unnest(embedding)::DOUBLE AS p, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
  w AS (SELECT image_id, (i // 8) * 4 + i % 8 AS x, p, greatest(0.05::DOUBLE, least(1, (0.5::DOUBLE - 0.5::DOUBLE * cos(3 * (6.283185307179586::DOUBLE / 7))) * (0.5::DOUBLE - 0.5::DOUBLE * cos((i % 8) * (6.283185307179586::DOUBLE / 7))))) AS wt FROM e)
  SELECT image_id, x, {rn('sum(p * wt) / sum(wt)', 6)} AS prob FROM w GROUP BY 1, 2""",
    "classify_images": with_views(
        f"""SELECT image_id, {rn('wr', 6)} AS white_ratio, {rn('dr', 6)} AS dark_ratio, {rn('gr', 6)} AS green_ratio, CASE WHEN wr > 0.65::DOUBLE AND ms < 35 THEN 'WHITE_PAGE_DRAWING' WHEN dr > 0.45::DOUBLE THEN 'CAD_TECHNICAL'
  WHEN (ms > 25 AND ss > 18) OR gr > 0.12::DOUBLE THEN 'SATELLITE_AERIAL' WHEN wr > 0.4::DOUBLE THEN 'WHITE_PAGE_DRAWING' ELSE 'CAD_TECHNICAL' END AS input_type FROM (
  SELECT image_id, count(*) FILTER (gray > 210) / count(*)::DOUBLE AS wr, count(*) FILTER (gray < 60) / count(*)::DOUBLE AS dr, count(*) FILTER (hue BETWEEN 32 AND 88 AND sat >= 35 AND gray >= 35) / count(*)::DOUBLE AS gr,
  avg(sat) AS ms, stddev_pop(sat) AS ss FROM px GROUP BY 1)""", extra=_PX),
    "rank_blocks": with_views("SELECT project_id, plot_id AS block_no, row_number() OVER (PARTITION BY project_id ORDER BY w * h DESC, plot_id) AS rank FROM v_rects WHERE w * h >= 1500", "v_rects"),
    "road_facts": with_views(
        f"""SELECT plot_id, greatest(20, least(w, h, 60)) AS road_width, greatest(w, h) AS road_length, CASE WHEN w >= h THEN x0 ELSE {r2('(x0 + x1) / 2')} END AS cx0, CASE WHEN w >= h THEN {r2('(y0 + y1) / 2')} ELSE y1 END AS cy1 FROM v_rects""", "v_rects"),
    "resolve_location": with_views(
        """SELECT project_id, CASE WHEN project_id % 5 = 0 THEN 18.5::DOUBLE ELSE k::DOUBLE END AS lat, CASE WHEN project_id % 5 = 0 THEN 73.8::DOUBLE ELSE k * 2.0::DOUBLE END AS lng,
  CASE WHEN project_id % 5 = 0 THEN 'project_coords' ELSE 'matched_nation_' || k END AS source FROM (SELECT project_id, min(n_nationkey) AS k FROM v_projects JOIN nation ON contains(lower(name || ' ' || location), lower(n_name)) GROUP BY 1)""", "v_projects"),
    "check_uploads": "SELECT doc_id, 'site_plan_' || doc_id || ['.PDF', '.png', '.docx'][CAST(doc_id % 3 + 1 AS INT)] AS safe_name, doc_id % 3 < 2 AND n_chars * 20000 <= 52428800 AS accepted FROM documents",
    "plot_schedule": with_views(
        """SELECT project_id, status, CASE WHEN is_corner THEN 'YES' ELSE 'NO' END AS corner, CAST(CAST(area_sqft AS DECIMAL(28,1)) AS VARCHAR) AS area, 'Main Road' AS road, count(*) AS n FROM v_plots GROUP BY ALL""", "v_plots"),
    "detect_plots": with_views(
        f"""SELECT plot_id, w * h AS area, 2 * (w + h) AS perimeter, CASE WHEN h >= w THEN 'NORTH' ELSE 'EAST' END AS orientation, {r2('w / h')} AS aspect_ratio, count(c2) AS n_neighbours FROM cand LEFT JOIN (SELECT p, o AS c2 FROM near WHERE o IN (SELECT plot_id FROM cand)) ON p = plot_id GROUP BY ALL""",
        "v_rects", extra=_NEAR + """, cls AS (SELECT *, CASE WHEN plot_id % 13 = 0 THEN 'OPEN_REGION' WHEN w * h * 4 / 800000 >= 0.3::DOUBLE THEN 'BOUNDARY_CANDIDATE' WHEN w * 4 / h > 5 AND w * 4 > 100 THEN 'ROAD_CANDIDATE'
  WHEN w * h * 4 / 800000 < 0.001::DOUBLE THEN 'TEXT_REGION' ELSE 'PLOT_CANDIDATE' END AS t FROM v_rects), cand AS (SELECT * FROM cls WHERE t = 'PLOT_CANDIDATE' AND w * h > 100)"""),
}
