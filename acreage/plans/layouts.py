"""Registered queries on labels, polygons, rules, norms, scores, candidates, evaluation, images."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.functions import scalars as S
from acreage.functions import text as T
from acreage.functions.rings import floor_round
from acreage.operators import candidates as N
from acreage.operators import crm as C
from acreage.operators import detection as D
from acreage.operators import evaluate as E
from acreage.operators import generate as W
from acreage.operators import imaging as M
from acreage.operators import labels as L
from acreage.operators import norms as O
from acreage.operators import overlay as Y
from acreage.operators import rules as Q
from acreage.operators import scoring as G
from acreage.operators import spatial as P
from acreage.plans import views as v
from acreage.plans.layouts_sql import ORACLE  # noqa: F401
from acreage.sources.tables import read_table

RULE_PARAMS = {"min_plot_sqft": 1400.0, "min_frontage_ft": 40.0, "min_road_width_ft": 24.0, "setback_ft": 10.0}


def label_texts(s, d):
    """Label texts in six styles, with the confusions a scanner makes, one per line item."""
    li = read_table(s, d, "lineitem")
    n = F.col("l_linenumber")
    k, q = F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string")
    text = (
        F.when(n == 1, F.concat(F.lit("PLOT NO. "), k)).when(n == 2, F.concat(q, F.lit("'0\" X 40'6\"")))
        .when(n == 3, F.concat(q, F.lit("O SQ. FT."))).when(n == 4, F.concat(q, F.lit(" FT WIDE ROAD")))
        .when(n == 5, F.concat(F.lit("~P-l"), k, F.lit("O|"))).when(n == 6, F.concat(F.lit("SURVEY NO "), k, F.lit("/1"))).otherwise(F.lit("Garden"))
    )
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("label_id"),
        text.alias("text"),
    )


def _labels(s, d):
    p = L.parse_labels(label_texts(s, d))
    return p.select(
        "label_id", "clean", "classification", F.col("dimension.width").alias("width"), F.col("dimension.length").alias("length"),
        F.col("area_value.areaValue").alias("area_value"), F.col("road.roadWidth").alias("road_width"), F.col("plot_no.plotNumber").alias("plot_number"),
    )


def _edit(s, d):
    p, n = read_table(s, d, "part"), read_table(s, d, "nation")
    return p.select("p_partkey", "p_name", "p_type").select(
        "p_partkey", F.levenshtein(T.normalize_text("p_name"), T.normalize_text("p_type")).cast("long").alias("distance"), T.normalize_text("p_name").alias("norm")
    )


def _words(s, d):
    """Words of every conversation turn against the words of the turn before it."""
    c = read_table(s, d, "conversations")
    gt = c.select(F.concat_ws("-", "conv_id", F.col("turn")).alias("k"), F.col("text").alias("words"))
    pred = c.select(F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("k"), F.col("text").alias("words"))
    return L.word_accuracy(gt, pred, "k").select("k", *[F.col(c).cast("long").alias(c) for c in ("n_gt", "n_pred", "n_common")], "precision", "recall", "f1")


def _measures(s, d):
    r = v.rects(s, d).withColumn("c", R.area_centroid("ring")).withColumn("vc", R.vertex_centroid("ring"))
    return r.select(
        "plot_id", R.ring_area("ring").alias("area"), R.ring_length("ring").alias("perimeter"), floor_round("c.x").alias("cx"), floor_round("c.y").alias("cy"),
        F.col("vc.x").alias("vx"), F.col("vc.y").alias("vy"), S.orientation("w", "h").alias("orientation"), S.aspect_ratio("w", "h").alias("aspect"),
    )


def _l_ring():
    """A rectangle with its upper right quarter cut away on every third plot, else the rectangle."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    mx, my = (x0 + x1) / 2.0, (y0 + y1) / 2.0
    cut = F.array(R.point(x0, y0), R.point(x1, y0), R.point(x1, my), R.point(mx, my), R.point(mx, y1), R.point(x0, y1))
    return F.when(F.col("plot_id") % 3 == 0, cut).otherwise(F.col("ring"))


def _shapes(s, d):
    r = v.rects(s, d).withColumn("ring", _l_ring())
    return D.shape_class(r).select("plot_id", "shape_type", "vertex_count", floor_round("concavity", 3).alias("concavity"), "aspect_ratio", R.ring_area("ring").alias("area"))


def _prims(s, d):
    return v.rects(s, d).select(
        "project_id", "plot_id", "ord", "ring", (F.col("plot_id") % 13 != 0).alias("is_closed"), (F.col("w") * F.col("h") * 4).alias("area"),
        (F.col("w") * 4).alias("box_w"), F.col("h").alias("box_h"), F.lit(1000.0).alias("canvas_w"), F.lit(800.0).alias("canvas_h"),
    )


def _classify(s, d):
    return D.classify_primitives(_prims(s, d)).select("plot_id", "candidate_type")


def _dedupe(s, d):
    """Rectangles without their offset: only sizes differ, so most are copies, every second one reversed."""
    r = v.rects(s, d)
    box = R.opened(R.box_ring(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")))
    pts = F.when(F.col("plot_id") % 2 == 0, box).otherwise(F.reverse(box))
    prim = r.select("project_id", "ord", "plot_id", pts.alias("points"))
    return D.dedupe_primitives(prim, ["project_id"]).select("project_id", "plot_id", "copies")


def _self_cross(s, d):
    """Every fifth ring has two vertices swapped, which makes it cross itself."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    bow = F.array(R.point(x0, y0), R.point(x1, y1), R.point(x1, y0), R.point(x0, y1))
    r = v.rects(s, d).withColumn("ring", F.when(F.col("plot_id") % 5 == 0, bow).otherwise(F.col("ring")))
    return r.select("plot_id", R.self_crossing("ring").alias("crosses"))


def _contains(s, d):
    return P.contains_join(v.points(s, d), v.rects(s, d)).select("label_id", "plot_id", F.col("n_rings").cast("long").alias("n_rings"))


def _bbox(s, d):
    return P.bbox_join(v.points(s, d), v.rects(s, d)).select("label_id", "plot_id")


def _nearest(s, d):
    return P.nearest_join(v.points(s, d), v.rects(s, d), 60.0).select("label_id", "plot_id", floor_round("distance").alias("distance"))


def _nearest_road(s, d):
    roads = D.road_facts(v.sheet_roads(s, d))
    pts = v.points(s, d)
    return P.nearest_road(pts, roads).select("label_id", "road_id", floor_round("distance").alias("distance"))


def _associate(s, d):
    pts = v.points(s, d).withColumn(
        "text", F.when(F.col("n") == 6, "SURVEY NO 45").when(F.col("n") == 4, "MAIN ROAD 40FT").otherwise(F.concat(F.lit("PLOT NO. "), F.col("n").cast("string")))
    ).withColumn("classification", F.lit(None).cast("string"))
    out = L.associate_labels(pts, v.rects(s, d), D.road_facts(v.sheet_roads(s, d)), max_dist=60.0)
    return out.select("label_id", "assigned_to", "assignment_type", "distance")


def _viewport(s, d):
    r = v.rects(s, d).withColumn("bbox", R.bbox("ring"))
    return P.viewport(P.grid_cells(r), 480.0, 90.0, 1300.0, 300.0, ["project_id", "plot_id"]).select("project_id", "plot_id")


def _overlap(s, d):
    return P.overlap_pairs(v.rects(s, d)).select("project_id", "a_id", "b_id", "overlap", "n_pairs")


def _iou_pairs(s, d):
    p = P.overlap_pairs(v.rects(s, d))
    return p.select("a_id", "b_id", floor_round(F.col("overlap") / (F.col("a_area") + F.col("b_area") - F.col("overlap")), 6).alias("iou"))


def _graph(s, d):
    return P.relationship_graph(v.rects(s, d)).select("project_id", "src", "dst", "relation", "distance", "overlap_area")


def _graph_counts(s, d):
    return P.relationship_counts(P.relationship_graph(v.rects(s, d)))


def _road_overlap(s, d):
    return Q.rule_overlap(v.rects(s, d), v.sheet_roads(s, d), "RULE_02").select("project_id", "entity_id", "measure")


def _union(s, d):
    return Y.union_area(v.sheet_roads(s, d), ["project_id"])


def _plot_union(s, d):
    return Y.union_area(v.rects(s, d), ["project_id"]).select("project_id", floor_round("union_area").alias("union_area"))


def _access(s, d):
    return P.no_road_access(v.rects(s, d), v.sheet_roads(s, d)).select("project_id", "plot_id")


def _violations(s, d):
    """With a green and a pond on every sheet, so that all rules are judged."""
    sheets = v.sheet_boundaries(s, d).select("project_id")
    patch = lambda *box: sheets.withColumn("ring", R.box_ring(*[F.lit(float(x)) for x in box]))
    green, pond = patch(300, 200, 420, 260), patch(1200, 150, 1260, 200)
    return Q.violations(v.sheet_boundaries(s, d), v.rects(s, d), v.sheet_roads(s, d), green, pond, **RULE_PARAMS)


def _validate(s, d):
    found = _violations(s, d)
    return Q.rule_results(v.sheet_boundaries(s, d), found).select("project_id", "rule_id", "violations", "passed")


def _report(s, d):
    return Q.compliance_report(v.sheet_boundaries(s, d), _violations(s, d))


def _parcels(s, d):
    """Parcels with registry ids by brand number; numbers past the registry are unknown places."""
    ids = F.array(*[F.lit(a[0]) for a in O.AUTHORITIES])
    n = F.regexp_extract("jurisdiction_id", r"(\d+)", 1).cast("int")
    return v.parcels(s, d).withColumn("jurisdiction_id", F.coalesce(F.get(ids, n - 1), F.col("jurisdiction_id")))


def _norms(s, d):
    out = O.applicable_norms(_parcels(s, d), O.authorities(s))
    return out.drop("notes", "jurisdiction_id", "land_use")


def _layout_inputs(s, d):
    """Every order is a candidate layout of its customer; its line items are the plots."""
    li, o = read_table(s, d, "lineitem"), read_table(s, d, "orders")
    plots = li.select(
        F.col("l_orderkey").alias("layout_id"), (F.col("l_quantity") * 48).alias("area_sqft"), (F.col("l_quantity") + 10).alias("width_ft"),
        (F.col("l_partkey") % 40 + 20.0).cast("double").alias("depth_ft"), F.when(F.col("l_returnflag") != "R", F.lit("Main Road")).alias("road_name"),
        (F.col("l_partkey") % 7 == 0).alias("is_corner"),
    )
    layouts = o.select(F.col("o_orderkey").alias("layout_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("ord"), F.lit(12000.0).alias("gross_sqft"), F.col("o_orderpriority").alias("strategy"))
    roads = o.select(F.col("o_orderkey").alias("layout_id"), (F.col("o_orderkey") % 30 * 100.0).alias("area_sqft"), (F.col("o_orderkey") % 20 + 15.0).cast("double").alias("width_ft"))
    zones = o.select(F.col("o_orderkey").alias("layout_id"), F.when(F.col("o_orderkey") % 3 == 0, "AMENITY_SPACE").otherwise("OPEN_SPACE").alias("zone_type"), (F.col("o_orderkey") % 15 * 100.0).alias("area_sqft"))
    return G.layout_totals(layouts, plots, roads, zones)


def _score_v1(s, d):
    return G.score_layouts(_layout_inputs(s, d)).select("layout_id", *[floor_round(c, 4).alias(c) for c in ("composite", "accessibility", "practicality", "utilization", "road_efficiency", "open_space", "residual_penalty")])


def _score_v2(s, d):
    return G.evaluate_layouts(_layout_inputs(s, d)).select("layout_id", *[floor_round(c, 4).alias(c) for c in ("composite", "util_score", "green_score", "efficiency_score", "shape_score")], "min_road_width_met", "open_space_met", "frontage_met", "overall_compliant")


def _rounded_scores(s, d):
    return G.score_layouts(_layout_inputs(s, d)).withColumn("composite", floor_round("composite", 4))


def _rank(s, d):
    return G.rank_variants(_rounded_scores(s, d)).select("project_id", "layout_id", F.col("rank").cast("long").alias("rank"), "badge")


def _top(s, d):
    return G.top_variants(_rounded_scores(s, d), 3).select("project_id", "layout_id", F.col("rank").cast("long").alias("rank"), "composite")


def _strategies(s, d):
    return G.strategy_comparison(_rounded_scores(s, d).withColumn("composite", F.col("composite"))).select("strategy", "variants", "mean_composite", "best_composite", F.col("plots").cast("long").alias("plots"))


def _stats(s, d):
    return G.variant_stats(_layout_inputs(s, d)).select("layout_id", "corner_plots", "plot_sqft", "plot_sqm", "avg_plot_sqft", "road_pct", "open_pct", "amenity_pct", "utilization_pct")


def _site(s, d):
    return v.parcels(s, d).select("parcel_id", "width_ft", "depth_ft", (F.col("width_ft") * F.col("depth_ft")).alias("gross_sqft"))


def _feasible(s, d):
    p = _site(s, d).withColumn("min_plot_sqft", F.lit(20000.0)).withColumn("feeder_ft", F.lit(29.53)).withColumn("min_frontage_ft", F.lit(40.0))
    return N.feasible(p).select("parcel_id", "is_feasible", floor_round("needed_sqft").alias("needed_sqft"))


def _grid(s, d):
    return N.grid_roads(_site(s, d)).select("parcel_id", "road_type", F.col("road_no").cast("long").alias("road_no"), *[floor_round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


def _subdivide(s, d):
    plots = N.subdivide_blocks(N.grid_blocks(_site(s, d)), min_w=20.0)
    return plots.groupBy("parcel_id").agg(
        F.count(F.lit(1)).alias("plots"), F.count_if("is_corner").alias("corners"), F.count_if(F.col("facing") == "NORTH").alias("north"),
        floor_round(F.sum(F.col("area_sqft").cast("decimal(28,6)")).cast("double"), 2).alias("plot_area"),
    )


def _sweep(s, d):
    out = W.sweep(_site(s, d), min_frontage_ft=24.0)
    return out.select(
        "parcel_id", "strategy", F.col("pass_no").cast("long").alias("pass_no"), "n_plots", *[floor_round(c).alias(c) for c in ("plot_area", "road_area", "open_area", "amenity_area")],
        F.col("warnings").cast("long").alias("warnings"), floor_round("composite").alias("composite"), F.col("rank").cast("long").alias("rank"), "badge",
    )


def _layout_zones(s, d):
    """Zones of every parcel and strategy."""
    z = W.candidate_layouts(_site(s, d)).select("parcel_id", "strategy", F.inline("zones"))
    return z.select("parcel_id", "strategy", "zone_type", "anchor", *[floor_round(c, 4).alias(c) for c in W.SIDES])


def _zones(s, d):
    p = _site(s, d)
    open_zone = N.reserve_zones(p, "RECREATIONAL_OPEN_SPACE", F.col("gross_sqft") * 0.10, "NORTH_EAST")
    amenity = N.reserve_zones(p, "AMENITY_SPACE", F.col("gross_sqft") * 0.05, "SOUTH_EAST", taken=open_zone)
    cols = ["parcel_id", "zone_type", "anchor", F.col("try").cast("long").alias("try"), *[floor_round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")]]
    return open_zone.select(*cols).unionByName(amenity.select(*cols))


def _detected(s, d):
    """Detected plots: rims moved by part size, every eleventh missing."""
    r = v.rects(s, d).filter(F.col("plot_id") % 11 != 0)
    shift = (F.col("p_size") % 5).cast("double")
    return r.select("project_id", "ord", R.box_ring(F.col("x0") + shift, "y0", F.col("x1") + shift, F.col("y1") + F.col("plot_id") % 3).alias("ring"))


def _approved(s, d):
    return v.rects(s, d).select("project_id", "ord", "ring")


def _match(s, d):
    return E.match_by_iou(_approved(s, d), _detected(s, d)).select("project_id", "g_ord", "p_ord", floor_round("iou", 6).alias("iou"))


def _plot_metrics(s, d):
    m = E.plot_metrics(_approved(s, d), _detected(s, d))
    return m.select("project_id", *[F.col(c).cast("long").alias(c) for c in ("n_gt", "n_pred", "matched", "missing", "extra", "merged", "duplicated")], "mean_iou", "median_iou", "mean_area_error_pct")


def _road_metrics(s, d):
    gt = v.sheet_roads(s, d)
    pred = gt.filter(F.col("ord") != 1).withColumn("ring", R.box_ring("x0", F.col("y0") + 5, "x1", F.col("y1") + 5))
    return E.road_metrics(gt, pred).select("project_id", "gt_roads", "pred_roads", "road_iou", "length_error_pct")


def _text_pairs(s, d):
    p = read_table(s, d, "part").select(F.floor(F.col("p_partkey") / v.BLOCK).alias("project_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("Plot "), F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_name")).alias("t"), "p_size")
    gt = p.select("project_id", "ord", F.col("t").alias("raw_text"), F.col("ord").cast("string").alias("associated_entity_id"))
    seen = F.when(F.col("p_size") == 7, F.concat(F.lit("Plat "), F.expr("substring(t, 6)"))).when(F.col("p_size") % 10 == 3, F.upper("t")).otherwise(F.col("t"))
    pred = p.filter(F.col("p_size") != 13).select("project_id", "ord", seen.alias("raw_text"), F.when(F.col("p_size") % 9 != 0, F.col("ord").cast("string")).alias("associated_entity_id"))
    return gt, pred


def _association(s, d):
    return E.association_metrics(*_text_pairs(s, d), strict=True)


def _evaluate(s, d):
    gt_l, pred_l = _text_pairs(s, d)
    rim = v.rects(s, d).groupBy("project_id").agg(*[fn(c).alias(c) for fn, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    b = rim.select("project_id", R.box_ring("x0", "y0", "x1", "y1").alias("ring"))
    seen = rim.select("project_id", R.box_ring("x0", "y0", F.col("x1") - (F.col("project_id") % 7) * 30, "y1").alias("ring"))
    road = rim.select("project_id", R.box_ring("x0", F.col("y1") + 5, "x1", F.col("y1") + 35).alias("ring"))
    gt = {"boundary": b, "plots": _approved(s, d), "roads": road, "labels": gt_l}
    pred = {"boundary": seen, "plots": _detected(s, d), "roads": road.filter(F.col("project_id") % 3 != 0), "labels": pred_l}
    out = E.evaluate(gt, pred)
    return out.withColumn("failures", F.array_join("failures", ",")).drop("boundary_evidence", "plots_evidence", "texts_evidence", "labels_evidence")


def _geo(s, d):
    """Rectangles placed on the globe and brought back to local feet."""
    r = v.rects(s, d)
    lat = lambda y: F.col(y) * 1e-5 + 18.5
    lng = lambda x: F.col(x) * 1e-5 + 73.8
    ring = F.array(R.point(lng("x0"), lat("y0")), R.point(lng("x1"), lat("y0")), R.point(lng("x1"), lat("y1")), R.point(lng("x0"), lat("y1")))
    return r.withColumn("g", S.geo_to_cad(ring)).select("plot_id", F.col("g.lengthFt").alias("length_ft"), F.col("g.breadthFt").alias("breadth_ft"), F.col("g.areaSqm").alias("area_sqm"))


def _affine(s, d):
    m = F.array(*[F.lit(x) for x in (2.0, 0.0, 0.0, 3.0, 10.0, -5.0)])
    return v.rects(s, d).withColumn("t", R.affine("ring", m)).select("plot_id", R.ring_area("t").alias("area"), F.col("t")[2]["x"].alias("x2"), F.col("t")[2]["y"].alias("y2"))


def _tiles(s, d):
    img = read_table(s, d, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 60).alias("width"), (F.floor("p_retailprice") + F.col("p_partkey") % 700).cast("int").alias("height"))
    return M.tile_index(img).select("image_id", *[F.col(c).cast("long").alias(c) for c in ("x", "y", "tile_w", "tile_h")])


def _probs(s, d):
    e = read_table(s, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "p"))
    return e.select("image_id", F.lit(0).alias("y"), F.floor(F.col("i") / 4).alias("x"), (F.col("i") % 4).alias("class_id"), F.col("p").cast("double").alias("prob"))


def _argmax(s, d):
    return M.argmax_class(_probs(s, d)).select("image_id", "x", F.col("class_id").cast("long").alias("class_id"))


def _pixel_counts(s, d):
    return M.class_pixel_counts(M.argmax_class(_probs(s, d))).select("image_id", F.col("class_id").cast("long").alias("class_id"), "pixels", "has_detections")


def _extent(s, d):
    return D.extents(v.rects(s, d))


def _layer_stats(s, d):
    e = v.rects(s, d).select("project_id", (F.col("w") * F.col("h")).alias("area"), F.when(F.col("p_type") == "PROMO", "ROAD").when(F.col("p_type") == "LARGE", "AMENITY").otherwise("PLOT").alias("entity_type"))
    return D.layer_stats(e)


def _balance(s, d):
    roads = v.sheet_roads(s, d)
    none = roads.filter(F.lit(False))
    greens = v.rects(s, d).filter(F.col("p_type") == "PROMO").select("project_id", "ring")
    return D.buildable_balance(v.sheet_boundaries(s, d), roads, greens, none).select("project_id", "gross_sqft", "setback_sqft", "road_sqft", "net_sqft", "buildable_pct")


def _crossings(s, d):
    return P.road_intersections(D.road_facts(v.sheet_roads(s, d)))


def _facing4(s, d):
    return D.facing4(v.rects(s, d)).select("plot_id", "facing4")


def _facing8(s, d):
    return P.facing8(v.rects(s, d), D.road_facts(v.sheet_roads(s, d))).select("plot_id", "facing8")


def _calibrate(s, d):
    r = v.rects(s, d)
    two = S.calibrate_two_point("x0", "y0", "x1", "y1", F.col("p_size").cast("double") * 2, F.when(F.col("plot_id") % 2 == 0, "METERS").otherwise("FEET"))
    area = S.calibrate_area(F.col("w") * F.col("h"), F.col("p_size").cast("double") / 10, F.when(F.col("plot_id") % 2 == 0, "Acres").otherwise("Guntha"))
    return r.withColumn("t", two).withColumn("a", area).select("plot_id", F.col("t.pixelsPerFoot").alias("px_per_ft"), F.col("t.metersPerPixel").alias("m_per_px"), F.col("a.feetPerPixel").alias("area_ft_per_px"))


QUERIES = {
    "classify_labels": _labels, "text_edit_distance": _edit, "word_accuracy": _words, "ring_measures": _measures, "shape_class": _shapes,
    "classify_primitives": _classify, "dedupe_primitives": _dedupe, "self_intersections": _self_cross, "contains_join": _contains, "bbox_join": _bbox,
    "nearest_join": _nearest, "nearest_road": _nearest_road, "associate_labels": _associate, "viewport": _viewport, "mutual_overlap": _overlap,
    "iou_pairs": _iou_pairs, "relationship_graph": _graph, "relationship_counts": _graph_counts, "road_overlap": _road_overlap, "union_area": _union,
    "plot_union_area": _plot_union, "no_road_access": _access, "validate_layouts": _validate, "compliance_report": _report, "applicable_norms": _norms,
    "score_layouts": _score_v1, "evaluate_layouts": _score_v2, "rank_variants": _rank, "top_variants": _top, "strategy_comparison": _strategies,
    "variant_stats": _stats, "feasible_parcels": _feasible, "grid_roads": _grid, "subdivide_blocks": _subdivide, "candidate_sweep": _sweep, "layout_zones": _layout_zones,
    "reserve_zones": _zones, "plot_match": _match, "plot_metrics": _plot_metrics, "road_metrics": _road_metrics, "label_association": _association,
    "evaluate_projects": _evaluate, "geo_to_cad": _geo, "affine": _affine, "tile_index": _tiles, "argmax_class": _argmax, "class_pixel_counts": _pixel_counts,
    "layer_extent": _extent, "layer_stats": _layer_stats, "buildable_balance": _balance, "road_intersections": _crossings, "facing4": _facing4,
    "facing8": _facing8, "calibrate_scale": _calibrate,
}
