"""From drawing primitives to boundaries, roads, plots and the buildable balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.functions import scalars as S
from acreage.functions.rings import floor_round
from acreage.operators import overlay, spatial
from acreage.session import numbered, once


def normalize_primitives(prims: DataFrame) -> DataFrame:
    """Two-decimal vertices without repeats, rich box, and the primitive's type."""
    pts = R.drop_repeats(R.rounded("points"), 0.0)
    df = prims.withColumn("points", pts).filter(F.size("points") > 0).withColumn("box", R.rich_bbox("points"))
    n = F.size("points")
    closed = F.coalesce("is_closed", F.lit(False))
    kind = F.when(n <= 2, "LINE").when(closed & n.isin(4, 5), "RECTANGLE").when(closed, "POLYGON").otherwise("POLYLINE")
    given = F.col("primitive_type") if "primitive_type" in prims.columns else F.lit(None).cast("string")
    return df.withColumn("primitive_type", F.coalesce(given, kind)).withColumn("area", F.col("box.area"))


def dedupe_primitives(prims: DataFrame, keys: list[str], points: str = "points") -> DataFrame:
    """First of every set of equal vertex lists, either direction; ``copies`` tells how many there were."""
    keyed = prims.withColumn("__key", R.canonical_key(points))
    other = [c for c in prims.columns if c not in keys]
    firsts = keyed.groupBy(*keys, F.xxhash64("__key").alias("__h"), "__key").agg(
        F.min_by(F.struct(*other), "ord").alias("f"), F.count(F.lit(1)).alias("copies")
    )
    return firsts.select(*keys, "f.*", "copies")


def primitive_counts(prims: DataFrame) -> DataFrame:
    return prims.groupBy("project_id").pivot("primitive_type", ["LINE", "POLYLINE", "POLYGON", "RECTANGLE"]).agg(F.count(F.lit(1))).na.fill(0)


def primitive_measures(prims: DataFrame) -> DataFrame:
    """Length and area of closed or open polylines and of circles."""
    ring = F.when(F.col("radius").isNotNull(), S.circle_ring("cx", "cy", "radius")).otherwise(F.col("points"))
    shaped = prims.withColumn("ring", ring)
    closed = F.coalesce("is_closed", F.lit(False)) | F.col("radius").isNotNull()
    return shaped.withColumn("length", F.when(closed, R.ring_length("ring")).otherwise(R.path_length("ring"))).withColumn(
        "area", F.when(closed, R.ring_area("ring")).otherwise(0.0)
    )


def extents(df: DataFrame, ring: str = "ring", key: str = "project_id") -> DataFrame:
    """Extent and centre over all vertices of a project; an empty one gets the page 612×792."""
    b = df.select(key, R.bbox(ring).alias("b")).groupBy(key).agg(
        F.coalesce(F.min("b.minX"), F.lit(0.0)).alias("min_x"), F.coalesce(F.min("b.minY"), F.lit(0.0)).alias("min_y"),
        F.coalesce(F.max("b.maxX"), F.lit(612.0)).alias("max_x"), F.coalesce(F.max("b.maxY"), F.lit(792.0)).alias("max_y"),
    )
    return b.withColumn("center_x", (F.col("min_x") + F.col("max_x")) / 2.0).withColumn("center_y", (F.col("min_y") + F.col("max_y")) / 2.0)


def normalize_drawing(prims: DataFrame, ring: str = "ring") -> DataFrame:
    """Shift every drawing to (50, 50); drawings wider than 50 000 units are millimetres and become metres."""
    e = extents(prims, ring)
    scale = F.when(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) > 50000, 0.001).otherwise(1.0)
    df = prims.join(e, "project_id").withColumn("scale", scale)
    moved = F.transform(ring, lambda p: R.point((p["x"] - F.col("min_x")) * F.col("scale") + 50.0, (p["y"] - F.col("min_y")) * F.col("scale") + 50.0))
    return df.withColumn(ring, moved).withColumn("area", F.col("area") * F.col("scale") * F.col("scale")).select(*prims.columns, "scale")


def layers_of(prims: DataFrame) -> DataFrame:
    return prims.groupBy("project_id").agg(F.sort_array(F.collect_set("layer")).alias("layers"))


def facing4(df: DataFrame) -> DataFrame:
    """Quarter of each polygon around the centre of its project's extent."""
    return df.join(extents(df).select("project_id", "center_x", "center_y"), "project_id").withColumn("c", R.vertex_centroid("ring")).withColumn(
        "facing4", S.facing4("c.x", "c.y", "center_x", "center_y")
    ).drop("c", "center_x", "center_y")


def shape_class(df: DataFrame) -> DataFrame:
    """Shape by concavity, vertex count and fill; the hull of one ring is taken in place."""
    hull = R.ring_area(overlay._chain(F.sort_array(F.array_distinct("ring"))))
    df = once(df, __b=R.bbox("ring"), __area=R.ring_area("ring"), __hull=hull)
    n = F.size(R.opened("ring"))
    df = df.withColumn("vertex_count", n).withColumn(
        "concavity", F.coalesce(F.col("__area") / F.nullif("__hull", F.lit(0.0)), F.lit(1.0))
    )
    w = F.greatest(F.lit(1.0), F.col("__b.maxX") - F.col("__b.minX"))
    h = F.greatest(F.lit(1.0), F.col("__b.maxY") - F.col("__b.minY"))
    fill, v, k = F.col("__area") / (w * h), F.col("vertex_count"), F.col("concavity")
    kind = (
        F.when((k < 0.88) & v.isin(6, 7, 8) & (k < 0.82), "L_SHAPED").when(k < 0.88, "CONCAVE")
        .when((v == 4) & (fill > 0.95), "RECTANGULAR").when((v == 4) & (fill > 0.70), "TRAPEZOIDAL").when(v == 4, "SLANTED")
        .when(v == 5, "TRAPEZOIDAL").otherwise("IRREGULAR")
    )
    return df.withColumn("shape_type", kind).withColumn("aspect_ratio", floor_round(w / h)).drop("__b", "__area", "__hull")


# fixed values: class bounds of primitives and entities, here and in classify_entities
def candidate_type(closed, area, aspect, w, h, canvas_area) -> Column:
    ratio = F.coalesce(area / F.nullif(canvas_area, F.lit(0.0)), F.lit(0.0))
    side = F.sqrt(canvas_area)
    return (
        F.when(~closed, "OPEN_REGION")
        .when((ratio >= 0.30) | ((w > side * 0.7) & (h > side * 0.7)), "BOUNDARY_CANDIDATE")
        .when(((aspect > 5.0) | (aspect < 0.2)) & ((w > 100) | (h > 100)), "ROAD_CANDIDATE")
        .when((ratio < 0.001) | ((w < 40) & (h < 40)), "TEXT_REGION")
        .when((ratio >= 0.001) & (ratio < 0.30) & aspect.between(0.15, 6.0), "PLOT_CANDIDATE")
        .otherwise("UNKNOWN")
    )


def classify_primitives(prims: DataFrame) -> DataFrame:
    """Candidate type from area, box and canvas (``canvas_w`` × ``canvas_h``)."""
    w, h = F.col("box_w"), F.col("box_h")
    aspect = F.coalesce(w / F.nullif(h, F.lit(0.0)), F.lit(1.0))
    return prims.withColumn(
        "candidate_type", candidate_type(F.col("is_closed"), F.col("area"), aspect, w, h, F.col("canvas_w") * F.col("canvas_h"))
    )


def classify_entities(prims: DataFrame, extent: DataFrame) -> DataFrame:
    """Entity type in the layout model, from the share of the page and the aspect."""
    df = prims.join(extent, "project_id")
    pw, ph = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    ratio = F.coalesce(F.col("area") / F.nullif(pw * ph, F.lit(0.0)), F.lit(0.0))
    w, h = F.col("box_w"), F.col("box_h")
    aspect = F.when((w > 0) & (h > 0), w / F.nullif(h, F.lit(0.0))).when(w > 0, 999.0).when(h > 0, 0.001).otherwise(1.0)
    solid = F.col("is_closed") & (F.size("points") >= 3)
    length = F.coalesce(F.nullif("length", F.lit(0.0)), R.path_length("points"))
    kind = (
        F.when(solid & (ratio >= 0.40), "BOUNDARY")
        .when(solid & (ratio >= 0.001) & (ratio < 0.25) & aspect.between(0.15, 6.5), "PLOT")
        .when(solid & (ratio >= 0.25), "AMENITY").when(solid, "UNCLASSIFIED")
        .when(((aspect > 5.0) | (aspect < 0.2)) & (length > F.hypot(pw, ph) * 0.10), "ROAD").otherwise("PATH")
    )
    return df.withColumn("entity_type", kind).select(*prims.columns, "entity_type")


def number_entities(classified: DataFrame) -> DataFrame:
    """Ids such as plot-001 within project and type, in drawing order."""
    seq = numbered(classified, ["project_id", "entity_type"], [F.asc("ord")], F.floor(F.col("ord") / 10000), "__seq")
    # fixed values: id prefixes
    names = {"BOUNDARY": "bound", "PLOT": "plot", "AMENITY": "amenity", "UNCLASSIFIED": "closed", "ROAD": "road", "PATH": "path"}
    prefix = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("entity_type")]
    text = F.col("__seq").cast("string")
    padded = F.when(F.length(text) >= 3, text).otherwise(F.lpad(text, 3, "0"))
    return seq.withColumn("entity_id", F.concat(prefix, F.lit("-"), padded)).drop("__seq")


def layer_stats(df: DataFrame) -> DataFrame:
    """Features by type and plot area of every project."""
    t = F.col("entity_type")
    return df.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("features"), F.count_if(t == "PLOT").alias("plots"), F.count_if(t == "ROAD").alias("roads"),
        F.count_if(t == "BOUNDARY").alias("boundaries"), F.count_if(t == "AMENITY").alias("amenities"),
        floor_round(F.coalesce(F.sum(F.when(t == "PLOT", F.col("area")).cast("decimal(28,6)")), F.lit(0)).cast("double")).alias("plot_area"),
    )


def road_facts(df: DataFrame) -> DataFrame:
    """Width (20 at least), length and centerline of road regions from their boxes."""
    b = R.bbox("ring")
    df = df.withColumn("__b", b).withColumn("__w", F.col("__b.maxX") - F.col("__b.minX")).withColumn("__h", F.col("__b.maxY") - F.col("__b.minY"))
    mx, my = floor_round((F.col("__b.minX") + F.col("__b.maxX")) / 2.0), floor_round((F.col("__b.minY") + F.col("__b.maxY")) / 2.0)
    flat = F.array(R.point(floor_round("__b.minX"), my), R.point(floor_round("__b.maxX"), my))
    tall = F.array(R.point(mx, floor_round("__b.minY")), R.point(mx, floor_round("__b.maxY")))
    return df.withColumn("road_width", F.greatest(F.lit(20.0), floor_round(F.least("__w", "__h", F.lit(60.0))))).withColumn(
        "road_length", floor_round(F.greatest("__w", "__h"))
    ).withColumn("centerline", F.when(F.col("__w") >= F.col("__h"), flat).otherwise(tall)).drop("__b", "__w", "__h")


def pick_boundary(cands: DataFrame, points: DataFrame | None = None, min_area: float = 2000.0) -> DataFrame:
    """Largest candidate above the minimum area; projects without one fall back to the hull of ``points``."""
    big = once(cands, area=R.ring_area("ring")).filter(F.col("area") > min_area)
    best = big.groupBy("project_id").agg(F.max_by(F.struct("ring", "source", "area"), F.struct("area", -F.col("ord"))).alias("b")).select(
        "project_id", "b.ring", "b.source", "b.area"
    )
    if points is None:
        return best
    hull = overlay.convex_hull(points, ["project_id"]).join(best, "project_id", "left_anti").withColumn("area", R.ring_area("ring")).filter(
        F.col("area") > min_area
    )
    return best.unionByName(hull.select("project_id", "ring", F.lit("CONVEX_HULL_RECONSTRUCTION").alias("source"), "area"))


def plot_candidates(prims: DataFrame, roads: DataFrame, boundary: DataFrame) -> DataFrame:
    """Primitives that may be plots: not the boundary, not a road, of fitting type and area."""
    keys = ["project_id", "plot_id"]
    kept = prims.join(boundary.select(*keys), keys, "left_anti").join(roads.select(*keys), keys, "left_anti")
    typed = kept.filter(F.col("candidate_type").isin("PLOT_CANDIDATE", "UNKNOWN")).drop("area")
    return once(typed, area=floor_round(R.ring_area("ring"))).filter((F.col("area") > 100.0) & (F.col("area") < 200000.0))


def detect_plots(cands: DataFrame, edges: DataFrame, prims: DataFrame | None = None) -> DataFrame:
    """Detected plots with measures, orientation, stable id and neighbour lists.

    ``edges`` are between distinct shapes; with ``prims``, the rows they were made of, copies of a shape get its edges as well.
    """
    if prims is not None:
        edges = spatial.expand_edges(edges, prims)
    ids = cands.select("project_id", "plot_id")
    inside = edges.join(ids.withColumnRenamed("plot_id", "src"), ["project_id", "src"], "left_semi").join(
        ids.withColumnRenamed("plot_id", "dst"), ["project_id", "dst"], "left_semi"
    )
    df = cands.join(spatial.neighbours(inside), ["project_id", "plot_id"], "left").withColumn("b", R.bbox("ring")).withColumn("c", R.area_centroid("ring"))
    w, h = F.col("b.maxX") - F.col("b.minX"), F.col("b.maxY") - F.col("b.minY")
    return df.select(
        "project_id", "plot_id", "ring", "area", floor_round(R.ring_length("ring")).alias("perimeter"), floor_round("c.x").alias("cx"), floor_round("c.y").alias("cy"),
        S.aspect_ratio(w, h).alias("aspect_ratio"), S.orientation(w, h).alias("orientation"), S.stable_plot_id("c.x", "c.y", "area").alias("stable_id"),
        F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"),
    )


def assemble_layout(plots: DataFrame, roads: DataFrame) -> DataFrame:
    """Plots and roads as one entity list with display defaults."""
    p = plots.select(
        "project_id", F.lit("PLOT").alias("entity_type"), F.col("plot_id").cast("string").alias("entity_id"), "ring", "area",
        F.coalesce("plot_number", F.substring(F.col("plot_id").cast("string"), 1, 8)).alias("name"),
        F.coalesce("area_label", F.concat(floor_round("area", 1).cast("string"), F.lit(" sq ft"))).alias("label"),
    )
    r = roads.select(
        "project_id", F.lit("ROAD").alias("entity_type"), F.col("road_id").alias("entity_id"), "ring", R.ring_area("ring").alias("area"),
        F.coalesce("road_name", F.concat(F.lit("ROAD-"), F.right(F.col("road_id"), F.lit(3)))).alias("name"), F.lit(None).cast("string").alias("label"),
    )
    return union_layers(p, r)


def union_layers(*layers: DataFrame) -> DataFrame:
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer, allowMissingColumns=True)
    return out


def analyze_polygons(df: DataFrame) -> DataFrame:
    """Full profile of each ring; an unusable ring is flagged and measured as zero."""
    df = df.withColumn("__clean", R.clean_ring("ring")).withColumn("__c", R.area_centroid("__clean"))
    zero = lambda c: F.coalesce(floor_round(c), F.lit(0.0))
    return df.withColumn("is_valid", F.col("__clean").isNotNull() & ~R.self_crossing("__clean")).withColumn("area", zero(R.ring_area("__clean"))).withColumn(
        "perimeter", zero(R.ring_length("__clean"))
    ).withColumn("cx", zero("__c.x")).withColumn("cy", zero("__c.y")).withColumn("bbox", R.bbox("__clean")).withColumn(
        "wkt", F.coalesce(R.wkt("__clean"), F.lit(""))
    ).withColumn(
        "geojson", F.when(F.col("__clean").isNotNull(), F.to_json(F.struct(F.lit("Polygon").alias("type"), R.coordinates("__clean").alias("coordinates"))))
    ).drop("__clean", "__c")


def confirm_boundaries(df: DataFrame) -> DataFrame:
    """Facts shown before a boundary is confirmed."""
    shaped = shape_class(df)
    area = R.ring_area("ring")
    b = F.col("__b")
    return shaped.withColumn("__b", R.bbox("ring")).withColumn("area_sqft", floor_round(area)).withColumn(
        "area_sqm", floor_round(area / 10.7639104)
    ).withColumn("perimeter_ft", floor_round(R.ring_length("ring"))).withColumn("length_ft", F.greatest(F.lit(20.0), b["maxX"] - b["minX"])).withColumn(
        "breadth_ft", F.greatest(F.lit(20.0), b["maxY"] - b["minY"])
    ).withColumn("is_confirmable", (F.col("vertex_count") >= 3) & (area > 10.0)).drop("__b")


def setback(df: DataFrame, distance: float, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Adds setback_area, the ground within ``distance`` of the ring's rim. ``keys`` name a row."""
    inner = overlay.inset_areas(df, list(keys), distance)
    lost = F.greatest(R.ring_area("ring") - F.coalesce("inset", F.lit(0.0)), F.lit(0.0))
    return df.join(inner.hint("merge"), list(keys), "left").withColumn("setback_area", lost).drop("inset")


def buildable_balance(boundary: DataFrame, roads: DataFrame, greens: DataFrame, obstacles: DataFrame, setback_ft: float = 10.0) -> DataFrame:
    """Gross, setback, road, green, obstacle and net buildable area of each boundary.

    Net is the inset boundary less the dissolved exclusions, by one sweep per project.
    """
    keys = ["project_id"]
    excl = roads.select("project_id", "ring").unionByName(greens.select("project_id", "ring")).unionByName(obstacles.select("project_id", "ring"))
    net = overlay.inset_areas(boundary, keys, setback_ft, excl).withColumnRenamed("inset", "net")
    out = setback(boundary, setback_ft).select("project_id", R.ring_area("ring").alias("gross"), "setback_area").join(net.hint("merge"), "project_id", "left")
    for name, side in (("road_area", roads), ("green_area", greens), ("obstacle_area", obstacles)):
        out = out.join(overlay.union_area(side, keys).withColumnRenamed("union_area", name).hint("merge"), "project_id", "left")
    z = lambda c: floor_round(F.coalesce(c, F.lit(0.0)))
    return out.select(
        "project_id", floor_round("gross").alias("gross_sqft"), floor_round("setback_area").alias("setback_sqft"),
        z("road_area").alias("road_sqft"), z("green_area").alias("green_sqft"), z("obstacle_area").alias("obstacle_sqft"),
        z("net").alias("net_sqft"), floor_round(F.coalesce("net", F.lit(0.0)) / F.nullif("gross", F.lit(0.0)) * 100.0).alias("buildable_pct"),
    )


def rank_blocks(blocks: DataFrame, min_sqft: float = 300.0) -> DataFrame:
    """Blocks of at least the minimum, numbered by area, largest first."""
    big = blocks.filter(F.col("area") >= min_sqft)
    return numbered(big, ["project_id"], [F.desc("area"), F.asc("block_no")], F.floor(F.col("area") / 100.0), "rank", descending=True).withColumn(
        "block_id", F.concat(F.lit("block-"), F.when(F.col("rank") < 1000, F.lpad(F.col("rank").cast("string"), 3, "0")).otherwise(F.col("rank").cast("string")))
    )

