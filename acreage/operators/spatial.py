"""Grid joins of points and polygons: containment, boxes, nearest, pairs, relations.

All joins are equi-joins on (project, grid cell), which Spark hashes, sorts and, where a cell
is hot, splits under AQE. Copies of a shape or a position are collapsed to one row before a
join and fanned out after it, so a pile of copies costs one row of geometry work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions import rings as R
from acreage.functions.rings import floor_round
from acreage.session import cut, once

VIEW_CELL = 500.0
#: Entries a list of a grid cell holds; a cell with more has several lists.
CELL_LIST = 128


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _straight(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def grid_cells(df: DataFrame, size: float = VIEW_CELL, box: str = "bbox", reach: float = 0.0) -> DataFrame:
    """One row per grid cell that a bounding box, widened by ``reach``, meets."""
    b = F.col(box)
    span = lambda lo, hi: F.sequence(_cell(lo - reach, size), _cell(hi + reach, size))
    return df.withColumn("cx", F.explode(span(b["minX"], b["maxX"]))).withColumn(
        "cy", F.explode(span(b["minY"], b["maxY"]))
    )


def viewport(cells: DataFrame, min_x: float, min_y: float, max_x: float, max_y: float, key: list[str], size: float = VIEW_CELL) -> DataFrame:
    """Entities whose box meets a view, by cell first, then by box, each once."""
    b = F.col("bbox")
    inside = cells.filter(
        F.col("cx").between(int(min_x // size), int(max_x // size)) & F.col("cy").between(int(min_y // size), int(max_y // size))
        & (b["minX"] <= max_x) & (b["maxX"] >= min_x) & (b["minY"] <= max_y) & (b["maxY"] >= min_y)
    )
    return inside.drop("cx", "cy").dropDuplicates(key)


def _spots(points: DataFrame) -> DataFrame:
    return points.select("project_id", "x", "y").distinct()


def _shapes(polys: DataFrame, order: str = "ord") -> DataFrame:
    """Distinct rings of a project, each standing for its first copy."""
    kept = polys.groupBy("project_id", "ring").agg(F.min(F.struct(order, "plot_id")).alias("f"))
    return kept.select("project_id", "ring", F.col(f"f.{order}").alias("ord"), F.col("f.plot_id").alias("plot_id"), R.bbox("ring").alias("bbox"), R.area_centroid("ring").alias("c"))


def _spot_cells(spots: DataFrame, cell: float) -> DataFrame:
    return spots.withColumn("cx", _cell(F.col("x"), cell)).withColumn("cy", _cell(F.col("y"), cell))


def _in_box(x, y, b) -> Column:
    return (x >= b["minX"]) & (x <= b["maxX"]) & (y >= b["minY"]) & (y <= b["maxY"])


def cell_lists(cells: DataFrame, entry: Column) -> DataFrame:
    """Entries of every (project, cx, cy) as lists of up to CELL_LIST, so that a spot meets a cell in few rows and no pair becomes a row.

    Joined by sorting: these rows are many more than Spark's estimate, which takes an exploded frame to be as large as its source.
    """
    keys = ["project_id", "cx", "cy"]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    dealt = cells.select(*keys, "ord", entry.alias("entry")).withColumn("part", F.floor((at - 1) / CELL_LIST))
    # by the part as well, so that the join shuffles the lists itself and can split a hot cell
    return dealt.repartition(*keys, "part").groupBy(*keys, "part").agg(F.collect_list("entry").alias("entries")).drop("part").hint("merge")


def spot_hits(spots: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """First shape whose box holds a spot and first whose interior does, per spot."""
    x, y = F.col("x"), F.col("y")
    first = lambda found: F.array_min(F.transform(found, lambda e: F.struct(*[e[k].alias(k) for k in ("ord", "plot_id", "c")])))
    lists = cell_lists(grid_cells(shapes, cell), F.struct("bbox", "ring", "ord", "plot_id", "c"))
    met = once(_spot_cells(spots, cell).join(lists, ["project_id", "cx", "cy"]), boxed=F.filter("entries", lambda e: _in_box(x, y, e["bbox"])))
    hits = once(met.filter(F.size("boxed") > 0), held=F.filter("boxed", lambda e: R.point_in_ring(x, y, e["ring"])))
    firsts = hits.select("project_id", "x", "y", first("boxed").alias("in_box"), first("held").alias("in_ring"), F.size("held").cast("long").alias("n"))
    return firsts.groupBy("project_id", "x", "y").agg(F.min("in_box").alias("in_box"), F.min("in_ring").alias("in_ring"), F.sum("n").alias("n_rings"))


def contains_join(points: DataFrame, polys: DataFrame, cell: float = 200.0) -> DataFrame:
    """Points with the first polygon (by ``ord``) that holds them; points in none are left out."""
    hits = spot_hits(_spots(points), _shapes(polys), cell).filter(F.col("in_ring").isNotNull())
    return points.hint("merge").join(
        hits.select("project_id", "x", "y", F.col("in_ring.plot_id").alias("plot_id"), "n_rings"), ["project_id", "x", "y"]
    )


def bbox_join(points: DataFrame, polys: DataFrame, cell: float = 200.0) -> DataFrame:
    """Points with the first polygon whose bounding box holds them, rim included."""
    hits = spot_hits(_spots(points), _shapes(polys), cell)
    return points.hint("merge").join(hits.select("project_id", "x", "y", F.col("in_box.plot_id").alias("plot_id")), ["project_id", "x", "y"])


def spot_nearest(spots: DataFrame, targets: DataFrame, max_dist: float) -> DataFrame:
    """Nearest target (tx, ty, ord, plot_id) strictly within ``max_dist`` of each spot."""
    ways = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = (
        targets.withColumn("w", F.explode(ways))
        .withColumn("cx", _cell(F.col("tx"), max_dist) + F.col("w.dx"))
        .withColumn("cy", _cell(F.col("ty"), max_dist) + F.col("w.dy"))
    )
    lists = cell_lists(near, F.struct("tx", "ty", "ord", "plot_id"))
    way = lambda e: F.struct(_straight(F.col("x") - e["tx"], F.col("y") - e["ty"]).alias("dist"), e["ord"].alias("ord"), e["plot_id"].alias("plot_id"))
    ways = F.filter(F.transform("entries", way), lambda e: e["dist"] < max_dist)
    met = once(_spot_cells(spots, max_dist).join(lists, ["project_id", "cx", "cy"]).select("project_id", "x", "y", "entries"), near=F.array_min(ways))
    return met.filter(F.col("near").isNotNull()).groupBy("project_id", "x", "y").agg(F.min("near").alias("near"))


def centres(polys: DataFrame) -> DataFrame:
    """Distinct polygon centroids, each standing for its first polygon."""
    c = polys.withColumn("c", R.area_centroid("ring")).groupBy("project_id", F.col("c.x").alias("tx"), F.col("c.y").alias("ty"))
    return c.agg(F.min(F.struct("ord", "plot_id")).alias("f")).select("project_id", "tx", "ty", "f.ord", "f.plot_id")


def nearest_join(points: DataFrame, polys: DataFrame, max_dist: float = 200.0) -> DataFrame:
    """Points with the polygon of nearest centroid, strictly within ``max_dist``."""
    near = spot_nearest(_spots(points), centres(polys), max_dist)
    return points.hint("merge").join(
        near.select("project_id", "x", "y", F.col("near.plot_id").alias("plot_id"), F.col("near.dist").alias("distance")),
        ["project_id", "x", "y"],
    )


def road_mids(roads: DataFrame) -> DataFrame:
    """Middle of a centerline: mean of its two end points."""
    a, b = F.get("centerline", F.lit(0)), F.element_at("centerline", -1)
    return roads.filter(F.size("centerline") > 0).select(
        "project_id", "road_id", "ord", ((a["x"] + b["x"]) / 2.0).alias("mx"), ((a["y"] + b["y"]) / 2.0).alias("my")
    )


def spot_nearest_road(spots: DataFrame, roads: DataFrame, reach: float = 2000.0) -> DataFrame:
    """Nearest road middle of each spot, however far away.

    A level asks the grid cells around a spot for a middle within the level's reach, which is then the nearest of all; spots without
    one rise to the next level, where reach and cells are twice as large. So a spot meets the middles of a neighbourhood only, and
    levels end when all spots are settled. A level asks only spots nearer than its reach to the box around their project's middles,
    and one that would ask none is passed over.
    """
    mids = road_mids(roads).groupBy("project_id", "mx", "my").agg(F.min(F.struct("ord", "road_id")).alias("f"))
    targets = mids.select("project_id", F.col("mx").alias("tx"), F.col("my").alias("ty"), "f.ord", F.col("f.road_id").alias("plot_id"))
    as_road = F.struct(F.col("near.dist").alias("dist"), F.col("near.ord").alias("ord"), F.col("near.plot_id").alias("road_id"))
    targets = cut(targets)
    sides = {"minX": F.min("tx"), "minY": F.min("ty"), "maxX": F.max("tx"), "maxY": F.max("ty")}
    rims = targets.groupBy("project_id").agg(F.struct(*[v.alias(k) for k, v in sides.items()]).alias("rim"))
    off = lambda c, lo, hi: F.greatest(F.col(f"rim.{lo}") - F.col(c), F.col(c) - F.col(f"rim.{hi}"), F.lit(0.0))
    # no middle is nearer than its box; coordinates that are no numbers put nothing off
    low = F.coalesce(F.nanvl(_straight(off("x", "minX", "maxX"), off("y", "minY", "maxY")), F.lit(0.0)), F.lit(0.0))
    placed = spots.select("project_id", "x", "y").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    found, open_ = None, cut(placed.join(rims.hint("merge"), "project_id").select("project_id", "x", "y", low.alias("low")))
    while True:
        least = open_.agg(F.min("low")).first()[0]
        if least is None and found is not None:
            return found
        while least is not None and reach <= least < math.inf:
            reach *= 2
        near = cut(spot_nearest(open_.filter(F.col("low") < reach), targets, reach).select("project_id", "x", "y", as_road.alias("near")))
        found = near if found is None else found.unionByName(near)
        open_ = cut(open_.join(near.select("project_id", "x", "y").hint("merge"), ["project_id", "x", "y"], "left_anti"))
        reach *= 2


def nearest_road(points: DataFrame, roads: DataFrame) -> DataFrame:
    near = spot_nearest_road(_spots(points), roads)
    return points.hint("merge").join(
        near.select("project_id", "x", "y", F.col("near.road_id").alias("road_id"), F.col("near.dist").alias("distance")),
        ["project_id", "x", "y"], "left",
    )


def shape_classes(df: DataFrame, keys: list[str] = ("project_id",)) -> DataFrame:
    """Rows with their distinct shape: ``shape_id`` is the first id among equal rings."""
    shapes = df.groupBy(*keys, "ring").agg(F.min("plot_id").alias("shape_id"), F.count(F.lit(1)).alias("copies"))
    return once(once(shapes, bbox=R.bbox("ring")), is_box=R.is_box("ring", "bbox"))


def shape_pairs(shapes: DataFrame, reach: float = 0.0, cell: float = VIEW_CELL) -> DataFrame:
    """Pairs of distinct shapes whose boxes come within ``reach``, each once.

    A pair is taken in the one cell that holds the lower-left corner of the common box, so
    no duplicates need removing.
    """
    cells = grid_cells(shapes, cell, reach=reach / 2.0)
    a, b = cells.alias("a"), cells.alias("b")
    half = reach / 2.0
    first_x = F.greatest(F.col("a.bbox.minX"), F.col("b.bbox.minX")) - half
    first_y = F.greatest(F.col("a.bbox.minY"), F.col("b.bbox.minY")) - half
    on = (
        (F.col("a.project_id") == F.col("b.project_id")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
        & (F.col("a.shape_id") < F.col("b.shape_id")) & R.boxes_overlap(F.col("a.bbox"), F.col("b.bbox"), reach)
        & (_cell(first_x, cell) == F.col("a.cx")) & (_cell(first_y, cell) == F.col("a.cy"))
    )
    return a.join(b.hint("merge"), on).select(
        F.col("a.project_id").alias("project_id"), F.col("a.shape_id").alias("a_id"), F.col("b.shape_id").alias("b_id"),
        F.col("a.ring").alias("a_ring"), F.col("b.ring").alias("b_ring"), R.box_common(F.col("a.bbox"), F.col("b.bbox")).alias("common"),
        (F.col("a.is_box") & F.col("b.is_box")).alias("boxes"), F.col("a.copies").alias("a_copies"), F.col("b.copies").alias("b_copies"),
    )


def _overlap() -> Column:
    """Overlap of a pair; two boxes need no edge work."""
    zero = F.lit(0.0)
    flat = F.greatest(F.col("common.w"), zero) * F.greatest(F.col("common.h"), zero)
    return F.when(F.col("boxes"), flat).otherwise(R.overlap_area("a_ring", "b_ring"))


def overlap_pairs(df: DataFrame, cell: float = VIEW_CELL) -> DataFrame:
    """Overlap of every two polygons of a project, at the level of distinct shapes.

    ``n_pairs`` says how many pairs of rows a line stands for; copies of one shape appear as
    one line of that shape with itself.
    """
    shapes = shape_classes(df)
    measured = once(
        shape_pairs(shapes, cell=cell), overlap=_overlap(), a_area=R.ring_area("a_ring"), b_area=R.ring_area("b_ring")
    )
    cross = measured.select(
        "project_id", "a_id", "b_id", "overlap", "a_area", "b_area",
        (F.col("a_copies") * F.col("b_copies")).alias("n_pairs"),
    )
    area = R.ring_area("ring")
    own = shapes.filter(F.col("copies") > 1).select(
        "project_id", F.col("shape_id").alias("a_id"), F.col("shape_id").alias("b_id"), area.alias("overlap"),
        area.alias("a_area"), area.alias("b_area"), F.floor(F.col("copies") * (F.col("copies") - 1) / 2).alias("n_pairs"),
    )
    return cross.unionByName(own).filter(F.col("overlap") > 0)


def expand_pairs(pairs: DataFrame, df: DataFrame) -> DataFrame:
    """Shape-level pairs fanned out to the ids of the rows; as long as the list of pairs is."""
    members = df.join(
        df.groupBy("project_id", "ring").agg(F.min("plot_id").alias("shape_id")), ["project_id", "ring"]
    ).select("project_id", "shape_id", "plot_id")
    a = members.select("project_id", F.col("shape_id").alias("a_id"), F.col("plot_id").alias("a_plot"))
    b = members.select("project_id", F.col("shape_id").alias("b_id"), F.col("plot_id").alias("b_plot"))
    out = pairs.join(a, ["project_id", "a_id"]).join(b, ["project_id", "b_id"])
    return out.filter((F.col("a_id") != F.col("b_id")) | (F.col("a_plot") < F.col("b_plot")))


NEIGHBOR_REACH = 50.0


def relate(pairs: DataFrame) -> DataFrame:
    """Topological relation, distance, shared length and overlap area of polygon pairs.

    Pairs come with ``common`` and ``boxes`` as ``shape_pairs`` makes them.
    """
    eps = 1e-9
    areas = once(pairs, overlap=_overlap(), a_area=R.ring_area("a_ring"), b_area=R.ring_area("b_ring"))
    o, tol = F.col("overlap"), lambda area: area * (1.0 - eps)
    touching = F.when(o <= eps, R.shared_length("a_ring", "b_ring"))
    common = R.ring_length(
        F.when(R.is_convex("b_ring"), R.clip_by_convex("a_ring", "b_ring")).otherwise(R.clip_by_convex("b_ring", "a_ring"))
    )
    relation = (
        F.when(o >= tol(F.col("b_area")), "CONTAINS").when(o >= tol(F.col("a_area")), "INSIDE")
        .when(o > 1.0, "OVERLAPS").when((o > eps) & (F.col("shared_len") > 0.1), "SHARED_EDGE").when(o > eps, "INTERSECTS")
        .when(F.col("distance") == 0, "TOUCHES").when(F.col("distance") < NEIGHBOR_REACH, "NEIGHBOR").otherwise("DISJOINT")
    )
    w, h, boxes = F.col("common.w"), F.col("common.h"), F.col("boxes")
    side = lambda v: F.greatest(v, F.lit(0.0))
    apart = F.when(boxes, _straight(side(-w), side(-h))).otherwise(R.ring_distance("a_ring", "b_ring"))
    measured = once(areas, distance=F.when(o > 0, F.lit(0.0)).otherwise(floor_round(apart)))
    flat = F.when(o > 0, (w + h) * 2.0).otherwise(F.greatest(side(w), side(h)))
    lengths = once(
        measured, shared_len=floor_round(F.when(F.col("distance") > 0, 0.0).when(boxes, flat).otherwise(F.coalesce(touching, common)))
    )
    return once(lengths, relation=relation).withColumn("overlap_area", floor_round(o))


def relationship_graph(prims: DataFrame, cell: float = VIEW_CELL) -> DataFrame:
    """Directed edges between distinct shapes of a drawing: containment both ways, others once.

    ``n_pairs`` is the number of row pairs an edge stands for (1 without copies).
    """
    shapes = shape_classes(prims)
    cross = shape_pairs(shapes, NEIGHBOR_REACH, cell).withColumn("n_pairs", F.col("a_copies") * F.col("b_copies"))
    own = shapes.filter(F.col("copies") > 1).select(
        "project_id", F.col("shape_id").alias("a_id"), F.col("shape_id").alias("b_id"), F.col("ring").alias("a_ring"), F.col("ring").alias("b_ring"),
        R.box_common(F.col("bbox"), F.col("bbox")).alias("common"), F.col("is_box").alias("boxes"),
        F.floor(F.col("copies") * (F.col("copies") - 1) / 2).alias("n_pairs"),
    )
    rel = relate(cross.drop("a_copies", "b_copies").unionByName(own)).filter(F.col("relation") != "DISJOINT")
    holds = F.col("relation").isin("CONTAINS", "INSIDE")
    edge = lambda s, t, r: F.struct(F.col(s).alias("src"), F.col(t).alias("dst"), r.alias("relation"))
    back = F.when(F.col("relation") == "CONTAINS", "INSIDE").otherwise("CONTAINS")
    both = F.array(edge("a_id", "b_id", F.col("relation")), edge("b_id", "a_id", back))
    once = F.array(edge("a_id", "b_id", F.col("relation")))
    return rel.withColumn("e", F.explode(F.when(holds, both).otherwise(once))).select(
        "project_id", "e.src", "e.dst", "e.relation", "distance", "shared_len", "overlap_area", "n_pairs"
    )


def expand_edges(edges: DataFrame, prims: DataFrame) -> DataFrame:
    """Edges between distinct shapes given to every row of a shape; as long as the list of row pairs is.

    An edge of a shape with itself joins its copies, each ordered pair once.
    """
    shapes = prims.groupBy("project_id", "ring").agg(F.min("plot_id").alias("shape_id"))
    members = prims.join(shapes, ["project_id", "ring"]).select("project_id", "shape_id", "plot_id")
    a = members.select("project_id", F.col("shape_id").alias("src"), F.col("plot_id").alias("__a"))
    b = members.select("project_id", F.col("shape_id").alias("dst"), F.col("plot_id").alias("__b"))
    wide = edges.join(a, ["project_id", "src"]).join(b, ["project_id", "dst"])
    own = F.col("src") == F.col("dst")
    back = F.col("relation") == "INSIDE"
    kept = wide.filter(~own | F.when(back, F.col("__a") > F.col("__b")).otherwise(F.col("__a") < F.col("__b")))
    return kept.select("project_id", F.col("__a").alias("src"), F.col("__b").alias("dst"), *[c for c in edges.columns if c not in ("project_id", "src", "dst", "n_pairs")])


def relationship_counts(edges: DataFrame) -> DataFrame:
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n_pairs"))), F.lit(0))
    r = F.col("relation")
    return edges.groupBy("project_id").agg(
        n(r == "CONTAINS").alias("contains"),
        n(r.isin("TOUCHES", "SHARED_EDGE", "OVERLAPS", "INTERSECTS")).alias("intersects"),
        n(r.isin("TOUCHES", "SHARED_EDGE")).alias("touches"),
        n(r.isin("TOUCHES", "SHARED_EDGE")).alias("shared_edge"),
        n(r == "NEIGHBOR").alias("neighbor"),
    )


def neighbours(edges: DataFrame, relations: list[str] = ("SHARED_EDGE", "TOUCHES", "OVERLAPS", "NEIGHBOR")) -> DataFrame:
    """Sorted neighbour list of every shape; a list is as long as its neighbourhood."""
    kept = edges.filter(F.col("relation").isin(*relations))
    flipped = kept.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return kept.select("project_id", "src", "dst").unionByName(flipped).filter(F.col("src") != F.col("dst")).groupBy(
        "project_id", F.col("src").alias("plot_id")
    ).agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def road_adjacency(edges: DataFrame, roads: DataFrame) -> DataFrame:
    ids = roads.select("project_id", "road_id").distinct()
    a = ids.withColumnRenamed("road_id", "src")
    b = ids.withColumnRenamed("road_id", "dst")
    inside = edges.join(a, ["project_id", "src"], "left_semi").join(b, ["project_id", "dst"], "left_semi")
    return neighbours(inside, ["CONTAINS", "INSIDE", "SHARED_EDGE", "TOUCHES", "OVERLAPS", "INTERSECTS", "NEIGHBOR"]).withColumnRenamed("plot_id", "road_id")


def within_distance(plots: DataFrame, roads: DataFrame, reach: float, cell: float = VIEW_CELL) -> DataFrame:
    """Distinct plot shapes that come within ``reach`` of some road of their project."""
    p = grid_cells(shape_classes(plots), cell, reach=reach)
    lanes = once(roads.select("project_id", F.col("ring").alias("road_ring")), road_box=R.bbox("road_ring"))
    r = grid_cells(once(lanes, road_is_box=R.is_box("road_ring", "road_box")), cell, "road_box")
    near = p.join(r.hint("merge"), ["project_id", "cx", "cy"]).filter(R.boxes_overlap(F.col("bbox"), F.col("road_box"), reach))
    common = R.box_common(F.col("bbox"), F.col("road_box"))
    flat = R.let(common, lambda c: _straight(F.greatest(-c["w"], F.lit(0.0)), F.greatest(-c["h"], F.lit(0.0))))
    gap = F.when(F.col("is_box") & F.col("road_is_box"), flat).otherwise(R.ring_distance("ring", "road_ring"))
    return once(near, gap=gap).filter(F.col("gap") <= reach).select("project_id", "ring").distinct()


def no_road_access(plots: DataFrame, roads: DataFrame, reach: float = 5.0) -> DataFrame:
    """Plots with neither a road within reach nor a road name, in projects that have roads."""
    named = F.coalesce("road_name", F.lit("")) != "" if "road_name" in plots.columns else F.lit(False)
    has_roads = plots.join(roads.select("project_id").distinct(), "project_id", "left_semi")
    return has_roads.filter(~named).join(within_distance(plots, roads, reach), ["project_id", "ring"], "left_anti")


def segment_crossings(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Crossing points of segments (x1,y1,x2,y2) of two sides that share ``keys``."""
    l, r = a.alias("l"), b.alias("r")
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    p = l.join(r, on)
    c = lambda s, n: F.col(f"{s}.{n}")
    ux, uy = c("l", "x2") - c("l", "x1"), c("l", "y2") - c("l", "y1")
    vx, vy = c("r", "x2") - c("r", "x1"), c("r", "y2") - c("r", "y1")
    det = F.nullif(ux * vy - uy * vx, F.lit(0.0))
    wx, wy = c("r", "x1") - c("l", "x1"), c("r", "y1") - c("l", "y1")
    t, u = (wx * vy - wy * vx) / det, (wx * uy - wy * ux) / det
    return p.filter((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).select(
        *[c("l", k).alias(k) for k in keys], c("l", "id").alias("a_id"), c("r", "id").alias("b_id"),
        (c("l", "x1") + t * ux).alias("x"), (c("l", "y1") + t * uy).alias("y"),
    )


def path_cells(segs: DataFrame, cell: float) -> DataFrame:
    """A row per grid cell that a segment (x1,y1,x2,y2) passes or comes next to: strip by strip, so their number grows with its length."""
    near = cell * 1e-6
    x0, x1 = F.least("x1", "x2"), F.greatest("x1", "x2")
    strips = segs.withColumn("cx", F.explode(F.sequence(_cell(x0 - near, cell), _cell(x1 + near, cell))))
    slope = (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0))
    at = lambda x: F.col("y1") + slope * (F.least(F.greatest(x, x0), x1) - F.col("x1"))
    ya, yb = at(F.col("cx") * cell - near), at((F.col("cx") + 1) * cell + near)
    low = F.coalesce(F.least(ya, yb), F.least("y1", "y2")) - near
    high = F.coalesce(F.greatest(ya, yb), F.greatest("y1", "y2")) + near
    return strips.withColumn("cy", F.explode(F.sequence(_cell(low, cell), _cell(high, cell))))


def road_intersections(roads: DataFrame, cell: float = VIEW_CELL) -> DataFrame:
    """Distinct crossing points of the road centerlines of a project, two decimals.

    Segments meet in the cells they pass; a crossing belongs to the cell it lies in.
    """
    segs = roads.select("project_id", F.col("road_id").alias("id"), F.explode(R.path_segments("centerline")).alias("s")).select("project_id", "id", "s.*")
    cells = path_cells(segs, cell)
    hits = segment_crossings(cells, cells, ["project_id", "cx", "cy"]).filter(F.col("a_id") < F.col("b_id"))
    own = hits.filter((_cell(F.col("x"), cell) == F.col("cx")) & (_cell(F.col("y"), cell) == F.col("cy")))
    return own.select("project_id", floor_round("x").alias("x"), floor_round("y").alias("y")).distinct()


# fixed values: compass points in turn order
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def nearest_road_edge(plots: DataFrame, roads: DataFrame, cutoff: float = 500.0) -> DataFrame:
    """Nearest road line of every distinct plot shape, within ``cutoff`` of its rim.

    Plot boxes are widened to the cut-off and matched with road segments by grid cell.
    """
    lines = roads.filter(F.size("centerline") >= 2).select("project_id", "road_id", "ord", "centerline", R.bbox("centerline").alias("road_box"))
    shapes = grid_cells(shape_classes(plots), cutoff, reach=cutoff)
    near = shapes.join(grid_cells(lines, cutoff, "road_box").hint("merge"), ["project_id", "cx", "cy"]).filter(
        R.boxes_overlap(F.col("bbox"), F.col("road_box"), cutoff)
    )
    best = once(near, dist=R.ring_line_distance("ring", "centerline")).filter(F.col("dist") <= cutoff).groupBy("project_id", "ring").agg(
        F.min(F.struct("dist", "ord", "road_id", "centerline")).alias("b")
    )
    return best.select("project_id", "ring", "b.road_id", "b.centerline", F.col("b.dist").alias("distance"))


def facing8(plots: DataFrame, roads: DataFrame, rotation: Column | DataFrame | float = 0.0) -> DataFrame:
    """Eight-way facing: outward normal of the road-side edge, turned by the site rotation.

    ``rotation`` is one angle, a column, or a table (project_id, rotation).
    """
    turns = rotation if isinstance(rotation, DataFrame) else None
    turn = F.coalesce("rotation", F.lit(0.0)) if turns is not None else F.lit(float(rotation)) if isinstance(rotation, (int, float)) else rotation

    def rank(e, line):
        mid_x, mid_y = (e["x1"] + e["x2"]) / 2.0, (e["y1"] + e["y2"]) / 2.0
        edge_gap = F.array_min(F.transform(R.path_segments(line), lambda s: R.segment_distance(e, s)))
        mid_gap = F.array_min(F.transform(R.path_segments(line), lambda s: R.point_segment_distance(mid_x, mid_y, s)))
        return F.struct((edge_gap + mid_gap * 0.001).alias("k"), e.alias("e"))

    ranked = F.transform(R.edges("ring"), lambda e, i: F.struct(rank(e, F.col("centerline")).alias("r"), i.alias("i")))
    best = F.array_min(F.transform(ranked, lambda v: F.struct(v["r"]["k"].alias("k"), v["i"].alias("i"), v["r"]["e"].alias("e"))))
    shapes = once(nearest_road_edge(plots, roads), e=best["e"], c=R.area_centroid("ring"))
    if turns is not None:
        shapes = shapes.join(turns, "project_id", "left")
    e, c = F.col("e"), F.col("c")
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    inward = -dy * (c["x"] - (e["x1"] + e["x2"]) / 2.0) + dx * (c["y"] - (e["y1"] + e["y2"]) / 2.0) > 0
    sign = F.when(inward, -1.0).otherwise(1.0)
    azimuth = F.pmod(F.degrees(F.atan2(-dy * sign, -(dx * sign))) + turn + 360.0, F.lit(360.0))
    index = F.pmod(F.rint(azimuth / 45.0).cast("int"), F.lit(8))
    facing = F.get(F.array(*map(F.lit, COMPASS)), index)
    known = shapes.select("project_id", "ring", facing.alias("facing8"), "road_id")
    return plots.join(known, ["project_id", "ring"], "left").withColumn("facing8", F.coalesce("facing8", F.lit("UNKNOWN")))


def snap_points(points: DataFrame, vertices: DataFrame, tolerance: float = 12.0, grid: float = 8.0) -> DataFrame:
    """Snap to the nearest model vertex within tolerance, else to the grid."""
    at = vertices.groupBy("project_id", F.col("x").alias("tx"), F.col("y").alias("ty")).agg(F.min("ord").alias("ord"))
    # a vertex goes by its place: the nearest needs no finding again
    near = spot_nearest(_spots(points), at.withColumn("plot_id", F.struct("tx", "ty")), tolerance).filter(F.col("near.ord").isNotNull())
    at = near.select("project_id", "x", "y", F.col("near.plot_id.tx").alias("tx"), F.col("near.plot_id.ty").alias("ty"))
    on_grid = lambda c: F.floor(F.col(c) / grid + 0.5) * grid
    return points.hint("merge").join(at, ["project_id", "x", "y"], "left").withColumn(
        "snapped", F.col("tx").isNotNull()
    ).withColumn("sx", F.coalesce("tx", on_grid("x"))).withColumn("sy", F.coalesce("ty", on_grid("y"))).drop("tx", "ty")
