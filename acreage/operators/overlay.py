"""Union, intersection and difference area of sets of polygons by a plane sweep in DataFrames.

Polygons are clipped to square tiles, so the work of one group spreads over (group, tile)
keys and a tile holds only what lies there; a tile with many edges is split by their counts
before any two of them meet. Inside a tile the x of all edge ends and crossings
cut the plane into slabs in which no edges cross; along a slab the running winding numbers of
side A and side B say which stretches belong to A, to B, to both. Groups with few edges, of which
there may be very many, are gathered into one row each and swept there, by the same steps on arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions import rings as R
from acreage.functions import slabs
from acreage.session import cut, once


#: Edges a tile may hold before it is split in four, and how often a tile is split at most: edges through one point stay together.
TILE_EDGES, TILE_SPLITS = 2048, 12


def dense_tiles(rings: DataFrame, keys: list[str], tile: float, most: int = TILE_EDGES) -> DataFrame:
    """``rings`` (keys, ring, bbox) by the tiles they meet: cx, cy and tile, the tile's side, which is halved where edges are many."""
    from acreage.operators.spatial import grid_cells

    def counted(rows: DataFrame) -> DataFrame:
        x0, y0 = F.col("cx") * F.col("tile"), F.col("cy") * F.col("tile")
        x1, y1 = x0 + F.col("tile"), y0 + F.col("tile")
        here = lambda e: (F.least(e["x1"], e["x2"]) <= x1) & (F.greatest(e["x1"], e["x2"]) >= x0) & (F.least(e["y1"], e["y2"]) <= y1) & (F.greatest(e["y1"], e["y2"]) >= y0)
        meets = (F.col("bbox.minX") <= x1) & (F.col("bbox.maxX") >= x0) & (F.col("bbox.minY") <= y1) & (F.col("bbox.maxY") >= y0)
        return rows.filter(meets).withColumn("n", F.size(F.filter(R.edges("ring"), here)))

    on = [*keys, "cx", "cy", "tile"]
    rows, settled = counted(grid_cells(rings, tile).withColumn("tile", F.lit(float(tile)))), None
    for _ in range(TILE_SPLITS):
        full = cut(rows.groupBy(*on).agg(F.sum("n").alias("edges")).filter(F.col("edges") > most).select(*[F.col(c).alias(f"f_{c}") for c in on]))
        if full.isEmpty():
            break
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
        done = rows.join(full, same, "left_anti").drop("n")
        settled = done if settled is None else settled.unionByName(done)
        quarter = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("q")
        parts = rows.join(full, same, "left_semi").drop("n").select("*", quarter)
        rows = cut(counted(parts.withColumn("cx", F.col("cx") * 2 + F.col("q.i")).withColumn("cy", F.col("cy") * 2 + F.col("q.j")).withColumn("tile", F.col("tile") / 2).drop("q")))
    rows = rows.drop("n")
    return rows if settled is None else settled.unionByName(rows)


#: Vertices a group may hold, copies counted, to be swept in one row.
GROUP_POINTS = 256


def sweep_areas(polys: DataFrame, keys: list[str], tile: float = 256.0, most: int = TILE_EDGES, row_points: int = GROUP_POINTS) -> DataFrame:
    """Areas per group of rows (``side`` 'A' or 'B', ``ring``): union, A, B, A∩B, A\\B.

    Groups of up to ``row_points`` vertices are swept in a row each, larger ones tile by tile.
    """
    known = polys.select(*keys, "side", "ring").dropna(subset=keys)
    sizes = known.groupBy(*keys).agg(F.sum(F.size("ring")).alias("n"))
    large = cut(sizes.filter(F.col("n") > row_points).select(*keys))
    if large.isEmpty():
        return _sweep_rows(known, keys)
    large = large.hint("merge")
    return _sweep_rows(known.join(large, keys, "left_anti"), keys).unionByName(_sweep_tiles(known.join(large, keys, "left_semi"), keys, tile, most))


def _sweep_rows(polys: DataFrame, keys: list[str]) -> DataFrame:
    """Areas of groups with few edges: the spans of a group become one row's list."""
    fields = polys.select(*keys).schema.fields
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], *[f"{a} double" for a in slabs.AREAS]])
    # rings travel, being smaller than their spans
    gathered = polys.groupBy(*keys).agg(F.collect_list(F.struct("side", "ring")).alias("rings"))
    one = F.flatten(F.transform("rings", lambda o: _weighted_spans(o["side"], o["ring"])))
    rows = gathered.select(*keys, one.alias("spans")).filter(F.size("spans") > 0)
    return rows.mapInArrow(lambda batches: (slabs.sweep_batch(keys, b) for b in batches), schema).filter("union_area > 0")


def _weighted_spans(side, ring):
    weight = lambda name, e: F.when(side == name, e["s"]).otherwise(0.0)
    return F.transform(R._spans(ring), lambda e: F.struct(
        e["xl"].alias("l"), e["xr"].alias("r"), e["yl"].alias("ly"), e["yr"].alias("ry"), weight("A", e).alias("wa"), weight("B", e).alias("wb")
    ))


def clear_areas(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and clear_area: what a row's ``ring`` shares with its list ``within`` off its list ``off``, all in the row."""
    sides = [(F.array("ring"), "wa"), (F.col("off"), "wb"), (F.col("within"), "wc")]

    def spans(rings, side):
        weight = lambda e, name: (e["s"] if name == side else F.lit(0.0)).alias(name)
        span = lambda e: F.struct(e["xl"].alias("l"), e["xr"].alias("r"), e["yl"].alias("ly"), e["yr"].alias("ry"), *[weight(e, w) for w in ("wa", "wb", "wc")])
        return F.flatten(F.transform(rings, lambda r: F.transform(R._spans(r), span)))

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields], *[f"{a} double" for a in slabs.CLEAR]])
    listed = rows.select(*keep, F.concat(*[spans(*side) for side in sides]).alias("spans"))
    return listed.mapInArrow(lambda batches: (slabs.sweep_batch(keep, b, slabs.CLEAR_PARTS, slabs.CLEAR) for b in batches), schema)


def _sweep_tiles(polys: DataFrame, keys: list[str], tile: float, most: int) -> DataFrame:
    distinct = once(polys.select(*keys, "side", "ring").distinct(), bbox=R.bbox("ring"))
    tiles = dense_tiles(distinct, keys, tile, most)
    side = F.col("tile")
    x0, y0 = F.col("cx") * side, F.col("cy") * side
    b = F.col("bbox")
    whole = (b["minX"] >= x0) & (b["maxX"] <= x0 + side) & (b["minY"] >= y0) & (b["maxY"] <= y0 + side)
    part = F.when(whole, F.col("ring")).otherwise(R.clip_by_convex("ring", R.box_ring(x0, y0, x0 + side, y0 + side)))
    on = [*keys, "cx", "cy", "tile"]
    spans = once(tiles, part=part).select(*on, "side", F.explode(R._spans("part")).alias("e")).select(*on, "side", "e.*")
    weight = lambda side: F.sum(F.when(F.col("side") == side, F.col("s")).otherwise(0.0))
    clipped = (
        spans.groupBy(*on, F.col("xl").alias("l"), F.col("xr").alias("r"), F.col("yl").alias("ly"), F.col("yr").alias("ry"))
        .agg(weight("A").alias("wa"), weight("B").alias("wb")).filter((F.col("wa") != 0) | (F.col("wb") != 0))
    )
    clipped = cut(clipped)  # read four times below
    slanted = clipped.filter(F.col("ly") != F.col("ry"))
    p = slanted.select(*on, *[F.col(c).alias(f"p{c}") for c in ("l", "r", "ly", "ry")]).join(
        clipped.select(*on, *[F.col(c).alias(f"q{c}") for c in ("l", "r", "ly", "ry")]), on
    )
    mp = (F.col("pry") - F.col("ply")) / (F.col("pr") - F.col("pl"))
    mq = (F.col("qry") - F.col("qly")) / (F.col("qr") - F.col("ql"))
    x = (F.col("qly") - mq * F.col("ql") - F.col("ply") + mp * F.col("pl")) / F.nullif(mp - mq, F.lit(0.0))
    crossing = p.withColumn("x", x).filter(
        (F.col("x") > F.greatest("pl", "ql")) & (F.col("x") < F.least("pr", "qr"))
    ).select(*on, "x")
    ends = clipped.select(*on, F.explode(F.array("l", "r")).alias("x"))
    cuts = ends.unionByName(crossing).distinct()
    slabs = cuts.withColumn("x2", F.lead("x").over(Window.partitionBy(*on).orderBy("x"))).filter(F.col("x2").isNotNull())
    inside = slabs.join(clipped, on).filter((F.col("l") <= F.col("x")) & (F.col("r") >= F.col("x2")))
    mid = (F.col("x") + F.col("x2")) / 2.0
    at = F.col("ly") + (F.col("ry") - F.col("ly")) * (mid - F.col("l")) / (F.col("r") - F.col("l"))
    lined = inside.withColumn("y", at)
    # going up, an edge with sign -1 is a lower rim: it adds one to the winding number
    up = Window.partitionBy(*on, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    step = lined.groupBy(*on, "x", "x2", "y").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    wound = step.withColumn("a", -F.sum("wa").over(up)).withColumn("b", -F.sum("wb").over(up)).withColumn(
        "y2", F.lead("y").over(Window.partitionBy(*on, "x").orderBy("y"))
    )
    area = (F.col("x2") - F.col("x")) * (F.col("y2") - F.col("y"))
    a, b = F.col("a") > 0.5, F.col("b") > 0.5
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, area)), F.lit(0.0))
    return wound.filter(F.col("y2").isNotNull()).groupBy(*keys).agg(
        pick(a | b).alias("union_area"), pick(a).alias("a_area"), pick(b).alias("b_area"),
        pick(a & b).alias("both_area"), pick(a & ~b).alias("a_only_area"),
    )


def union_area(polys: DataFrame, keys: list[str], tile: float = 256.0) -> DataFrame:
    """Dissolved area of the polygons of each group."""
    return sweep_areas(polys.withColumn("side", F.lit("A")), keys, tile).select(*keys, "union_area")


def inset_areas(rings: DataFrame, keys: list[str], distance: float, taken: DataFrame | None = None) -> DataFrame:
    """keys, inset: the area of each row's ``ring`` that is ``distance`` or more inside its rim, less the ``taken`` rings of its keys.

    A convex ring is clipped by its own moved edges. Off a concave one the sweep takes the bands along its rim, with the same rings.
    """
    known = once(rings.select(*keys, "ring"), convex=R.is_convex("ring"))
    flat = once(known.filter("convex"), inner=R.inset_clip("ring", "ring", F.lit(float(distance))))
    bent = known.filter("not convex")
    if taken is None and bent.isEmpty():
        return flat.select(*keys, R.ring_area("inner").alias("inset"))
    bands = bent.select(*keys, F.explode(R.rim_bands("ring", float(distance))).alias("ring"))
    side = lambda df, name, ring="ring": df.select(*keys, F.lit(name).alias("side"), F.col(ring).alias("ring"))
    off = side(bands, "B") if taken is None else side(bands, "B").unionByName(side(taken, "B"))
    if taken is None:
        clipped = flat.select(*keys, R.ring_area("inner").alias("inset"))
        swept = sweep_areas(side(bent, "A").unionByName(off), keys)
    else:
        clipped = None
        swept = sweep_areas(side(bent, "A").unionByName(side(flat.filter(R.ring_area("inner") > 0), "A", "inner")).unionByName(off), keys)
    swept = swept.select(*keys, F.col("a_only_area").alias("inset"))
    return swept if clipped is None else clipped.unionByName(swept)


def set_iou(a: DataFrame, b: DataFrame, keys: list[str], tile: float = 256.0) -> DataFrame:
    """IoU of two dissolved sets; 0 when both are empty."""
    both = a.select(*keys, F.lit("A").alias("side"), "ring").unionByName(b.select(*keys, F.lit("B").alias("side"), "ring"))
    s = sweep_areas(both, keys, tile)
    return s.withColumn("iou", F.coalesce(F.col("both_area") / F.nullif("union_area", F.lit(0.0)), F.lit(0.0)))


def iou(a, b):
    """IoU of two polygons as a column."""
    common = R.overlap_area(a, b)
    return R.let(
        F.struct(common.alias("i"), (R.ring_area(a) + R.ring_area(b)).alias("t")),
        lambda v: F.when(v["t"] - v["i"] > 0, v["i"] / (v["t"] - v["i"])).otherwise(0.0),
    )


def overlap_with_set(plots: DataFrame, others: DataFrame, cell: float = 500.0) -> DataFrame:
    """Area each distinct plot shape shares with the dissolved ``others`` of its project.

    One overlapping polygon needs no dissolving: the pair's own area is exact. Only shapes
    that meet several go through the sweep, keyed by the shape.
    """
    from acreage.operators.spatial import grid_cells, shape_classes

    p = grid_cells(shape_classes(plots), cell)
    o = others.select("project_id", F.col("ring").alias("o_ring")).distinct()
    o = once(o, o_box=R.bbox("o_ring"))
    o = once(o, o_is_box=R.is_box("o_ring", "o_box"))
    first_x = F.floor(F.greatest(F.col("bbox.minX"), F.col("o_box.minX")) / cell)
    first_y = F.floor(F.greatest(F.col("bbox.minY"), F.col("o_box.minY")) / cell)
    met = p.join(grid_cells(o, cell, "o_box").hint("merge"), ["project_id", "cx", "cy"]).filter(
        R.boxes_overlap(F.col("bbox"), F.col("o_box")) & (first_x == F.col("cx")) & (first_y == F.col("cy"))
    )
    flat = R.let(
        R.box_common(F.col("bbox"), F.col("o_box")), lambda c: F.greatest(c["w"], F.lit(0.0)) * F.greatest(c["h"], F.lit(0.0))
    )
    common = F.when(F.col("is_box") & F.col("o_is_box"), flat).otherwise(R.overlap_area("ring", "o_ring"))
    # read three times below: written once, with only the columns needed
    met = cut(once(met, common=common).filter(F.col("common") > 0).select("project_id", "shape_id", "ring", "o_ring", "common"))
    counted = met.groupBy("project_id", "shape_id").agg(F.count(F.lit(1)).alias("n"), F.max("common").alias("one"))
    keys = ["project_id", "shape_id"]
    crowded = cut(counted.filter(F.col("n") > 1).select(*keys))
    if crowded.isEmpty():
        return counted.select(*keys, F.col("one").alias("common"))
    several = met.join(crowded.hint("merge"), keys)
    rows = several.select(*keys, F.lit("A").alias("side"), "ring").unionByName(
        several.select(*keys, F.lit("B").alias("side"), F.col("o_ring").alias("ring"))
    )
    swept = sweep_areas(rows, keys).select(*keys, "both_area")
    return counted.join(swept.hint("merge"), keys, "left").select(*keys, F.coalesce("both_area", "one").alias("common"))


#: Points a slice of a hull holds on average.
HULL_SLICE = 256


def convex_hull(points: DataFrame, keys: list[str]) -> DataFrame:
    """Convex hull of each group's points as a ring.

    Only the lowest and the highest point of an x can be a corner, and none strictly inside the octagon of the outermost points in
    eight directions. What is left is dealt into slices of about HULL_SLICE points, whose hulls are dealt again, until a group fits
    a slice or nearly all its points are corners, so no list grows with the group but the hull itself.
    """
    rims = points.groupBy(*keys, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    outer = cut(rims.select(*keys, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y")))
    p, x, y = F.struct("x", "y"), F.col("x"), F.col("y")
    around = [F.min_by(p, x), F.min_by(p, x + y), F.min_by(p, y), F.max_by(p, x - y), F.max_by(p, x), F.max_by(p, x + y), F.max_by(p, y), F.min_by(p, x - y)]
    far = outer.groupBy(*keys).agg(*[c.alias(f"o{i}") for i, c in enumerate(around)])
    far = far.select(*[F.col(k).alias(f"__{k}") for k in keys], *[f"o{i}" for i in range(8)])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = F.lit(True)
    for i in range(8):
        a, b = F.col(f"o{i}"), F.col(f"o{(i + 1) % 8}")
        left = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        inside = inside & ((a == b) | (left > 0))
    left = cut(outer.join(far, same).filter(~inside).select(*keys, "x", "y"))
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total, largest = sizes.agg(F.sum("n"), F.max("n")).first()
    while largest is not None and largest > 2 * HULL_SLICE:
        parts = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("n") / HULL_SLICE).alias("__parts"))
        dealt = left.join(parts, same).withColumn("__slice", F.pmod(F.xxhash64("x", "y"), F.col("__parts")))
        hulls = dealt.groupBy(*keys, "__slice").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("pts"))
        left = cut(hulls.select(*keys, F.explode(_chain("pts")).alias("p")).select(*keys, "p.x", "p.y"))
        sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        before, (total, largest) = total, sizes.agg(F.sum("n"), F.max("n")).first()
        if total > 0.9 * before:
            break
    corners = left.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("pts"))
    return corners.select(*keys, _chain("pts").alias("ring"))


def _chain(pts):
    """Monotone chain over sorted points: lower hull, then upper hull."""

    def half(sequence):
        def push(stack, p):
            def keep(s):
                n = F.size(s)
                o, q = F.get(s, n - 2), F.get(s, n - 1)
                turn = (q["x"] - o["x"]) * (p["y"] - o["y"]) - (q["y"] - o["y"]) * (p["x"] - o["x"])
                return F.when((n >= 2) & (turn <= 0), F.slice(s, F.lit(1), n - 1)).otherwise(s)

            # drop points from the top while they do not turn left; the stack shrinks at most to one
            popped = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(stack), F.lit(1))), stack, lambda s, _: keep(s))
            return F.concat(popped, F.array(p))

        return F.aggregate(sequence, F.array().cast(R.RING), push)

    def join_halves(s):
        lower, upper = half(s), half(F.reverse(s))
        cut = lambda h: F.filter(h, lambda p, i: i < F.size(h) - 1)
        return F.concat(R.let(lower, cut), R.let(upper, cut))

    return R.let(F.col(pts) if isinstance(pts, str) else pts, lambda s: F.when(F.size(s) >= 3, join_halves(s)).otherwise(s))
