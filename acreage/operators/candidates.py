"""Parts of candidate layouts on rectangular parcels: feasibility, roads, zones, plots. ``operators.generate`` sweeps them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.functions.rings import floor_round, let
from acreage.session import first_per_key, once

# fixed values: road widths and block depth
MAIN_ROAD_FT, FEEDER_ROAD_FT, BLOCK_DEPTH_FT = 39.37, 29.53, 85.0

def feasible(parcels: DataFrame) -> DataFrame:
    """Is there room for a plot, its setbacks and a road? Adds the need and the reason."""
    need = F.col("min_plot_sqft") * 2.5 + F.col("feeder_ft") * F.col("min_frontage_ft")
    reason = F.concat(F.lit("Insufficient usable land area: needs "), F.floor(need + 0.5).cast("string"), F.lit(" sqft."))
    return parcels.withColumn("needed_sqft", need).withColumn("is_feasible", F.col("gross_sqft") >= need).withColumn(
        "reason", F.when(F.col("gross_sqft") < need, reason)
    )


def corridor(x1, y1, x2, y2, width) -> Column:
    """Rectangle of a given width along a segment."""
    c = lambda v: F.col(v) if isinstance(v, str) else v
    x1, y1, x2, y2, width = map(c, (x1, y1, x2, y2, width))
    length = F.hypot(x2 - x1, y2 - y1)
    n = F.struct(
        F.coalesce(-(y2 - y1) / F.nullif(length, F.lit(0.0)) * (width / 2.0), F.lit(0.0)).alias("x"),
        F.coalesce((x2 - x1) / F.nullif(length, F.lit(0.0)) * (width / 2.0), F.lit(0.0)).alias("y"),
    )
    return let(
        n,
        lambda d: F.array(
            R.point(x1 + d["x"], y1 + d["y"]), R.point(x2 + d["x"], y2 + d["y"]),
            R.point(x2 - d["x"], y2 - d["y"]), R.point(x1 - d["x"], y1 - d["y"]),
        ),
    )


def entry_points(parcels: DataFrame) -> DataFrame:
    """Entry on a side at an offset; the middle of the south side when none is given."""
    e = F.col("e")
    edge = F.upper(F.coalesce(e["edge"], F.lit("SOUTH")))
    off = F.coalesce(e["offset_pct"], F.lit(50.0)) / 100.0
    b = F.col("bbox")
    along_x, along_y = b["minX"] + (b["maxX"] - b["minX"]) * off, b["minY"] + (b["maxY"] - b["minY"]) * off
    x = F.when(edge.isin("SOUTH", "NORTH"), along_x).when(edge == "WEST", b["minX"]).otherwise(b["maxX"])
    y = F.when(edge == "SOUTH", b["minY"]).when(edge == "NORTH", b["maxY"]).otherwise(along_y)
    return parcels.withColumn("e", F.explode_outer("entries")).withColumn("edge", edge).withColumn("x", x).withColumn("y", y).withColumn(
        "width_ft", F.coalesce(e["width_ft"], F.lit(30.0))
    ).drop("e")


def grid_roads(parcels: DataFrame, main_ft: float = MAIN_ROAD_FT, feeder_ft: float = FEEDER_ROAD_FT, block_ft: float = BLOCK_DEPTH_FT) -> DataFrame:
    """Spine and feeders of an orthogonal grid in a parcel box (0,0)–(width_ft, depth_ft).

    Wide parcels have a spine across and feeders down, the others the reverse.
    """
    w, h = F.col("width_ft"), F.col("depth_ft")
    wide = w >= h * 1.35
    n = F.greatest(F.lit(1), F.floor(F.when(wide, w).otherwise(h) / block_ft).cast("int") - 1)
    slots = parcels.withColumn("wide", wide).withColumn("n_feeders", n).withColumn("i", F.explode(F.sequence(F.lit(0), n)))
    main = F.col("i") == 0
    run = F.when(F.col("wide"), w).otherwise(h)
    cross = F.when(F.col("wide"), h).otherwise(w)
    at = F.when(main, cross * 0.5).otherwise(run * F.col("i") / (F.col("n_feeders") + 1))
    half = F.when(main, main_ft).otherwise(feeder_ft) / 2.0
    limit = F.when(main, cross).otherwise(run)
    lo, hi = F.greatest(F.lit(0.0), at - half), F.least(limit, at + half)
    across = F.col("wide") == main  # the road runs along x
    return slots.select(
        *parcels.columns, F.when(main, "MAIN").otherwise("FEEDER").alias("road_type"), F.col("i").alias("road_no"), F.col("n_feeders"),
        F.when(across, 0.0).otherwise(lo).alias("x0"), F.when(across, lo).otherwise(0.0).alias("y0"),
        F.when(across, w).otherwise(hi).alias("x1"), F.when(across, hi).otherwise(h).alias("y1"),
        F.when(main, main_ft).otherwise(feeder_ft).alias("road_width_ft"),
    )


def grid_blocks(parcels: DataFrame, main_ft: float = MAIN_ROAD_FT, feeder_ft: float = FEEDER_ROAD_FT, block_ft: float = BLOCK_DEPTH_FT) -> DataFrame:
    """Rectangles left between the spine and the feeders."""
    w, h = F.col("width_ft"), F.col("depth_ft")
    wide = w >= h * 1.35
    run, cross = F.when(wide, w).otherwise(h), F.when(wide, h).otherwise(w)
    n = F.greatest(F.lit(1), F.floor(run / block_ft).cast("int") - 1)
    step = run / (n + 1)
    df = parcels.withColumn("wide", wide).withColumn("i", F.explode(F.sequence(F.lit(0), n))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    a0 = F.when(F.col("i") == 0, 0.0).otherwise(step * F.col("i") + feeder_ft / 2.0)
    a1 = F.when(F.col("i") == n, run).otherwise(step * (F.col("i") + 1) - feeder_ft / 2.0)
    b0 = F.when(F.col("side") == 0, 0.0).otherwise(cross * 0.5 + main_ft / 2.0)
    b1 = F.when(F.col("side") == 0, cross * 0.5 - main_ft / 2.0).otherwise(cross)
    out = df.select(
        *parcels.columns, (F.col("i") * 2 + F.col("side")).alias("block_no"),
        F.when(F.col("wide"), a0).otherwise(b0).alias("x0"), F.when(F.col("wide"), b0).otherwise(a0).alias("y0"),
        F.when(F.col("wide"), a1).otherwise(b1).alias("x1"), F.when(F.col("wide"), b1).otherwise(a1).alias("y1"),
    )
    return out.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))


def subdivide_blocks(
    blocks: DataFrame, target_sqft: float = 1200.0, min_plot_sqft: float = 800.0, min_w: Column | float = 20.0, max_w: float = 60.0,
    min_depth: float = 30.0, rate: float = 2500.0,
) -> DataFrame:
    """Plots of rectangular blocks in one or two rows, with price, facing and corner flag.

    ``gross_sqft`` of the parcel, when present, enlarges the target on big parcels.
    """
    target = F.lit(target_sqft)
    if "gross_sqft" in blocks.columns and target_sqft < 1800:
        big = F.greatest(F.lit(target_sqft), F.least(F.lit(2800.0), F.col("gross_sqft") / 75.0))
        target = F.when(F.col("gross_sqft") > 120000, big).otherwise(target)
    low = F.lit(float(min_w)) if isinstance(min_w, (int, float)) else min_w
    bw, bh = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    df = blocks.filter(bw * bh >= min_plot_sqft * 0.55).withColumn("tw", F.greatest(low, F.least(F.lit(max_w), F.sqrt(target * 0.65))))
    df = df.withColumn("td", F.greatest(F.lit(min_depth), target / F.col("tw")))
    rows = F.when(bh <= F.col("td") * 1.6, 1).otherwise(F.least(F.lit(2), F.greatest(F.lit(1), F.rint(bh / F.col("td")).cast("int"))))
    df = df.withColumn("n_rows", rows).withColumn(
        "row_h", F.when(bh > F.col("td") * 2.3, F.least(F.col("td") * 1.15, bh / F.col("n_rows"))).otherwise(bh / F.col("n_rows"))
    )
    df = df.withColumn("n_cols", F.greatest(F.lit(1), F.rint(bw / F.col("tw")).cast("int"))).filter(bw * F.col("row_h") >= min_plot_sqft * 0.50)
    df = df.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    y = F.when(F.col("r") == 0, F.col("y0")).otherwise(F.greatest(F.col("y0") + F.col("row_h"), F.col("y1") - F.col("row_h")))
    pw = bw / F.col("n_cols")
    mid = F.col("x0") + pw * (F.col("c") + 0.5)
    facing = F.when(F.col("n_rows") == 1, F.when(mid >= (F.col("x0") + F.col("x1")) / 2.0, "EAST").otherwise("WEST")).otherwise(
        F.when(F.col("r") == 0, "NORTH").otherwise("SOUTH")
    )
    corner = (F.col("c").isin(0) | (F.col("c") == F.col("n_cols") - 1)) & ((F.col("r") == 0) | (F.col("r") == F.col("n_rows") - 1))
    area = pw * F.col("row_h")
    return df.select(
        *blocks.columns, F.col("r").alias("row_no"), F.col("c").alias("col_no"), (F.col("x0") + pw * F.col("c")).alias("px0"), y.alias("py0"),
        pw.alias("plot_w"), F.col("row_h").alias("plot_d"), area.alias("area_sqft"), facing.alias("facing"), corner.alias("is_corner"),
        floor_round(area * rate).alias("price"),
    )


# fixed values: order in which zone positions and shapes are tried
ANCHORS = ["NORTH_EAST", "SOUTH_EAST", "SOUTH_WEST", "NORTH_WEST", "CENTER"]
SCALES = [(1.0, 1.0), (1.15, 0.9), (0.9, 1.15), (1.25, 0.8), (0.8, 1.25), (1.3, 1.3)]


def zone_boxes(target: Column, first_anchor: str, setback_ft: float) -> Column:
    """Boxes tried for one reservation in the setback box of a rectangular parcel, in order, as one list."""
    order = [first_anchor, *[a for a in ANCHORS if a != first_anchor]]
    dx0, dy0 = F.lit(setback_ft), F.lit(setback_ft)
    dx1, dy1 = F.col("width_ft") - setback_ft, F.col("depth_ft") - setback_ft
    dw, dh = F.greatest(F.lit(1.0), dx1 - dx0), F.greatest(F.lit(1.0), dy1 - dy0)
    w = F.greatest(F.lit(20.0), F.sqrt(target) * 1.12)
    mx, my = (dx0 + dx1) / 2.0, (dy0 + dy1) / 2.0

    def box(t: Column) -> Column:
        cw = F.least(dw * 0.85, w * t["sw"])
        ch = F.least(dh * 0.85, F.greatest(F.lit(20.0), target / w) * t["sh"])
        a = t["anchor"]
        x0 = F.when(a.isin("NORTH_EAST", "SOUTH_EAST"), dx1 - cw).when(a == "CENTER", mx - cw / 2.0).otherwise(dx0)
        y0 = F.when(a.isin("NORTH_EAST", "NORTH_WEST"), dy1 - ch).when(a == "CENTER", my - ch / 2.0).otherwise(dy0)
        return F.struct(t["try"].alias("try"), a.alias("anchor"), x0.alias("x0"), y0.alias("y0"), (x0 + cw).alias("x1"), (y0 + ch).alias("y1"))

    tries = [f"named_struct('try', {i * len(SCALES) + j}, 'anchor', '{a}', 'sw', {sw}D, 'sh', {sh}D)" for i, a in enumerate(order) for j, (sw, sh) in enumerate(SCALES)]
    return F.transform(F.expr(f"array({', '.join(tries)})"), box)


def zone_candidates(parcels: DataFrame, target: Column, first_anchor: str, setback_ft: float) -> DataFrame:
    """A row per box tried for one reservation."""
    known = parcels.withColumn("target", target)
    return known.select("*", F.inline(zone_boxes(F.col("target"), first_anchor, setback_ft)))


def reserve_zones(parcels: DataFrame, zone: str, target: Column, first_anchor: str, setback_ft: float = 10.0, taken: DataFrame | None = None) -> DataFrame:
    """First tried box with at least 70 % of the target free of the ``taken`` boxes (disjoint, per parcel).

    The boxes stay in the parcel's row; only the ground that ``taken`` boxes cost each of them travels.
    """
    tried = once(parcels.withColumn("target", target), tries=zone_boxes(F.col("target"), first_anchor, setback_ft))
    area = lambda b: (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    if taken is None:
        free = F.transform("tries", lambda b: F.struct(area(b).alias("free"), b.alias("b")))
    else:
        n = len(ANCHORS) * len(SCALES)
        t = taken.select("parcel_id", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
        common = F.transform("tries", lambda b: R.rect_overlap(b["x0"], b["y0"], b["x1"], b["y1"], "tx0", "ty0", "tx1", "ty1"))
        met = once(tried.select("parcel_id", "tries").join(t.hint("merge"), "parcel_id"), common=common)
        lost = met.groupBy("parcel_id").agg(*[F.sum(F.get("common", F.lit(i))).alias(f"l{i}") for i in range(n)])
        lost = lost.select("parcel_id", F.array(*[F.col(f"l{i}") for i in range(n)]).alias("lost"))
        tried = tried.join(lost.hint("merge"), "parcel_id", "left")
        free = F.transform("tries", lambda b: F.struct((area(b) - F.coalesce(F.get("lost", b["try"]), F.lit(0.0))).alias("free"), b.alias("b")))
    good = lambda v: (v["free"] >= F.col("target") * 0.70) & (v["free"] >= 30.0)
    found = once(tried, first=F.get(F.filter(free, good), F.lit(0))).filter(F.col("first").isNotNull())
    flat = found.select(*parcels.columns, "target", *[F.col(f"first.b.{c}").alias(c) for c in ("try", "anchor", "x0", "y0", "x1", "y1")], F.col("first.free").alias("free"))
    return first_per_key(flat, ["parcel_id"], [F.asc("try")]).withColumn("zone_type", F.lit(zone))
