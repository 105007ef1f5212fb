"""Candidate sweep on rectangular parcels: three road strategies, reserved zones, plots, rule check, scores, rank.

A layout is one row. Its land is a list of free rectangles: the box inside the set-back, from which roads and then each zone in turn
are cut out, every cut leaving at most four rectangles; so roads, zones and plots share no ground by construction. Plots of a
rectangle are alike, so counts, areas and rule hits are closed forms per rectangle and no plot is made before it is asked for
(``layout_plots``). Everything up to the rank stays in the row: no shuffle but for the best pass and the rank of a parcel.
Lists are worked on as arrays, many rows at a time (``functions.sites``), as Spark's functions on arrays are interpreted item by item.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.functions import sites as A
from acreage.functions.rings import floor_round
from acreage.operators import scoring
from acreage.operators.candidates import ANCHORS, BLOCK_DEPTH_FT, FEEDER_ROAD_FT, MAIN_ROAD_FT, SCALES
from acreage.operators.rules import RULES
from acreage.session import first_per_key, once

# fixed values: strategies in their order, and the perturbations of a pass (spacing changes nothing, kept as a column)
STRATEGIES = ["efficiency", "loop", "quality"]
PERTURBATIONS = [(1.0, 1.0), (1.12, 0.95), (0.90, 1.05)]
# fixed values: zones with their first anchor, the share of the parcel in percent, and the least target that is placed
ZONES = [("RECREATIONAL_OPEN_SPACE", "NORTH_EAST", "open_space_pct", 100.0), ("AMENITY_SPACE", "SOUTH_EAST", "amenity_pct", 100.0), ("UTILITY_SERVICE", "NORTH_WEST", "utility_pct", 50.0)]
# fixed values: limits of a plot, a road and a zone
MAX_PLOT_W, MIN_PLOT_D, MIN_ROAD_SQFT, MIN_ZONE_SQFT, MIN_ZONE_SIDE, ZONE_SHARE = 45.0, 30.0, 200.0, 30.0, 20.0, 0.70
DEFAULTS = {"target_plot_sqft": 1200.0, "min_plot_sqft": 800.0, "min_frontage_ft": 24.0, "open_space_pct": 10.0, "amenity_pct": 5.0, "utility_pct": 1.0, "setback_ft": 10.0}
SIDES = A.SIDES
BOX = "x0: double, y0: double, x1: double, y1: double"
ROADS, ZONE_LIST = f"array<struct<{BOX}, road_type: string, road_width_ft: double>>", f"array<struct<zone_type: string, anchor: string, {BOX}>>"
BLOCKS = f"array<struct<{BOX}, n_rows: int, n_cols: int, plot_d: double, second_y: double, plot_w: double>>"


# ---- roads

KINDS = ["MAIN", "FEEDER", "ARTERIAL", "PERIMETER"]
MAIN, FEEDER, ARTERIAL, PERIMETER = range(len(KINDS))
WIDTHS = np.array([MAIN_ROAD_FT, FEEDER_ROAD_FT, MAIN_ROAD_FT, FEEDER_ROAD_FT])


def _road(w, h, x0, y0, x1, y1) -> np.ndarray:
    """A corridor clipped to the parcel."""
    return np.stack([np.fmax(0.0, x0), np.fmax(0.0, y0), np.fmin(w, x1), np.fmin(h, y1)])


def _across(w, h, kind, y, x0, x1) -> np.ndarray:
    half = WIDTHS[kind] / 2.0
    return _road(w, h, x0 + np.zeros_like(w), y - half, x1, y + half)


def _down(w, h, kind, x, y0, y1) -> np.ndarray:
    half = WIDTHS[kind] / 2.0
    return _road(w, h, x - half, y0 + np.zeros_like(w), x + half, y1)


def _grid(w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spine in the middle of the longer run and cross streets a block depth apart."""
    wide = w >= h * 1.35
    n = np.fmax(1.0, np.floor(np.where(wide, w, h) / BLOCK_DEPTH_FT) - 1.0).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n + 1)
    i = np.arange(len(row)) - (np.cumsum(n + 1) - n - 1)[row]
    kind = np.where(i == 0, MAIN, FEEDER)
    w, h, n, wide = w[row], h[row], n[row], wide[row]
    run, cross = np.where(wide, w, h), np.where(wide, h, w)
    at = np.where(i == 0, cross * 0.5, run * i / (n + 1))
    return row, kind, np.where(wide == (i == 0), _across(w, h, kind, at, 0.0, w), _down(w, h, kind, at, 0.0, h))


def _each(roads: list[tuple], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roads (which parcels have it, kind, box) parcel by parcel."""
    has = np.stack([np.broadcast_to(r[0], w.shape) for r in roads], axis=1)
    row, k = np.nonzero(has)
    return row, np.array([r[1] for r in roads])[k], np.stack([r[2] for r in roads], axis=2)[:, row, k]


def _loop(w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A boulevard from the entry to the middle and a ring along the inset rim; narrow parcels get two branches instead."""
    i = np.fmax(40.0, np.fmin(w, h) * 0.22)
    mid, top, mx = h * 0.40, h - h * 0.18, w * 0.22
    ring = np.fmin(w, h) > i * 2
    flat, tall = ring & (w - i * 2 >= 20.0), ring & (h - i * 2 >= 20.0)
    across, down = (lambda *v: _across(w, h, FEEDER, *v)), (lambda *v: _down(w, h, FEEDER, *v))
    return _each([
        (True, ARTERIAL, _down(w, h, ARTERIAL, w * 0.5, 0.0, mid)),
        (flat, FEEDER, across(i, i, w - i)), (tall, FEEDER, down(w - i, i, h - i)), (flat, FEEDER, across(h - i, i, w - i)), (tall, FEEDER, down(i, i, h - i)),
        (~ring, FEEDER, across(mid, mx, w * 0.5)), (~ring, FEEDER, down(mx, mid, top)), (~ring, FEEDER, across(top, mx, w * 0.5)),
        (~ring, FEEDER, across(mid, w * 0.5, w - mx)), (~ring, FEEDER, down(w - mx, mid, top)), (~ring, FEEDER, across(top, w * 0.5, w - mx)),
    ], w)


def _courtyard(w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A ring around the middle, an avenue from the entry to it and a wing to either side."""
    rw, rh = np.fmin(w * 0.25, 75.0), np.fmin(h * 0.25, 60.0)
    x1, x2, y1, y2 = w * 0.5 - rw, w * 0.5 + rw, h * 0.5 - rh, h * 0.5 + rh
    across, down = (lambda k, *v: (True, k, _across(w, h, k, *v))), (lambda k, *v: (True, k, _down(w, h, k, *v)))
    return _each([
        across(PERIMETER, y1, x1, x2), down(PERIMETER, x2, y1, y2), across(PERIMETER, y2, x1, x2), down(PERIMETER, x1, y1, y2),
        down(MAIN, w * 0.5, 0.0, y1), across(FEEDER, h * 0.5, 0.0, x1), across(FEEDER, h * 0.5, x2, w),
    ], w)


def strategy_roads(efficiency: np.ndarray, loop: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[A.Boxes, np.ndarray]:
    """Roads of every layout and their kinds, by its strategy; corridors under MIN_ROAD_SQFT are left out."""
    row, kind, at = [], [], []
    for which, build in ((efficiency, _grid), (loop, _loop), (~efficiency & ~loop, _courtyard)):
        rows = np.flatnonzero(which)
        r, k, b = build(w[rows], h[rows])
        good = A.real(b) & (A.area(b) >= MIN_ROAD_SQFT)
        row, kind, at = [*row, rows[r[good]]], [*kind, k[good]], [*at, b[:, good]]
    row = np.concatenate(row)
    order = np.argsort(row, kind="stable")
    return A.Boxes(row[order], np.concatenate(at, axis=1)[:, order]), np.concatenate(kind)[order]


# ---- zones

ORDERS = np.array([[i, *[k for k in range(len(ANCHORS)) if k != i]] for i in range(len(ANCHORS))])  # anchors as tried, by the first one


def _place(target: np.ndarray, domain: np.ndarray, free: A.Boxes, tried: Callable) -> tuple[np.ndarray, np.ndarray]:
    return A.place(target, domain, free, tried, ZONE_SHARE, MIN_ZONE_SQFT, MIN_ZONE_SIDE)


def _sides(anchor: list | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which anchors lie east, north, in the center."""
    names = [ANCHORS[a] if isinstance(a, int) else str(a) for a in anchor]
    return tuple(np.array([is_so(a) for a in names], bool) for is_so in (lambda a: a.endswith("EAST"), lambda a: a.startswith("NORTH"), lambda a: a == "CENTER"))


EAST, NORTH, CENTER = _sides(list(range(len(ANCHORS))))


def _in_order(first: np.ndarray) -> Callable:
    """Every anchor with every scale, from the ``first`` anchor of each layout."""

    def tried(k: int, rows: np.ndarray):
        if k == len(ANCHORS) * len(SCALES):
            return None
        a = ORDERS[first[rows], k // len(SCALES)]
        return slice(None), EAST[a], NORTH[a], CENTER[a], *SCALES[k % len(SCALES)]

    return tried


def place(target: Column, tries: Column) -> Column:
    """First of the listed tries (anchor, sw, sh) whose largest part in the row's ``free`` rectangles has ZONE_SHARE of the target, as
    that part with its anchor.

    Null if none has. Boxes lie in the row's ``domain``; of equal parts the one to the left, then the lower one counts.
    """

    def work(target: pa.Array, tries: pa.Array, domain: pa.Array, free: pa.Array) -> pa.Array:
        items, sizes = tries.flatten(), tries.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        begin, part = np.cumsum(sizes) - sizes, dict(zip([f.name for f in items.type], items.flatten()))

        def tried(k: int, rows: np.ndarray):
            has = sizes[rows] > k
            at = pa.array(begin[rows[has]] + k)
            scales = [A.numbers(part[c].take(at).cast(pa.float64())) for c in ("sw", "sh")]
            return (has, *_sides(part["anchor"].take(at).to_pylist()), *scales) if has.any() else None

        wanted = A.numbers(target)
        box, number = _place(wanted, np.array(A.fields(domain, list(SIDES))), A.boxes_of(free), tried)
        found = number >= 0
        anchor = part["anchor"].take(pa.array(begin + number, mask=~found))
        area = np.floor(A.area(box) * 10000.0 + 0.5) / 10000.0
        best = pa.StructArray.from_arrays([A.column(v) for v in (area, -box[0], -box[1])] + [A.struct(**dict(zip(SIDES, box)))], names=["area", "x", "y", "box"])
        return pa.StructArray.from_arrays([best, anchor], names=["best", "anchor"], mask=pa.array(~found))

    spot = f"best: struct<area: double, x: double, y: double, box: struct<{BOX}>>, anchor: string"
    return F.arrow_udf(work, f"struct<{spot}>")(target.cast("double"), tries, F.col("domain"), F.col("free"))


def _in_parts(work: Callable) -> Callable:
    """``work`` on strategy, width and other columns, for some layouts at a time: by the roads their parcels may have."""

    def parts(strategy: pa.Array, width: pa.Array, depth: pa.Array, *columns: pa.Array) -> pa.Array:
        roads = np.nan_to_num(np.fmax(A.numbers(width), A.numbers(depth)) / BLOCK_DEPTH_FT, nan=0.0) + 8
        done = [work(*[c[part] for c in (strategy, width, depth, *columns)]) for part in A.runs(roads, A.CELLS // 4)]
        return pa.concat_arrays(done) if done else work(strategy, width, depth, *columns)

    return parts


def _land(strategy: pa.Array, *columns: pa.Array) -> pa.Array:
    """Roads, domain, free rectangles and zones of layouts."""
    is_a = lambda name: pc.equal(strategy, name).fill_null(False).to_numpy(zero_copy_only=False)
    (efficiency, loop, quality), (w, h, gross, setback, *shares) = map(is_a, STRATEGIES), map(A.numbers, columns)
    n = len(w)
    roads, kind = strategy_roads(efficiency, loop, w, h)
    inset = np.where((w > setback * 2) & (h > setback * 2), setback, 0.0)
    domain = np.stack([inset, inset, w - inset, h - inset])
    free = A.cut_all(A.Boxes(np.arange(n), domain), roads, n)
    rows, boxes, names, anchors = [], [], [], []
    for z, ((_, first, _, least), share) in enumerate(zip(ZONES, shares)):
        target = gross * share / 100.0
        start = np.full(n, ANCHORS.index(first))
        if z == 0:
            start[quality] = ANCHORS.index("CENTER")
        box, number = _place(np.where(target >= least, target, np.nan), domain, free, _in_order(start))
        has = np.flatnonzero(number >= 0)
        free = A.cut_all(free, A.Boxes(has, box[:, has]), n)
        rows, boxes, names, anchors = [*rows, has], [*boxes, box[:, has]], [*names, np.full(len(has), z)], [*anchors, ORDERS[start[has], number[has] // len(SCALES)]]
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    word = lambda words, which: pa.array(words, pa.string()).take(pa.array(which))
    zones = A.struct(
        zone_type=word([z[0] for z in ZONES], np.concatenate(names)[order]), anchor=word(ANCHORS, np.concatenate(anchors)[order]), **dict(zip(SIDES, np.concatenate(boxes, axis=1)[:, order]))
    )
    road = A.struct(**dict(zip(SIDES, roads.at)), road_type=word(KINDS, kind), road_width_ft=WIDTHS[kind])
    return A.struct(
        roads=A.listed(roads.row, road, n), domain=A.struct(**dict(zip(SIDES, domain))), free=A.listed(free.row, A.struct(**dict(zip(SIDES, free.at))), n),
        zones=A.listed(row[order], zones, n),
    )


LAND = f"roads: {ROADS}, domain: struct<{BOX}>, free: array<struct<{BOX}>>, zones: {ZONE_LIST}"
LAND_INPUT = ["width_ft", "depth_ft", "gross_sqft", "setback_ft", *[share for _, _, share, _ in ZONES]]


def _by_strategy(parcels: DataFrame, params: dict[str, float]) -> DataFrame:
    """A row per parcel and strategy, with a column for all of DEFAULTS."""
    given = {**DEFAULTS, **params}
    known = parcels.select(*parcels.columns, *[F.lit(float(v)).alias(k) for k, v in given.items() if k not in parcels.columns])
    rows = known.withColumn("strategy", F.explode(F.array(*map(F.lit, STRATEGIES)))).withColumn("ord", F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy")))
    parts = int(parcels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "parcel_id", "strategy")  # little data, much work: not left to the files' sizes


def _doubles(names: list[str]) -> list[Column]:
    return [F.col(c).cast("double") for c in names]


def candidate_layouts(parcels: DataFrame, **params: float) -> DataFrame:
    """Parcels by strategy with roads, zones and the free rectangles that are left.

    ``parcels``: parcel_id, width_ft, depth_ft, gross_sqft and any of the columns in DEFAULTS; ``params`` stand for missing ones.
    """
    rows = _by_strategy(parcels, params)
    return once(rows, land=F.arrow_udf(_in_parts(_land), f"struct<{LAND}>")("strategy", *_doubles(LAND_INPUT))).select(*rows.columns, "land.*")


# ---- plots

BLOCK_INPUT = ["gross_sqft", "target_plot_sqft", "min_plot_sqft", "min_frontage_ft", "plot_w_mult"]


def _block_list(found: dict[str, np.ndarray], rows: int) -> pa.Array:
    return A.listed(found["row"], A.struct(**{k: v for k, v in found.items() if k != "row"}), rows)


def plot_blocks() -> Column:
    """Free rectangles as blocks of equal plots: rows, columns, plot width, row height and where the second row starts.

    One or two rows; columns under 70 % of the least area merge into one plot; blocks, strips and plots that are too small or too
    slim are left out. Large parcels get larger plots.
    """

    def work(free: pa.Array, *columns: pa.Array) -> pa.Array:
        return _block_list(A.blocks(A.boxes_of(free), dict(zip(BLOCK_INPUT, map(A.numbers, columns))), MAX_PLOT_W, MIN_PLOT_D), len(free))

    return F.arrow_udf(work, BLOCKS)("free", *_doubles(BLOCK_INPUT))


def layout_plots(layouts: DataFrame, rate: float = 2500.0) -> DataFrame:
    """A row per plot of layouts with ``blocks``: box, facing, corner, price, and the type of the road whose middle is nearest."""
    keys = [c for c in ("parcel_id", "strategy", "pass_no") if c in layouts.columns]
    df = layouts.select(*keys, "roads", F.posexplode("blocks").alias("block_no", "b"))
    df = df.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("b.n_rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("b.n_cols") - 1)))
    b = F.col("b")
    y0 = F.when(F.col("r") == 0, b["y0"]).otherwise(b["second_y"])
    x0 = b["x0"] + b["plot_w"] * F.col("c")
    df = df.withColumn("x0", x0).withColumn("y0", y0).withColumn("x1", F.col("x0") + b["plot_w"]).withColumn("y1", F.col("y0") + b["plot_d"])
    mx, my = (F.col("x0") + F.col("x1")) / 2.0, (F.col("y0") + F.col("y1")) / 2.0
    away = F.array_min(F.transform("roads", lambda r, i: F.struct(F.hypot(mx - (r["x0"] + r["x1"]) / 2.0, my - (r["y0"] + r["y1"]) / 2.0).alias("d"), i.alias("i"), r["road_type"].alias("t"))))
    facing = F.when(b["n_rows"] == 1, F.when(mx >= (b["x0"] + b["x1"]) / 2.0, "EAST").otherwise("WEST")).otherwise(F.when(F.col("r") == 0, "NORTH").otherwise("SOUTH"))
    area = b["plot_w"] * b["plot_d"]
    return df.select(
        *keys, "block_no", F.col("r").alias("row_no"), F.col("c").alias("col_no"), *SIDES, area.alias("area_sqft"), facing.alias("facing"),
        (F.col("c").isin(0) | (F.col("c") == b["n_cols"] - 1)).alias("is_corner"), floor_round(area * rate).alias("price"), F.coalesce(away["t"], F.lit("NONE")).alias("road_type"),
    )


SUMS = ["n_plots", "plot_area", "n_access", "regular_v1", "regular_v2", "n_corner", "n_roads", "n_zones", "road_area", "min_road_width", "open_area", "amenity_area", "utility_area"]
CHECKS = ["RULE_01", "RULE_02", "RULE_03", "RULE_05", "RULE_06", "RULE_07", "RULE_10", "RULE_11"]


def _layout_sums(b: dict[str, np.ndarray], roads: A.Boxes, widths: np.ndarray, zones: A.Boxes, zone_type: pa.Array, rows: int) -> dict[str, np.ndarray | pa.Array]:
    """SUMS, the totals that both scores read."""
    w, d, n = b["plot_w"], b["plot_d"], b["n_rows"].astype(float) * b["n_cols"]
    slim = np.fmax(w / np.fmax(1.0, d), d / np.fmax(1.0, w))
    square = np.fmax(np.fmax(1.0, w) / np.fmax(1.0, d), np.fmax(1.0, d) / np.fmax(1.0, w))
    summed = lambda values: A.total(b["row"], values, rows)
    count = lambda values: summed(values).astype(np.int64)
    is_a = lambda *kinds: pc.is_in(zone_type, pa.array(kinds)).to_numpy(zero_copy_only=False)
    covered = lambda boxes, which: A.total(boxes.row, np.where(which, A.exact(A.area(boxes.at)), 0.0), rows) / 1e6
    narrowest = np.full(rows, np.nan)
    np.fmin.at(narrowest, roads.row, widths)
    return {
        "n_plots": count(n), "plot_area": summed(A.exact(w * d) * n) / 1e6, "n_access": count(np.where(w >= 15.0, n, 0)),
        "regular_v1": count(n * np.where(slim <= 2.2, 10, np.where(slim <= 3.0, 6, 2))), "regular_v2": count(n * np.where(square <= 2.5, 10, np.where(square <= 3.5, 5, 0))),
        "n_corner": count(b["n_rows"] * np.minimum(2, b["n_cols"])), "n_roads": np.bincount(roads.row, minlength=rows).astype(np.int32),
        "n_zones": np.bincount(zones.row, minlength=rows).astype(np.int32), "road_area": covered(roads, True), "min_road_width": narrowest,
        "open_area": covered(zones, is_a("RECREATIONAL_OPEN_SPACE", "UTILITY_SERVICE")), "amenity_area": covered(zones, is_a("AMENITY_SPACE")), "utility_area": covered(zones, is_a("UTILITY_SERVICE")),
    }


def _check_layouts(b: dict[str, np.ndarray], roads: A.Boxes, widths: np.ndarray, zones: A.Boxes, domain: np.ndarray, parcel: np.ndarray, min_plot: np.ndarray, min_frontage: np.ndarray) -> dict[str, np.ndarray]:
    """errors, warnings, failed_rules: the rules on plots, worked out per block, whose plots are alike.

    Access (RULE_08) holds as every plot names its road; plots are boxes, so they are valid and no slivers.
    """
    row, rows, n = b["row"], len(min_plot), b["n_rows"].astype(float) * b["n_cols"]
    at, w, d = np.stack([b[c] for c in SIDES]), b["plot_w"], b["plot_d"]
    size, whole = w * d, A.area(at)
    forgiven = np.fmax(3.5, size * 0.005)  # rules.tolerance
    hits = {
        "RULE_01": whole - A.shared(at, parcel[:, row]) > forgiven,
        "RULE_02": A.shared_with(at, row, roads, rows) > forgiven, "RULE_03": A.shared_with(at, row, zones, rows) > forgiven,
        "RULE_05": (b["n_rows"] > 1) & ((b["y0"] + d - b["second_y"]) * w > forgiven),
        "RULE_06": size < (min_plot * 0.90)[row], "RULE_07": np.fmin(w, d) < (min_frontage * 0.85)[row],
        "RULE_10": size < 1.0, "RULE_11": whole - A.shared(at, domain[:, row]) > 5.0,
    }
    counted = {rule: A.total(row, np.where(hits[rule], n, 0.0), rows).astype(np.int64) for rule in CHECKS}
    narrow = A.total(roads.row, widths < FEEDER_ROAD_FT * 0.95 - 1.0, rows).astype(np.int64)
    warns = [r for r, _, severity in RULES if severity == "WARNING"]
    return {
        "errors": sum(v for r, v in counted.items() if r not in warns) + narrow, "warnings": sum(v for r, v in counted.items() if r in warns),
        "failed_rules": sum((v > 0).astype(np.int32) for v in counted.values()) + (narrow > 0).astype(np.int32),
    }


def _judge(free: pa.Array, roads: pa.Array, zones: pa.Array, domain: pa.Array, parcel: np.ndarray, given: dict[str, np.ndarray]) -> dict[str, np.ndarray | pa.Array]:
    rows, road, zone = len(free), A.boxes_of(roads), A.boxes_of(zones)
    b = A.blocks(A.boxes_of(free), given, MAX_PLOT_W, MIN_PLOT_D)
    widths = A.fields(roads.flatten(), ["road_width_ft"])[0]
    zone_type = zones.flatten().flatten()[[f.name for f in zones.type.value_type].index("zone_type")]
    sums = _layout_sums(b, road, widths, zone, zone_type, rows)
    checks = _check_layouts(b, road, widths, zone, np.array(A.fields(domain, list(SIDES))), parcel, given["min_plot_sqft"], given["min_frontage_ft"])
    return {"blocks": _block_list(b, rows), **sums, **checks}


def _judged_land(strategy: pa.Array, *columns: pa.Array) -> pa.Array:
    """What ``_land`` gives, and a list of the passes with what ``_judge`` gives of each."""
    land, given = _land(strategy, *columns[: len(LAND_INPUT)]), {k: A.numbers(c) for k, c in zip([*LAND_INPUT, *BLOCK_INPUT[1:-1]], columns)}
    n, times = len(strategy), len(PERTURBATIONS)
    parts = dict(zip([f.name for f in land.type], land.flatten()))
    every = {k: v.take(pa.array(np.repeat(np.arange(n), times))) for k, v in parts.items()}
    given = {k: np.repeat(v, times) for k, v in given.items()}
    number, (spacing, width) = np.tile(np.arange(times, dtype=np.int32), n), (np.tile(v, n) for v in zip(*PERTURBATIONS))
    parcel = np.stack([np.zeros(n * times), np.zeros(n * times), given["width_ft"], given["depth_ft"]])
    found = _judge(**every, parcel=parcel, given={**given, "plot_w_mult": width})
    passes = A.struct(pass_no=number, spacing_mult=spacing, plot_w_mult=width, **found)
    return A.struct(**parts, passes=A.listed(np.repeat(np.arange(n), times), passes, n))


def judged_layouts(parcels: DataFrame, **params: float) -> DataFrame:
    """``candidate_layouts`` by pass, with blocks of plots, SUMS, errors, warnings and failed_rules.

    All of a layout is made in one step of a task, so that its lists do not go to Python and back in between.
    """
    doubles = ("plot_area", "road_area", "min_road_width", "open_area", "amenity_area", "utility_area")
    sums = ", ".join(f"{c}: {'double' if c in doubles else 'int' if c in ('n_roads', 'n_zones') else 'long'}" for c in SUMS)
    one_pass = f"pass_no: int, spacing_mult: double, plot_w_mult: double, blocks: {BLOCKS}, {sums}, errors: long, warnings: long, failed_rules: int"
    rows = _by_strategy(parcels, params)
    land = F.arrow_udf(_in_parts(_judged_land), f"struct<{LAND}, passes: array<struct<{one_pass}>>>")("strategy", *_doubles([*LAND_INPUT, *BLOCK_INPUT[1:-1]]))
    return once(rows, land=land).select(*rows.columns, *[f"land.{c}" for c in ("roads", "domain", "free", "zones")], F.inline("land.passes"))


def sweep(parcels: DataFrame, **params: float) -> DataFrame:
    """The layouts of each parcel that pass the rules, best first: one per strategy, from its best pass.

    A first pass with four plots and a composite of 60 stands; otherwise the best composite at one decimal, of equal ones the earlier.
    Layouts with an error, or under 80 % of the rules, go. The others are ranked by the second score and carry its badge.
    """
    tried = judged_layouts(parcels, **params)
    judged = scoring.evaluate_layouts(tried.filter(F.col("n_plots") > 0), min_road_width_ft=FEEDER_ROAD_FT)
    early = (F.col("pass_no") == 0) & (F.col("n_plots") >= 4) & (F.col("composite") >= 60.0)
    best = first_per_key(judged, ["parcel_id", "ord"], [F.when(early, 0).otherwise(1), F.desc(floor_round("composite", 1)), F.asc("pass_no")])
    sound = best.filter((F.col("errors") == 0) & ((len(RULES) - F.col("failed_rules")) * 100.0 / len(RULES) >= 80.0))
    kept = sound.select("parcel_id", "strategy", "ord", "pass_no", "gross_sqft", *SUMS, F.col("composite").alias("first_score"), "errors", "warnings", "roads", "zones", "blocks")
    scored = scoring.score_layouts(kept).withColumn("composite", floor_round("composite", 4))
    return scoring.rank_variants(scored, "parcel_id", few=True)  # a layout per strategy
