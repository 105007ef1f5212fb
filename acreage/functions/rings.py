"""Polygon geometry as column expressions.

A ring is ``array<struct<x:double,y:double>>``, closed or open. Everything here is a
projection: no shuffle, no Python worker, so Spark can fuse it with the scan or join
that supplies the rings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def point(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def floor_round(col, digits: int = 2) -> Column:
    """Half-up rounding by the same IEEE steps in every engine."""
    scale = float(10**digits)
    return F.floor(_c(col) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def box_ring(x0, y0, x1, y1) -> Column:
    """Closed five-point ring of a bounding box."""
    x0, y0, x1, y1 = _c(x0), _c(y0), _c(x1), _c(y1)
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def pairs_to_ring(col) -> Column:
    """``[[x, y], …]`` to a ring."""
    return F.transform(_c(col), lambda p: point(p[0], p[1]))


def let(value, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; keeps nested expressions small."""
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def opened(ring) -> Column:
    """The ring without its closing vertex."""

    def strip(r):
        n = F.size(r)
        return F.filter(r, lambda p, i: (i == 0) | (i < n - 1) | (p != F.get(r, F.lit(0))))

    return let(ring, strip)


def closed(ring) -> Column:
    return let(opened(ring), lambda r: F.concat(r, F.slice(r, 1, 1)))


def _segment(a, b) -> Column:
    return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def path_segments(path) -> Column:
    """Consecutive segments of a polyline, not closed."""

    def cut(r):
        return F.filter(
            F.transform(r, lambda p, i: _segment(p, F.get(r, i + 1))), lambda e: e["x2"].isNotNull()
        )

    return let(path, cut)


def edges(ring) -> Column:
    """Edges of a polygon, the closing edge included; edges without length are left out."""

    def cut(r):
        n = F.size(r)
        return F.filter(
            F.transform(r, lambda p, i: _segment(p, F.get(r, (i + 1) % n))),
            lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]),
        )

    return let(ring, cut)


def drop_repeats(ring, tolerance: float = 1e-5) -> Column:
    """Remove consecutive duplicate vertices."""
    return let(
        ring,
        lambda r: F.filter(
            r,
            lambda p, i: (i == 0)
            | (F.abs(p["x"] - F.get(r, i - 1)["x"]) > tolerance)
            | (F.abs(p["y"] - F.get(r, i - 1)["y"]) > tolerance),
        ),
    )


def rounded(ring, digits: int = 2) -> Column:
    return F.transform(_c(ring), lambda p: point(floor_round(p["x"], digits), floor_round(p["y"], digits)))


def clean_ring(ring) -> Column:
    """Repeats dropped and closed; null when fewer than three vertices or no area remain."""
    return let(
        closed(drop_repeats(ring)), lambda r: F.when((F.size(r) >= 4) & (ring_area(r) > 0), r)
    )


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def cross(e) -> Column:
    return e["x1"] * e["y2"] - e["x2"] * e["y1"]


def moved(ring, origin) -> Column:
    """The ring seen from a point near it, so that no digits are lost far from the origin."""
    return F.transform(_c(ring), lambda p: point(p["x"] - origin["x"], p["y"] - origin["y"]))


def signed_area(ring) -> Column:
    def turned(o):
        return _sum(edges(ring), lambda e: (e["x1"] - o["x"]) * (e["y2"] - o["y"]) - (e["x2"] - o["x"]) * (e["y1"] - o["y"])) / 2.0

    return let(F.get(_c(ring), F.lit(0)), turned)


def ring_area(ring) -> Column:
    return F.abs(signed_area(ring))


def path_length(ring) -> Column:
    return _sum(path_segments(ring), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def ring_length(ring) -> Column:
    """Perimeter, the closing edge included."""
    return path_length(closed(ring))


def vertex_centroid(ring) -> Column:
    return let(
        opened(ring),
        lambda r: point(_sum(r, lambda p: p["x"]) / F.size(r), _sum(r, lambda p: p["y"]) / F.size(r)),
    )


def area_centroid(ring) -> Column:
    """Area-weighted centroid; vertex mean for a ring without area."""

    def weigh(es):
        sums = F.aggregate(
            es,
            F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")),
            lambda acc, e: F.struct(
                (acc["w"] + cross(e)).alias("w"),
                (acc["x"] + (e["x1"] + e["x2"]) * cross(e)).alias("x"),
                (acc["y"] + (e["y1"] + e["y2"]) * cross(e)).alias("y"),
            ),
        )
        return let(
            sums, lambda t: F.when(t["w"] != 0, point(t["x"] / (t["w"] * 3.0), t["y"] / (t["w"] * 3.0)))
        )

    return F.coalesce(let(edges(ring), weigh), vertex_centroid(ring))


def bbox(ring) -> Column:
    return let(
        ring,
        lambda r: F.struct(
            F.array_min(F.transform(r, lambda p: p["x"])).alias("minX"),
            F.array_min(F.transform(r, lambda p: p["y"])).alias("minY"),
            F.array_max(F.transform(r, lambda p: p["x"])).alias("maxX"),
            F.array_max(F.transform(r, lambda p: p["y"])).alias("maxY"),
        ),
    )


def rich_bbox(ring) -> Column:
    """Bounding box with width, height, area and centre, two decimals."""
    def corners(b):
        return F.struct(*[floor_round(b[k]).alias(k) for k in ("minX", "minY", "maxX", "maxY")])

    def sides(b):
        return F.struct(
            b["minX"].alias("minX"), b["minY"].alias("minY"), b["maxX"].alias("maxX"), b["maxY"].alias("maxY"),
            floor_round(b["maxX"] - b["minX"]).alias("width"), floor_round(b["maxY"] - b["minY"]).alias("height"),
        )

    def full(b):
        return F.struct(
            *[b[k].alias(k) for k in ("minX", "minY", "maxX", "maxY", "width", "height")],
            floor_round(b["width"] * b["height"]).alias("area"),
            floor_round(b["minX"] + b["width"] / 2.0).alias("centerX"),
            floor_round(b["minY"] + b["height"] / 2.0).alias("centerY"),
        )

    return let(let(let(bbox(ring), corners), sides), full)


def wkt(ring) -> Column:
    """``POLYGON ((x y, …))`` of the closed ring."""
    words = F.transform(closed(ring), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(words, ", "), F.lit("))"))


def coordinates(ring) -> Column:
    """GeoJSON polygon coordinates: one closed exterior."""
    return F.array(F.transform(closed(ring), lambda p: F.array(p["x"], p["y"])))


def boxes_overlap(a: Column, b: Column, reach: float = 0.0) -> Column:
    """Bounding boxes meet, or come within ``reach`` of each other."""
    r = F.lit(float(reach))
    return (
        (a["minX"] <= b["maxX"] + r) & (b["minX"] <= a["maxX"] + r)
        & (a["minY"] <= b["maxY"] + r) & (b["minY"] <= a["maxY"] + r)
    )


def point_in_ring(x, y, ring) -> Column:
    """Ray casting; a point on a left or lower side counts as inside."""
    x, y = _c(x), _c(y)

    def flips(e):
        straddles = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return F.when(straddles & (x < at), 1).otherwise(0)

    hits = F.aggregate(edges(ring), F.lit(0), lambda acc, e: acc + flips(e))
    return hits % 2 == 1


def point_segment_distance(x, y, e) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    length2 = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    along = F.coalesce(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / length2, F.lit(0.0))
    return let(
        F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)),
        lambda t: F.hypot(x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)),
    )


def _side(ax, ay, bx, by, px, py) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_cross(a, b) -> Column:
    """The two segments share a point that is interior to both (proper crossing)."""
    s1 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x1"], b["y1"])
    s2 = _side(a["x1"], a["y1"], a["x2"], a["y2"], b["x2"], b["y2"])
    s3 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x1"], a["y1"])
    s4 = _side(b["x1"], b["y1"], b["x2"], b["y2"], a["x2"], a["y2"])
    return (s1 * s2 < 0) & (s3 * s4 < 0)


def segment_distance(a, b) -> Column:
    gap = F.least(
        point_segment_distance(b["x1"], b["y1"], a), point_segment_distance(b["x2"], b["y2"], a),
        point_segment_distance(a["x1"], a["y1"], b), point_segment_distance(a["x2"], a["y2"], b),
    )
    return F.when(segments_cross(a, b), F.lit(0.0)).otherwise(gap)


def _edge_gap(edges_a: Column, edges_b: Column) -> Column:
    return let(
        edges_b,
        lambda eb: F.array_min(
            F.flatten(F.transform(edges_a, lambda a: F.transform(eb, lambda b: segment_distance(a, b))))
        ),
    )


def ring_distance(a, b) -> Column:
    """Distance of two polygons, 0 when they meet or one holds the other."""
    a, b = _c(a), _c(b)
    first_a, first_b = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    inside = point_in_ring(first_a["x"], first_a["y"], b) | point_in_ring(first_b["x"], first_b["y"], a)
    return F.when(inside, F.lit(0.0)).otherwise(_edge_gap(edges(a), edges(b)))


def rim_distance(a, b) -> Column:
    """Distance of the rims of two polygons, also when one holds the other."""
    return _edge_gap(edges(a), edges(b))


def ring_line_distance(ring, line) -> Column:
    """Distance of a polygon and a polyline."""
    ring, line = _c(ring), _c(line)
    first = F.get(line, F.lit(0))
    return F.when(point_in_ring(first["x"], first["y"], ring), F.lit(0.0)).otherwise(
        _edge_gap(edges(ring), path_segments(line))
    )


def shared_length(a, b, tolerance: float = 1e-6) -> Column:
    """Total length over which edges of the two rings lie on one another."""

    def project(e, g):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = F.hypot(dx, dy)
        return F.struct(
            length.alias("n"),
            (F.abs(dx * (g["y1"] - e["y1"]) - dy * (g["x1"] - e["x1"])) / length).alias("o1"),
            (F.abs(dx * (g["y2"] - e["y1"]) - dy * (g["x2"] - e["x1"])) / length).alias("o2"),
            (((g["x1"] - e["x1"]) * dx + (g["y1"] - e["y1"]) * dy) / length).alias("t1"),
            (((g["x2"] - e["x1"]) * dx + (g["y2"] - e["y1"]) * dy) / length).alias("t2"),
        )

    def span(p):
        covered = F.least(F.greatest(p["t1"], p["t2"]), p["n"]) - F.greatest(F.least(p["t1"], p["t2"]), F.lit(0.0))
        on_line = (p["o1"] <= tolerance) & (p["o2"] <= tolerance)
        return F.when(on_line & (covered > tolerance), covered).otherwise(F.lit(0.0))

    pairs = let(
        edges(b),
        lambda eb: F.flatten(F.transform(edges(a), lambda e: F.transform(eb, lambda g: project(e, g)))),
    )
    return _sum(F.transform(pairs, span), lambda v: v)


def _spans(ring) -> Column:
    """Non-vertical edges as left-to-right spans with the sign of the area below them."""
    slanted = F.filter(edges(ring), lambda e: e["x1"] != e["x2"])

    def span(e, turn):
        forward = e["x1"] < e["x2"]
        return F.struct(
            F.least(e["x1"], e["x2"]).alias("xl"),
            F.when(forward, e["y1"]).otherwise(e["y2"]).alias("yl"),
            F.greatest(e["x1"], e["x2"]).alias("xr"),
            F.when(forward, e["y2"]).otherwise(e["y1"]).alias("yr"),
            F.when(forward, -turn).otherwise(turn).alias("s"),
        )

    return let(
        F.when(signed_area(ring) < 0, F.lit(-1.0)).otherwise(F.lit(1.0)),
        lambda turn: F.transform(slanted, lambda e: span(e, turn)),
    )


def _height(e, x) -> Column:
    return F.when(x == e["xl"], e["yl"]).when(x == e["xr"], e["yr"]).otherwise(
        e["yl"] + (e["yr"] - e["yl"]) * (x - e["xl"]) / (e["xr"] - e["xl"])
    )


def overlap_area(a, b) -> Column:
    """Area common to two simple polygons, exact for any shape, measured from the first vertex of ``a``."""
    at = F.get(_c(a), F.lit(0))
    near = let(at, lambda o: F.struct(moved(a, o).alias("a"), moved(b, o).alias("b")))
    return let(near, lambda v: _overlap_area(v["a"], v["b"]))


def _overlap_area(a, b) -> Column:
    """A polygon is the signed sum of the strips below its edges, so the common area is the
    signed sum, over edge pairs, of the integral of the lower of the two edges.
    """

    def cut_pair(ea, spans_b):
        meeting = F.filter(spans_b, lambda eb: (eb["xl"] < ea["xr"]) & (eb["xr"] > ea["xl"]))
        return F.transform(
            meeting,
            lambda eb: F.struct(
                ea.alias("a"), eb.alias("b"),
                F.greatest(ea["xl"], eb["xl"]).alias("l"), F.least(ea["xr"], eb["xr"]).alias("r"),
            ),
        )

    def sample(p):
        return F.struct(
            (p["r"] - p["l"]).alias("w"), (p["a"]["s"] * p["b"]["s"]).alias("s"),
            _height(p["a"], p["l"]).alias("fl"), _height(p["a"], p["r"]).alias("fr"),
            _height(p["b"], p["l"]).alias("gl"), _height(p["b"], p["r"]).alias("gr"),
        )

    def heights(p):
        return F.struct(
            p["w"].alias("w"), p["s"].alias("s"),
            (p["fl"] + p["fr"] + p["gl"] + p["gr"]).alias("total"),
            (p["fl"] - p["gl"]).alias("dl"), (p["fr"] - p["gr"]).alias("dr"),
        )

    def term(h):
        dl, dr = F.abs(h["dl"]), F.abs(h["dr"])
        same_order = h["dl"] * h["dr"] >= 0
        gap = F.when(same_order, (dl + dr) / 2.0).otherwise(
            (dl * dl + dr * dr) / (F.nullif(dl + dr, F.lit(0.0)) * 2.0)
        )
        return h["s"] * h["w"] * (h["total"] / 4.0 - gap / 2.0)

    pairs = let(_spans(b), lambda sb: F.flatten(F.transform(_spans(a), lambda ea: cut_pair(ea, sb))))
    return F.greatest(_sum(F.transform(F.transform(pairs, sample), heights), term), F.lit(0.0))


def box_area(b: Column) -> Column:
    return (b["maxX"] - b["minX"]) * (b["maxY"] - b["minY"])


def is_box(ring, b) -> Column:
    """The ring is its own bounding box."""
    return ring_area(ring) == box_area(_c(b))


def box_common(a: Column, b: Column) -> Column:
    """Extent struct (w, h) common to two boxes; negative parts are gaps."""
    return F.struct(
        (F.least(a["maxX"], b["maxX"]) - F.greatest(a["minX"], b["minX"])).alias("w"),
        (F.least(a["maxY"], b["maxY"]) - F.greatest(a["minY"], b["minY"])).alias("h"),
    )


def clip_by_convex(ring, window) -> Column:
    """The part of ``ring`` inside a convex ``window``, as a ring (right area for any ring)."""
    return _clip(ring, window, F.lit(0.0))


def inset_clip(ring, boundary, distance) -> Column:
    """The part of ``ring`` at least ``distance`` inside a convex ``boundary``."""
    return _clip(ring, boundary, _c(distance))


# fixed value: segments that stand for a quarter of a circle
QUARTER = 16


def rim_bands(ring, distance: float) -> Column:
    """Rings that cover everything within ``distance`` of the rim on the inside: a rectangle along every edge, to both sides, and at
    every concave corner the fan of an arc, whose chords stand QUARTER to the right angle."""
    sides = F.filter(edges(ring), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))

    def band(e):
        length = F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])
        normal = F.struct(((e["y1"] - e["y2"]) / length * distance).alias("x"), ((e["x2"] - e["x1"]) / length * distance).alias("y"))
        return let(normal, lambda n: F.array(
            point(e["x1"] + n["x"], e["y1"] + n["y"]), point(e["x2"] + n["x"], e["y2"] + n["y"]), point(e["x2"] - n["x"], e["y2"] - n["y"]), point(e["x1"] - n["x"], e["y1"] - n["y"])
        ))

    def corner(a, b, turn):
        ax, ay, bx, by = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
        bend, along = (ax * by - ay * bx) * turn, ax * bx + ay * by
        angle = F.when(bend < 0, F.atan2(-bend, along)).otherwise(0.0)
        chords = F.greatest(F.lit(1), F.floor(angle / (math.pi / 2 / QUARTER) + 0.5).cast("int"))
        return F.struct(a["x2"].alias("x"), a["y2"].alias("y"), F.atan2(ax * turn, -ay * turn).alias("start"), (-turn * angle / chords).alias("step"), chords.alias("chords"))

    def fan(c):
        at = lambda k: point(c["x"] + F.cos(c["start"] + c["step"] * k) * distance, c["y"] + F.sin(c["start"] + c["step"] * k) * distance)
        return F.concat(F.array(point(c["x"], c["y"])), F.transform(F.sequence(F.lit(0), c["chords"]), at))

    def around(v):
        n = F.size(v["sides"])
        corners = F.transform(v["sides"], lambda e, i: corner(e, F.get(v["sides"], (i + 1) % n), v["turn"]))
        return F.concat(F.transform(v["sides"], band), F.transform(F.filter(corners, lambda c: c["step"] != 0), fan))

    turn = F.when(signed_area(ring) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return let(F.struct(sides.alias("sides"), turn.alias("turn")), around)


def _clip(ring, window, inset: Column) -> Column:
    def plane(e, turn):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        length = F.hypot(dx, dy)
        return F.struct(
            (-dy * turn / length).alias("nx"), (dx * turn / length).alias("ny"),
            ((dx * e["y1"] - dy * e["x1"]) * turn / length + inset).alias("c"),
        )

    planes = let(
        F.when(signed_area(window) < 0, F.lit(-1.0)).otherwise(F.lit(1.0)),
        lambda turn: F.transform(edges(window), lambda e: plane(e, turn)),
    )

    def depths(e, h):
        return F.struct(
            e.alias("e"),
            (h["nx"] * e["x1"] + h["ny"] * e["y1"] - h["c"]).alias("d1"),
            (h["nx"] * e["x2"] + h["ny"] * e["y2"] - h["c"]).alias("d2"),
        )

    def piece(v):
        e, d1, d2 = v["e"], v["d1"], v["d2"]
        t = d1 / F.nullif(d1 - d2, F.lit(0.0))
        at = point(e["x1"] + t * (e["x2"] - e["x1"]), e["y1"] + t * (e["y2"] - e["y1"]))
        none = F.array().cast(RING)
        kept = F.when(d1 >= 0, F.array(point(e["x1"], e["y1"]))).otherwise(none)
        return F.concat(kept, F.when(d1 * d2 < 0, F.array(at)).otherwise(none))

    def cut(poly, h):
        return F.flatten(F.transform(F.transform(edges(poly), lambda e: depths(e, h)), piece))

    return F.aggregate(planes, opened(ring).cast(RING), cut)


def is_convex(ring) -> Column:
    """All turns go the same way."""
    def turns(es):
        n = F.size(es)
        return F.transform(
            es,
            lambda e, i: let(
                F.get(es, (i + 1) % n),
                lambda f: (e["x2"] - e["x1"]) * (f["y2"] - f["y1"]) - (e["y2"] - e["y1"]) * (f["x2"] - f["x1"]),
            ),
        )

    return let(
        let(edges(ring), turns), lambda ts: F.forall(ts, lambda t: t >= 0) | F.forall(ts, lambda t: t <= 0)
    )


def self_crossing(ring) -> Column:
    """Some two non-adjacent edges cross."""
    es = F.transform(
        edges(ring),
        lambda e, i: F.struct(i.alias("i"), e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2")),
    )
    def crosses(es):
        n = F.size(es)
        return F.exists(
            es,
            lambda a: F.exists(
                es,
                lambda b: (b["i"] > a["i"] + 1) & ~((a["i"] == 0) & (b["i"] == n - 1)) & segments_cross(a, b),
            ),
        )

    return let(es, crosses)


def rect_overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Short cut for axis-aligned rectangles."""
    w = F.least(_c(ax1), _c(bx1)) - F.greatest(_c(ax0), _c(bx0))
    h = F.least(_c(ay1), _c(by1)) - F.greatest(_c(ay0), _c(by0))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def canonical_key(ring) -> Column:
    """Direction-free key of a vertex list, two decimals."""
    words = F.transform(_c(ring), lambda p: F.format_string("(%.2f,%.2f)", p["x"], p["y"]))
    return let(words, lambda w: F.least(F.array_join(w, "-"), F.array_join(F.reverse(w), "-")))


def affine(ring, m) -> Column:
    """Apply the 2×3 matrix ``[a, b, c, d, e, f]`` (PDF order) to every vertex."""
    m = _c(m)
    return F.transform(
        _c(ring),
        lambda p: point(m[0] * p["x"] + m[2] * p["y"] + m[4], m[1] * p["x"] + m[3] * p["y"] + m[5]),
    )


def compose(m1, m2) -> Column:
    """Matrix that applies ``m1`` after ``m2`` was current: m1 × m2."""
    a, b = _c(m1), _c(m2)
    return F.array(
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )
