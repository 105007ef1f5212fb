"""Polygon functions against closed forms."""

import random

from conftest import box
from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.operators import detection as D
from acreage.operators import overlay as O

L_SHAPE = [(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (4.0, 4.0), (4.0, 10.0), (0.0, 10.0)]


def frame(spark, rows):
    return spark.createDataFrame(rows, f"id int, a {R.RING}, b {R.RING}")


def test_overlap_area_of_known_shapes(spark):
    rows = [
        (1, L_SHAPE, box(2, 2, 8, 8)), (2, box(0, 0, 100, 100), [(10.0, 10.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]),
        (3, box(0, 0, 10, 10), box(10, 2, 20, 8)), (4, box(0, 0, 10, 10)[::-1], box(5, 5, 15, 15)),
    ]
    got = {r.id: r for r in frame(spark, rows).select("id", R.overlap_area("a", "b").alias("o"), R.ring_distance("a", "b").alias("d"), R.shared_length("a", "b").alias("s")).collect()}
    assert [round(got[i].o, 6) for i in (1, 2, 3, 4)] == [20.0, 9000.0, 0.0, 25.0]
    assert got[3].d == 0.0 and got[3].s == 6.0


def test_random_rectangles_overlap_and_union(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for i in range(60):
        a = [rng.randint(0, 50) for _ in range(2)]
        b = [rng.randint(0, 50) for _ in range(2)]
        ra = (a[0], a[1], a[0] + rng.randint(1, 40), a[1] + rng.randint(1, 40))
        rb = (b[0], b[1], b[0] + rng.randint(1, 40), b[1] + rng.randint(1, 40))
        w = max(0, min(ra[2], rb[2]) - max(ra[0], rb[0])) * max(0, min(ra[3], rb[3]) - max(ra[1], rb[1]))
        rows.append((i, box(*ra), box(*rb)))
        want[i] = (w, (ra[2] - ra[0]) * (ra[3] - ra[1]) + (rb[2] - rb[0]) * (rb[3] - rb[1]) - w)
    df = frame(spark, rows)
    pair = {r.id: r.o for r in df.select("id", R.overlap_area("a", "b").alias("o")).collect()}
    sides = df.select("id", F.lit("A").alias("side"), F.col("a").alias("ring")).unionByName(df.select("id", F.lit("B").alias("side"), F.col("b").alias("ring")))
    swept = {r.id: r for r in O.sweep_areas(sides, ["id"], tile=16.0).collect()}
    for i, (common, union) in want.items():
        assert abs(pair[i] - common) < 1e-6
        assert abs(swept[i].both_area - common) < 1e-6 and abs(swept[i].union_area - union) < 1e-6


def test_clip_setback_and_self_crossing(spark):
    df = frame(spark, [(1, box(0, 0, 100, 100), [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)])])
    r = df.select(R.ring_area(R.inset_clip("a", "a", F.lit(10.0))).alias("inner"), R.self_crossing("a").alias("a"), R.self_crossing("b").alias("b"), R.is_convex("a").alias("c")).first()
    assert (r.inner, r.a, r.b, r.c) == (6400.0, False, True, True)


def test_shape_class_and_hull(spark):
    df = spark.createDataFrame([(1, L_SHAPE), (2, box(0, 0, 10, 10)), (3, [(0.0, 0.0), (10.0, 0.0), (8.0, 8.0), (2.0, 8.0)])], f"project_id int, ring {R.RING}")
    got = {r.project_id: r.shape_type for r in D.shape_class(df).collect()}
    assert got == {1: "L_SHAPED", 2: "RECTANGULAR", 3: "TRAPEZOIDAL"}
    pts = df.select("project_id", F.explode("ring").alias("p")).select("project_id", "p.*")
    hull = {r.project_id: r.a for r in O.convex_hull(pts, ["project_id"]).select("project_id", R.ring_area("ring").alias("a")).collect()}
    assert hull[1] == 82.0 and hull[2] == 100.0


def test_dedupe_is_idempotent_and_direction_free(spark):
    df = spark.createDataFrame([(1, 1, box(0, 0, 1, 1)), (1, 2, box(0, 0, 1, 1)[::-1]), (1, 3, box(0, 0, 2, 1))], f"project_id int, ord int, points {R.RING}")
    once = D.dedupe_primitives(df, ["project_id"])
    assert sorted((r.ord, r.copies) for r in once.collect()) == [(1, 2), (3, 1)]
    assert D.dedupe_primitives(once.drop("copies"), ["project_id"]).count() == 2


def test_shapes_far_from_the_origin_keep_their_digits(spark):
    from acreage.operators import spatial as P

    far = 2.0e7
    rows = [(1, 1, [(far, far), (far + 30, far + 10), (far + 20, far + 40), (far - 10, far + 30)]), (1, 2, [(far + 30, far + 10), (far + 60, far + 20), (far + 50, far + 50), (far + 20, far + 40)])]
    df = spark.createDataFrame([(p, i, [{"x": x, "y": y} for x, y in ring]) for p, i, ring in rows], f"project_id int, plot_id int, ring {R.RING}")
    edge = P.relationship_graph(df).first()
    assert edge.relation in ("SHARED_EDGE", "TOUCHES") and abs(edge.shared_len - 1000**0.5) < 0.01 and edge.overlap_area == 0.0
    assert [r.a for r in df.select(R.ring_area("ring").alias("a")).collect()] == [1000.0, 1000.0]


def test_a_tile_with_many_edges_is_split_and_the_areas_stay(spark):
    """Twelve thousand small triangles in one tile: exact union by a raster of their legs, no tile above the bound."""
    rows = [(1, "A" if (i + j) % 2 else "B", [(i * 2.0, j * 2.0), (i * 2.0 + 1.5, j * 2.0), (i * 2.0, j * 2.0 + 1.5)]) for i in range(60) for j in range(60)]
    polys = spark.createDataFrame([(k, s, [{"x": x, "y": y} for x, y in r]) for k, s, r in rows], f"project_id int, side string, ring {R.RING}")
    boxed = polys.withColumn("bbox", R.bbox("ring"))
    tiles = O.dense_tiles(boxed, ["project_id"], 256.0, 300)
    sizes = tiles.groupBy("cx", "cy", "tile").count().collect()
    assert max(r["count"] for r in sizes) * 3 <= 300 and {r["tile"] for r in sizes} < {256.0, 128.0, 64.0, 32.0, 16.0, 8.0}
    got = O.sweep_areas(polys, ["project_id"], 256.0, 300).first()
    assert abs(got.union_area - 3600 * 1.125) < 1e-6 and abs(got.a_area - 1800 * 1.125) < 1e-6 and got.both_area < 1e-9
    assert O.sweep_areas(polys, ["project_id"]).first().union_area - got.union_area < 1e-6


def test_groups_swept_in_a_row_equal_groups_swept_by_tiles(spark):
    rng, rows = random.Random(5), []
    for g in range(12):
        for _ in range(rng.randint(1, 7)):
            x, y, n = rng.uniform(0, 300) + 5000 * (g % 3), rng.uniform(0, 300), rng.randint(3, 6)
            ring = [(x + rng.uniform(20, 150) * c, y + rng.uniform(20, 150) * s) for c, s in [(1, 0), (0.5, 0.9), (-0.5, 0.9), (-1, 0), (-0.5, -0.9), (0.5, -0.9)][:n]]
            rows.append((g or None, rng.choice("AB"), ring[:: rng.choice((1, -1))]))
    df = spark.createDataFrame(rows, f"k int, side string, ring {R.RING}")
    by_row, by_tile, mixed = ({r.k: r for r in O.sweep_areas(df, ["k"], row_points=most).collect()} for most in (256, -1, 20))
    assert set(by_row) == set(by_tile) == set(mixed) == set(range(1, 12))
    for k, r in by_tile.items():
        assert all(abs(by_row[k][c] - r[c]) < 1e-6 and abs(mixed[k][c] - r[c]) < 1e-6 for c in r.asDict() if c != "k")


def test_many_small_insets_are_no_rows_of_spans(spark):
    df = spark.createDataFrame([(i, [(x + 9000.0 * i, y) for x, y in L_SHAPE]) for i in range(3)], f"id int, ring {R.RING}")
    swept = O.sweep_areas(df.select("id", F.lit("A").alias("side"), "ring"), ["id"])
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and {round(r.a_area, 6) for r in swept.collect()} == {64.0}
