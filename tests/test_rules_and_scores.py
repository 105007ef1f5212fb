import math

from conftest import box
from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.operators import norms as N
from acreage.operators import rules as Q
from acreage.operators import scoring as G
from acreage.operators import spatial as P

PLOT = f"project_id string, plot_id string, ord int, ring {R.RING}, road_name string"
ROAD = f"project_id string, road_id string, ring {R.RING}, width_ft double"


def report(spark, bound, plots, roads, **p):
    b = spark.createDataFrame([("p", bound)], f"project_id string, ring {R.RING}")
    pl = spark.createDataFrame([("p", str(i), i, r, "Main") for i, r in enumerate(plots)], PLOT)
    rd = spark.createDataFrame([("p", f"r{i}", r, w) for i, (r, w) in enumerate(roads)], ROAD)
    found = Q.violations(b, pl, rd, **p)
    return {r.rule_id: r.violations for r in Q.rule_results(b, found).collect()}, Q.compliance_report(b, found).first()


def test_passing_layout(spark):
    rules, overall = report(spark, box(0, 0, 300, 200), [box(10, 10, 40, 50), box(45, 10, 75, 50)], [(box(0, 85, 300, 115), 30.0)], min_plot_sqft=800.0, min_frontage_ft=20.0, min_road_width_ft=24.0, setback_ft=5.0)
    assert overall.overall and overall.passed_rules == 12 and sum(rules.values()) == 0


def test_failing_layout(spark):
    rules, overall = report(spark, box(0, 0, 100, 100), [box(-20, 30, 40, 70), box(10, 30, 60, 70)], [(box(0, 40, 100, 60), 20.0)])
    assert rules["RULE_01"] == 1 and rules["RULE_02"] == 2 and rules["RULE_05"] == 1 and rules["RULE_12"] == 1
    assert not overall.overall


def test_copies_count_as_pairs_without_being_listed(spark):
    rows = [("p", f"{i:03d}", i, box(0, 0, 10, 10), None) for i in range(50)] + [("p", "x", 99, box(5, 5, 15, 15), None)]
    df = spark.createDataFrame(rows, PLOT)
    pairs = P.overlap_pairs(df)
    assert pairs.count() == 2
    assert pairs.agg(F.sum("n_pairs")).first()[0] == 50 * 49 // 2 + 50
    assert P.expand_pairs(pairs, df).count() == 50 * 49 // 2 + 50


def test_relations(spark):
    rows = [("p", "a", 0, box(0, 0, 1000, 800), None), ("p", "b", 1, box(200, 200, 400, 400), None), ("p", "c", 2, box(400, 200, 500, 400), None), ("p", "d", 3, box(530, 200, 560, 400), None)]
    edges = {(r.src, r.dst): r for r in P.relationship_graph(spark.createDataFrame(rows, PLOT)).collect()}
    assert edges[("a", "b")].relation == "CONTAINS" and edges[("b", "a")].relation == "INSIDE"
    assert edges[("b", "c")].relation == "TOUCHES" and edges[("b", "c")].shared_len == 200.0
    assert edges[("c", "d")].relation == "NEIGHBOR" and edges[("c", "d")].distance == 30.0


def test_norms_tiers(spark):
    rows = [("small", 3000.0, False), ("mid", 6000.0, False), ("big", 25000.0, False), ("tight", 3000.0, True)]
    df = spark.createDataFrame([(i, a, "RESIDENTIAL", k, None) for i, a, k in rows], "parcel_id string, land_area_sqm double, land_use string, is_congested boolean, jurisdiction_id string")
    got = {r.parcel_id: r for r in N.applicable_norms(df, N.authorities(spark)).collect()}
    assert (got["small"].open_space_sqm, got["small"].amenity_pct, got["small"].internal_road_m, got["small"].min_plot_sqm) == (0.0, 0.0, 9.0, 100.0)
    assert (got["mid"].open_space_sqm, got["mid"].min_cluster_sqm, got["mid"].min_open_width_m) == (600.0, 400.0, 7.5)
    assert got["big"].amenity_sqm == 1250.0
    assert (got["tight"].internal_road_m, got["tight"].min_plot_sqm, got["tight"].min_frontage_m, got["tight"].setback_m) == (6.0, 50.0, 4.5, 1.5)


def test_score_fixture(spark):
    lay = spark.createDataFrame([("l", "p", 0, 100000.0)], "layout_id string, project_id string, ord int, gross_sqft double")
    plots = spark.createDataFrame([("l", 1200.0, 30.0, 40.0, "Main Road", False)] * 40, "layout_id string, area_sqft double, width_ft double, depth_ft double, road_name string, is_corner boolean")
    roads = spark.createDataFrame([("l", 18000.0, 30.0)], "layout_id string, area_sqft double, width_ft double")
    zones = spark.createDataFrame([("l", "GREEN", 10000.0)], "layout_id string, zone_type string, area_sqft double")
    r = G.score_layouts(G.layout_totals(lay, plots, roads, zones)).first()
    assert (r.util, r.accessibility, r.green_pct) == (48.0, 100.0, 10.0) and r.ratio > 2 and r.composite > 60


def test_nearest_road_both_ways(spark):
    """Few roads meet every spot; many are searched by cell. Both find the nearest middle."""
    import math

    spots = spark.createDataFrame([("p", float(x), float(y)) for x, y in ((0, 0), (50, 40), (9000, 9000), (333, 777))], "project_id string, x double, y double")
    mids = [(i, (i * 37) % 900, (i * 91) % 700) for i in range(100)]
    for n in (10, 100):
        roads = spark.createDataFrame([("p", f"r{i}", i, [(float(x) - 1, float(y)), (float(x) + 1, float(y))]) for i, x, y in mids[:n]], f"project_id string, road_id string, ord int, centerline {R.RING}")
        got = {(r.x, r.y): r.near.road_id for r in P.spot_nearest_road(spots, roads, reach=200.0).collect()}
        for x, y in got:
            best = min(mids[:n], key=lambda m: (math.hypot(m[1] - x, m[2] - y), m[0]))
            assert got[(x, y)] == f"r{best[0]}"
        assert len(got) == 4


def test_concave_boundaries_are_judged(spark):
    """Plots beside and in the slot of a U lose the ground in its band; the balance takes the whole band off."""
    from acreage.operators import detection as D

    u = [(0.0, 0.0), (300.0, 0.0), (300.0, 300.0), (200.0, 300.0), (200.0, 100.0), (100.0, 100.0), (100.0, 300.0), (0.0, 300.0)]
    shape = lambda ring: [{"x": x, "y": y} for x, y in ring]
    kind = "project_id int, plot_id int, ring array<struct<x: double, y: double>>"
    boundary = spark.createDataFrame([(1, 0, shape(u))], kind)
    plots = spark.createDataFrame([(1, 1, shape(box(85, 120, 99, 140))), (1, 2, shape(box(30, 120, 60, 140))), (1, 3, shape(box(120, 150, 150, 180)))], kind)
    found = {r.entity_id: r.measure for r in Q.rule_setback(plots, boundary, {"setback_ft": 10.0}).collect()}
    assert found == {"1": 180.0, "3": 900.0}
    none = boundary.filter("false").select("project_id", "ring")
    row = D.buildable_balance(boundary, none, none, none, 10.0).first()
    inset = 280 * 280 - 120 * 200 + 2 * (100 - 800 * math.sin(math.pi / 32))
    assert row.gross_sqft == 70000.0 and abs(row.net_sqft - inset) < 0.01 and abs(row.setback_sqft - 70000 + inset) < 0.01


def test_plots_on_concave_boundaries_are_judged_in_their_rows(spark, monkeypatch):
    """No pair of a plot and a band is written; with many vertices the tiles give the same."""
    from acreage.operators import overlay

    u = [(0.0, 0.0), (300.0, 0.0), (300.0, 300.0), (200.0, 300.0), (200.0, 100.0), (100.0, 100.0), (100.0, 300.0), (0.0, 300.0)]
    far = [(x + 400.0, y) for x, y in u[::-1]]
    square = box(0, 0, 300, 300)
    shape = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    kind = "project_id int, plot_id int, ring array<struct<x: double, y: double>>"
    boundary = spark.createDataFrame([(1, 0, shape(u)), (2, 0, shape(u)), (2, 0, shape(far)), (3, 0, shape(square)), (3, 0, shape(u)), (None, 0, shape(u)), (4, 0, None)], kind)
    dense = [(x + dx * i / 20, y + dy * i / 20) for x, y, dx, dy in [(85, 120, 14, 0), (99, 120, 0, 20), (99, 140, -14, 0), (85, 140, 0, -20)] for i in range(20)]
    rings = [box(85, 120, 99, 140), box(30, 120, 60, 140), box(120, 150, 150, 180), box(280, 20, 430, 80), box(85, 120, 99, 140)[::-1]]
    few = [(p, i, shape(r)) for p in (1, 2, 3, 4, 9, None) for i, r in enumerate(rings)] + [(1, 9, None)]
    judge = lambda rows: sorted((r.project_id, r.entity_id, r.measure) for r in Q.rule_setback(spark.createDataFrame(rows, kind), boundary, {"setback_ft": 10.0}).collect())
    want = [
        (1, "0", 180.0), (1, "2", 900.0), (1, "3", 8400.0), (1, "4", 180.0), (2, "0", 180.0), (2, "2", 900.0), (2, "3", 7200.0), (2, "4", 180.0),
        (3, "0", 180.0), (3, "2", 900.0), (3, "3", 8400.0), (3, "3", 8400.0), (3, "4", 180.0),
    ]
    with_dense = judge([*few, (1, 7, shape(dense))])
    assert with_dense == sorted([*want, (1, "7", 180.0)])
    monkeypatch.setattr(Q, "ROW_POINTS", 15)
    assert judge(few) == want
    monkeypatch.setattr(Q, "ROW_POINTS", 64)
    monkeypatch.setattr(overlay, "cut", None)
    assert judge(few) == want


def test_copies_get_their_neighbours(spark):
    rows = [(1, 1, box(0, 0, 10, 10)), (1, 2, box(0, 0, 10, 10)), (1, 3, box(10, 0, 20, 10))]
    prims = spark.createDataFrame([(p, i, [{"x": x, "y": y} for x, y in ring]) for p, i, ring in rows], "project_id int, plot_id int, ring array<struct<x: double, y: double>>")
    near = {r.plot_id: r.neighbours for r in P.neighbours(P.expand_edges(P.relationship_graph(prims), prims)).collect()}
    assert near == {1: [3], 2: [3], 3: [1, 2]}


def test_facing_follows_the_rotation(spark):
    from acreage.operators import versions as V

    point = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    plots = spark.createDataFrame([(1, 1, point(box(0, 0, 10, 10)), "WEST"), (2, 2, point(box(0, 0, 10, 10)), "WEST"), (3, 3, point(box(0, 0, 10, 10)), None)], f"project_id int, plot_id int, ring {R.RING}, facing string")
    roads = spark.createDataFrame([(p, "r", 1, point([(-50, 15), (50, 15)])) for p in (1, 2)], f"project_id int, road_id string, ord int, centerline {R.RING}")
    turns = spark.createDataFrame([(1, 0.0), (2, 90.0)], "project_id int, rotation double")
    got = {r.project_id: r.facing for r in V.refresh_facing(plots, roads, turns).collect()}
    points = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
    assert got[3] == "UNKNOWN" and points.index(got[2]) == (points.index(got[1]) + 2) % 8


def test_rules_without_inputs_are_not_passed(spark):
    b = spark.createDataFrame([("p", [{"x": x, "y": y} for x, y in box(0, 0, 9, 9)])], f"project_id string, ring {R.RING}")
    found = spark.createDataFrame([], "project_id string, rule_id string, entity_id string, measure double, n long")
    assert Q.unchecked() == ["RULE_03", "RULE_04"] and Q.unchecked(b, b, setback_ft=0.0) == ["RULE_11"]
    rows = {r.rule_id: r.passed for r in Q.rule_results(b, found, Q.unchecked()).collect()}
    assert rows["RULE_03"] is None and rows["RULE_04"] is None and rows["RULE_01"] is True
