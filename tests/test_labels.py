from conftest import box

from acreage.functions import rings as R
from acreage.operators import labels as L


def test_parse_and_classify(spark):
    cases = {
        "30' x 40'": "DIMENSION", "1200 SQFT": "AREA", "30' WIDE ROAD": "ROAD_LABEL", "PLOT NO. 10": "PLOT_LABEL", "102": "PLOT_LABEL",
        "SURVEY NO 45/1": "BOUNDARY_OR_GLOBAL", "hello": "GENERAL_TEXT", "": "OTHER",
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r.text: r for r in L.parse_labels(df).collect()}
    assert {t: got[t].classification for t in cases} == cases
    assert got["30' x 40'"].dimension.areaApprox == 1200.0
    assert got["PLOT NO. 10"].plot_no.formattedLabel == "PLOT-10"


def test_sanitize(spark):
    df = spark.createDataFrame([("15OO",), ("P-l0",), ("|30'0\" X 40'0\"~",)], "text string")
    got = [r.clean for r in L.parse_labels(df).collect()]
    assert got == ["1500", "P-10", "30'0\" x 40'0\""]


def test_association_fixture(spark):
    plots = spark.createDataFrame([(1, "101", 0, box(100, 100, 200, 200)), (1, "102", 1, box(200, 100, 300, 200))], f"project_id int, plot_id string, ord int, ring {R.RING}")
    roads = spark.createDataFrame([(1, "road-1", 0, [(100.0, 400.0), (900.0, 400.0)])], f"project_id int, road_id string, ord int, centerline {R.RING}")
    rows = [
        ("n", "NORTH", 500, 20), ("r", "MAIN ROAD 40FT", 500, 400), ("a", "101", 150, 150), ("s", "AREA: 1200 SQ FT", 250, 160),
        ("b", "102", 320, 150), ("y", "SURVEY NO 45/1", 50, 50), ("far", "999", 5000, 5000),
    ]
    labels = spark.createDataFrame([(1, i, t, None, float(x), float(y)) for i, t, x, y in rows], "project_id int, label_id string, text string, classification string, x double, y double")
    got = {r.label_id: (r.assigned_to, r.assignment_type) for r in L.associate_labels(labels, plots, roads).collect()}
    assert got["a"] == ("101", "POINT_IN_POLYGON") and got["s"][0] == "102"
    assert got["b"] == ("102", "NEAREST_POLYGON") and got["r"] == ("road-1", "ROAD_NETWORK")
    assert got["n"][1] == got["y"][1] == "PROJECT_BOUNDARY" and got["far"] == (None, "UNASSIGNED")
