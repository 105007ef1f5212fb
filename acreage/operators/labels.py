"""Plan labels: sanitizing, parsing, and linking to plots, roads and the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acreage.functions import text as T
from acreage.functions.rings import floor_round
from acreage.operators import spatial as P
from acreage.session import once

# fixed values: words that mark a label as site-wide
SITE_WORDS = r"NORTH|SURVEY|S\.NO|SY\.NO|LAYOUT|KEY PLAN"


def parse_labels(df: DataFrame, col: str = "text") -> DataFrame:
    """Cleaned text, its four parses and its class. Repeated texts are parsed where they are: a projection."""
    clean = once(df, clean=T.sanitize_label(col))
    parsed = once(
        clean, dimension=T.parse_dimension("clean"), area_value=T.parse_area("clean"), road=T.parse_road("clean"), plot_no=T.parse_plot_no("clean")
    )
    return parsed.withColumn("classification", T.classify_clean("clean", "dimension", "area_value", "road", "plot_no"))


def associate_labels(labels: DataFrame, plots: DataFrame, roads: DataFrame, boundary_id: str = "boundary-001", max_dist: float = 200.0) -> DataFrame:
    """Link every label: boundary, else road, else plot (inside, else box, else nearest), else unassigned.

    ``labels``: project_id, label_id, text, classification, x, y. Plots and roads carry ``ord``,
    the order in which ties are decided.
    """
    upper = F.upper(F.trim("text"))
    kind = F.coalesce("classification", F.lit(""))
    is_site = (kind == "BOUNDARY_OR_GLOBAL") | upper.rlike(SITE_WORDS)
    is_road = (kind == "ROAD_LABEL") | upper.rlike("ROAD|STREET|AVENUE") | (
        upper.contains("FT") & ~upper.contains("SQ") & upper.contains("WIDE")
    )
    marked = labels.withColumn("route", F.when(is_site, "SITE").when(is_road, "ROAD").otherwise("PLOT"))
    spots = marked.filter(F.col("route") != "SITE").select("project_id", "x", "y").distinct()
    road_spots = marked.filter(F.col("route") == "ROAD").select("project_id", "x", "y").distinct()
    hits = P.spot_hits(spots, P._shapes(plots), max_dist)
    near = P.spot_nearest(spots, P.centres(plots), max_dist)
    by_road = P.spot_nearest_road(road_spots, roads).withColumnRenamed("near", "road")
    keys = ["project_id", "x", "y"]
    found = marked.hint("merge").join(hits.hint("merge"), keys, "left").join(near.hint("merge"), keys, "left").join(by_road.hint("merge"), keys, "left")
    site, road = F.col("route") == "SITE", (F.col("route") == "ROAD") & F.col("road").isNotNull()
    in_ring, in_box = F.col("in_ring").isNotNull(), F.col("in_box").isNotNull()
    is_near = F.col("near").isNotNull()
    text_id = lambda c: F.col(c).cast("string")
    kind_out = (
        F.when(site, "PROJECT_BOUNDARY").when(road, "ROAD_NETWORK").when(in_ring, "POINT_IN_POLYGON")
        .when(in_box, "BBOX_INTERSECTION").when(is_near, "NEAREST_POLYGON").otherwise("UNASSIGNED")
    )
    target = (
        F.when(site, F.lit(boundary_id)).when(road, text_id("road.road_id")).when(in_ring, text_id("in_ring.plot_id"))
        .when(in_box, text_id("in_box.plot_id")).when(is_near, text_id("near.plot_id"))
    )
    distance = (
        F.when(site, 0.0).when(road, F.col("road.dist")).when(in_ring, 0.0)
        .when(in_box, F.hypot(F.col("x") - F.col("in_box.c.x"), F.col("y") - F.col("in_box.c.y"))).when(is_near, F.col("near.dist")).otherwise(-1.0)
    )
    return found.select(
        *labels.columns, target.alias("assigned_to"), kind_out.alias("assignment_type"), floor_round(distance).alias("distance")
    )


def unassigned(assignments: DataFrame) -> DataFrame:
    return assignments.filter(F.col("assignment_type") == "UNASSIGNED")


def label_plots(plots: DataFrame, assignments: DataFrame) -> DataFrame:
    """Plots with the number, area and dimension texts of their labels (latest number and area win)."""
    upper = F.upper("text")
    is_area = (F.col("classification") == "AREA") | upper.contains("AREA") | upper.contains("SQ")
    is_dim = ~is_area & ((F.col("classification") == "DIMENSION") | upper.contains("X") | upper.contains("*"))
    on_plot = assignments.filter(F.col("assignment_type").isin("POINT_IN_POLYGON", "BBOX_INTERSECTION", "NEAREST_POLYGON"))
    number = F.coalesce(T.parse_plot_no("text")["formattedLabel"], F.col("text"))
    marked = F.col("classification") == "PLOT_LABEL"
    per_plot = on_plot.groupBy("project_id", F.col("assigned_to").alias("__plot")).agg(
        F.coalesce(
            F.max_by(F.when(~is_area & ~is_dim & marked, number), F.when(~is_area & ~is_dim & marked, F.col("ord"))),
            F.min_by(F.when(~is_area & ~is_dim, number), F.when(~is_area & ~is_dim, F.col("ord"))),
        ).alias("plot_number"),
        F.max_by(F.when(is_area, F.col("text")), F.when(is_area, F.col("ord"))).alias("area_label"),
        F.count_if(is_dim).alias("n_dimension_labels"),
    )
    return plots.join(
        per_plot, (plots["project_id"] == per_plot["project_id"]) & (plots["plot_id"].cast("string") == F.col("__plot")), "left"
    ).drop(per_plot["project_id"]).drop("__plot")


def name_roads(roads: DataFrame, assignments: DataFrame) -> DataFrame:
    """Roads with the text of their last label; others are named after their id."""
    texts = assignments.filter(F.col("assignment_type") == "ROAD_NETWORK").groupBy(
        "project_id", F.col("assigned_to").alias("road_id")
    ).agg(F.max_by("text", "ord").alias("__text"))
    name = F.coalesce("__text", F.concat(F.lit("ROAD-"), F.right(F.col("road_id"), F.lit(3))))
    return roads.join(texts, ["project_id", "road_id"], "left").withColumn("road_name", name).drop("__text")


def word_accuracy(gt: DataFrame, pred: DataFrame, key: str, words: str = "words") -> DataFrame:
    """Precision, recall and F1 of predicted word sets per key."""
    exact = lambda c: T.word_set(F.split(c, r"\s+"))
    both = gt.select(key, exact(words).alias("g")).join(pred.select(key, exact(words).alias("p")), key, "full_outer")
    empty = F.array().cast("array<string>")
    g, p = F.coalesce("g", empty), F.coalesce("p", empty)
    sized = both.select(key, F.size(g).alias("n_gt"), F.size(p).alias("n_pred"), F.size(F.array_intersect(g, p)).alias("n_common"))
    ratio = lambda n: F.coalesce(F.col("n_common") / F.nullif(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0))
    f1 = F.coalesce(F.col("n_common") * 2.0 / F.nullif((F.col("n_gt") + F.col("n_pred")).cast("double"), F.lit(0.0)), F.lit(0.0))
    return sized.withColumn("precision", floor_round(ratio("n_pred"), 4)).withColumn("recall", floor_round(ratio("n_gt"), 4)).withColumn(
        "f1", floor_round(f1, 4)
    )
