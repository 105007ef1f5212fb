"""Detected layouts against approved ones: greedy matching and metrics per project.

Matching is one-to-one and greedy in the order of the approved side; see ``operators.matching``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions import rings as R
from acreage.functions import text as T
from acreage.functions.rings import floor_round
from acreage.operators import matching, overlay
from acreage.operators.spatial import grid_cells
from acreage.session import cut, once

def _shape_rows(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their shape class, and the distinct shapes."""
    shapes = df.groupBy("project_id", "ring").agg(F.min("ord").alias(f"{side}_class"))
    rows = df.join(shapes.hint("merge"), ["project_id", "ring"]).select("project_id", F.col("ord").alias(f"{side}_ord"), f"{side}_class")
    return rows, shapes.withColumnRenamed("ring", f"{side}_ring")


def iou_candidates(gt_shapes: DataFrame, pred_shapes: DataFrame, threshold: float, cell: float = 500.0) -> DataFrame:
    """Pairs of distinct shapes with at least the threshold IoU, found by grid cell."""
    g = grid_cells(once(gt_shapes, g_box=R.bbox("g_ring")), cell, "g_box")
    p = grid_cells(once(pred_shapes, p_box=R.bbox("p_ring")), cell, "p_box")
    first_x = F.floor(F.greatest(F.col("g_box.minX"), F.col("p_box.minX")) / cell)
    first_y = F.floor(F.greatest(F.col("g_box.minY"), F.col("p_box.minY")) / cell)
    pairs = g.join(p.hint("merge"), ["project_id", "cx", "cy"]).filter(
        R.boxes_overlap(F.col("g_box"), F.col("p_box")) & (first_x == F.col("cx")) & (first_y == F.col("cy"))
    )
    return once(pairs, score=overlay.iou("g_ring", "p_ring")).filter((F.col("score") >= threshold) & (F.col("score") > 0)).select(
        "project_id", "g_class", "p_class", "score"
    )


def match_by_iou(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy one-to-one match by largest IoU (columns project_id, ord, ring on both sides)."""
    g_rows, g_shapes = _shape_rows(gt, "g")
    p_rows, p_shapes = _shape_rows(pred, "p")
    pairs = cut(iou_candidates(g_shapes, p_shapes, threshold))
    return matching.match_pairs(g_rows, p_rows, pairs).withColumnRenamed("score", "iou")


def match_labels(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Greedy one-to-one match of texts: equal after normalizing, else least edit distance.

    Columns project_id, ord, raw_text on both sides. Distances are only worked out for texts
    without an equal partner, between distinct texts.
    """
    g = gt.select("project_id", F.col("ord").alias("g_ord"), F.coalesce("raw_text", F.lit("")).alias("g_raw"), T.normalize_text("raw_text").alias("g_class"))
    p = pred.select("project_id", F.col("ord").alias("p_ord"), F.coalesce("raw_text", F.lit("")).alias("p_raw"), T.normalize_text("raw_text").alias("p_class"))

    pairs = matching.match_texts(g.select("project_id", "g_ord", "g_class"), p.select("project_id", "p_ord", "p_class"))
    return (
        g.join(pairs.hint("merge"), ["project_id", "g_ord"], "left").join(p.select("project_id", "p_ord", "p_raw").hint("merge"), ["project_id", "p_ord"], "left")
        .select(
            "project_id", "g_ord", "p_ord", "g_raw", "p_raw", F.col("g_class").alias("g_norm"),
            F.coalesce("score", F.length("g_class")).alias("distance"), F.coalesce(F.col("g_raw") == F.col("p_raw"), F.lit(False)).alias("exact"),
            F.coalesce(F.col("score") == 0, F.lit(False)).alias("normalized"),
        )
    )


def _ratio(a, b) -> Column:
    c = lambda v: F.col(v) if isinstance(v, str) else v
    return F.coalesce(c(a) / F.nullif(c(b).cast("double"), F.lit(0.0)), F.lit(0.0))


def missing_extra(gt: DataFrame, matches: DataFrame, pred: DataFrame) -> DataFrame:
    """Rows of either side that found no partner."""
    g = gt.join(matches.select("project_id", F.col("g_ord").alias("ord")).hint("merge"), ["project_id", "ord"], "left_anti")
    p = pred.join(matches.select("project_id", F.col("p_ord").alias("ord")).hint("merge"), ["project_id", "ord"], "left_anti")
    return g.select("project_id", "ord", F.lit("MISSING").alias("kind")).unionByName(p.select("project_id", "ord", F.lit("EXTRA").alias("kind")))


def match_errors(gt: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """IoU, centroid distance and area error of every matched pair."""
    side = lambda df, s: df.select("project_id", F.col("ord").alias(f"{s}_ord"), R.area_centroid("ring").alias(f"{s}_c"), R.ring_area("ring").alias(f"{s}_area"))
    joined = matches.join(side(gt, "g").hint("merge"), ["project_id", "g_ord"]).join(side(pred, "p").hint("merge"), ["project_id", "p_ord"])
    return joined.withColumn(
        "centroid_error", F.sqrt(F.pow(F.col("g_c.x") - F.col("p_c.x"), 2) + F.pow(F.col("g_c.y") - F.col("p_c.y"), 2))
    ).withColumn("area_error_pct", _ratio(F.abs(F.col("g_area") - F.col("p_area")) * 100.0, "g_area"))


MEDIAN_BUCKETS = 1024


def exact_median(values: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key, ``name``: the median of each key, without a buffer that grows with the key.

    Equal values are counted first; counts are summed per bucket of a key's range, and only the buckets with the middle rows are
    gone through in order.
    """
    counted = cut(values.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")))
    span = counted.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    share = (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    placed = counted.join(span, key).withColumn("bucket", F.floor(F.coalesce(share, F.lit(0.0)) * MEDIAN_BUCKETS))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lower, upper = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    sums = placed.groupBy(key, "bucket", "total").agg(F.sum("n").alias("held")).withColumn("ahead", F.coalesce(F.sum("held").over(before), F.lit(0)))
    middle = sums.filter((F.col("ahead") <= upper) & (F.col("ahead") + F.col("held") > lower)).select(key, "bucket", "ahead")
    inside = Window.partitionBy(key, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    rows = placed.join(middle, [key, "bucket"]).withColumn("first", F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    hit = lambda rank: F.max(F.when((F.col("first") <= rank) & (F.col("first") + F.col("n") > rank), F.col("v")))
    return rows.groupBy(key).agg(((hit(lower) + hit(upper)) / 2.0).alias(name))


def plot_metrics(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Counts and error means of plot detection per project."""
    matches = match_by_iou(gt, pred, threshold)
    matches = cut(matches)
    middle = exact_median(matches, "project_id", "iou", "mid")
    errors = match_errors(gt, pred, matches).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("matched"), F.avg(F.col("iou").cast("decimal(20,12)")).cast("double").alias("iou"),
        F.avg(F.col("centroid_error").cast("decimal(24,9)")).cast("double").alias("ce"), F.avg(F.col("area_error_pct").cast("decimal(24,9)")).cast("double").alias("ae"),
    )
    g = gt.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_gt"))
    p = pred.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_pred"))
    df = g.join(p, "project_id", "full_outer").join(errors, "project_id", "left").join(middle, "project_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    df = df.select(
        "project_id", z("n_gt").alias("n_gt"), z("n_pred").alias("n_pred"), z("matched").alias("matched"),
        *[floor_round(F.coalesce(c, F.lit(0.0)), k).alias(n) for c, k, n in (("iou", 4, "mean_iou"), ("mid", 4, "median_iou"), ("ce", 4, "mean_centroid_error"), ("ae", 2, "mean_area_error_pct"))],
    ).withColumn("missing", F.col("n_gt") - F.col("matched")).withColumn("extra", F.col("n_pred") - F.col("matched"))
    merged = (F.col("n_pred") < F.col("n_gt")) & (F.col("extra") == 0) & (F.col("missing") > 0)
    doubled = (F.col("n_pred") > F.col("n_gt")) & (F.col("missing") == 0) & (F.col("extra") > 0)
    return df.withColumn("merged", F.when(merged, F.col("missing")).otherwise(0)).withColumn("duplicated", F.when(doubled, F.col("extra")).otherwise(0))


def boundary_metrics(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """IoU, area and perimeter error of the boundary; defaults when a side is missing."""
    df = gt.select("project_id", F.col("ring").alias("g")).join(pred.select("project_id", F.col("ring").alias("p")), "project_id", "full_outer")
    no_g, no_p = F.col("g").isNull(), F.col("p").isNull()
    both = ~no_g & ~no_p
    iou = F.when(both, overlay.iou("g", "p")).otherwise(0.0)
    error = lambda fn: F.when(no_g, 0.0).when(no_p, 100.0).otherwise(_ratio(F.abs(fn("g") - fn("p")) * 100.0, fn("g")))
    return once(df, __iou=iou).select(
        "project_id", floor_round("__iou", 4).alias("boundary_iou"), floor_round(error(R.ring_area)).alias("area_error_pct"),
        floor_round(error(R.ring_length)).alias("perimeter_error_pct"), (both & ~R.self_crossing("p")).alias("boundary_valid"),
        F.when(no_g, 0).when(no_p, 1).otherwise(F.when(F.col("__iou") < 0.95, 1).otherwise(0)).alias("containment_failures"),
    )


def road_metrics(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """IoU of the dissolved roads, area error standing for length, and counts."""
    g = gt.groupBy("project_id").agg(F.count(F.lit(1)).alias("gt_roads"))
    p = pred.groupBy("project_id").agg(F.count(F.lit(1)).alias("pred_roads"))
    swept = overlay.set_iou(gt, pred, ["project_id"])
    err = _ratio(F.abs(F.col("a_area") - F.col("b_area")) * 100.0, "a_area")
    return g.join(p, "project_id", "full_outer").join(swept, "project_id", "left").select(
        "project_id", F.coalesce("gt_roads", F.lit(0)).alias("gt_roads"), F.coalesce("pred_roads", F.lit(0)).alias("pred_roads"),
        floor_round(F.coalesce("iou", F.lit(0.0)), 4).alias("road_iou"), floor_round(F.coalesce(err, F.lit(0.0))).alias("length_error_pct"),
        floor_round(F.coalesce("iou", F.lit(0.0)), 4).alias("connectivity"),
    )


def text_metrics(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Precision, recall, F1, exact and normalized shares, mean edit distance and its word-error proxy."""
    m = match_labels(gt, pred).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_gt"), F.count_if("exact").alias("n_exact"), F.count_if("normalized").alias("n_norm"),
        F.sum("distance").alias("sum_distance"), F.sum(F.length("g_norm")).alias("sum_length"),
    )
    p = pred.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_pred"))
    z = lambda c: F.coalesce(c, F.lit(0))
    df = m.join(p, "project_id", "full_outer").select("project_id", *[z(c).alias(c) for c in ("n_gt", "n_exact", "n_norm", "sum_distance", "sum_length", "n_pred")])
    precision, recall = _ratio("n_norm", "n_pred"), _ratio("n_norm", "n_gt")
    return df.select(
        "project_id", floor_round(precision, 4).alias("precision"), floor_round(recall, 4).alias("recall"),
        floor_round(_ratio(F.col("n_norm") * 2, F.col("n_gt") + F.col("n_pred")), 4).alias("f1"),
        floor_round(_ratio("n_exact", "n_gt"), 4).alias("exact_ratio"), floor_round(recall, 4).alias("normalized_ratio"),
        floor_round(_ratio("sum_distance", "n_gt")).alias("mean_edit_distance"), floor_round(_ratio("sum_distance", "sum_length"), 4).alias("wer"),
    )


def association_metrics(gt: DataFrame, pred: DataFrame, strict: bool = False) -> DataFrame:
    """Share of predicted labels that are linked; ``strict`` also wants the approved target."""
    linked = F.coalesce("associated_entity_id", F.lit("")) != ""
    n_gt = gt.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_gt"))
    rows = pred
    good = linked
    if strict:
        truth = gt.groupBy("project_id", "raw_text").agg(F.max_by("associated_entity_id", "ord").alias("__truth"))
        rows = pred.join(truth, ["project_id", "raw_text"], "left")
        good = linked & F.coalesce(F.col("associated_entity_id") == F.col("__truth"), F.lit(False))
    p = rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_pred"), F.count_if(good).alias("correct"), F.count_if(linked & ~good).alias("incorrect"), F.count_if(~linked).alias("unassociated")
    )
    df = n_gt.join(p, "project_id", "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0))
    total = F.when(z("n_gt") == 0, 0).when(z("n_pred") > 0, z("n_pred")).otherwise(z("n_gt"))
    return df.select(
        "project_id", total.alias("total_labels"), z("correct").alias("correct"), z("incorrect").alias("incorrect"), z("unassociated").alias("unassociated"),
        F.when(z("n_gt") == 0, 1.0).otherwise(floor_round(_ratio(z("correct"), total), 4)).alias("association_accuracy"),
    )


# fixed values: acceptance thresholds, and below the names of failures in their order
THRESHOLDS = {"min_plot_iou": 0.85, "min_boundary_iou": 0.90, "min_ocr_recall": 0.80, "min_label_association_accuracy": 0.85}


def failure_categories(df: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    """Names of everything that went wrong, in fixed order."""
    checks = [
        (~F.col("boundary_valid"), "GEOMETRY_INVALID"), (F.col("boundary_iou") < t["min_boundary_iou"], "BROKEN_BOUNDARY"),
        (F.col("merged") > 0, "MERGED_PLOTS"), (F.col("missing") > 0, "MISSING_PLOTS"), (F.col("extra") > 0, "EXTRA_PLOTS"),
        (F.col("recall") < t["min_ocr_recall"], "OCR_FAILURE"), (F.col("road_iou") < 0.5, "ROAD_FAILURE"),
        (F.col("association_accuracy") < t["min_label_association_accuracy"], "LABEL_ASSOCIATION_FAILURE"),
    ]
    return df.withColumn("failures", F.filter(F.array(*[F.when(c, n) for c, n in checks]), lambda x: x.isNotNull()))


def acceptance(df: DataFrame, t: dict = THRESHOLDS) -> DataFrame:
    """Evidence per stage and the overall verdict."""
    stages = {
        "boundary": ("boundary_iou", "min_boundary_iou"), "plots": ("mean_iou", "min_plot_iou"),
        "texts": ("recall", "min_ocr_recall"), "labels": ("association_accuracy", "min_label_association_accuracy"),
    }
    verdict = F.lit(True)
    for name, (measure, limit) in stages.items():
        ok = F.col(measure) >= t[limit]
        verdict = verdict & ok
        df = df.withColumn(f"{name}_evidence", F.struct(ok.alias("pass"), F.col(measure).alias("measured"), F.lit(t[limit]).alias("threshold")))
    return df.withColumn("is_acceptable", verdict)


def evaluate(gt: dict[str, DataFrame], pred: dict[str, DataFrame], thresholds: dict = THRESHOLDS) -> DataFrame:
    """Every metric of every project. Both sides: boundary, plots, roads, labels."""
    parts = [
        plot_metrics(gt["plots"], pred["plots"]), road_metrics(gt["roads"], pred["roads"]),
        text_metrics(gt["labels"], pred["labels"]), association_metrics(gt["labels"], pred["labels"]),
    ]
    df = boundary_metrics(gt["boundary"], pred["boundary"])
    for part in parts:
        df = df.join(part, "project_id", "full_outer")
    zeros = ["n_gt", "n_pred", "matched", "missing", "extra", "merged", "duplicated", "mean_iou", "median_iou", "boundary_iou"]
    ones = ["road_iou", "connectivity", "precision", "recall", "f1", "exact_ratio", "normalized_ratio", "association_accuracy"]
    df = df.na.fill(0, zeros).na.fill(1.0, ones).na.fill(0, ["length_error_pct", "mean_edit_distance", "wer"]).na.fill(False, ["boundary_valid"])
    return acceptance(failure_categories(df, thresholds), thresholds)
