"""Two layout scores, variant statistics, ranking and badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage import constants as K
from acreage.functions.rings import floor_round
from acreage.functions.scalars import clamp
from acreage.session import first_per_key, numbered

DEC = "decimal(28,6)"


def _sum(col, when: Column | None = None) -> Column:
    value = F.coalesce(F.col(col).cast(DEC), F.lit(0).cast(DEC))
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0)).cast("double")


def _aspect(w, h) -> Column:
    one = F.lit(1.0)
    return F.greatest(w / F.greatest(one, h), h / F.greatest(one, w))


def _zero(c: str) -> Column:
    return F.coalesce(c, F.lit(0.0))


def layout_totals(layouts: DataFrame, plots: DataFrame, roads: DataFrame, zones: DataFrame) -> DataFrame:
    """Per-layout sums of plots, roads and zones: one aggregation each, joined on the layout."""
    w, d = F.coalesce("width_ft", F.lit(30.0)), F.coalesce("depth_ft", F.lit(40.0))
    has_road = F.coalesce("road_name", F.lit("")) != ""
    aspect = _aspect(w, d)
    v1 = F.when(aspect <= 2.2, 10).when(aspect <= 3.0, 6).otherwise(2)
    one = F.lit(1.0)
    squared = F.greatest(F.greatest(one, w) / F.greatest(one, d), F.greatest(one, d) / F.greatest(one, w))
    v2 = F.when(squared <= 2.5, 10).when(squared <= 3.5, 5).otherwise(0)
    p = plots.groupBy("layout_id").agg(
        F.count(F.lit(1)).alias("n_plots"), _sum("area_sqft").alias("plot_area"),
        F.count_if(has_road & (w >= 15.0)).alias("n_access"), F.sum(v1).alias("regular_v1"), F.sum(v2).alias("regular_v2"),
        F.count_if(F.coalesce("is_corner", F.lit(False))).alias("n_corner"),
    )
    r = roads.groupBy("layout_id").agg(F.count(F.lit(1)).alias("n_roads"), _sum("area_sqft").alias("road_area"), F.min("width_ft").alias("min_road_width"))
    amenity = F.contains(F.coalesce("zone_type", F.lit("")), F.lit("AMENITY"))
    utility = F.contains(F.coalesce("zone_type", F.lit("")), F.lit("UTILITY"))
    z = zones.groupBy("layout_id").agg(
        F.count(F.lit(1)).alias("n_zones"), _sum("area_sqft", ~amenity).alias("open_area"), _sum("area_sqft", amenity).alias("amenity_area"),
        _sum("area_sqft", utility).alias("utility_area"),
    )
    out = layouts.join(p, "layout_id", "left").join(r, "layout_id", "left").join(z, "layout_id", "left")
    doubles = ["plot_area", "road_area", "open_area", "amenity_area", "utility_area"]
    counts = ["n_plots", "n_access", "regular_v1", "regular_v2", "n_corner", "n_roads", "n_zones"]
    for c in doubles:
        out = out.withColumn(c, _zero(c))
    for c in counts:
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    return out


# fixed values: weights, penalties and cut-offs of the two scores below
def score_layouts(totals: DataFrame, target_plot_sqft: float = 1200.0) -> DataFrame:
    """Composite v1: six weighted sub-scores less penalties for violations and unused land.

    ``totals`` may carry ``errors`` and ``warnings`` of the compliance report.
    """
    errors = F.coalesce("errors", F.lit(0)) if "errors" in totals.columns else F.lit(0)
    warnings = F.coalesce("warnings", F.lit(0)) if "warnings" in totals.columns else F.lit(0)
    gross = F.greatest(F.lit(1.0), F.col("gross_sqft"))
    n = F.greatest(F.lit(1), F.col("n_plots"))
    df = totals.select(
        "*", gross.alias("gross"), errors.alias("e"), warnings.alias("wn"),
        (F.col("plot_area") / gross * 100.0).alias("util"), (F.col("n_access") / n * 100.0).alias("accessibility"),
        (F.col("regular_v1") * 10.0 / n).alias("practicality"), (F.col("plot_area") / F.greatest(F.lit(1.0), F.col("road_area"))).alias("ratio"),
        (F.col("open_area") / gross * 100.0).alias("green_pct"), (F.col("amenity_area") / gross * 100.0).alias("amenity_pct"),
    )
    public = F.col("green_pct") + F.col("amenity_pct")
    u, ratio = F.col("util"), F.col("ratio")
    used = F.col("plot_area") + F.col("road_area") + F.col("open_area") + F.col("amenity_area")
    residual = F.greatest(F.lit(0.0), F.col("gross") - used) / F.col("gross") * 100.0
    df = df.select(
        "*",
        F.when(F.col("e") > 0, F.greatest(F.lit(0.0), 100.0 - F.col("e") * 40.0)).otherwise(F.greatest(F.lit(70.0), 100.0 - F.col("wn") * 3.0)).alias("compliance"),
        F.when(F.col("e") > 0, F.col("e") * 35.0 + F.col("wn") * 2.0).otherwise(F.col("wn") * 2.0).alias("violation_penalty"),
        F.when(u.between(50.0, 65.0), 100.0).when(u < 50.0, F.greatest(F.lit(0.0), u / 50.0 * 100.0)).otherwise(F.greatest(F.lit(50.0), 100.0 - (u - 65.0) * 3.0)).alias("utilization"),
        F.when(ratio.between(2.0, 3.5), 100.0).when(ratio < 2.0, F.greatest(F.lit(40.0), ratio / 2.0 * 100.0)).otherwise(F.greatest(F.lit(60.0), 100.0 - (ratio - 3.5) * 10.0)).alias("road_efficiency"),
        F.when(public >= 10.0, 100.0).when(public >= 5.0, 75.0 + (public - 5.0) * 5.0).otherwise(public / 5.0 * 75.0).alias("open_space"),
        F.when(residual > 15.0, (residual - 15.0) * 1.5).otherwise(0.0).alias("residual_penalty"),
    )
    composite = (
        0.25 * F.col("compliance") + 0.20 * F.col("accessibility") + 0.15 * F.col("practicality") + 0.15 * F.col("utilization")
        + 0.15 * F.col("road_efficiency") + 0.10 * F.col("open_space")
    ) - F.col("violation_penalty") - F.col("residual_penalty")
    target_yield = F.greatest(F.lit(1.0), F.col("gross") * 0.60 / max(100.0, target_plot_sqft))
    buildable = F.col("gross") * 0.75
    if "buildable_sqft" in totals.columns:
        buildable = F.when(F.col("buildable_sqft") > 0, F.col("buildable_sqft")).otherwise(buildable)
    return df.select(
        *[c for c in totals.columns if c not in ("compliance_pct",)],
        clamp(composite, 0, 100).alias("composite"), "compliance", "accessibility", "practicality", "utilization", "road_efficiency", "open_space",
        F.least(F.lit(100.0), F.col("n_plots") / target_yield * 100.0).alias("yield_score"),
        clamp(F.col("plot_area") / buildable * 100.0 * 1.25, 0, 100).alias("boundary_fit"),
        "violation_penalty", "residual_penalty", "util", "green_pct", "amenity_pct", "ratio", (F.col("e") == 0).alias("is_compliant"),
    )


def evaluate_layouts(totals: DataFrame, target_garden_pct: float = 10.0, min_road_width_ft: float = 24.0) -> DataFrame:
    """Composite v2: five sub-scores with their own cut-offs, and the compliance flags."""
    land = F.when(F.col("gross_sqft") > 0, F.col("gross_sqft")).otherwise(F.col("plot_area") + F.col("road_area"))
    pct = lambda c: F.coalesce(c / F.nullif(F.col("land"), F.lit(0.0)) * 100.0, F.lit(0.0))
    df = totals.withColumn("land", land)
    df = df.select(
        "*", pct(F.col("plot_area")).alias("u"), pct(F.col("open_area") + F.col("amenity_area")).alias("g"),
        (F.col("n_access") / F.greatest(F.lit(1), F.col("n_plots")) * 100.0).alias("access_score"),
        F.when(F.col("road_area") > 0, F.col("plot_area") / F.nullif("road_area", F.lit(0.0))).otherwise(1.0).alias("road_ratio"),
        (F.col("regular_v2") * 10.0 / F.greatest(F.lit(1), F.col("n_plots"))).alias("shape_score"),
    )
    u, g = F.col("u"), F.col("g")
    df = df.select(
        "*",
        F.when(u.between(50.0, 65.0), 100.0).when(u < 50.0, F.greatest(F.lit(0.0), u / 50.0 * 100.0)).otherwise(F.greatest(F.lit(50.0), 100.0 - (u - 65.0) * 2.5)).alias("util_score"),
        F.when(g >= target_garden_pct, 100.0).otherwise(g / max(1.0, target_garden_pct) * 100.0).alias("green_score"),
        F.when(F.col("road_ratio") >= 2.5, 100.0).otherwise(F.least(F.lit(100.0), F.col("road_ratio") / 2.5 * 100.0)).alias("efficiency_score"),
    )
    composite = 0.30 * F.col("util_score") + 0.25 * F.col("access_score") + 0.20 * F.col("green_score") + 0.15 * F.col("efficiency_score") + 0.10 * F.col("shape_score")
    width_ok = F.coalesce(F.col("min_road_width") >= min_road_width_ft - 1.0, F.lit(False))
    open_ok = g >= min(8.0, target_garden_pct * 0.8)
    front_ok = F.col("access_score") >= 95.0
    return df.withColumn("composite", composite).select(
        *totals.columns, "composite", "util_score", "access_score", "green_score", "efficiency_score", "shape_score", "road_ratio",
        width_ok.alias("min_road_width_met"), open_ok.alias("open_space_met"), front_ok.alias("frontage_met"),
        (width_ok & open_ok & front_ok & (F.col("composite") >= 65.0)).alias("overall_compliant"),
    )


def variant_stats(totals: DataFrame) -> DataFrame:
    """Areas in both units, percentages, corner plots and averages of each variant."""
    sqm = lambda c: floor_round(F.col(c) * K.SQFT_TO_SQM_SCORER, 1)
    land = F.greatest(F.lit(1.0), F.col("gross_sqft"))
    pct = lambda c: floor_round(F.col(c) / land * 100.0, 1)
    avg = F.col("plot_area") / F.greatest(F.lit(1), F.col("n_plots"))
    return totals.select(
        "layout_id", F.col("n_plots").alias("total_plots"), F.col("n_corner").alias("corner_plots"),
        floor_round("gross_sqft", 1).alias("land_sqft"), sqm("gross_sqft").alias("land_sqm"),
        floor_round("plot_area", 1).alias("plot_sqft"), sqm("plot_area").alias("plot_sqm"),
        floor_round(avg, 1).alias("avg_plot_sqft"), floor_round(avg * K.SQFT_TO_SQM_SCORER, 1).alias("avg_plot_sqm"),
        floor_round("road_area", 1).alias("road_sqft"), sqm("road_area").alias("road_sqm"), pct("road_area").alias("road_pct"),
        floor_round("open_area", 1).alias("open_sqft"), pct("open_area").alias("open_pct"),
        floor_round("amenity_area", 1).alias("amenity_sqft"), pct("amenity_area").alias("amenity_pct"),
        floor_round("utility_area", 1).alias("utility_sqft"), pct("plot_area").alias("utilization_pct"), "n_roads", "n_zones",
    )


def rank_variants(scored: DataFrame, key: str = "project_id", few: bool = False) -> DataFrame:
    """Rank by composite score, ties in given order; badge of the first three, else its option number.

    ``few``: no key has many rows, so they are numbered together, and ``scored`` is worked out once instead of twice.
    """
    order = [F.desc("composite"), F.asc("ord")]
    if few:
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    else:
        ranked = numbered(scored, [key], order, F.floor("composite"), "rank", descending=True)
    badge = F.get(F.array(*map(F.lit, K.OPTION_BADGES)), (F.col("rank") - 1).cast("int"))
    return ranked.withColumn("badge", F.coalesce(badge, F.concat(F.lit("OPTION "), F.col("rank").cast("string"))))


def top_variants(scored: DataFrame, n: int = 3, key: str = "project_id") -> DataFrame:
    return first_per_key(scored, [key], [F.desc("composite"), F.asc("ord")], n, "rank")


def strategy_comparison(scored: DataFrame) -> DataFrame:
    return scored.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("variants"), floor_round(F.avg(F.col("composite").cast(DEC)).cast("double"), 2).alias("mean_composite"),
        floor_round(F.max("composite"), 2).alias("best_composite"), F.sum("n_plots").alias("plots"),
    )
