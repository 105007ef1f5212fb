"""Twelve compliance rules, their report, draft review and approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.functions.rings import floor_round
from acreage.operators import inventory, overlay, spatial
from acreage.operators.versions import duplicate_numbers
from acreage.session import cut, once

# fixed values: rule numbers, names and severities
RULES = [
    ("RULE_01", "PLOTS_CONTAINED_IN_BOUNDARY", "ERROR"),
    ("RULE_02", "ZERO_ROAD_OVERLAP", "ERROR"),
    ("RULE_03", "ZERO_GREEN_SPACE_OVERLAP", "ERROR"),
    ("RULE_04", "ZERO_OBSTACLE_OVERLAP", "ERROR"),
    ("RULE_05", "ZERO_PLOT_MUTUAL_OVERLAP", "ERROR"),
    ("RULE_06", "MIN_PLOT_AREA_SATISFIED", "WARNING"),
    ("RULE_07", "MIN_FRONTAGE_WIDTH_SATISFIED", "WARNING"),
    ("RULE_08", "DIRECT_ROAD_ACCESS_VERIFIED", "ERROR"),
    ("RULE_09", "TOPOLOGICAL_VALIDITY_GEOS", "ERROR"),
    ("RULE_10", "NO_SELF_INTERSECTIONS_OR_SLIVERS", "ERROR"),
    ("RULE_11", "SETBACK_COMPLIANCE", "WARNING"),
    ("RULE_12", "ROAD_CORRIDOR_WIDTH_COMPLIANT", "ERROR"),
]

DEFAULTS = {"min_plot_sqft": 800.0, "min_frontage_ft": 20.0, "min_road_width_ft": 24.0, "setback_ft": 10.0}


def tolerance(area: Column) -> Column:
    """Overlap that is still forgiven: 3.5 square feet or half a percent."""
    return F.greatest(F.lit(3.5), area * 0.005)


def _hit(df: DataFrame, rule: str, entity: Column, measure: Column, weight: Column | None = None) -> DataFrame:
    return df.select(
        "project_id", F.lit(rule).alias("rule_id"), entity.cast("string").alias("entity_id"),
        floor_round(measure.cast("double")).alias("measure"), (F.lit(1) if weight is None else weight).cast("long").alias("n"),
    )


def _with_boundary(plots: DataFrame, boundary: DataFrame) -> DataFrame:
    """Plots with their boundary; ``boxes`` where both are axis-parallel boxes, which need no edge work."""
    rims = once(boundary.select("project_id", F.col("ring").alias("b_ring")), b_bbox=R.bbox("b_ring"))
    rims = once(rims, b_box=R.is_box("b_ring", "b_bbox"), b_convex=R.is_convex("b_ring"))
    own = once(plots.select("project_id", "plot_id", "ring"), bbox=R.bbox("ring"))
    return once(own, is_box=R.is_box("ring", "bbox")).join(rims.hint("merge"), "project_id").withColumn("boxes", F.col("is_box") & F.col("b_box"))


def _common_area(a: Column, b: Column, inset: float = 0.0) -> Column:
    """Area two boxes share, the second one drawn in by ``inset``."""
    w = F.least(a["maxX"], b["maxX"] - inset) - F.greatest(a["minX"], b["minX"] + inset)
    h = F.least(a["maxY"], b["maxY"] - inset) - F.greatest(a["minY"], b["minY"] + inset)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def rule_containment(plots: DataFrame, boundary: DataFrame) -> DataFrame:
    joined = _with_boundary(plots, boundary)
    common = F.when(F.col("boxes"), _common_area(F.col("bbox"), F.col("b_bbox"))).otherwise(R.overlap_area("ring", "b_ring"))
    outside = once(joined, area=R.ring_area("ring"), common=common).withColumn("outside", F.col("area") - F.col("common"))
    return _hit(outside.filter(F.col("outside") > tolerance(F.col("area"))), "RULE_01", F.col("plot_id"), F.col("outside"))


def rule_overlap(plots: DataFrame, others: DataFrame, rule: str) -> DataFrame:
    """Plots overlapping the dissolved roads, greens or obstacles of their project."""
    shapes = spatial.shape_classes(plots).select("project_id", "ring", "shape_id")
    common = overlay.overlap_with_set(plots, others)
    bad = shapes.join(common.hint("merge"), ["project_id", "shape_id"]).filter(F.col("common") > tolerance(R.ring_area("ring")))
    rows = plots.join(bad.select("project_id", "ring", "common").hint("merge"), ["project_id", "ring"])
    return _hit(rows, rule, F.col("plot_id"), F.col("common"))


def rule_mutual_overlap(plots: DataFrame) -> DataFrame:
    """Overlapping pairs at shape level; ``n`` counts the pairs of plots a line stands for."""
    pairs = spatial.overlap_pairs(plots)
    bad = pairs.filter(F.col("overlap") > tolerance(F.least("a_area", "b_area")))
    name = F.concat_ws("&", F.col("a_id").cast("string"), F.col("b_id").cast("string"))
    return _hit(bad, "RULE_05", name, F.col("overlap"), F.col("n_pairs"))


def rule_min_area(plots: DataFrame, p: dict) -> DataFrame:
    area = R.ring_area("ring")
    small = once(plots, __area=area).filter(F.col("__area") < p["min_plot_sqft"] * 0.90)
    return _hit(small, "RULE_06", F.col("plot_id"), F.col("__area"))


def rule_frontage(plots: DataFrame, p: dict) -> DataFrame:
    b = R.bbox("ring")
    shorter = R.let(b, lambda v: F.least(v["maxX"] - v["minX"], v["maxY"] - v["minY"]))
    given = F.col("width_ft") if "width_ft" in plots.columns else F.lit(None).cast("double")
    df = once(plots, __w=F.when(given > 0, given).otherwise(shorter))
    return _hit(df.filter(F.col("__w") < p["min_frontage_ft"] * 0.85), "RULE_07", F.col("plot_id"), F.col("__w"))


def rule_access(plots: DataFrame, roads: DataFrame) -> DataFrame:
    return _hit(spatial.no_road_access(plots, roads), "RULE_08", F.col("plot_id"), F.lit(0.0))


def rule_validity(plots: DataFrame) -> DataFrame:
    boxed = once(plots.select("project_id", "plot_id", "ring"), bbox=R.bbox("ring"))
    broken = F.when(R.is_box("ring", "bbox") & (R.ring_area("ring") > 0), F.lit(False)).otherwise((F.size(R.opened("ring")) < 3) | R.self_crossing("ring"))
    return _hit(boxed.filter(broken), "RULE_09", F.col("plot_id"), F.lit(0.0))


def rule_sliver(plots: DataFrame) -> DataFrame:
    area = R.ring_area("ring")
    return _hit(plots.filter((area < 1.0) | (R.ring_length("ring") < 5.0)), "RULE_10", F.col("plot_id"), area)


#: Vertices that a plot, and the concave boundaries of a project, may have to be swept in the plot's row.
ROW_POINTS = 64


def _lost_in_rows(own: DataFrame, rims: DataFrame, inset: float) -> DataFrame:
    """Ground of each plot that is outside the inset ``rims`` of its project: plots travel once, and the bands are made in their rows."""
    lists = rims.groupBy("project_id").agg(F.collect_list("ring").alias("rims"))
    met = once(own.join(lists.hint("merge"), "project_id"), bbox=R.bbox("ring"), area=R.ring_area("ring"))
    near = lambda rings: F.filter(rings, lambda r: R.let(R.bbox(r), lambda b: R.boxes_overlap(F.col("bbox"), b)))
    bands = F.flatten(F.transform("rims", lambda r: R.rim_bands(r, inset)))
    swept = overlay.clear_areas(once(met, off=near(bands), within=near(F.col("rims"))), ["project_id", "plot_id", "area"])
    return swept.select("project_id", "plot_id", (F.col("area") - F.col("clear_area")).alias("__out")).filter(F.col("__out") > 5.0)


def _lost_by_tiles(own: DataFrame, rims: DataFrame, inset: float) -> DataFrame:
    """The same for rims or plots of any size: the plot's area and what it shares with the bands along the rim, less what it shares with
    bands and boundary together."""
    bands = rims.select("project_id", F.explode(R.rim_bands("ring", inset)).alias("ring"))
    own = own.join(rims.select("project_id").distinct().hint("merge"), "project_id", "left_semi")
    shapes = spatial.shape_classes(own).select("project_id", "ring", "shape_id")
    shared = lambda others, name: overlay.overlap_with_set(own, others).withColumnRenamed("common", name).hint("merge")
    keys = ["project_id", "shape_id"]
    met = shapes.join(shared(bands, "near"), keys, "left").join(shared(bands.unionByName(rims), "held"), keys, "left")
    lost = R.ring_area("ring") + F.coalesce("near", F.lit(0.0)) - F.coalesce("held", F.lit(0.0))
    out = once(met, __out=lost).filter(F.col("__out") > 5.0).select("project_id", "ring", "__out")
    return own.join(out.hint("merge"), ["project_id", "ring"]).select("project_id", "plot_id", "__out")


def rule_setback(plots: DataFrame, boundary: DataFrame, p: dict) -> DataFrame:
    """Plots with more than 5 square feet outside the inset boundary.

    A convex boundary clips the plot by its moved edges. Off a concave one counts what is in the bands along the rim or outside of it:
    in the plot's row where plot and boundary have up to ROW_POINTS vertices, else tile by tile.
    """
    inset = float(p["setback_ft"])
    own, known = plots.select("project_id", "plot_id", "ring"), once(boundary.select("project_id", "ring"), convex=R.is_convex("ring"))
    n_convex, n_bent = known.agg(F.count_if("convex"), F.count_if(~F.col("convex"))).first()
    parts = []
    if n_convex or not n_bent:
        both = _with_boundary(plots, boundary).filter("b_convex")
        kept = F.when(F.col("boxes"), _common_area(F.col("bbox"), F.col("b_bbox"), inset)).otherwise(R.ring_area(R.inset_clip("ring", "b_ring", F.lit(inset))))
        parts.append(once(both, __out=R.ring_area("ring") - kept).filter(F.col("__out") > 5.0).select("project_id", "plot_id", "__out"))
    if n_bent:
        rims, long = known.filter("not convex").drop("convex"), F.coalesce(F.size("ring") > ROW_POINTS, F.lit(False))
        many = cut(rims.groupBy("project_id").agg(F.sum(F.size("ring")).alias("n")).filter(F.col("n") > ROW_POINTS).select("project_id"))
        if many.isEmpty() and own.filter(long).isEmpty():
            parts.append(_lost_in_rows(own, rims, inset))
        else:
            marked = own.join(many.withColumn("many", F.lit(True)).hint("merge"), "project_id", "left")
            parts.append(_lost_in_rows(own.filter(~long), rims.join(many.hint("merge"), "project_id", "left_anti"), inset))
            parts.append(_lost_by_tiles(marked.filter(long | F.col("many")).select(*own.columns), rims, inset))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _hit(out, "RULE_11", F.col("plot_id"), F.col("__out"))


def rule_road_width(roads: DataFrame, p: dict) -> DataFrame:
    return _hit(roads.filter(F.col("width_ft") < p["min_road_width_ft"] - 1.0), "RULE_12", F.col("road_id"), F.col("width_ft"))


def violations(boundary: DataFrame, plots: DataFrame, roads: DataFrame, greens: DataFrame | None = None, obstacles: DataFrame | None = None, **params: float) -> DataFrame:
    """All violations of all projects."""
    p = {**DEFAULTS, **params}
    parts = [
        rule_containment(plots, boundary), rule_overlap(plots, roads, "RULE_02"), rule_mutual_overlap(plots),
        rule_min_area(plots, p), rule_frontage(plots, p), rule_access(plots, roads), rule_validity(plots), rule_sliver(plots), rule_road_width(roads, p),
    ]
    if greens is not None:
        parts.append(rule_overlap(plots, greens, "RULE_03"))
    if obstacles is not None:
        parts.append(rule_overlap(plots, obstacles, "RULE_04"))
    if p["setback_ft"] > 0:
        parts.append(rule_setback(plots, boundary, p))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compliance_report(boundary: DataFrame, found: DataFrame, not_judged: list[str] = ()) -> DataFrame:
    """Errors, warnings, rules passed and overall verdict of every project with a boundary; shares are of the rules that were judged."""
    judged = len(RULES) - len(not_judged)
    by_rule = found.groupBy("project_id", "rule_id").agg(F.sum("n").alias("n"))
    warning = F.col("rule_id").isin(*[r for r, _, s in RULES if s == "WARNING"])
    summed = by_rule.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("failed_rules"),
        F.coalesce(F.sum(F.when(~warning, F.col("n"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(warning, F.col("n"))), F.lit(0)).alias("warnings"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    passed = F.lit(judged) - zero("failed_rules")
    pct = floor_round(passed * 100.0 / judged)
    return boundary.select("project_id").join(summed, "project_id", "left").select(
        "project_id", passed.cast("long").alias("passed_rules"), zero("errors").alias("errors"), zero("warnings").alias("warnings"),
        pct.alias("compliance_pct"), ((zero("errors") == 0) & (passed * 100.0 / judged >= 80.0)).alias("overall"),
    )


def unchecked(greens: DataFrame | None = None, obstacles: DataFrame | None = None, **params: float) -> list[str]:
    """Rules that ``violations`` does not judge with these arguments."""
    out = ([] if greens is not None else ["RULE_03"]) + ([] if obstacles is not None else ["RULE_04"])
    return out + ([] if {**DEFAULTS, **params}["setback_ft"] > 0 else ["RULE_11"])


def rule_results(boundary: DataFrame, found: DataFrame, not_judged: list[str] = ()) -> DataFrame:
    """One row per project and rule, passed or not; null for rules that were ``not_judged``."""
    rule = F.explode(F.array(*[F.struct(F.lit(a).alias("rule_id"), F.lit(b).alias("rule_name"), F.lit(c).alias("severity")) for a, b, c in RULES]))
    every = boundary.select("project_id", rule.alias("r")).select("project_id", "r.*")
    counts = found.groupBy("project_id", "rule_id").agg(F.sum("n").alias("violations"))
    return every.join(counts, ["project_id", "rule_id"], "left").withColumn("violations", F.coalesce("violations", F.lit(0))).withColumn(
        "passed", F.when(~F.col("rule_id").isin(*not_judged), F.col("violations") == 0)
    )


def review_drafts(layouts: DataFrame, boundary: DataFrame, plots: DataFrame) -> DataFrame:
    """Errors and warnings of draft layouts and whether each can be approved."""
    clean = R.clean_ring("ring")
    state = plots.withColumn("__ok", clean.isNotNull() & ~R.self_crossing("ring"))
    good = state.filter("__ok").select(*plots.columns)
    bounds = boundary.withColumn("__b_ok", R.clean_ring("ring").isNotNull() & ~R.self_crossing("ring"))
    inside = good.join(bounds.filter("__b_ok").select("project_id", F.col("ring").alias("b_ring")), "project_id")
    partly = once(inside, held=R.overlap_area("ring", "b_ring") / R.ring_area("ring")).filter(F.col("held") < 0.85).groupBy("project_id").agg(F.count(F.lit(1)).alias("partly_outside"))
    sizes = state.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_plots"), F.count_if("__ok").alias("valid_plots"))
    overlaps = spatial.overlap_pairs(good).filter(F.col("overlap") > 1.0).groupBy("project_id").agg(F.sum("n_pairs").alias("overlapping_pairs"))
    dupes = duplicate_numbers(plots).groupBy("project_id").agg(F.count(F.lit(1)).alias("duplicate_numbers"))
    out = layouts
    for side in (sizes, overlaps, dupes, partly, bounds.select("project_id", "__b_ok")):
        out = out.join(side, "project_id", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    no_boundary = F.when(F.coalesce("__b_ok", F.lit(False)), 0).otherwise(1)
    has_dupes = F.when(z("duplicate_numbers") > 0, 1).otherwise(0)
    errors = no_boundary + (z("total_plots") - z("valid_plots")) + has_dupes + z("overlapping_pairs")
    return out.select(
        *layouts.columns, z("total_plots").alias("total_plots"), z("valid_plots").alias("valid_plots"),
        z("overlapping_pairs").alias("overlapping_pairs"), z("duplicate_numbers").alias("duplicate_numbers"),
        z("partly_outside").alias("warnings"), errors.alias("errors"), ((errors == 0) & (z("total_plots") > 0)).alias("can_approve"),
    )


def approve_layouts(layouts: DataFrame, review: DataFrame, plots: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Approve what passed review: new layout states, and the inventory after merging its plots.

    The snapshot of the approved models is written by ``sources.snapshots.write_snapshot``.
    """
    passed = review.filter("can_approve").select("project_id", "layout_id").withColumn("__pass", F.lit(True))
    states = layouts.join(passed, ["project_id", "layout_id"], "left").withColumn(
        "layout_status", F.when(F.col("__pass"), "APPROVED").otherwise(F.col("layout_status"))
    ).drop("__pass")
    incoming = plots.join(passed.select("project_id").distinct(), "project_id", "left_semi")
    return states, inventory.upsert_plots(existing, incoming)
