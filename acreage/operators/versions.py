"""Latest rows, version numbers, revisions, duplicate numbers, stage timelines, artifact assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from acreage.functions import rings as R
from acreage.operators.inventory import editable
from acreage.operators.spatial import facing8
from acreage.session import first_per_key, numbered


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of every key."""
    return first_per_key(df, keys, [F.col(c).desc() for c in order])


def version_number(col) -> Column:
    """``v12`` to 12, so that versions order by number and not by text."""
    return F.regexp_extract(F.col(col), r"^v(\d+)$", 1).try_cast("int")


def assign_versions(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, base: DataFrame | None = None) -> DataFrame:
    """Consecutive version numbers per key, after the highest in ``base``, and a latest flag."""
    seq = numbered(df, keys, order, bucket, "version")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    out = seq.join(counts, keys)
    start = F.lit(0)
    if base is not None:
        out = out.join(base.groupBy(*keys).agg(F.max("version").alias("__base")), keys, "left")
        start = F.coalesce("__base", F.lit(0))
    return out.withColumn("is_latest", F.col("version") == F.col("__n")).withColumn(
        "version", F.col("version") + start
    ).drop("__n", "__base")


def duplicate_numbers(plots: DataFrame) -> DataFrame:
    """Plot numbers used more than once in a project."""
    return (
        plots.filter(F.trim("plot_number") != "").groupBy("project_id", F.trim("plot_number").alias("plot_number"))
        .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )


def edit_history(edits: DataFrame) -> DataFrame:
    """Revision counter of every layout over its edits in time order."""
    return numbered(edits, ["layout_id"], [F.col("ts"), F.col("seq")], F.date_trunc("day", "ts"), "revision")


def rollback(models: DataFrame, targets: DataFrame) -> DataFrame:
    """Re-append the model of the wanted version as the newest version of its project."""
    top = models.groupBy("project_id").agg(F.max("version").alias("__top"))
    wanted = targets.select("project_id", F.col("version").alias("__wanted"))
    old = models.join(wanted, "project_id").filter(F.col("version") == F.col("__wanted"))
    again = old.join(top, "project_id").withColumn("version", F.col("__top") + 1).select(*models.columns)
    return models.unionByName(again)


def reopen_layouts(layouts: DataFrame, ids: DataFrame, status: str = "REVISION") -> DataFrame:
    """Approved layouts in ``ids`` go back to revision with the next version number."""
    asked = ids.select("layout_id").distinct().withColumn("__asked", F.lit(True))
    hit = F.col("__asked") & (F.col("layout_status") == "APPROVED")
    return layouts.join(asked, "layout_id", "left").withColumn(
        "layout_version", F.when(hit, F.col("layout_version") + 1).otherwise(F.col("layout_version"))
    ).withColumn("layout_status", F.when(hit, status).otherwise(F.col("layout_status"))).drop("__asked")


def stage_timeline(events: DataFrame, slice_by: str = "day") -> DataFrame:
    """Previous stage, seconds since it, and whether progress fell, for every job event.

    As in the booking replay, a job's history is cut into time slices so that no task holds
    all of it; only the last event of each slice crosses slices.
    """
    order = [F.col("ts"), F.col("seq")]
    state = F.struct("ts", "seq", "stage", "progress")
    cut = events.withColumn("__slice", F.date_trunc(slice_by, "ts"))
    inside = Window.partitionBy("job_id", "__slice").orderBy(*order)
    local = cut.withColumn("__prev", F.lag(state).over(inside))
    last = cut.groupBy("job_id", "__slice").agg(F.max(state).alias("__last"))
    carried = last.select(
        "job_id", "__slice", F.lag("__last").over(Window.partitionBy("job_id").orderBy("__slice")).alias("__carried")
    )
    prev = F.coalesce("__prev", "__carried")
    elapsed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(prev["ts"].cast("timestamp"))) / F.lit(1000000.0)
    return local.join(carried, ["job_id", "__slice"]).select(
        *events.columns, prev["stage"].alias("previous_stage"), elapsed.alias("elapsed_sec"),
        F.coalesce(F.col("progress") < prev["progress"], F.lit(False)).alias("fell_back"),
    )


def layouts_with_latest_job(layouts: DataFrame, jobs: DataFrame) -> DataFrame:
    newest = latest_by(jobs, ["layout_id"], ["created_at", "job_id"])
    return layouts.join(
        newest.select("layout_id", "job_id", F.col("status").alias("job_status"), "stage", "progress"), "layout_id", "left"
    )


def run_result(artifacts: DataFrame, types: list[str]) -> DataFrame:
    """One row per run with the latest document of each artifact type."""
    newest = F.struct("created_at", "artifact_id")
    return artifacts.filter(F.col("artifact_type").isin(*types)).groupBy("job_id").pivot("artifact_type", types).agg(
        F.max_by("content_json", newest)
    )


def apply_entity_patches(entities: DataFrame, patches: DataFrame, fields: list[str], layouts: DataFrame | None = None) -> DataFrame:
    """Field-wise patches; a changed ring gets new area, perimeter and centroid. Patches of approved or locked ``layouts`` are refused."""
    keys = ["project_id", "layout_id", "entity_id"]
    if layouts is not None:
        patches = editable(patches, layouts)
    new = patches.select(*keys, *[F.col(c).alias(f"__{c}") for c in fields])
    joined = entities.join(new, keys, "left")
    for c in fields:
        joined = joined.withColumn(c, F.coalesce(f"__{c}", c))
    if "ring" in fields:
        moved = F.col("__ring").isNotNull()
        joined = (
            joined.withColumn("area", F.when(moved, R.floor_round(R.ring_area("ring"))).otherwise(F.col("area")))
            .withColumn("perimeter", F.when(moved, R.floor_round(R.ring_length("ring"))).otherwise(F.col("perimeter")))
            .withColumn("centroid", F.when(moved, R.area_centroid("ring")).otherwise(F.col("centroid")))
        )
    return joined.drop(*[f"__{c}" for c in fields])


def refresh_facing(plots: DataFrame, roads: DataFrame, rotations: DataFrame) -> DataFrame:
    """Plots with their facing worked out again for the rotation of their project; an unknown one keeps what was there."""
    turned = facing8(plots, roads, rotations.select("project_id", "rotation"))
    now = F.when(F.col("facing8") != "UNKNOWN", F.col("facing8")).otherwise(F.coalesce("facing", F.lit("UNKNOWN")))
    return turned.withColumn("facing", now).select(*plots.columns)


def merge_georef(models: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Georeference fields: patch over stored value."""
    new = patches.select("project_id", *[F.col(c).alias(f"__{c}") for c in fields])
    return models.join(new, "project_id", "left").select(
        *[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in models.columns]
    )


def version_summaries(snapshots: DataFrame) -> DataFrame:
    """Versions of each project in numeric order, newest flagged."""
    parsed = snapshots.withColumn("number", version_number("version"))
    top = parsed.groupBy("project_id").agg(F.max("number").alias("__top"), F.count(F.lit(1)).alias("n_versions"))
    return parsed.join(top, "project_id").withColumn("is_latest", F.col("number") == F.col("__top")).drop("__top").orderBy(
        "project_id", "number"
    )


def snapshot_metadata(models: DataFrame) -> DataFrame:
    """Entity counts and boundary area of every stored layout model."""
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    return models.select(
        "project_id", "version", size("plots").alias("plot_count"), size("roads").alias("road_count"),
        size("labels").alias("label_count"), F.coalesce("boundary.area", F.lit(0.0)).alias("boundary_area"),
    )
