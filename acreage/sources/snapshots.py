"""Layout-model snapshots: JSON documents in, immutable parquet versions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage import schemas
from acreage.functions.rings import pairs_to_ring
from acreage.session import by_project


def read_layout_models(spark: SparkSession, root: str) -> DataFrame:
    """Every ``root/<project>/v<n>/*.json`` model, parsed; unreadable ones are flagged."""
    raw = spark.read.text(f"{root}/*/v*/*model.json", wholetext=True).withColumn("path", F.input_file_name())
    place = r"/([^/]+)/(v\d+)/[^/]+$"
    df = raw.withColumn("model", F.from_json("value", schemas.LAYOUT_MODEL))
    return df.select(
        F.regexp_extract("path", place, 1).alias("project_id"), F.regexp_extract("path", place, 2).alias("version"),
        "model.*", F.col("model").isNull().alias("is_corrupt"),
    )


def model_entities(models: DataFrame) -> dict[str, DataFrame]:
    """Plots, roads, labels and boundaries of the models, one row each with a ring and its order."""
    keys = ["project_id", "version"]
    plots = models.select(*keys, F.posexplode("plots").alias("ord", "p")).select(
        *keys, "ord", F.col("p.id").alias("plot_id"), F.col("p.plotNumber").alias("plot_number"), pairs_to_ring("p.polygon").alias("ring"), F.col("p.facing").alias("facing")
    )
    roads = models.select(*keys, F.posexplode("roads").alias("ord", "r")).select(
        *keys, "ord", F.col("r.roadId").alias("road_id"), F.col("r.roadName").alias("road_name"), pairs_to_ring("r.geometry").alias("ring")
    )
    labels = models.select(*keys, F.posexplode("labels").alias("ord", "l")).select(
        *keys, "ord", F.col("l.labelId").alias("label_id"), F.col("l.rawText").alias("raw_text"), F.col("l.associatedEntityId").alias("associated_entity_id")
    )
    boundary = models.filter("boundary IS NOT NULL").select(*keys, F.col("boundary.boundaryId").alias("boundary_id"), pairs_to_ring("boundary.geometry").alias("ring"))
    return {"plots": plots, "roads": roads, "labels": labels, "boundary": boundary}


def write_snapshot(df: DataFrame, root: str, version: str) -> None:
    """Write one version of all projects; an existing version is refused by Spark."""
    by_project(df).write.mode("errorifexists").partitionBy("project_id").parquet(f"{root}/version={version}")


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All versions; project and version prune partitions."""
    return spark.read.parquet(root)
