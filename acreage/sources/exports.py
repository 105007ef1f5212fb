"""CSV, GeoJSON and report outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.functions.text import fixed_text
from acreage.session import by_project


def plot_schedule(plots: DataFrame) -> DataFrame:
    """Nine schedule columns with fixed number formats."""
    num = lambda c, d: fixed_text(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), d)
    text = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    return plots.select(
        "project_id", text("plot_number", "P-000").alias("Plot Number"), text("status", "AVAILABLE").alias("Status"),
        num("area_sqft", 1).alias("Area (Sq Ft)"), num("width_ft", 1).alias("Width (Ft)"), num("depth_ft", 1).alias("Depth (Ft)"),
        text("facing", "NORTH").alias("Facing"), text("road_name", "Main Road").alias("Road Access"),
        F.when(F.col("is_corner"), "YES").otherwise("NO").alias("Corner Plot"), num("price", 2).alias("Est. Base Price (INR)"),
    )


def write_plot_schedule(plots: DataFrame, path: str) -> None:
    by_project(plot_schedule(plots)).write.mode("overwrite").partitionBy("project_id").option("header", True).csv(path)


def inventory_rows(view: DataFrame, customers: DataFrame, brokers: DataFrame) -> DataFrame:
    """Thirteen inventory columns with customer and broker names."""
    c = customers.select("customer_id", F.col("name").alias("Customer"))
    b = brokers.select("broker_id", F.col("name").alias("Broker"))
    df = view.join(c, "customer_id", "left").join(b, "broker_id", "left")
    return df.select(
        "project_id", F.col("plot_number").alias("Plot No"), F.col("area_sqft").alias("Area (Sq.Ft)"), fixed_text(F.col("area_sqft") * 0.092903, 1).alias("Area (Sq.M)"),
        F.col("dimensions").alias("Dimensions"), F.col("facing").alias("Facing"), F.col("road_name").alias("Road"), F.when(F.col("is_corner"), "Yes").otherwise("No").alias("Corner"),
        F.col("price").alias("Price"), F.col("rate_per_sqft").alias("Rate/Sq.Ft"), F.col("status_label").alias("Status"),
        F.coalesce("Customer", F.lit("")).alias("Customer"), F.coalesce("Broker", F.lit("")).alias("Broker"), F.coalesce("notes", F.lit("")).alias("Notes"),
    )


def write_inventory_csv(view: DataFrame, customers: DataFrame, brokers: DataFrame, path: str) -> None:
    by_project(inventory_rows(view, customers, brokers)).write.mode("overwrite").partitionBy("project_id").option("header", True).csv(path)


def to_geojson(entities: DataFrame, props: list[str], kind: Column | str = "entity_type") -> DataFrame:
    """One GeoJSON feature per row, ring closed."""
    geometry = F.struct(F.lit("Polygon").alias("type"), R.coordinates("ring").alias("coordinates"))
    kind = F.col(kind) if isinstance(kind, str) else kind
    properties = F.struct(kind.alias("entityType"), *props)
    return entities.withColumn(
        "feature", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
    )


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features per project: streamable, and no project is gathered in one row."""
    by_project(features.select("project_id", F.col("feature").alias("value"))).write.mode("overwrite").partitionBy("project_id").text(path)


def report_text(df: DataFrame) -> DataFrame:
    """Evaluation rows with a Markdown summary."""
    line = lambda label, c: F.concat(F.lit(f"* {label}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a")))
    verdict = F.when(F.col("is_acceptable"), "ACCEPTABLE").otherwise("NOT ACCEPTABLE")
    body = F.concat_ws(
        "\n", F.concat(F.lit("# Evaluation of project "), F.col("project_id").cast("string")), F.concat(F.lit("**Verdict: "), verdict, F.lit("**")),
        line("Boundary IoU", "boundary_iou"), line("Mean plot IoU", "mean_iou"), line("Road IoU", "road_iou"), line("Text recall", "recall"),
        line("Label accuracy", "association_accuracy"), F.concat(F.lit("* Failures: "), F.array_join("failures", ", ")),
    )
    return df.withColumn("markdown", body)


def write_eval_report(df: DataFrame, path: str) -> None:
    report_text(df).write.mode("append").json(path)
