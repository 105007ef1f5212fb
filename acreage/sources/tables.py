"""Table readers with declared schemas where the format carries none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage import schemas


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in names}


def load_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options
    )
    return reader.load()


def read_crm(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON arrays of customers, brokers, payments, documents, plots or monthly figures."""
    return (
        spark.read.schema(f"{schemas.CRM[kind]}, _corrupt_record STRING")
        .option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    )


def normalize_projects(payloads: DataFrame, col: str = "payload") -> dict[str, DataFrame]:
    """Nested project payloads to the relational tables; a legal row only when one was given."""
    doc = payloads.withColumn("p", F.from_json(col, schemas.PROJECT_PAYLOAD))
    project_id = F.sha2(F.concat_ws("|", "p.name", "p.developerName", F.col(col)), 256)
    doc = doc.withColumn("project_id", F.coalesce("p.id", project_id))
    has_layout = F.col("p.layout").isNotNull()
    given = F.nullif(F.trim("p.status"), F.lit(""))
    surveys = F.filter(F.transform("p.surveyNumbers", lambda s: F.trim(s)), lambda s: s != "")
    return {
        "projects": doc.select(
            "project_id", F.col("p.name").alias("name"), F.col("p.developerName").alias("developer_name"),
            F.col("p.projectType").alias("project_type"),
            F.coalesce(given, F.when(has_layout, "LAYOUT_PENDING"), F.lit("DRAFT")).alias("status"),
        ),
        "project_locations": doc.filter("p.location IS NOT NULL").select("project_id", "p.location.*"),
        "project_surveys": doc.select("project_id", F.explode(surveys).alias("survey_number")),
        "project_commercials": doc.filter("p.commercial IS NOT NULL").select(
            "project_id", F.col("p.commercial.grossLandArea").alias("gross_land_area"),
            F.col("p.commercial.areaUnit").alias("area_unit"), F.col("p.commercial.minPrice").alias("min_price"),
            F.col("p.commercial.maxPrice").alias("max_price"),
            F.expr("try_to_date(p.commercial.launchDate, 'yyyy-MM-dd')").alias("launch_date"),
            F.expr("try_to_date(p.commercial.completionDate, 'yyyy-MM-dd')").alias("completion_date"),
        ),
        "project_legal": doc.filter(
            "p.legal IS NOT NULL AND (p.legal.reraNumber IS NOT NULL OR p.legal.approvalAuthority IS NOT NULL)"
        ).select(
            "project_id", F.col("p.legal.reraNumber").alias("rera_number"),
            F.col("p.legal.approvalAuthority").alias("approval_authority"),
        ),
        "layout_sources": doc.filter(has_layout).select(
            "project_id", F.col("p.layout.fileName").alias("file_name"), F.lit("DRAFT").alias("layout_status")
        ),
    }


def parse_artifacts(artifacts: DataFrame, artifact_type: str, schema: str) -> DataFrame:
    """Rows of one artifact type with their document parsed; unreadable ones are flagged."""
    doc = F.from_json("content_json", schema)
    return artifacts.filter(F.col("artifact_type") == artifact_type).withColumn("doc", doc).withColumn(
        "is_corrupt", F.col("doc").isNull() & F.col("content_json").isNotNull()
    )
