"""Session set-up and the two physical helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def get_session(app: str = "acreage", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, skew joins split."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # a call site per column makes long expressions slow to write
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    A machine-local folder is used only by a local session that names none.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="acreage-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)  # a local session's own folder ends with it
    spark.sparkContext.setCheckpointDir(made)
    return made


#: A task holds a row group until it is full, so written tables have small ones.
ROW_GROUP = 16 << 20


def plain_reads(df: DataFrame) -> DataFrame:
    """Lets the session read parquet files through a stream, unless it was told otherwise; returns ``df``.

    Vectored reads run in a pool of threads, each of which keeps a buffer outside the heap as large as the largest range it read, so
    an executor's memory beside its heap would grow with the files read.
    """
    key = "parquet.hadoop.vectored.io.enabled"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, "false")
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write a reused or iterated frame to the shared folder and read it back.

    The table is computed once, ends the lineage, and outlives lost executors.
    """
    path = fresh_folder(plain_reads(df).sparkSession, "cut")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are worked out once per row.

    A generated column is a barrier: later filters stay above it, so a costly expression is
    neither copied into every place that reads it nor moved into a join condition.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the shuffle partitions: for tables that are small as files and whose rows need much work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def by_project(df: DataFrame, key: str = "project_id") -> DataFrame:
    """Rows of a project together before a partitioned write, so files follow projects and not tasks; Spark splits large ones."""
    return df.hint("rebalance", key)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder path of the shared folder."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.urandom(6).hex()}"


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, name: str | None = None) -> DataFrame:
    """First ``n`` rows of every key. Spark limits each group before the shuffle, so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return out.withColumnRenamed("__rn", name) if name else out.drop("__rn")


def numbered(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    name: str = "seq",
    descending: bool = False,
) -> DataFrame:
    """``row_number`` over ``keys`` that does not gather a hot key in one task.

    ``bucket`` must be monotone in the first ordering column. Rows are numbered inside
    (key, bucket); per-bucket counts, a far smaller table, give each bucket its offset.
    """
    marked = df.withColumn("__bucket", bucket)
    local = marked.withColumn(
        "__local", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    )
    direction = F.col("__bucket").desc_nulls_last() if descending else F.col("__bucket").asc_nulls_first()
    before = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy(*keys, "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    join_keys = [*keys, "__bucket"]
    renamed = offsets.select(
        *[F.col(k).alias(f"__key{i}") for i, k in enumerate(join_keys)], "__offset"
    )
    same = [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(join_keys)]
    return local.join(renamed, same, "left").select(
        *df.columns, (F.col("__local") + F.col("__offset")).alias(name)
    )
