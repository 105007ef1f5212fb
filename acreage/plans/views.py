"""The business tables, derived from the generated star schema.

Each view is a projection or a dimension join over whole tables. The SQL texts of the same
views, used by the checks, are in ``plans/sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage.functions import rings as R
from acreage.session import spread
from acreage.sources.tables import read_table

BLOCK = 400  # parts per synthetic project sheet
PER_ROW = 40


def projects(spark: SparkSession, d: str) -> DataFrame:
    supplier, nation, region = (read_table(spark, d, t) for t in ("supplier", "nation", "region"))
    status = F.element_at(F.array(*map(F.lit, ["Active", "Upcoming", "Planning", "Completed"])), (F.col("s_nationkey") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ["Residential", "Commercial", "Mixed"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("project_id"), F.col("s_name").alias("name"),
            F.concat_ws(", ", "n_name", "r_name").alias("location"), F.col("n_name").alias("city_village"),
            F.col("r_name").alias("state"), status.alias("status"), status.alias("project_status"), kind.alias("type"),
            F.timestamp_seconds(F.lit(1577836800) + F.col("s_suppkey") * 86400).alias("created_at"),
            F.col("s_acctbal").alias("acctbal"),
        )
    )


def plots(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem")
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = (
        F.when(flag == "A", "SOLD").when(flag == "R", "RESERVED").when((flag == "N") & (line == "O"), "AVAILABLE").otherwise("BLOCKED")
    )
    facing = F.element_at(F.array(*map(F.lit, ["NORTH", "EAST", "SOUTH", "WEST"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("plot_id"),
        F.col("l_suppkey").alias("project_id"),
        F.concat(F.chr(F.lit(65) + F.col("l_linenumber") % 3), F.lit("-"), (F.col("l_partkey") % 500).cast("string")).alias("plot_number"),
        (F.col("l_quantity") * 48).alias("area_sqft"), F.col("l_extendedprice").alias("base_price"), status.alias("status"),
        facing.alias("facing"), (F.col("l_partkey") % 7 == 0).alias("is_corner"),
        F.when(flag != "N", F.col("l_partkey") % 25).alias("broker_id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_shipdate").alias("created_at"),
    )


def owned_plots(spark: SparkSession, d: str) -> DataFrame:
    """Plots with their customer, taken from the order."""
    orders = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    return plots(spark, d).join(orders, "order_id")


def payments(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Pending").otherwise("Overdue")
    return o.select(
        F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("customer_id"), (F.col("o_orderkey") % 100).alias("project_id"),
        (F.col("o_orderkey") % 25).alias("broker_id"), F.col("o_totalprice").alias("amount"), state.alias("status"),
        F.expr("substring(o_orderpriority, 3)").alias("method"), F.concat(F.lit("REC-"), F.col("o_orderkey").cast("string")).alias("receipt"),
        F.col("o_orderdate").alias("due_date"), F.when(state == "Completed", F.col("o_orderdate")).alias("paid_date"),
    )


def customers(spark: SparkSession, d: str) -> DataFrame:
    c, n = read_table(spark, d, "customer"), read_table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("total_invested"),
    )


def brokers(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("broker_id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1.0).alias("commission_rate")
    )


def commands(spark: SparkSession, d: str) -> DataFrame:
    return commands_of(read_table(spark, d, "events"))


def commands_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    command = F.when(kind == "purchase", "book").when(kind == "error", "cancel").when(kind == "signup", "patch")
    return events.select(
        F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("plot_id"), command.alias("command"),
        F.when(kind == "signup", "RESERVED").alias("patch_status"), F.col("value").alias("amount"),
    )


def rects(spark: SparkSession, d: str) -> DataFrame:
    """Plot rectangles, laid out on sheets of 400 parts; neighbours may overlap."""
    p, k = spread(read_table(spark, d, "part").select("p_partkey", "p_size", "p_type", "p_brand", "p_retailprice")), F.col("p_partkey")
    local = k % BLOCK
    x0 = ((local % PER_ROW) * 60).cast("double")
    y0 = (F.floor(local / PER_ROW) * 45).cast("double")
    w, h = (F.col("p_size") + 30).cast("double"), ((k % 7) * 8 + 20).cast("double")
    out = p.select(
        F.floor(k / BLOCK).alias("project_id"), k.alias("plot_id"), k.alias("ord"), x0.alias("x0"), y0.alias("y0"),
        (x0 + w).alias("x1"), (y0 + h).alias("y1"), w.alias("w"), h.alias("h"), "p_size", "p_type", "p_brand", "p_retailprice",
    )
    return out.withColumn("ring", R.box_ring("x0", "y0", "x1", "y1"))


def sheet_roads(spark: SparkSession, d: str) -> DataFrame:
    """Three roads per sheet: two across at y 100 and 290, one down at x 600; they cross."""
    sheets = rects(spark, d).select("project_id").distinct()
    spec = F.array(
        *[
            F.struct(F.lit(n).alias("n"), *[F.lit(float(v)).alias(c) for v, c in zip(box, ("x0", "y0", "x1", "y1"))])
            for n, box in ((0, (0, 100, 2400, 130)), (1, (0, 290, 2400, 312)), (2, (600, 0, 630, 470)))
        ]
    )
    road = sheets.select("project_id", F.explode(spec).alias("r")).select("project_id", "r.*")
    return road.select(
        "project_id", F.concat(F.lit("road-"), F.col("n").cast("string")).alias("road_id"), F.col("n").cast("long").alias("ord"),
        "x0", "y0", "x1", "y1", F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("width_ft"),
        R.box_ring("x0", "y0", "x1", "y1").alias("ring"),
    )


def sheet_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """One boundary per sheet; plots at the right and the lower rim reach past it."""
    return rects(spark, d).select("project_id").distinct().withColumn("ring", R.box_ring(F.lit(0.0), F.lit(0.0), F.lit(2400.0), F.lit(460.0)))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Label positions over the sheets, one per line item."""
    li = read_table(spark, d, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("label_id"),
        F.floor(F.col("l_partkey") / BLOCK).alias("project_id"),
        (F.col("l_quantity") * 48 + F.col("l_linenumber") * 7).alias("x"), (F.col("l_orderkey") % 520).cast("double").alias("y"),
        F.col("l_linenumber").alias("n"),
    )


def parcels(spark: SparkSession, d: str) -> DataFrame:
    p = spread(read_table(spark, d, "part").select("p_partkey", "p_size", "p_type", "p_brand", "p_retailprice"))
    kind, size = F.col("p_type"), F.col("p_size")
    authority = F.concat(F.lit("AUTH_"), F.regexp_extract("p_brand", r"(\d+)", 1))
    return p.select(
        F.col("p_partkey").alias("parcel_id"), (size * F.col("p_retailprice")).alias("land_area_sqm"),
        F.when(kind == "PROMO", "COMMERCIAL").when(kind == "SMALL", "EWS").otherwise("RESIDENTIAL").alias("land_use"),
        (F.col("p_partkey") % 5 == 0).alias("is_congested"), authority.alias("jurisdiction_id"),
        (size * 10 + 200).cast("double").alias("width_ft"), ((F.col("p_partkey") % 50) * 10 + 150).cast("double").alias("depth_ft"),
    )


def _turned(points: list[tuple], backwards: Column) -> Column:
    """A ring through points of the upright shape, turned and moved by the row's angle and offset."""
    cos, sin = F.cos("angle"), F.sin("angle")
    c = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else v
    ring = F.array(*[R.point(c(x) * cos - c(y) * sin + F.col("off"), c(x) * sin + c(y) * cos - F.col("off")) for x, y in points])
    return F.when(backwards, F.reverse(ring)).otherwise(ring)


def turned_box(x0, y0, x1, y1) -> Column:
    """A box of an upright bent shape, turned with it."""
    return _turned([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], F.lit(False))


def bent(spark: SparkSession, d: str) -> DataFrame:
    """One L or U per part, turned by any angle, some of them clockwise, near the origin and away from it.

    An L lacks its upper right corner, a U has a slot from above; m wide and n deep, beside the concave corner (vx, vy).
    """
    p, k = spread(read_table(spark, d, "part").select("p_partkey", "p_size")), F.col("p_partkey")
    w, h = (F.col("p_size") * 6 + 200).cast("double"), ((k % 5) * 20 + 180).cast("double")
    shape = p.select(
        k.alias("project_id"), k.alias("plot_id"), (k % 2 == 0).alias("is_l"), w.alias("w"), h.alias("h"), (w / 4).alias("m"), (h / 2).alias("n"),
        ((k % 7) * 0.3).cast("double").alias("angle"), ((k % 3) * 5000).cast("double").alias("off"), (k % 4 == 1).alias("backwards"),
    ).withColumn("vx", F.when(F.col("is_l"), F.col("w") - F.col("m")).otherwise(F.col("w") / 3)).withColumn("vy", F.col("h") - F.col("n"))
    w, h, m, vx, vy = (F.col(c) for c in ("w", "h", "m", "vx", "vy"))
    ell = _turned([(0, 0), (w, 0), (w, vy), (vx, vy), (vx, h), (0, h)], F.col("backwards"))
    cup = _turned([(0, 0), (w, 0), (w, h), (vx + m, h), (vx + m, vy), (vx, vy), (vx, h), (0, h)], F.col("backwards"))
    return shape.withColumn("ring", F.when(F.col("is_l"), ell).otherwise(cup))
