"""Registered queries on records of the business: cleaning, patches, text and date fields, norms, block numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage import constants as K
from acreage.functions import rings as R
from acreage.functions import scalars as S
from acreage.functions import text as T
from acreage.functions.rings import floor_round
from acreage.operators import bookings as B
from acreage.operators import crm as C
from acreage.operators import detection as D
from acreage.operators import inventory as I
from acreage.operators import norms as N
from acreage.operators import versions as V
from acreage.plans import views as v
from acreage.plans.sql import r2, with_views
from acreage.sources.tables import read_table


def _bookings(s, d):
    """A booking for every SOLD plot of an even line."""
    p = v.plots(s, d).filter("status = 'SOLD'")
    return p.filter(F.split_part("plot_id", F.lit("-"), F.lit(2)).cast("int") % 2 == 0).dropDuplicates(["plot_id"]).select(
        F.concat(F.lit("b-"), "plot_id").alias("booking_id"), "project_id", "plot_id", F.concat(F.lit("Owner "), F.col("order_id").cast("string")).alias("customer_name"),
        F.lit("100").alias("customer_phone"), F.lit("a@b").alias("customer_email"), F.when(F.col("order_id") % 9 == 0, "CANCELLED").otherwise("BOOKED").alias("booking_status"), "created_at",
    )


def _plots(s, d):
    return v.plots(s, d).dropDuplicates(["plot_id"]).select("plot_id", "project_id", "plot_number", "status", "base_price", F.lit("c").alias("customer_id"), F.lit(None).cast("timestamp").alias("reservation_date"), F.lit("old").alias("notes"), "order_id")


def _patches(s, d):
    k = F.col("order_id")
    status = F.when(k % 5 == 0, " sold ").when(k % 5 == 1, "available").when(k % 5 == 2, "nonsense").when(k % 5 == 3, "BLOCKED")
    return _plots(s, d).filter(k % 3 == 0).select(
        "plot_id", status.alias("status"), F.when(k % 2 == 0, " Mira ").otherwise(" ").alias("customer_name"), F.lit("900").alias("customer_phone"), F.when(k % 4 == 0, " ").when(k % 4 == 1, "m@x").alias("customer_email"),
        F.when(k % 7 == 0, "new").alias("notes"), F.when(k % 11 == 0, F.lit(12.0)).alias("base_price"),
    )


def _status_patches(s, d):
    now = F.lit("2024-02-01").cast("timestamp")
    p, b = B.apply_status_patches(_plots(s, d).drop("order_id"), _bookings(s, d), _patches(s, d), now)
    own = b.select("plot_id", "booking_id", "booking_status", F.col("customer_name").alias("who"), "customer_phone", "customer_email", F.col("total_amount").cast("double").alias("total"))
    mark = F.when(F.col("booking_id").startswith("b-"), "kept").when(F.col("booking_id").isNotNull(), "opened")
    owner = F.when(F.col("customer_id").isNull(), "none").when(F.col("customer_id") == "c", "old").otherwise("booking")
    return p.join(own, "plot_id", "left").select("plot_id", "status", "notes", "base_price", owner.alias("owner"), F.col("reservation_date").isNotNull().alias("reserved"), mark.alias("booking"), "booking_status", "who", "customer_phone", "customer_email", "total")


def _with_active(s, d):
    out = B.plots_with_active_booking(_plots(s, d), _bookings(s, d))
    return out.select("plot_id", "status", "active_booking_id", "customer_name")


def _with_plot(s, d):
    return B.bookings_with_plot(_bookings(s, d), _plots(s, d)).select("booking_id", "plot_number", "booking_status")


def _invalid_status(s, d):
    odd = v.plots(s, d).withColumn("status", F.when(F.col("order_id") % 10 == 0, "GONE").when(F.col("order_id") % 10 == 1, F.concat(F.lit(" "), F.lower("status"))).otherwise(F.col("status")))
    return I.invalid_status(odd).groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("n"))


def _editable(s, d):
    entities = v.rects(s, d).select("project_id", (F.col("plot_id") % 4).alias("layout_id"), "plot_id")
    layouts = entities.select("project_id", "layout_id").distinct().withColumn("layout_status", F.when(F.col("layout_id") == 0, "APPROVED").when(F.col("layout_id") == 1, "LOCKED").otherwise("DRAFT"))
    return I.editable(entities, layouts)


def _clean_payments(s, d):
    k = F.col("payment_id")
    raw = v.payments(s, d).select(
        "payment_id", F.when(k % 13 != 0, F.col("customer_id")).alias("customer_id"), F.when(k % 7 == 0, "n/a").when(k % 7 == 1, "-5").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(k % 5 != 0, F.col("status")).alias("status"), "due_date", F.when(k % 3 == 0, F.col("paid_date")).alias("paid_date"),
    )
    return C.clean_payments(raw).select("payment_id", "status", "error", "paid_date")


def _validate_projects(s, d):
    k = F.col("s_suppkey")
    p = read_table(s, d, "supplier").select(
        k.alias("project_id"), F.when(k % 6 == 0, " x ").otherwise(F.col("s_name")).alias("name"), F.when(k % 5 != 0, F.col("s_name")).alias("developer_name"),
        F.when(k % 4 == 0, "41100").otherwise("411001").alias("pincode"), F.col("s_acctbal").alias("gross_land_area"), F.array(F.when(k % 3 == 0, " ").otherwise("12/1")).alias("survey_numbers"),
    )
    return B.validate_projects(p).select("project_id", F.array_join("failed", ",").alias("failed"))


def _text_fields(s, d):
    part = F.split("p_name", " ")
    return read_table(s, d, "part").select(
        F.col("p_partkey").alias("part_id"), T.price_range(F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice") * 1000), F.col("p_retailprice") * 1500).alias("price_range"),
        T.strip(F.concat(F.lit(" \t"), "p_name", F.lit("\n "))).alias("stripped"), F.array_join(T.split_tags(F.concat(part[0], F.lit(" , ,"), part[1], F.lit(" "))), "|").alias("tags"),
        T.rgb_hex(F.col("p_size") / 40.0, (F.col("p_partkey") % 8) / 8.0, F.lit(-1.0)).alias("colour"), T.city_of(F.concat(part[0], F.lit(" , "), part[1])).alias("city"),
    )


def _dates(s, d):
    k = F.col("o_orderkey")
    text = F.when(k % 10 == 0, "soon").when(k % 10 == 1, F.lit(None)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    stamp = F.when(k % 10 == 0, "soon").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:20:30Z")))
    return read_table(s, d, "orders").select(
        k.alias("order_id"), S.parse_day(text).cast("string").alias("day"), S.format_day(S.parse_day(text)).alias("shown"), S.parse_ts(stamp, F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz").alias("at"),
    )


def _event_values(s, d):
    e = read_table(s, d, "events")
    checks = F.create_map(F.lit("a"), F.col("value") > 20, F.lit("b"), F.col("event_type") != "error")
    return e.select(
        "event_id", S.json_first("props", "$.none", "$.k").alias("k"), S.all_checked(checks).alias("ready"), floor_round(S.share("value", F.col("user_id") % 3), 2).alias("share"), S.clamp("value", 5, 50).alias("clamped"),
        floor_round(S.estimated_gdv(F.col("value"), F.lit(1000.0)), 2).alias("gdv"),
    )


def _norm_notes(s, d):
    registry = s.createDataFrame([(f"AUTH_{i}", f"Office {i}", 0.5 * i) for i in range(1, 8)] + [(N.STATEWIDE, "Statewide", 2.0)], "id string, short_name string, amenity_threshold_ha double")
    out = N.applicable_norms(v.parcels(s, d), registry)
    return out.select("parcel_id", "authority_id", F.array_join("notes", " ").alias("notes"), "amenity_pct")


def _block_ids(s, d):
    blocks = read_table(s, d, "part").select((F.col("p_partkey") % 1).alias("project_id"), F.col("p_partkey").alias("block_no"), (F.col("p_size") * 40.0 + F.col("p_partkey") % 97).alias("area"))
    return D.rank_blocks(blocks).select("block_no", F.col("rank").cast("long").alias("rank"), "block_id")


def _new_customers(s, d):
    name = F.concat(F.lit(" CUSTOMER#"), F.lpad((F.col("payment_id") % 3000).cast("string"), 9, "0"), F.lit(" "))
    asked = v.payments(s, d).select("payment_id", name.alias("customer_name"))
    return C.new_customers(C.resolve_customers(asked, v.customers(s, d))).select("name", "requests")


def _reopen(s, d):
    k = F.col("s_suppkey")
    layouts = read_table(s, d, "supplier").select(k.alias("layout_id"), F.element_at(F.array(*map(F.lit, ["APPROVED", "DRAFT", "LOCKED"])), (k % 3 + 1).cast("int")).alias("layout_status"), F.col("s_nationkey").alias("layout_version"))
    return V.reopen_layouts(layouts, layouts.filter(k % 2 == 0).select("layout_id").unionByName(layouts.select("layout_id").filter("layout_id = 0")))


def _latest_job(s, d):
    layouts = read_table(s, d, "supplier").select(F.col("s_suppkey").alias("layout_id"))
    jobs = read_table(s, d, "events").select(F.col("user_id").alias("layout_id"), F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"), F.col("props").alias("stage"), F.col("value").alias("progress"))
    return V.layouts_with_latest_job(layouts, jobs)


def _version_summaries(s, d):
    shots = read_table(s, d, "orders").select((F.col("o_custkey") % 50).alias("project_id"), F.concat(F.lit("v"), (F.col("o_orderkey") % 23).cast("string")).alias("version")).distinct()
    return V.version_summaries(shots).select("project_id", "version", "number", "n_versions", "is_latest")


def _entity_patches(s, d):
    r = v.rects(s, d)
    keys = [F.col("project_id"), (F.col("plot_id") % 4).alias("layout_id"), F.col("plot_id").alias("entity_id")]
    entities = r.select(*keys, "ring", F.lit("old").alias("note"), (F.col("w") * F.col("h")).alias("area"), ((F.col("w") + F.col("h")) * 2).alias("perimeter"), R.area_centroid("ring").alias("centroid"))
    wider = R.box_ring("x0", "y0", F.col("x1") + 10, "y1")
    patches = r.filter(F.col("plot_id") % 5 == 0).select(*keys, F.when(F.col("plot_id") % 2 == 0, wider).alias("ring"), F.lit("new").alias("note"))
    layouts = entities.select("project_id", "layout_id").distinct().withColumn("layout_status", F.when(F.col("layout_id") == 0, "LOCKED").otherwise("DRAFT"))
    out = V.apply_entity_patches(entities, patches, ["ring", "note"], layouts)
    return out.select("entity_id", "note", floor_round("area").alias("area"), floor_round("perimeter").alias("perimeter"), floor_round("centroid.x").alias("cx"))


def _broker_directory(s, d):
    b = v.brokers(s, d).select("broker_id", (F.col("broker_id") * 2).alias("total_deals"), (F.col("commission_rate") * 10).cast("decimal(18,2)").alias("total_earned"), F.col("commission_rate").cast("decimal(18,2)").alias("pending_payout"))
    return C.broker_directory(b)


def _sorted_plots(s, d):
    """Place of each plot of a project of its own in natural order of the numbers."""
    p = v.plots(s, d).select("plot_number").distinct().withColumn("plot_id", F.col("plot_number"))
    return C.head_n(p, [k.asc_nulls_first() for k in C.natural_key("plot_number")], 40).select("plot_number")


QUERIES = {
    "new_customers": _new_customers, "reopen_layouts": _reopen, "layouts_with_latest_job": _latest_job, "version_summaries": _version_summaries, "entity_patches": _entity_patches,
    "broker_directory": _broker_directory, "first_plot_numbers": _sorted_plots,
    "status_patches": _status_patches, "plots_with_active_booking": _with_active, "bookings_with_plot": _with_plot, "invalid_status": _invalid_status, "editable_entities": _editable,
    "clean_payments": _clean_payments, "validate_projects": _validate_projects, "text_fields": _text_fields, "date_fields": _dates, "event_values": _event_values, "norm_notes": _norm_notes, "block_ids": _block_ids,
}

_BOOKED = """books AS (
  SELECT DISTINCT ON (plot_id) 'b-' || plot_id AS booking_id, plot_id, 'Owner ' || order_id AS customer_name, CASE WHEN order_id % 9 = 0 THEN 'CANCELLED' ELSE 'BOOKED' END AS booking_status
  FROM v_plots WHERE status = 'SOLD' AND CAST(split_part(plot_id, '-', 2) AS INT) % 2 = 0
), own AS (SELECT DISTINCT ON (plot_id) plot_id, plot_number, status, base_price, order_id FROM v_plots)"""

ORACLE = {
    "new_customers": with_views("SELECT 'CUSTOMER#' || lpad(CAST(k AS VARCHAR), 9, '0') AS name, count(*) AS requests FROM (SELECT payment_id % 3000 AS k FROM v_payments) WHERE k NOT IN (SELECT customer_id FROM v_customers) GROUP BY k", "v_payments", "v_customers"),
    "reopen_layouts": """SELECT s_suppkey AS layout_id, CASE WHEN s_suppkey % 6 = 0 THEN 'REVISION' ELSE ['APPROVED', 'DRAFT', 'LOCKED'][CAST(s_suppkey % 3 + 1 AS INT)] END AS layout_status,
  CAST(s_nationkey + CASE WHEN s_suppkey % 6 = 0 THEN 1 ELSE 0 END AS INT) AS layout_version FROM supplier""",
    "layouts_with_latest_job": """SELECT s_suppkey AS layout_id, event_id AS job_id, event_type AS job_status, props AS stage, value AS progress FROM supplier
  LEFT JOIN (SELECT DISTINCT ON (user_id) * FROM events ORDER BY user_id, ts DESC, event_id DESC) ON user_id = s_suppkey""",
    "version_summaries": """SELECT project_id, 'v' || n AS version, CAST(n AS INT) AS number, count(*) OVER p AS n_versions, n = max(n) OVER p AS is_latest FROM (SELECT DISTINCT o_custkey % 50 AS project_id, o_orderkey % 23 AS n FROM orders) WINDOW p AS (PARTITION BY project_id)""",
    "entity_patches": with_views(
        f"""SELECT plot_id AS entity_id, CASE WHEN hit THEN 'new' ELSE 'old' END AS note, {r2('(w + g) * h')} AS area, {r2('(w + g + h) * 2')} AS perimeter, {r2('x0 + (w + g) / 2')} AS cx
  FROM (SELECT *, plot_id % 5 = 0 AND plot_id % 4 <> 0 AS hit, CASE WHEN plot_id % 5 = 0 AND plot_id % 4 <> 0 AND plot_id % 2 = 0 THEN 10 ELSE 0 END AS g FROM v_rects)""", "v_rects"),
    "broker_directory": with_views("SELECT count(*) AS brokers, CAST(sum(broker_id * 2) AS BIGINT) AS deals, CAST(sum(commission_rate * 10) AS DOUBLE) AS earned, CAST(sum(commission_rate) AS DOUBLE) AS pending FROM v_brokers", "v_brokers"),
    "first_plot_numbers": with_views("SELECT plot_number FROM (SELECT DISTINCT plot_number FROM v_plots) ORDER BY lower(split_part(plot_number, '-', 1)), CAST(split_part(plot_number, '-', 2) AS INT) LIMIT 40", "v_plots"),
    "status_patches": with_views(
        """SELECT o.plot_id, st AS status, CASE WHEN good AND order_id % 7 = 0 THEN 'new' ELSE 'old' END AS notes, price AS base_price,
  CASE WHEN good AND st = 'AVAILABLE' THEN 'none' WHEN opens THEN 'booking' ELSE 'old' END AS owner, coalesce(opens, false) AS reserved,
  CASE WHEN opens THEN 'opened' WHEN booking_id IS NOT NULL THEN 'kept' END AS booking,
  CASE WHEN opens THEN 'BOOKED' WHEN good AND st = 'AVAILABLE' AND booking_status = 'BOOKED' THEN 'CANCELLED' ELSE booking_status END AS booking_status,
  CASE WHEN opens THEN CASE WHEN order_id % 2 = 0 THEN 'Mira' ELSE 'Customer' END WHEN touched AND order_id % 2 = 0 THEN 'Mira' ELSE customer_name END AS who,
  CASE WHEN opens OR touched THEN '900' WHEN booking_id IS NOT NULL THEN '100' END AS customer_phone,
  CASE WHEN opens OR touched THEN CASE order_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'm@x' ELSE CASE WHEN opens THEN NULL ELSE 'a@b' END END WHEN booking_id IS NOT NULL THEN 'a@b' END AS customer_email,
  CASE WHEN opens THEN CAST(CAST(price AS DECIMAL(18,2)) AS DOUBLE) END AS total
FROM (SELECT *, good AND st IN ('SOLD', 'BOOKED') AND (booking_status IS NULL) AS opens, good AND st IN ('SOLD', 'BOOKED') AND booking_status = 'BOOKED' AS touched
  FROM (SELECT own.*, booking_id, booking_status, customer_name, own.order_id % 3 = 0 AND own.order_id % 5 <> 2 AS good,
    CASE WHEN own.order_id % 3 = 0 THEN CASE own.order_id % 5 WHEN 0 THEN 'SOLD' WHEN 1 THEN 'AVAILABLE' WHEN 3 THEN 'BLOCKED' ELSE status END ELSE status END AS st,
    CASE WHEN own.order_id % 3 = 0 AND own.order_id % 5 <> 2 AND own.order_id % 11 = 0 THEN 12.0 ELSE base_price END AS price
    FROM own LEFT JOIN books USING (plot_id) WHERE booking_status IS DISTINCT FROM 'CANCELLED') x) o
UNION ALL
SELECT o.plot_id, st, CASE WHEN good AND order_id % 7 = 0 THEN 'new' ELSE 'old' END, price, CASE WHEN good AND st = 'AVAILABLE' THEN 'none' WHEN opens THEN 'booking' ELSE 'old' END, coalesce(opens, false),
  k, CASE k WHEN 'kept' THEN 'CANCELLED' ELSE 'BOOKED' END, CASE WHEN k = 'kept' THEN customer_name WHEN order_id % 2 = 0 THEN 'Mira' ELSE 'Customer' END, CASE k WHEN 'kept' THEN '100' ELSE '900' END,
  CASE WHEN k = 'kept' THEN 'a@b' WHEN order_id % 4 = 1 THEN 'm@x' END, CASE WHEN k = 'opened' THEN CAST(CAST(price AS DECIMAL(18,2)) AS DOUBLE) END
FROM (SELECT *, good AND st IN ('SOLD', 'BOOKED') AS opens
  FROM (SELECT own.*, customer_name, own.order_id % 3 = 0 AND own.order_id % 5 <> 2 AS good,
    CASE WHEN own.order_id % 3 = 0 THEN CASE own.order_id % 5 WHEN 0 THEN 'SOLD' WHEN 1 THEN 'AVAILABLE' WHEN 3 THEN 'BLOCKED' ELSE status END ELSE status END AS st,
    CASE WHEN own.order_id % 3 = 0 AND own.order_id % 5 <> 2 AND own.order_id % 11 = 0 THEN 12.0 ELSE base_price END AS price
    FROM own JOIN books USING (plot_id) WHERE booking_status = 'CANCELLED') x) o, (VALUES ('kept'), ('opened')) m(k) WHERE k = 'kept' OR opens""",
        "v_plots", extra=_BOOKED),
    "plots_with_active_booking": with_views("SELECT plot_id, status, booking_id AS active_booking_id, customer_name FROM own LEFT JOIN (SELECT * FROM books WHERE booking_status = 'BOOKED') USING (plot_id)", "v_plots", extra=_BOOKED),
    "bookings_with_plot": with_views("SELECT booking_id, plot_number, booking_status FROM books LEFT JOIN own USING (plot_id)", "v_plots", extra=_BOOKED),
    "invalid_status": with_views("SELECT project_id, 'GONE' AS status, count(*) AS n FROM v_plots WHERE order_id % 10 = 0 GROUP BY 1", "v_plots"),
    "editable_entities": with_views("SELECT project_id, plot_id % 4 AS layout_id, plot_id FROM v_rects WHERE plot_id % 4 > 1", "v_rects"),
    "clean_payments": with_views(
        """SELECT payment_id, st AS status, CASE WHEN payment_id % 13 = 0 THEN 'customer required' WHEN payment_id % 7 < 2 OR amount <= 0 THEN 'amount must be positive' END AS error,
  CASE WHEN st = 'Completed' THEN coalesce(CASE WHEN payment_id % 3 = 0 THEN paid_date END, due_date) END AS paid_date FROM (SELECT *, CASE WHEN payment_id % 5 = 0 THEN 'Pending' ELSE status END AS st FROM v_payments)""", "v_payments"),
    "validate_projects": """SELECT s_suppkey AS project_id, concat_ws(',', CASE WHEN s_suppkey % 6 = 0 THEN 'name' END, CASE WHEN s_suppkey % 5 = 0 THEN 'developer_name' END, CASE WHEN s_suppkey % 4 = 0 THEN 'pincode' END,
  CASE WHEN NOT s_acctbal > 0 THEN 'gross_land_area' END, CASE WHEN s_suppkey % 3 = 0 THEN 'survey_numbers' END) AS failed FROM supplier""",
    "text_fields": """SELECT p_partkey AS part_id, CASE WHEN p_size % 10 <> 0 THEN format('₹{:,} – ₹{:,}', CAST(floor(p_retailprice * 1000) AS BIGINT), CAST(floor(p_retailprice * 1500) AS BIGINT)) ELSE 'Price on request' END AS price_range,
  p_name AS stripped, concat_ws('|', split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)) AS tags, split_part(p_name, ' ', 1) AS city,
  printf('#%02x%02x00', CAST(least(trunc(p_size / 40.0::DOUBLE * 255), 255) AS INT), CAST(trunc((p_partkey % 8) / 8.0::DOUBLE * 255) AS INT)) AS colour FROM part""",
    "date_fields": """SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 10 > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 10 > 1 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE 'N/A' END AS shown,
  CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate ELSE date_trunc('day', o_orderdate) + INTERVAL '10 hours 20 minutes 30 seconds' END AS at FROM orders""",
    "event_values": f"""SELECT event_id, json_extract_string(props, '$.k') AS k, value > 20 AND event_type <> 'error' AS ready, {r2("coalesce(value * 100.0::DOUBLE / nullif(user_id % 3, 0), 0)")} AS share,
  least(greatest(value, 5), 50) AS clamped, {r2(f"value * {K.SALEABLE_SHARE}::DOUBLE * 1000.0::DOUBLE")} AS gdv FROM events""",
    "norm_notes": with_views(
        """SELECT parcel_id, authority_id, CASE WHEN is_congested THEN 'Congested area: open space relaxed to 5%.' WHEN ha < 0.4 THEN 'Below 0.40 ha: no open space required.' WHEN ha < 1 THEN '0.40–1.0 ha: 10% open space, one cluster of 400 sqm.' ELSE 'From 1.0 ha: 10% open space, one cluster of 1,000 sqm.' END
  || ' ' || CASE WHEN is_congested THEN 'Congested area: amenity space exempted.' WHEN ha >= threshold THEN 'From ' || CAST(CAST(threshold AS DECIMAL(9,1)) AS VARCHAR) || ' ha: 5% amenity space, ' || office || '.' ELSE 'Below ' || CAST(CAST(threshold AS DECIMAL(9,1)) AS VARCHAR) || ' ha: amenity space exempted, ' || office || '.' END
  || ' Utility reservation is mandatory.' AS notes, CASE WHEN NOT is_congested AND ha >= threshold THEN 5.0 ELSE 0.0 END::DOUBLE AS amenity_pct
FROM (SELECT *, greatest(100.0, land_area_sqm) / 10000.0::DOUBLE AS ha, no BETWEEN 1 AND 7 AS known, CASE WHEN no BETWEEN 1 AND 7 THEN jurisdiction_id ELSE '{state}' END AS authority_id, CASE WHEN no BETWEEN 1 AND 7 THEN 0.5 * no ELSE 2.0 END AS threshold, CASE WHEN no BETWEEN 1 AND 7 THEN 'Office ' || no ELSE 'Statewide' END AS office
  FROM (SELECT *, CAST(substr(jurisdiction_id, 6) AS INT) AS no FROM v_parcels))""".replace("{state}", N.STATEWIDE), "v_parcels"),
    "block_ids": """SELECT block_no, rank, 'block-' || CASE WHEN rank < 1000 THEN lpad(CAST(rank AS VARCHAR), 3, '0') ELSE CAST(rank AS VARCHAR) END AS block_id
FROM (SELECT p_partkey AS block_no, row_number() OVER (ORDER BY p_size * 40.0 + p_partkey % 97 DESC, p_partkey) AS rank FROM part WHERE p_size * 40.0 + p_partkey % 97 >= 300)""",
}
