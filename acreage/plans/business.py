"""Registered queries on inventory, payments, people and bookings, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from acreage.functions import scalars as S
from acreage.functions import text as T
from acreage.functions.rings import floor_round
from acreage.operators import bookings as B
from acreage.operators import crm as C
from acreage.operators import inventory as I
from acreage.operators import versions as V
from acreage.plans import views as v
from acreage.plans.sql import money, r2, with_views
from acreage.session import first_per_key


def _flagship(s, d):
    return C.sort_projects(I.sales_progress(v.projects(s, d), I.project_inventory(v.plots(s, d))).withColumn("created_at", F.lit(None).cast("timestamp")), "revenue").drop("created_at")


def _leaderboard(s, d):
    return C.broker_leaderboard(C.broker_performance(v.plots(s, d), v.brokers(s, d)), 5)


def _natural(s, d):
    """Plot numbers of the whole inventory with their first row in natural order."""
    nums = v.plots(s, d).groupBy("plot_number").agg(F.count(F.lit(1)).alias("n"))
    k = C.natural_key("plot_number")
    return nums.select("plot_number", "n", k[0].alias("prefix"), k[1].cast("long").alias("number")).orderBy("prefix", "number")


def _top_plots(s, d):
    return first_per_key(v.plots(s, d), ["project_id"], [F.desc("base_price"), F.asc("plot_id")], 3, "rank").select(
        "project_id", F.col("rank").cast("long").alias("rank"), "plot_id", "base_price"
    )


def _upsert(s, d):
    """Half of the parts exist already; incoming geometry comes for two thirds of them."""
    r = v.rects(s, d)
    base = r.select("project_id", F.concat(F.lit("P-"), F.col("plot_id").cast("string")).alias("plot_number"), "plot_id", "p_size", "w", "h")
    existing = base.filter(F.col("p_size") <= 25).select(
        "project_id", "plot_number", F.col("plot_id").cast("string").alias("plot_id"), F.lit(0.0).alias("area_sqft"), F.lit("SOLD").alias("status")
    )
    incoming = base.filter(F.col("plot_id") % 3 != 0).select("project_id", "plot_number", (F.col("w") * F.col("h")).alias("area_sqft"))
    merged = I.upsert_plots(existing, incoming)
    return merged.select("project_id", "plot_number", "area_sqft", "status", "change")


def _select_variant(s, d):
    r = v.rects(s, d).select("project_id", F.col("plot_id").alias("variant_id"), (F.col("plot_id") % 2 == 0).alias("is_selected"), "p_retailprice")
    choice = r.filter(F.col("project_id") % 2 == 0).groupBy("project_id").agg(F.max_by("variant_id", F.struct("p_retailprice", "variant_id")).alias("variant_id"))
    return I.select_variant(r, choice).select("project_id", "variant_id", "is_selected")


def _drop_projects(s, d):
    gone = v.projects(s, d).filter(F.col("status") == "Completed")
    kept = I.drop_projects({"plots": v.plots(s, d), "payments": v.payments(s, d)}, gone)
    n = lambda df, name: df.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).withColumn("table", F.lit(name))
    return n(kept["plots"], "plots").unionByName(n(kept["payments"], "payments"))


def _replay(s, d):
    return B.replay_bookings(v.commands(s, d)).select("seq", "plot_id", "command", "state_before", "accepted", "state_after")


def _amounts(s, d):
    p = v.payments(s, d).select(
        "payment_id", (F.col("amount") * (F.col("payment_id") % 3).cast("double")).cast("decimal(18,2)").alias("base_price"),
        F.lit(None).cast("decimal(18,2)").alias("total_amount"), F.col("amount").cast("decimal(18,2)").alias("booking_amount"),
        F.when(F.col("payment_id") % 2 == 0, (F.col("amount") * 2).cast("decimal(18,2)")).alias("paid_amount"),
    )
    return B.with_amounts(p).select("payment_id", "total_amount", "paid_amount", "remaining_amount", "payment_status")


def _invalid(s, d):
    p = v.payments(s, d).join(v.customers(s, d).select("customer_id", "name", "segment"), "customer_id", "left").select(
        "payment_id", F.when(F.col("payment_id") % 11 != 0, F.col("name")).alias("customer_name"),
        F.when(F.col("payment_id") % 7 != 0, F.col("segment")).otherwise("  ").alias("customer_phone"),
        (F.col("amount") - 100000).alias("booking_amount"),
    )
    return B.validate_bookings(p).filter("error IS NOT NULL").select("payment_id", "error")


def _resolve_customers(s, d):
    req = v.payments(s, d).select("payment_id", F.concat(F.lit(" CUSTOMER#"), F.lpad((F.col("payment_id") % 3000).cast("string"), 9, "0")).alias("customer_name"))
    return C.resolve_customers(req, v.customers(s, d)).select("payment_id", F.when(~F.col("is_new"), F.col("customer_id")).alias("known_id"), "is_new")


def _match_customer(s, d):
    """Customers list a plot number of their own; plots of unknown customers match through it."""
    cust = v.customers(s, d).withColumn("assigned_plots", F.array(F.concat(F.lit("a-"), (F.col("customer_id") % 600).cast("string"))))
    plots = v.owned_plots(s, d).withColumn("customer_id", F.when(F.col("is_corner"), F.col("customer_id")))
    return C.match_customer(plots, cust).select("plot_id", "matched_id", "matched_name")


def _page(s, d):
    return C.paginate(v.payments(s, d), [F.desc("due_date"), F.asc("payment_id")], 3, 25).select("payment_id", "due_date", "amount")


def _inr(s, d):
    return v.payments(s, d).select("payment_id", T.format_inr(F.col("amount") * (F.col("payment_id") % 60)).alias("label"))


def _project_wide(s, d):
    pr, pl, pay = v.projects(s, d), v.plots(s, d), v.payments(s, d)
    return I.project_wide(pr.select("project_id", "name", "status"), {}, {"plots": pl, "payments": pay}).select("project_id", "name", "n_plots", "n_payments")


def _payment_state(s, d):
    return C.payment_breakdown(v.payments(s, d).withColumn("status", F.when(F.col("status") == "Overdue", "Pending").otherwise(F.col("status"))), F.lit("1997-01-01").cast("timestamp"))


def _monthly(s, d):
    targets = v.payments(s, d).groupBy(F.date_format("due_date", "yyyy-MM").alias("month")).agg(I.money_sum("amount").alias("target"))
    return C.monthly_revenue(v.payments(s, d), targets)


def _views_of_plots(s, d):
    pl = v.plots(s, d).withColumn("polygon_geojson", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("facing", F.when(F.col("is_corner"), F.lit(True)).alias("isCorner")).alias("properties")))).withColumn(
        "notes", F.when(F.col("project_id") % 2 == 0, F.concat(F.lit("30 x 40, Road "), F.col("facing")))
    ).withColumn("base_price", F.when(F.col("status") == "SOLD", F.col("base_price")))
    live = s.createDataFrame([], "plot_id STRING, customer_name STRING, customer_phone STRING")
    return I.plot_view(pl, live).select("plot_id", "dimensions", "road_name", "is_corner", "price", "rate_per_sqft", "status_label")


def _latest(s, d):
    ev = v.commands(s, d)
    return V.latest_by(ev, ["plot_id"], ["ts", "seq"]).select("plot_id", "seq", "command", "amount")


def _versions(s, d):
    ev = v.commands(s, d)
    return V.assign_versions(ev, ["plot_id"], [F.col("ts"), F.col("seq")], F.date_trunc("day", "ts")).select("seq", "plot_id", "version", "is_latest")


def _timeline(s, d):
    ev = v.commands(s, d).select("seq", F.col("plot_id").alias("job_id"), "ts", F.coalesce("command", F.lit("view")).alias("stage"), F.col("amount").alias("progress"))
    return V.stage_timeline(ev).select("seq", "job_id", "stage", "previous_stage", "elapsed_sec", "fell_back")


def _history(s, d):
    ev = v.commands(s, d).select(F.col("plot_id").alias("layout_id"), "seq", "ts")
    return V.edit_history(ev).select("layout_id", "seq", "revision")


def _duplicates(s, d):
    return V.duplicate_numbers(v.plots(s, d)).select("project_id", "plot_number", "n")


def _run_result(s, d):
    ev = v.commands(s, d).select(F.col("plot_id").alias("job_id"), F.coalesce("command", F.lit("view")).alias("artifact_type"), F.col("amount").cast("string").alias("content_json"), F.col("ts").alias("created_at"), F.col("seq").alias("artifact_id"))
    return V.run_result(ev, ["book", "cancel", "patch"])


QUERIES = {
    "project_inventory": lambda s, d: I.project_inventory(v.plots(s, d)),
    "project_stats": lambda s, d: I.project_stats(v.plots(s, d)),
    "portfolio_kpis": lambda s, d: I.portfolio_kpis(v.projects(s, d), I.project_inventory(v.plots(s, d))),
    "sales_progress": _flagship,
    "status_distribution": lambda s, d: I.status_distribution(v.plots(s, d)),
    "facing_distribution": lambda s, d: I.facing_distribution(v.plots(s, d)),
    "project_wide": _project_wide,
    "plot_view": _views_of_plots,
    "distinct_cities": lambda s, d: I.distinct_cities(v.projects(s, d)),
    "payment_totals": lambda s, d: C.payment_totals(v.payments(s, d)),
    "payment_breakdown": _payment_state,
    "monthly_revenue": _monthly,
    "broker_performance": lambda s, d: C.broker_performance(v.plots(s, d), v.brokers(s, d), v.payments(s, d)),
    "broker_leaderboard": _leaderboard,
    "customer_ledger": lambda s, d: C.customer_ledger(v.owned_plots(s, d), v.customers(s, d), v.payments(s, d)),
    "project_customers": lambda s, d: C.project_members(v.owned_plots(s, d), v.customers(s, d), "customer_id").select("project_id", "customer_id", "name"),
    "match_customer": _match_customer,
    "resolve_customers": _resolve_customers,
    "project_search": lambda s, d: C.search(v.projects(s, d), " nation_1 ", ["name", "location"]).select("project_id", "name", "location"),
    "payment_search": lambda s, d: C.search_payments(v.payments(s, d), v.customers(s, d), v.projects(s, d), "00042").select("payment_id", "customer_name", "project_name"),
    "facets": lambda s, d: C.facet(v.projects(s, d), status="Upcoming", kind="residential").select("project_id", "status", "type"),
    "plot_facets": lambda s, d: C.facet(v.plots(s, d), facing="EAST", corner="CORNER").select("plot_id", "facing"),
    "natural_sort_plots": _natural,
    "top_plots": _top_plots,
    "paginate_payments": _page,
    "format_inr": _inr,
    "upsert_plots": _upsert,
    "select_variant": _select_variant,
    "drop_projects": _drop_projects,
    "replay_bookings": _replay,
    "booking_amounts": _amounts,
    "invalid_bookings": _invalid,
    "final_plot_states": lambda s, d: B.final_states(B.replay_bookings(v.commands(s, d))),
    "latest_command": _latest,
    "assign_versions": _versions,
    "stage_timeline": _timeline,
    "edit_history": _history,
    "duplicate_numbers": _duplicates,
    "run_result": _run_result,
}

_CALLS = """
SELECT *, CASE command WHEN 'book' THEN 'BOOKED' WHEN 'cancel' THEN 'AVAILABLE' ELSE 'RESERVED' END AS state_after
FROM v_commands WHERE command IS NOT NULL"""
_DECIDED = f"""decided AS (SELECT *, NOT (command = 'book' AND state_before = 'BOOKED') AS accepted FROM (
  SELECT *, coalesce(lag(state_after) OVER (PARTITION BY plot_id ORDER BY ts, seq), 'AVAILABLE') AS state_before FROM ({_CALLS})))"""

ORACLE = {
    "project_inventory": with_views("SELECT * FROM v_inventory", "v_inventory"),
    "project_stats": with_views(
        f"""SELECT project_id, count(*) AS n_plots, CAST(sum(CAST(area_sqft AS DECIMAL(28,6))) AS DOUBLE) AS total_sqft,
  CAST(sum(CAST(area_sqft * 0.092903::DOUBLE AS DECIMAL(28,6))) AS DOUBLE) AS total_sqm, {money('base_price')} AS total_value,
  {r2("CAST(sum(CAST(area_sqft AS DECIMAL(28,6))) AS DOUBLE) / count(*)")} AS avg_sqft,
  count(*) FILTER (is_corner) AS corner_plots, {money('base_price', "status = 'SOLD'")} AS sold_revenue
  FROM v_plots GROUP BY project_id""", "v_plots"),
    "portfolio_kpis": with_views(
        f"""SELECT count(*) AS projects, count(*) FILTER (lower(status) = 'active') AS active_projects,
  CAST(coalesce(sum(total_plots), 0) AS BIGINT) AS plots, CAST(coalesce(sum(sold_plots), 0) AS BIGINT) AS sold, {money('revenue')} AS revenue,
  {r2("sum(sold_plots)::DOUBLE * 100 / sum(total_plots)::DOUBLE")} AS occupancy_pct
  FROM v_projects LEFT JOIN v_inventory USING (project_id)""", "v_projects", "v_inventory"),
    "sales_progress": with_views(
        f"""SELECT project_id, name, coalesce(total_plots, 0) AS total_plots, coalesce(sold_plots, 0) AS sold_plots,
  greatest(coalesce(total_plots, 0) - coalesce(sold_plots, 0), 0) AS remaining,
  {r2("coalesce(sold_plots * 100.0::DOUBLE / total_plots, 0)")} AS sold_pct, coalesce(revenue, 0) AS revenue
  FROM v_projects LEFT JOIN v_inventory USING (project_id) ORDER BY revenue DESC, project_id""", "v_projects", "v_inventory"),
    "status_distribution": with_views(
        f"""SELECT project_id, status, n, {r2("n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY project_id)")} AS share_pct
  FROM (SELECT project_id, status, count(*) AS n FROM v_plots GROUP BY 1, 2)""", "v_plots"),
    "facing_distribution": with_views(
        f"SELECT project_id, facing, count(*) AS n, {money('base_price', chr(115)+'tatus = ' + chr(39) + 'SOLD' + chr(39))} AS revenue FROM v_plots GROUP BY 1, 2", "v_plots"),
    "project_wide": with_views(
        """SELECT p.project_id, name, coalesce(a.n, 0) AS n_plots, coalesce(b.n, 0) AS n_payments FROM v_projects p
  LEFT JOIN (SELECT project_id, count(*) n FROM v_plots GROUP BY 1) a USING (project_id)
  LEFT JOIN (SELECT project_id, count(*) n FROM v_payments GROUP BY 1) b USING (project_id)""", "v_projects", "v_plots", "v_payments"),
    "plot_view": with_views(
        """SELECT plot_id, CASE WHEN project_id % 2 = 0 THEN '30 x 40' ELSE 'Standard 30×40 FT' END AS dimensions,
  CASE WHEN project_id % 2 = 0 THEN 'Road ' || facing ELSE 'Main Avenue (9.0M ROW)' END AS road_name, is_corner,
  floor(price + 0.5) AS price, floor(price / area_sqft + 0.5) AS rate_per_sqft,
  upper(status[1]) || lower(status[2:]) AS status_label
  FROM (SELECT *, CASE WHEN status = 'SOLD' THEN base_price ELSE area_sqft * 2500 END AS price FROM v_plots)""", "v_plots"),
    "distinct_cities": with_views("SELECT DISTINCT split_part(location, ',', 1) AS city FROM v_projects ORDER BY 1", "v_projects"),
    "payment_totals": with_views(
        f"""SELECT project_id, count(*) AS n, count(*) FILTER (status = 'Completed') AS n_completed, {money('amount')} AS total,
  {money('amount', "status = 'Completed'")} AS completed, {money('amount', "status <> 'Completed'")} AS pending FROM v_payments GROUP BY 1""", "v_payments"),
    "payment_breakdown": with_views(
        f"""SELECT s AS status, {money('amount')} AS amount, count(*) AS n FROM (SELECT amount,
  CASE WHEN status = 'Completed' THEN status WHEN due_date < TIMESTAMP '1997-01-01' THEN 'Overdue' ELSE 'Pending' END AS s FROM v_payments) GROUP BY s""", "v_payments"),
    "monthly_revenue": with_views(
        f"""SELECT month, coalesce(revenue, 0) AS revenue, coalesce(n, 0) AS plots_sold, target, {r2("coalesce(revenue, 0) * 100.0::DOUBLE / target")} AS attained_pct FROM
  (SELECT strftime(due_date, '%Y-%m') AS month, {money('amount')} AS target FROM v_payments GROUP BY 1) LEFT JOIN
  (SELECT strftime(paid_date, '%Y-%m') AS month, {money('amount')} AS revenue, count(*) AS n FROM v_payments WHERE status = 'Completed' GROUP BY 1) USING (month)""", "v_payments"),
    "broker_performance": with_views(
        f"""SELECT project_id, broker_id, name AS broker_name, deals, revenue, commission, coalesce(paid, 0) AS paid,
  greatest({r2("commission - coalesce(paid, 0)")}, 0) AS pending FROM (
  SELECT d.*, name, {r2("revenue * commission_rate / 100.0::DOUBLE")} AS commission FROM
  (SELECT project_id, broker_id, count(*) AS deals, {money('base_price', "status = 'SOLD'")} AS revenue FROM v_plots WHERE broker_id IS NOT NULL GROUP BY 1, 2) d
  JOIN v_brokers USING (broker_id)) LEFT JOIN
  (SELECT project_id, broker_id, {money('amount')} AS paid FROM v_payments WHERE status = 'Completed' GROUP BY 1, 2) USING (project_id, broker_id)""", "v_plots", "v_brokers", "v_payments"),
    "broker_leaderboard": with_views(
        f"""SELECT row_number() OVER (ORDER BY deals DESC, broker_id) AS rank, broker_id, name AS broker_name, deals, revenue FROM
  (SELECT broker_id, count(*) AS deals, {money('base_price', "status = 'SOLD'")} AS revenue FROM v_plots WHERE broker_id IS NOT NULL GROUP BY 1) JOIN v_brokers USING (broker_id)
  QUALIFY rank <= 5""", "v_plots", "v_brokers"),
    "customer_ledger": with_views(
        f"""SELECT h.project_id, h.customer_id, name AS customer_name, plots, value, coalesce(paid, 0) AS paid, coalesce(outstanding, 0) AS outstanding FROM
  (SELECT project_id, customer_id, count(*) AS plots, {money('base_price')} AS value FROM v_owned GROUP BY 1, 2) h JOIN v_customers USING (customer_id) LEFT JOIN
  (SELECT project_id, customer_id, {money('amount', "status = 'Completed'")} AS paid, {money('amount', "status <> 'Completed'")} AS outstanding FROM v_payments GROUP BY 1, 2) USING (project_id, customer_id)""",
        "v_owned", "v_customers", "v_payments"),
    "project_customers": with_views("SELECT DISTINCT project_id, customer_id, name FROM v_owned JOIN v_customers USING (customer_id)", "v_owned", "v_customers"),
    "match_customer": with_views(
        """SELECT plot_id, coalesce(a.customer_id, b.customer_id) AS matched_id, coalesce(a.name, b.name) AS matched_name
  FROM (SELECT plot_id, plot_number, CASE WHEN is_corner THEN customer_id END AS customer_id FROM v_owned) p LEFT JOIN v_customers a ON a.customer_id = p.customer_id
  LEFT JOIN (SELECT customer_id % 600 AS k, min(customer_id) AS customer_id, arg_min(name, customer_id) AS name FROM v_customers GROUP BY 1) b ON p.plot_number = 'A-' || b.k""", "v_owned", "v_customers"),
    "resolve_customers": with_views(
        """SELECT payment_id, CAST(customer_id AS VARCHAR) AS known_id, customer_id IS NULL AS is_new
  FROM v_payments p(payment_id, x) LEFT JOIN v_customers c ON lower(name) = 'customer#' || lpad(CAST(payment_id % 3000 AS VARCHAR), 9, '0')""".replace("v_payments p(payment_id, x)", "(SELECT payment_id FROM v_payments) p"),
        "v_payments", "v_customers"),
    "project_search": with_views("SELECT project_id, name, location FROM v_projects WHERE lower(name) LIKE '%nation\\_1%' ESCAPE '\\' OR lower(location) LIKE '%nation\\_1%' ESCAPE '\\'", "v_projects"),
    "payment_search": with_views(
        """SELECT * FROM (SELECT payment_id, coalesce(c.name, 'Customer') AS customer_name, coalesce(p.name, 'Project') AS project_name, receipt, method
  FROM v_payments LEFT JOIN v_customers c USING (customer_id) LEFT JOIN v_projects p USING (project_id))
  WHERE contains(lower(customer_name || '~' || project_name || '~' || receipt || '~' || method), '00042')""".replace("SELECT * FROM (", "SELECT payment_id, customer_name, project_name FROM ("), "v_payments", "v_customers", "v_projects"),
    "facets": with_views("SELECT project_id, status, type FROM v_projects WHERE status IN ('Upcoming', 'Planning') AND type = 'Residential'", "v_projects"),
    "plot_facets": with_views("SELECT plot_id, facing FROM v_plots WHERE facing = 'EAST' AND is_corner", "v_plots"),
    "natural_sort_plots": with_views(
        "SELECT plot_number, count(*) AS n, lower(plot_number[1]) || '-' AS prefix, CAST(plot_number[3:] AS BIGINT) AS number FROM v_plots GROUP BY plot_number ORDER BY 3, 4", "v_plots"),
    "top_plots": with_views("SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY base_price DESC, plot_id) AS rank, plot_id, base_price FROM v_plots QUALIFY rank <= 3", "v_plots"),
    "paginate_payments": with_views("SELECT payment_id, due_date, amount FROM v_payments ORDER BY due_date DESC, payment_id LIMIT 25 OFFSET 50", "v_payments"),
    "format_inr": with_views(
        """SELECT payment_id, CASE
  WHEN a >= 10000000 THEN '₹' || CAST(CAST(floor(a / 10000000 * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS DECIMAL(28,2)) AS VARCHAR) || ' Cr'
  WHEN a >= 100000 THEN '₹' || CAST(CAST(floor(a / 100000 * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE AS DECIMAL(28,2)) AS VARCHAR) || ' L'
  WHEN a >= 1000 THEN '₹' || CAST(CAST(floor(a / 1000 * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE AS DECIMAL(28,1)) AS VARCHAR) || ' K'
  ELSE '₹' || CAST(CAST(floor(a + 0.5) AS BIGINT) AS VARCHAR) END AS label
  FROM (SELECT payment_id, amount * (payment_id % 60) AS a FROM v_payments)""", "v_payments"),
    "upsert_plots": with_views(
        """SELECT project_id, 'P-' || plot_id AS plot_number, CASE WHEN plot_id % 3 <> 0 THEN w * h ELSE 0 END AS area_sqft,
  CASE WHEN p_size <= 25 THEN 'SOLD' ELSE 'AVAILABLE' END AS status,
  CASE WHEN p_size <= 25 AND plot_id % 3 <> 0 THEN 'updated' WHEN p_size <= 25 THEN 'kept' ELSE 'created' END AS change
  FROM v_rects WHERE p_size <= 25 OR plot_id % 3 <> 0""", "v_rects"),
    "select_variant": with_views(
        """SELECT project_id, plot_id AS variant_id, CASE WHEN project_id % 2 = 0 THEN plot_id = first_value(plot_id) OVER (PARTITION BY project_id ORDER BY p_retailprice DESC, plot_id DESC)
  ELSE plot_id % 2 = 0 END AS is_selected FROM v_rects""", "v_rects"),
    "drop_projects": with_views(
        """SELECT project_id, count(*) AS n, 'plots' AS "table" FROM v_plots WHERE project_id NOT IN (SELECT project_id FROM v_projects WHERE status = 'Completed') GROUP BY 1
  UNION ALL SELECT project_id, count(*) AS n, 'payments' FROM v_payments WHERE project_id NOT IN (SELECT project_id FROM v_projects WHERE status = 'Completed') GROUP BY 1""",
        "v_plots", "v_payments", "v_projects"),
    "replay_bookings": with_views("SELECT seq, plot_id, command, state_before, accepted, state_after FROM decided", "v_commands", extra=_DECIDED),
    "final_plot_states": with_views(
        "SELECT plot_id, arg_max(state_after, (ts, seq)) AS status, count(*) AS commands, count(*) FILTER (NOT accepted) AS rejected FROM decided GROUP BY 1",
        "v_commands", extra=_DECIDED),
    "booking_amounts": with_views(
        """SELECT payment_id, CAST(total AS DOUBLE) AS total_amount, CAST(paid AS DOUBLE) AS paid_amount,
  CAST(greatest(total - paid, 0) AS DOUBLE) AS remaining_amount, CASE WHEN total - paid <= 0 THEN 'PAID' ELSE 'PARTIAL' END AS payment_status FROM (
  SELECT payment_id, CASE WHEN payment_id % 3 = 0 THEN 1000000 ELSE CAST(amount * (payment_id % 3) AS DECIMAL(18,2)) END AS total,
  CASE WHEN payment_id % 2 = 0 THEN CAST(amount * 2 AS DECIMAL(18,2)) ELSE CAST(amount AS DECIMAL(18,2)) END AS paid FROM v_payments)""", "v_payments"),
    "invalid_bookings": with_views(
        """SELECT payment_id, error FROM (SELECT payment_id, CASE WHEN payment_id % 11 = 0 OR c.name IS NULL THEN 'Customer Name is required.'
  WHEN payment_id % 7 = 0 THEN 'Customer Phone Number is required.' WHEN amount - 100000 <= 0 THEN 'Booking amount must be greater than 0.' END AS error
  FROM v_payments LEFT JOIN v_customers c USING (customer_id)) WHERE error IS NOT NULL""", "v_payments", "v_customers"),
    "latest_command": with_views("SELECT plot_id, seq, command, amount FROM v_commands QUALIFY row_number() OVER (PARTITION BY plot_id ORDER BY ts DESC, seq DESC) = 1", "v_commands"),
    "assign_versions": with_views(
        """SELECT seq, plot_id, row_number() OVER (PARTITION BY plot_id ORDER BY ts, seq) AS version,
  row_number() OVER (PARTITION BY plot_id ORDER BY ts DESC, seq DESC) = 1 AS is_latest FROM v_commands""", "v_commands"),
    "stage_timeline": with_views(
        """SELECT seq, plot_id AS job_id, coalesce(command, 'view') AS stage, lag(coalesce(command, 'view')) OVER w AS previous_stage,
  (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0::DOUBLE AS elapsed_sec, coalesce(amount < lag(amount) OVER w, false) AS fell_back
  FROM v_commands WINDOW w AS (PARTITION BY plot_id ORDER BY ts, seq)""", "v_commands"),
    "edit_history": with_views("SELECT plot_id AS layout_id, seq, row_number() OVER (PARTITION BY plot_id ORDER BY ts, seq) AS revision FROM v_commands", "v_commands"),
    "duplicate_numbers": with_views("SELECT project_id, plot_number, count(*) AS n FROM v_plots GROUP BY 1, 2 HAVING count(*) > 1", "v_plots"),
    "run_result": with_views(
        """SELECT job_id, max(CASE WHEN t = 'book' THEN c END) AS book, max(CASE WHEN t = 'cancel' THEN c END) AS cancel, max(CASE WHEN t = 'patch' THEN c END) AS patch FROM
  (SELECT plot_id AS job_id, command AS t, arg_max(CAST(amount AS VARCHAR), (ts, seq)) AS c FROM v_commands WHERE command IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", "v_commands"),
}
