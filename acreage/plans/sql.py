"""SQL twins of the registered queries, for a second engine to check results against."""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "v_projects": """
  SELECT s_suppkey AS project_id, s_name AS name, n_name || ', ' || r_name AS location,
         ['Active','Upcoming','Planning','Completed'][s_nationkey % 4 + 1] AS status,
         ['Residential','Commercial','Mixed'][CAST(s_suppkey % 3 + 1 AS INT)] AS type,
         TIMESTAMP '2020-01-01' + to_days(CAST(s_suppkey AS INT)) AS created_at, n_name AS city_village
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "v_plots": """
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS plot_id, l_suppkey AS project_id,
         chr(CAST(65 + l_linenumber % 3 AS INT)) || '-' || (l_partkey % 500) AS plot_number, l_quantity * 48 AS area_sqft,
         l_extendedprice AS base_price,
         CASE WHEN l_returnflag = 'A' THEN 'SOLD' WHEN l_returnflag = 'R' THEN 'RESERVED'
              WHEN l_linestatus = 'O' THEN 'AVAILABLE' ELSE 'BLOCKED' END AS status,
         ['NORTH','EAST','SOUTH','WEST'][l_linenumber % 4 + 1] AS facing, l_partkey % 7 = 0 AS is_corner,
         CASE WHEN l_returnflag <> 'N' THEN l_partkey % 25 END AS broker_id, l_orderkey AS order_id, l_shipdate AS created_at
  FROM lineitem""",
    "v_owned": """
  SELECT p.*, o_custkey AS customer_id FROM v_plots p JOIN orders ON order_id = o_orderkey""",
    "v_payments": """
  SELECT o_orderkey AS payment_id, o_custkey AS customer_id, o_orderkey % 100 AS project_id, o_orderkey % 25 AS broker_id,
         o_totalprice AS amount,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' ELSE 'Overdue' END AS status,
         substr(o_orderpriority, 3) AS method, 'REC-' || o_orderkey AS receipt, o_orderdate AS due_date,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS paid_date
  FROM orders""",
    "v_customers": """
  SELECT c_custkey AS customer_id, c_name AS name, n_name AS city, c_mktsegment AS segment, c_acctbal AS total_invested
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_brokers": """
  SELECT CAST(n_nationkey AS BIGINT) AS broker_id, n_name AS name, n_regionkey + 1.0::DOUBLE AS commission_rate FROM nation""",
    "v_commands": """
  SELECT event_id AS seq, ts, user_id AS plot_id,
         CASE event_type WHEN 'purchase' THEN 'book' WHEN 'error' THEN 'cancel' WHEN 'signup' THEN 'patch' END AS command,
         value AS amount
  FROM events""",
    "v_inventory": """
  SELECT project_id, count(*) AS total_plots, count(*) FILTER (status = 'SOLD') AS sold_plots,
         count(*) FILTER (status = 'AVAILABLE') AS available_plots, count(*) FILTER (status = 'RESERVED') AS reserved_plots,
         count(*) FILTER (status = 'BLOCKED') AS blocked_plots, count(*) FILTER (status = 'BOOKED') AS booked_plots,
         CAST(coalesce(sum(CAST(base_price AS DECIMAL(18,2))) FILTER (status = 'SOLD'), 0) AS DOUBLE) AS revenue
  FROM v_plots GROUP BY project_id""",
    "v_rects": """
  SELECT p_partkey // 400 AS project_id, p_partkey AS plot_id, p_partkey AS ord,
         ((p_partkey % 400) % 40) * 60.0::DOUBLE AS x0, ((p_partkey % 400) // 40) * 45.0::DOUBLE AS y0,
         ((p_partkey % 400) % 40) * 60.0::DOUBLE + p_size + 30 AS x1,
         ((p_partkey % 400) // 40) * 45.0::DOUBLE + (p_partkey % 7) * 8 + 20 AS y1,
         p_size + 30.0::DOUBLE AS w, (p_partkey % 7) * 8 + 20.0::DOUBLE AS h, p_size, p_type, p_brand, p_retailprice
  FROM part""",
    "v_roads": """
  SELECT project_id, 'road-' || n AS road_id, CAST(n AS BIGINT) AS ord, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1,
         least(x1 - x0, y1 - y0)::DOUBLE AS width_ft
  FROM (SELECT DISTINCT project_id FROM v_rects),
       (VALUES (0, 0, 100, 2400, 130), (1, 0, 290, 2400, 312), (2, 600, 0, 630, 470)) r(n, x0, y0, x1, y1)""",
    "v_points": """
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_extendedprice AS DECIMAL(18,2)) AS label_id,
         l_partkey // 400 AS project_id, l_quantity * 48 + l_linenumber * 7 AS x, (l_orderkey % 520)::DOUBLE AS y, l_linenumber AS n
  FROM lineitem""",
    "v_parcels": """
  SELECT p_partkey AS parcel_id, p_size * p_retailprice AS land_area_sqm,
         CASE p_type WHEN 'PROMO' THEN 'COMMERCIAL' WHEN 'SMALL' THEN 'EWS' ELSE 'RESIDENTIAL' END AS land_use,
         p_partkey % 5 = 0 AS is_congested, 'AUTH_' || regexp_extract(p_brand, '(\\d+)', 1) AS jurisdiction_id,
         (p_size * 10 + 200)::DOUBLE AS width_ft, ((p_partkey % 50) * 10 + 150)::DOUBLE AS depth_ft
  FROM part""",
}

DEPENDS = {
    "v_owned": ["v_plots"], "v_inventory": ["v_plots"], "v_roads": ["v_rects"],
}


def with_views(body: str, *names: str, extra: str = "") -> str:
    """Prefix ``body`` with the views it reads, each after the ones it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in DEPENDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    if extra:
        parts.append(extra.strip())
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def r2(x: str) -> str:
    return f"floor(({x}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"


def money(col: str, where: str | None = None) -> str:
    f = f" FILTER ({where})" if where else ""
    return f"CAST(coalesce(sum(CAST({col} AS DECIMAL(18,2))){f}, 0) AS DOUBLE)"
