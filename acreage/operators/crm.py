"""Search, facets, name look-ups, payments, brokers, customers, documents, ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage.functions import text as T
from acreage.functions.rings import floor_round
from acreage.functions.scalars import share
from acreage.operators.inventory import money_sum
from acreage.session import cut, numbered

ALL = "ALL"


def _found(query: str, cols: list[str], arrays: list[str] = ()) -> Column:
    q = query.strip().lower()
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(q)), F.lit(False))
    for c in arrays:
        hit = hit | F.coalesce(F.exists(c, lambda t: F.contains(F.lower(t), F.lit(q))), F.lit(False))
    return hit


def search(df: DataFrame, query: str, cols: list[str], arrays: list[str] = ()) -> DataFrame:
    """Case-insensitive substring search over several columns; a blank query keeps every row."""
    return df.filter(_found(query, cols, arrays)) if query.strip() else df


def with_names(df: DataFrame, dim: DataFrame, key: str, dim_key: str, dim_name: str, out: str, fallback: str | None = None) -> DataFrame:
    """Look a name up; fall back to the key itself or to a literal.

    No broadcast is forced: Spark broadcasts ``dim`` only below its size threshold.
    """
    names = dim.select(F.col(dim_key).alias(key), F.col(dim_name).alias("__name"))
    other = F.lit(fallback) if fallback is not None else F.col(key).cast("string")
    return df.join(names, key, "left").withColumn(out, F.coalesce("__name", other)).drop("__name")


def search_payments(payments: DataFrame, customers: DataFrame, projects: DataFrame, query: str) -> DataFrame:
    named = with_names(payments, customers, "customer_id", "customer_id", "name", "customer_name", "Customer")
    named = with_names(named, projects, "project_id", "project_id", "name", "project_name", "Project")
    return search(named, query, ["customer_name", "project_name", "receipt", "method"])


def search_documents(documents: DataFrame, projects: DataFrame, customers: DataFrame, query: str) -> DataFrame:
    named = with_names(documents, projects, "project_id", "project_id", "name", "project_name", "")
    named = with_names(named, customers, "customer_id", "customer_id", "name", "customer_name", "")
    return search(named, query, ["name", "reg_number", "project_name", "customer_name"], ["tags"])


def search_plots(plots: DataFrame, customers: DataFrame, brokers: DataFrame, query: str) -> DataFrame:
    """Plots found by their number or by the name of customer or broker.

    The customers that the query names are found first, so only plots that may be found travel to the customers' names.
    """
    named = with_names(plots, brokers, "broker_id", "broker_id", "name", "broker_name", "")
    order = ["broker_id", "customer_id", *[c for c in plots.columns if c not in ("broker_id", "customer_id")], "customer_name", "broker_name"]
    if query.strip():
        hits = cut(search(customers, query, ["name"]).select(F.col("customer_id").alias("__customer")).distinct())
        met = named.join(hits, F.col("customer_id") == F.col("__customer"), "left")
        named = met.filter(_found(query, ["plot_number", "broker_name"]) | F.col("__customer").isNotNull()).drop("__customer")
    named = with_names(named, customers, "customer_id", "customer_id", "name", "customer_name", "")
    return search(named, query, ["plot_number", "customer_name", "broker_name"]).select(order)


def facet(
    df: DataFrame, status: str = ALL, city: str = ALL, kind: str = ALL, facing: str = ALL, corner: str = ALL,
    category: str = ALL,
) -> DataFrame:
    """Facet filters; ``ALL`` leaves a facet open and 'Upcoming' also takes 'Planning'."""
    if status == "Upcoming":
        df = df.filter(F.col("status").isin("Upcoming", "Planning"))
    elif status != ALL:
        df = df.filter(F.lower("status") == status.lower())
    if city != ALL:
        df = df.filter(F.contains(F.lower("location"), F.lit(city.lower())))
    if kind != ALL:
        df = df.filter(F.lower("type") == kind.lower())
    if facing != ALL:
        df = df.filter(F.col("facing") == facing)
    if corner == "CORNER":
        df = df.filter("is_corner")
    elif corner == "REGULAR":
        df = df.filter(~F.col("is_corner"))
    if category != ALL:
        df = df.filter((F.col("category") == category) | (F.col("type") == category))
    return df


def payment_totals(payments: DataFrame) -> DataFrame:
    done = F.col("status") == "Completed"
    return payments.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("n_completed"),
        money_sum("amount").alias("total"), money_sum("amount", done).alias("completed"),
        money_sum("amount", ~done).alias("pending"),
    )


def payment_breakdown(payments: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Amount and count by state; with ``as_of``, pending payments past due count as Overdue."""
    state = F.col("status")
    if as_of is not None:
        state = F.when((state == "Pending") & (F.col("due_date") < as_of), "Overdue").otherwise(state)
    return payments.groupBy(state.alias("status")).agg(money_sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))


def monthly_revenue(payments: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Completed revenue by month, with target and attainment when targets are given."""
    month = F.date_format("paid_date", "yyyy-MM")
    out = payments.filter((F.col("status") == "Completed") & F.col("paid_date").isNotNull()).groupBy(
        month.alias("month")
    ).agg(money_sum("amount").alias("revenue"), F.count(F.lit(1)).alias("plots_sold"))
    if targets is None:
        return out
    return out.join(targets, "month", "full_outer").select(
        "month", F.coalesce("revenue", F.lit(0.0)).alias("revenue"), F.coalesce("plots_sold", F.lit(0)).alias("plots_sold"),
        F.coalesce("target", F.lit(0.0)).alias("target"),
        floor_round(share(F.coalesce("revenue", F.lit(0.0)), F.coalesce("target", F.lit(0.0)))).alias("attained_pct"),
    )


def broker_performance(plots: DataFrame, brokers: DataFrame, payments: DataFrame | None = None) -> DataFrame:
    """Deals, sold revenue, commission, paid and pending of each broker in each project."""
    deals = plots.filter(F.col("broker_id").isNotNull()).groupBy("project_id", "broker_id").agg(
        F.count(F.lit(1)).alias("deals"), money_sum("base_price", F.col("status") == "SOLD").alias("revenue")
    )
    commission = floor_round(F.col("revenue") * F.col("commission_rate") / 100.0)
    out = deals.join(brokers.select("broker_id", F.col("name").alias("broker_name"), "commission_rate"), "broker_id")
    if payments is None:
        paid = out.withColumn("paid", F.lit(0.0))
    else:
        sums = payments.filter(F.col("status") == "Completed").groupBy("project_id", "broker_id").agg(
            money_sum("amount").alias("paid")
        )
        paid = out.join(sums, ["project_id", "broker_id"], "left").withColumn("paid", F.coalesce("paid", F.lit(0.0)))
    return paid.select(
        "project_id", "broker_id", "broker_name", "deals", "revenue", commission.alias("commission"), "paid",
        F.greatest(floor_round(commission - F.col("paid")), F.lit(0.0)).alias("pending"),
    )


def broker_leaderboard(performance: DataFrame, n: int) -> DataFrame:
    """The ``n`` brokers with most deals over all projects."""
    totals = performance.groupBy("broker_id", "broker_name").agg(
        F.sum("deals").alias("deals"), money_sum("revenue").alias("revenue")
    )
    best = totals.orderBy(F.desc("deals"), "broker_id").limit(n)
    packed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("deals")).alias("o"), "broker_id", "broker_name", "deals", "revenue"))).alias("a"))
    return packed.select(F.posexplode("a").alias("pos", "b")).select(
        (F.col("pos") + 1).cast("long").alias("rank"), "b.broker_id", "b.broker_name", "b.deals", "b.revenue"
    )


def project_members(plots: DataFrame, people: DataFrame, key: str) -> DataFrame:
    """(project, person) pairs where the person holds at least one plot of the project."""
    pairs = plots.filter(F.col(key).isNotNull()).select("project_id", key).distinct()
    return pairs.join(people, key)


def holders(people: DataFrame, plots: DataFrame, key: str) -> DataFrame:
    """People who hold a plot anywhere."""
    return people.join(plots.select(key), key, "left_semi")


def customer_ledger(plots: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """Value held, paid and outstanding per customer and project, for customers with a plot there."""
    held = plots.filter(F.col("customer_id").isNotNull()).groupBy("project_id", "customer_id").agg(
        F.count(F.lit(1)).alias("plots"), money_sum("base_price").alias("value")
    )
    done = F.col("status") == "Completed"
    sums = payments.groupBy("project_id", "customer_id").agg(
        money_sum("amount", done).alias("paid"), money_sum("amount", ~done).alias("outstanding")
    )
    return (
        held.join(customers.select("customer_id", F.col("name").alias("customer_name")), "customer_id")
        .join(sums, ["project_id", "customer_id"], "left")
        .select(
            "project_id", "customer_id", "customer_name", "plots", "value",
            F.coalesce("paid", F.lit(0.0)).alias("paid"), F.coalesce("outstanding", F.lit(0.0)).alias("outstanding"),
        )
    )


def match_customer(plots: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer of a plot: by id, else the first who lists the plot number among the assigned plots."""
    by_id = customers.select(F.col("customer_id"), F.col("name").alias("__by_id"))
    listed = (
        customers.select("customer_id", "name", F.explode("assigned_plots").alias("p"))
        .groupBy(F.upper("p").alias("__no")).agg(F.min(F.struct("customer_id", "name")).alias("__by_no"))
    )
    return (
        plots.join(by_id, "customer_id", "left")
        .join(listed, F.upper("plot_number") == F.col("__no"), "left")
        .select(
            *plots.columns,
            F.coalesce(F.when(F.col("__by_id").isNotNull(), F.col("customer_id")), "__by_no.customer_id").alias("matched_id"),
            F.coalesce("__by_id", "__by_no.name").alias("matched_name"),
        )
    )


def resolve_customers(requests: DataFrame, customers: DataFrame) -> DataFrame:
    """Existing customer by case-insensitive name, or one new customer per unseen name."""
    key = lambda c: F.lower(F.trim(c))
    known = customers.groupBy(key("name").alias("__k")).agg(F.min("customer_id").alias("customer_id"))
    asked = requests.withColumn("__k", key("customer_name"))
    return asked.join(known, "__k", "left").withColumn("is_new", F.col("customer_id").isNull()).withColumn(
        "customer_id", F.coalesce(F.col("customer_id").cast("string"), F.sha2("__k", 256))
    ).drop("__k")


def new_customers(resolved: DataFrame) -> DataFrame:
    """Customers that ``resolve_customers`` had to make, one row each: id, name as first written in order, number of requests."""
    return resolved.filter("is_new").groupBy("customer_id").agg(F.min(F.trim("customer_name")).alias("name"), F.count(F.lit(1)).alias("requests"))


def customer_directory(customers: DataFrame) -> DataFrame:
    return customers.agg(
        F.count(F.lit(1)).alias("customers"), money_sum("total_invested").alias("invested"),
        F.coalesce(F.sum(F.when(F.col("assigned_plots").isNotNull(), F.size("assigned_plots"))), F.lit(0)).alias("assigned"),
    )


def broker_directory(brokers: DataFrame) -> DataFrame:
    return brokers.agg(
        F.count(F.lit(1)).alias("brokers"), F.coalesce(F.sum("total_deals"), F.lit(0)).alias("deals"),
        money_sum("total_earned").alias("earned"), money_sum("pending_payout").alias("pending"),
    )


def document_counts(documents: DataFrame) -> DataFrame:
    settled = F.lower("status").isin("verified", "approved", "signed")
    return documents.groupBy("project_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if(settled).alias("settled"))


def clean_payments(payments: DataFrame) -> DataFrame:
    """Defaults and checks of payment records; ``error`` is null for good rows."""
    amount = F.col("amount").try_cast("double")
    return payments.withColumn(
        "error", F.when(F.col("customer_id").isNull(), "customer required").when(amount.isNull() | (amount <= 0), "amount must be positive")
    ).withColumn("status", F.coalesce("status", F.lit("Pending"))).withColumn(
        "paid_date", F.when(F.col("status") == "Completed", F.coalesce("paid_date", "due_date"))
    )


def clean_documents(documents: DataFrame) -> DataFrame:
    return documents.withColumn(
        "error", F.when(T.blank_to_null("name").isNull(), "title required")
    ).withColumn("name", F.trim("name")).withColumn("tags", T.split_tags(F.coalesce("tags_text", F.lit(""))))


def sort_projects(df: DataFrame, by: str) -> DataFrame:
    epoch = F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp"))
    order = {
        "newest": [epoch.desc(), F.asc("project_id")],
        "oldest": [epoch.asc(), F.asc("project_id")],
        "revenue": [F.coalesce("revenue", F.lit(0.0)).desc(), F.asc("project_id")],
        "alphabetical": [F.lower(F.coalesce("name", F.lit(""))).asc(), F.asc("project_id")],
    }
    return df.orderBy(*order[by])


def natural_key(col) -> list[Column]:
    """Sort key with A-2 before A-10: prefix, number, rest."""
    text = F.lower(col)
    return [
        F.regexp_extract(text, r"^(\D*)", 1),
        F.nullif(F.regexp_extract(text, r"^\D*(\d+)", 1), F.lit("")).cast("decimal(38,0)"),
        F.regexp_extract(text, r"^\D*\d+(.*)$", 1),
    ]


def sort_plots(df: DataFrame, by: str) -> DataFrame:
    natural = natural_key("plot_number")
    order = {
        "plotNo_asc": [k.asc_nulls_first() for k in natural],
        "plotNo_desc": [k.desc_nulls_last() for k in natural],
        "area_desc": [F.coalesce("area_sqft", F.lit(0.0)).desc()],
        "area_asc": [F.coalesce("area_sqft", F.lit(0.0)).asc()],
        "price_desc": [F.coalesce("base_price", F.lit(0.0)).desc()],
        "price_asc": [F.coalesce("base_price", F.lit(0.0)).asc()],
    }
    return df.orderBy(*order[by], F.asc("plot_id"))


def head_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def paginate(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """Page of an ordered list: only the leading rows up to the page are kept while sorting."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def with_seq(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, prefix: str, width: int, name: str = "seq_id") -> DataFrame:
    """Sequential labels per group, e.g. plot-001."""
    seq = numbered(df, keys, order, bucket, "__seq")
    text = F.col("__seq").cast("string")
    label = F.concat(F.lit(prefix), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))
    return seq.withColumn(name, label).drop("__seq")
