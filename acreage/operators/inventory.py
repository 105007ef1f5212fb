"""Plots and projects: counts, statistics, views, upsert, replacement, cascade."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acreage import constants as K
from acreage.functions import scalars as S
from acreage.functions import text as T
from acreage.functions.rings import _c, floor_round
from acreage.session import first_per_key, once

MONEY = "decimal(18,2)"


def money_sum(col, when: Column | None = None) -> Column:
    """Exact sum of money (order does not matter), as double."""
    value = F.coalesce(_c(col).cast(MONEY), F.lit(0).cast(MONEY))
    picked = value if when is None else F.when(when, value).otherwise(F.lit(0).cast(MONEY))
    return F.coalesce(F.sum(picked), F.lit(0)).cast("double")


def _count(state: str) -> Column:
    return F.count_if(F.col("status") == state)


def project_inventory(plots: DataFrame) -> DataFrame:
    """Counts by state and sold revenue of every project."""
    return plots.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_plots"),
        _count("SOLD").alias("sold_plots"),
        _count("AVAILABLE").alias("available_plots"),
        _count("RESERVED").alias("reserved_plots"),
        _count("BLOCKED").alias("blocked_plots"),
        _count("BOOKED").alias("booked_plots"),
        money_sum("base_price", F.col("status") == "SOLD").alias("revenue"),
    )


def project_stats(plots: DataFrame) -> DataFrame:
    """Area in both units, value, mean size, corners and sold revenue."""
    sqft = F.coalesce(F.col("area_sqft"), F.lit(0.0))
    sqm = F.coalesce(F.col("area_sqm"), sqft * K.SQFT_TO_SQM_DISPLAY) if "area_sqm" in plots.columns else (
        sqft * K.SQFT_TO_SQM_DISPLAY
    )
    exact = lambda c: F.sum(c.cast("decimal(28,6)"))
    return plots.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_plots"),
        exact(sqft).cast("double").alias("total_sqft"),
        exact(sqm).cast("double").alias("total_sqm"),
        money_sum("base_price").alias("total_value"),
        floor_round(exact(sqft).cast("double") / F.count(F.lit(1))).alias("avg_sqft"),
        F.count_if("is_corner").alias("corner_plots"),
        money_sum("base_price", F.col("status") == "SOLD").alias("sold_revenue"),
    )


def portfolio_kpis(projects: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row over all projects."""
    wide = projects.join(inventory, "project_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return wide.agg(
        F.count(F.lit(1)).alias("projects"),
        F.count_if(F.lower("project_status") == "active").alias("active_projects"),
        total("total_plots").alias("plots"),
        total("sold_plots").alias("sold"),
        money_sum("revenue").alias("revenue"),
        floor_round(S.share(total("sold_plots"), total("total_plots"))).alias("occupancy_pct"),
    )


def sales_progress(projects: DataFrame, inventory: DataFrame) -> DataFrame:
    total, sold = F.coalesce("total_plots", F.lit(0)), F.coalesce("sold_plots", F.lit(0))
    return projects.join(inventory, "project_id", "left").select(
        "project_id", "name", total.alias("total_plots"), sold.alias("sold_plots"),
        F.greatest(total - sold, F.lit(0)).alias("remaining"),
        floor_round(S.share(sold, total)).alias("sold_pct"),
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
    )


def status_distribution(plots: DataFrame) -> DataFrame:
    """Rows per state with the share of the project total; the total comes from the grouped rows."""
    by_state = plots.groupBy("project_id", "status").agg(F.count(F.lit(1)).alias("n"))
    totals = by_state.groupBy("project_id").agg(F.sum("n").alias("__total"))
    return by_state.join(totals, "project_id").select(
        "project_id", "status", "n", floor_round(S.share(F.col("n"), F.col("__total"))).alias("share_pct")
    )


def facing_distribution(plots: DataFrame) -> DataFrame:
    return plots.groupBy("project_id", "facing").agg(
        F.count(F.lit(1)).alias("n"), money_sum("base_price", F.col("status") == "SOLD").alias("revenue")
    )


def distinct_cities(projects: DataFrame) -> DataFrame:
    return (
        projects.select(T.city_of("location").alias("city")).filter(F.coalesce("city", F.lit("")) != "")
        .distinct().orderBy("city")
    )


def distinct_facings(plots: DataFrame) -> DataFrame:
    return plots.filter(F.col("facing").isNotNull()).select("facing").distinct().orderBy("facing")


def project_wide(projects: DataFrame, one: Mapping[str, DataFrame], many: Mapping[str, DataFrame]) -> DataFrame:
    """Projects with one-to-one sides joined and one-to-many sides grouped first, so rows never multiply.

    A ``many`` side becomes a count; ``surveys`` also keeps its numbers as a sorted list.
    """
    wide = projects
    for side in one.values():
        wide = wide.join(side, "project_id", "left")
    for name, side in many.items():
        aggs = [F.count(F.lit(1)).alias(f"n_{name}")]
        if name == "surveys":
            aggs.append(F.sort_array(F.collect_set("survey_number")).alias("survey_numbers"))
        wide = wide.join(side.groupBy("project_id").agg(*aggs), "project_id", "left")
        wide = wide.withColumn(f"n_{name}", F.coalesce(F.col(f"n_{name}"), F.lit(0)))
    return wide


def project_summary(wide: DataFrame) -> DataFrame:
    """Display fields of a project with their defaults."""
    where = F.concat_ws(", ", "city_village", "district", "state")
    return wide.select(
        "project_id", "name",
        F.when(F.col("state").isNotNull(), where).otherwise("Maharashtra, India").alias("location"),
        T.price_range(F.coalesce("min_price", F.lit(0)), F.coalesce("max_price", F.lit(0))).alias("price_range"),
        F.coalesce(
            F.concat(F.col("gross_land_area").cast("string"), F.lit(" "), F.col("area_unit")), F.lit("Acres")
        ).alias("total_area"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.struct(
            F.coalesce("state", F.lit("")).alias("state"), F.coalesce("district", F.lit("")).alias("district"),
            F.coalesce("pincode", F.lit("")).alias("pincode"),
            F.coalesce("survey_numbers", F.array().cast("array<string>")).alias("surveyNumbers"),
            F.coalesce("rera_number", F.lit("")).alias("reraNo"),
            F.coalesce("approval_authority", F.lit("")).alias("approvingAuthority"),
        ).alias("location_details"),
        (F.coalesce("n_layout_sources", F.lit(0)) > 0).alias("layout_uploaded"),
    )


GEOJSON = (
    "type STRING, coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>, "
    "geometry STRUCT<type STRING, coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>>, "
    "properties STRUCT<plotNumber STRING, areaSqft DOUBLE, areaSqm DOUBLE, facing STRING, "
    "dimensions STRING, roadName STRING, isCorner BOOLEAN, confidence DOUBLE, corrected BOOLEAN>"
)


def parse_geojson(df: DataFrame, col: str = "polygon_geojson") -> DataFrame:
    """Adds ``geo``: geometry coordinates and properties, feature or bare geometry."""
    raw = F.from_json(F.col(col), GEOJSON)
    return df.withColumn("__geo", raw).withColumn(
        "geo",
        F.struct(
            F.coalesce("__geo.geometry.coordinates", "__geo.coordinates").alias("coordinates"),
            F.col("__geo.properties").alias("properties"),
        ),
    ).drop("__geo")


def with_price(df: DataFrame) -> DataFrame:
    """Price fallback chain and rate per square foot."""
    area = F.coalesce("area_sqft", F.lit(0.0))
    known = [F.col(c).cast("double") for c in ("base_price", "estimated_price", "price") if c in df.columns]
    price = F.coalesce(*known, F.when(area > 0, area * K.DEFAULT_RATE_PER_SQFT).otherwise(0.0))
    return df.withColumn("resolved_price", price).withColumn(
        "rate_per_sqft",
        F.when(area > 0, F.floor(F.col("resolved_price") / area + 0.5).cast("double")).otherwise(0.0),
    )


def plot_view(plots: DataFrame, active_bookings: DataFrame) -> DataFrame:
    """Plot with dimensions, road and corner from its feature, else its notes, else defaults."""
    # fixed values: display defaults of a plot
    notes = T.split_notes("notes")
    looks = notes["dimensions"].rlike("FT|×|x")
    parsed = with_price(parse_geojson(plots)).join(
        active_bookings.select("plot_id", "customer_name", "customer_phone"), "plot_id", "left"
    )
    props = F.col("geo.properties")
    return parsed.select(
        "plot_id", "project_id", "plot_number",
        F.coalesce("area_sqft", props["areaSqft"], F.lit(0.0)).alias("area_sqft"),
        F.upper(F.coalesce("facing", props["facing"], F.lit("NORTH"))).alias("facing"),
        F.coalesce(
            props["dimensions"], F.when(looks, notes["dimensions"]), F.lit("Standard 30×40 FT")
        ).alias("dimensions"),
        F.coalesce(props["roadName"], notes["roadName"], F.lit("Main Avenue (9.0M ROW)")).alias("road_name"),
        F.coalesce(props["isCorner"], F.lit(False)).alias("is_corner"),
        F.floor(F.col("resolved_price") + 0.5).cast("double").alias("price"),
        "rate_per_sqft", T.status_label("status").alias("status_label"), "customer_name", "customer_phone",
    )


def find_plot(plots: DataFrame, project_id, ref) -> DataFrame:
    """Plot by id or plot number within a project."""
    return plots.filter((F.col("project_id") == project_id) & ((F.col("plot_id") == ref) | (F.col("plot_number") == ref)))


def invalid_status(plots: DataFrame) -> DataFrame:
    return plots.filter(~F.upper(F.trim("status")).isin(*K.PLOT_STATES))


def editable(entities: DataFrame, layouts: DataFrame) -> DataFrame:
    """Entities of layouts that are not approved or locked."""
    frozen = layouts.filter(F.col("layout_status").isin("APPROVED", "LOCKED")).select("project_id", "layout_id")
    return entities.join(frozen, ["project_id", "layout_id"], "left_anti")


GEOMETRY_COLUMNS = ["polygon_geojson", "area_sqft", "facing", "centroid_x", "centroid_y", "layout_id"]


def upsert_plots(existing: DataFrame, incoming: DataFrame, update: list[str] | None = None) -> DataFrame:
    """Merge by (project, plot number): new geometry, old state; new rows start AVAILABLE.

    ``change`` says created, updated or kept. Repeated incoming rows: the last by ``ord`` wins.
    """
    update = update or [c for c in GEOMETRY_COLUMNS if c in incoming.columns]
    keys = ["project_id", "plot_number"]
    latest = first_per_key(incoming, keys, [F.col("ord").desc()]) if "ord" in incoming.columns else incoming
    new = latest.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in update], F.lit(True).alias("__in"))
    old = existing.withColumn("__old", F.lit(True))
    merged = old.join(new, keys, "full_outer")
    has_old, has_new = F.col("__old").isNotNull(), F.col("__in").isNotNull()
    cols = []
    for c in existing.columns:
        if c in keys:
            cols.append(F.col(c))
        elif c in update:
            cols.append(F.when(has_new, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "status":
            cols.append(F.when(has_old, F.col(c)).otherwise("AVAILABLE").alias(c))
        elif c == "plot_id":
            made = F.sha2(F.concat_ws("|", F.col("project_id").cast("string"), "plot_number"), 256)
            cols.append(F.when(has_old, F.col(c)).otherwise(made).alias(c))
        else:
            cols.append(F.col(c))
    change = F.when(has_old & has_new, "updated").when(has_old, "kept").otherwise("created")
    return merged.select(*cols, change.alias("change"))


def upsert_counts(merged: DataFrame) -> DataFrame:
    return merged.groupBy("project_id").agg(
        F.count_if(F.col("change") == "created").alias("created"),
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.count_if(F.col("change") != "kept").alias("persisted"),
    )


def select_variant(variants: DataFrame, choice: DataFrame) -> DataFrame:
    """Mark the chosen variant of each project that made a choice; siblings are cleared."""
    picked = choice.select("project_id", F.col("variant_id").alias("__chosen"))
    return variants.join(picked, "project_id", "left").withColumn(
        "is_selected",
        F.when(F.col("__chosen").isNotNull(), F.col("variant_id") == F.col("__chosen")).otherwise(F.col("is_selected")),
    ).drop("__chosen")


def selected_plots(variants: DataFrame) -> DataFrame:
    """Plots of the selected variants, ready for the inventory."""
    return variants.filter("is_selected").select("project_id", F.explode("plots").alias("p")).select("project_id", "p.*")


def drop_projects(tables: Mapping[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given projects; artifacts follow their jobs."""
    gone = ids.select("project_id").distinct()
    out: dict[str, DataFrame] = {}
    for name, df in tables.items():
        if "project_id" in df.columns:
            out[name] = df.join(gone, "project_id", "left_anti")
    if "artifacts" in tables and "project_id" not in tables["artifacts"].columns:
        dead = tables["jobs"].join(gone, "project_id", "left_semi").select("job_id")
        out["artifacts"] = tables["artifacts"].join(dead, "job_id", "left_anti")
    return out


def variant_summaries(variants: DataFrame) -> DataFrame:
    """Statistics and score out of the stored model, badge by fallback chain."""
    stats = "totalPlots INT, utilizationPercent DOUBLE, optionBadge STRING, compositeScore DOUBLE"
    model = F.from_json(
        "model_json", f"optionBadge STRING, statistics STRUCT<{stats}>, evaluation STRUCT<compositeScore DOUBLE, optionBadge STRING>"
    )
    return variants.withColumn("m", model).select(
        "project_id", "variant_id", "variant_number", "strategy",
        F.coalesce("m.statistics.totalPlots", "total_plots").alias("total_plots"),
        F.coalesce("m.evaluation.compositeScore", "m.statistics.compositeScore", F.lit(0.0)).alias("composite_score"),
        F.coalesce(
            "m.optionBadge", "m.statistics.optionBadge", "m.evaluation.optionBadge",
            F.concat(F.lit("OPTION "), F.col("variant_number").cast("string")),
        ).alias("option_badge"),
        "is_selected",
    ).orderBy("project_id", "variant_number")


def review_stats(plots: DataFrame) -> DataFrame:
    """Plots and hand-corrected labels per project, from feature properties."""
    return parse_geojson(plots).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("plots"),
        F.count_if(F.coalesce("geo.properties.corrected", F.lit(False))).alias("corrected_labels"),
    )


def resolve_location(projects: DataFrame, cities: list[tuple[str, float, float]]) -> DataFrame:
    """Own coordinates, else the first known city named in the text, else the first city of the list.

    ``cities`` (key, lat, lng) is a short fixed list, such as ``constants.KNOWN_CITIES``; it
    becomes a literal, so nothing is joined.
    """
    text_cols = [c for c in ("name", "location", "city_village", "district", "taluka", "state") if c in projects.columns]
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text_cols]))
    listed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(y)).alias("lat"), F.lit(float(x)).alias("lng")) for k, y, x in cities])
    own = F.coalesce("latitude", F.lit(0.0)), F.coalesce("longitude", F.lit(0.0))
    has_own = (own[0] != 0) & (own[1] != 0)
    named = F.get(F.filter(listed, lambda c: F.contains(haystack, c["key"])), F.lit(0))
    default = F.get(listed, F.lit(0))
    found = once(projects, __hit=named)
    hit = F.col("__hit")
    return found.select(
        *projects.columns,
        F.when(has_own, own[0]).otherwise(F.coalesce(hit["lat"], default["lat"])).alias("lat"),
        F.when(has_own, own[1]).otherwise(F.coalesce(hit["lng"], default["lng"])).alias("lng"),
        F.when(has_own, "project_coords").when(hit.isNotNull(), F.concat(F.lit("matched_"), hit["key"]))
        .otherwise(F.concat(F.lit("default_"), default["key"])).alias("source"),
    )
