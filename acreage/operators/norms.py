"""Planning authorities, presets and the norms that apply to a parcel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acreage import constants as K
from acreage.functions.rings import floor_round
from acreage.functions.text import fixed_text

STATEWIDE = "IN_MH_UDCPR_STANDARD"

# fixed values: public planning authorities (id, short name, amenity threshold in hectares)
AUTHORITIES = [
    ("IN_MH_PMC", "PMC Pune", 0.4),
    ("IN_MH_PCMC", "PCMC", 0.4),
    ("IN_MH_BMC", "BMC Mumbai", 0.4),
    ("IN_MH_PMRDA", "PMRDA", 1.0),
    ("IN_MH_MMRDA", "MMRDA", 2.0),
    ("IN_MH_NMMC", "NMMC / CIDCO", 1.0),
    ("IN_MH_TMC", "TMC Thane", 0.4),
    ("IN_MH_NMC", "NMC Nagpur", 1.0),
    ("IN_MH_NASHIK", "NMC Nashik", 1.0),
    ("IN_MH_CSN", "AMC Sambhajinagar", 1.0),
    ("IN_MH_COUNCILS", "MH Municipal Councils", 2.0),
    ("IN_MH_NAGAR_PANCHAYAT", "Nagar Panchayats", 2.0),
    ("IN_MH_REGIONAL_PLAN", "Regional Plan / Collectorate", 2.0),
    (STATEWIDE, "UDCPR Standard", 2.0),
]


def authorities(spark: SparkSession) -> DataFrame:
    """The registry as a dimension: fourteen rows."""
    return spark.createDataFrame(AUTHORITIES, "id STRING, short_name STRING, amenity_threshold_ha DOUBLE")


def presets(auth: DataFrame) -> DataFrame:
    """Standing norms of each authority: the residential, non-congested case of one hectare."""
    base = auth.select(F.col("id").alias("parcel_id"), F.col("id").alias("jurisdiction_id"), F.lit(10000.0).alias("land_area_sqm"), F.lit("RESIDENTIAL").alias("land_use"), F.lit(False).alias("is_congested"))
    return applicable_norms(base, auth).drop("parcel_id")


def with_preset(requests: DataFrame, preset: DataFrame) -> DataFrame:
    """Preset of the asked authority, else the statewide one."""
    known = preset.select(F.col("jurisdiction_id").alias("__id")).withColumn("__known", F.lit(True))
    asked = requests.join(known, F.col("jurisdiction_id") == F.col("__id"), "left").withColumn(
        "preset_id", F.when(F.col("__known"), F.col("jurisdiction_id")).otherwise(STATEWIDE)
    ).drop("__id", "__known")
    return asked.join(preset.withColumnRenamed("jurisdiction_id", "preset_id"), "preset_id", "left")


def with_authority(parcels: DataFrame, auth: DataFrame) -> DataFrame:
    """Authority of each parcel by the registry handed in, the statewide one where it is not listed there."""
    facts = [F.col(c).alias(f"__{c}") for c in ("id", "short_name", "amenity_threshold_ha")]
    own, rest = auth.select(*facts), auth.filter(F.col("id") == STATEWIDE).select(*facts)
    found = parcels.join(own, F.col("jurisdiction_id") == F.col("__id"), "left").withColumn("__fallback", F.lit(STATEWIDE))
    default = rest.select(*[F.col(f"__{c}").alias(f"__state_{c}") for c in ("id", "short_name", "amenity_threshold_ha")])
    both = found.join(default, F.col("__fallback") == F.col("__state_id"), "left")
    either = [F.when(F.col("__id").isNotNull(), F.col(f"__{c}")).otherwise(F.col(f"__state_{c}")).alias(c) for c in ("short_name", "amenity_threshold_ha")]
    return both.select(*parcels.columns, F.coalesce("__id", "__fallback").alias("authority_id"), *either)


def _ladder(*steps) -> Column:
    *conds, default = steps
    out = None
    for cond, value in conds:
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(default))


def applicable_norms(parcels: DataFrame, auth: DataFrame) -> DataFrame:
    """Open space, amenity, utility, roads, setback and plot minima of every parcel, both units."""
    df = with_authority(parcels, auth).withColumn("area_sqm", F.greatest(F.lit(100.0), F.col("land_area_sqm").cast("double")))
    df = df.withColumn("area_ha", F.col("area_sqm") / K.HECTARE_TO_SQM)
    tight, ha = F.col("is_congested"), F.col("area_ha")
    use = F.upper("land_use")
    cheap = use.contains("AFFORDABLE") | use.contains("EWS")
    shop = use.contains("MIXED") | use.contains("COMMERCIAL")
    small = ha < 0.40
    # fixed values: the ladders of each norm
    rules = {
        "open_space_pct": _ladder((tight, 5.0), (small, 0.0), 10.0),
        "min_cluster_sqm": _ladder((tight, 200.0), (small, 0.0), (ha < 1.0, 400.0), 1000.0),
        "min_open_width_m": _ladder((tight, 6.0), (small, 0.0), (ha < 1.0, 7.5), 10.0),
        "amenity_pct": _ladder((tight, 0.0), (ha >= F.col("amenity_threshold_ha"), 5.0), 0.0),
        "utility_pct": _ladder((ha >= 0.40, 1.0), 0.5),
        "internal_road_m": _ladder((tight, 6.0), 9.0),
        "main_road_m": _ladder((tight, 9.0), 12.0),
        "setback_m": _ladder((tight, 1.5), 3.0),
        "min_plot_sqm": _ladder((cheap, 50.0), (shop, 150.0), (tight, 50.0), 100.0),
        "min_frontage_m": _ladder((cheap, 4.5), (shop, 9.0), (tight, 4.5), 6.0),
        "min_depth_m": _ladder((cheap, 10.0), (shop, 15.0), (tight, 10.0), 12.0),
    }
    df = df.select("*", *[c.alias(n) for n, c in rules.items()])
    threshold = fixed_text("amenity_threshold_ha", 1)
    notes = F.filter(
        F.array(
            F.when(tight, "Congested area: open space relaxed to 5%.").when(small, "Below 0.40 ha: no open space required.")
            .when(ha < 1.0, "0.40–1.0 ha: 10% open space, one cluster of 400 sqm.").otherwise("From 1.0 ha: 10% open space, one cluster of 1,000 sqm."),
            F.when(tight, "Congested area: amenity space exempted.")
            .when(ha >= F.col("amenity_threshold_ha"), F.concat(F.lit("From "), threshold, F.lit(" ha: 5% amenity space, "), F.col("short_name"), F.lit(".")))
            .otherwise(F.concat(F.lit("Below "), threshold, F.lit(" ha: amenity space exempted, "), F.col("short_name"), F.lit("."))),
            F.lit("Utility reservation is mandatory."),
        ),
        lambda n: n.isNotNull(),
    )
    part = lambda pct, factor=1.0: floor_round(F.col("area_sqm") * (F.col(pct) / 100.0) * factor)
    feet = lambda c: floor_round(F.col(c) * K.M_TO_FT)
    return df.select(
        "parcel_id", "jurisdiction_id", "authority_id", "is_congested", "land_use",
        floor_round("area_sqm").alias("land_area_sqm"), floor_round(F.col("area_sqm") * K.SQM_TO_SQFT).alias("land_area_sqft"),
        floor_round("area_ha", 3).alias("land_area_ha"),
        "open_space_pct", part("open_space_pct").alias("open_space_sqm"), part("open_space_pct", K.SQM_TO_SQFT).alias("open_space_sqft"),
        "min_cluster_sqm", "min_open_width_m",
        "amenity_pct", part("amenity_pct").alias("amenity_sqm"), part("amenity_pct", K.SQM_TO_SQFT).alias("amenity_sqft"),
        "utility_pct", part("utility_pct").alias("utility_sqm"), part("utility_pct", K.SQM_TO_SQFT).alias("utility_sqft"),
        "setback_m", feet("setback_m").alias("setback_ft"), "internal_road_m", feet("internal_road_m").alias("internal_road_ft"),
        "main_road_m", feet("main_road_m").alias("main_road_ft"),
        "min_plot_sqm", floor_round(F.col("min_plot_sqm") * K.SQM_TO_SQFT).alias("min_plot_sqft"),
        "min_frontage_m", feet("min_frontage_m").alias("min_frontage_ft"), "min_depth_m", feet("min_depth_m").alias("min_depth_ft"),
        notes.alias("notes"),
    )
