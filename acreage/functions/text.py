"""Text of plan labels, names, tags and money as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acreage.functions.rings import _c, floor_round, let

# fixed values: label patterns
NOISE_HEAD = r"^[|_~^{}\\`\-]+"
NOISE_TAIL = r"[|_~^{}\\`\-]+$"
DIMENSION = (
    r"(?i)(\d+(?:\.\d+)?)\s*(?:'|ft|feet|m|mtr|meters)?(?:\s*[-–]?\s*(\d+(?:\.\d+)?)(?:\"|''|in)?)?"
    r"\s*x\s*(\d+(?:\.\d+)?)\s*(?:'|ft|feet|m|mtr|meters)?(?:\s*[-–]?\s*(\d+(?:\.\d+)?)(?:\"|''|in)?)?"
)
ROAD_WORDS = r"(?:ROAD|STREET|AVENUE|LANE)"
AREA = r"(\d+(?:\.\d+)?)\s*(?:SQ\.?\s*FT|SQFT|SQ\.?\s*M|SQM|SQUARE\s*FEET|ACRES|HECTARES|CENTS|GUNTHAS?)"
ROAD = (
    r"(\d+(?:\.\d+)?)\s*(?:'|FT|M|MTR|FEET|METERS)?\s*(?:WIDE|W)?\s*"
    r"(?:ROAD|STREET|AVENUE|LANE|R\.?O\.?W\.?|PATHWAY)"
)
PLOT = r"(?:PLOT\s*(?:NO\.?|#)?\s*|SITE\s*(?:NO\.?|#)?\s*|P\.?\s*NO\.?\s*|P\s*[-#]?\s*)(\d+[A-Za-z]?)"
BARE_NUMBER = r"^\d{1,4}[A-Za-z]?$"
GLOBAL_WORDS = r"NORTH|SURVEY|S\.NO|SY\.NO|KHASRA|VILLAGE|DISTRICT|TALUK|KEY PLAN"


def strip(col) -> Column:
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def blank_to_null(col) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(F.trim(_c(col)), F.lit(""))


def _digits(col: Column) -> Column:
    return F.translate(col, "OolI", "0011")


def sanitize_label(col) -> Column:
    """Repair common character confusions of scanned labels."""

    def token(t):
        zeros = F.when(t.rlike(r"^\d+[Oo0-9.,']+$"), F.translate(t, "Oo", "00")).otherwise(t)
        ones = let(zeros, lambda z: F.when(z.rlike(r"^\d+[lI0-9.,']+$"), F.translate(z, "lI", "11")).otherwise(z))
        dashed = r"^([A-Za-z]+-)([Oo0-9lI]+)$"
        return let(
            ones,
            lambda z: F.when(
                z.rlike(dashed),
                F.concat(F.regexp_extract(z, dashed, 1), _digits(F.regexp_extract(z, dashed, 2))),
            ).otherwise(z),
        )

    bare = F.regexp_replace(F.regexp_replace(strip(F.coalesce(_c(col), F.lit(""))), NOISE_HEAD, ""), NOISE_TAIL, "")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, token), " ")
    return strip(F.regexp_replace(joined, r"\s*[×*X]\s*", " x "))


def _number(col: Column) -> Column:
    return F.nullif(col, F.lit("")).try_cast("double")


def _any_in(text: Column, words: list[str]) -> Column:
    """Cheap test that spares a pattern the texts it cannot match."""
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def parse_dimension(clean) -> Column:
    """Width and length with feet-inches folded in; null when the label holds no ``w x l``.

    The pattern runs once over a text; its groups are read from what it found.
    """
    clean = _c(clean)
    upper = F.upper(clean)

    def build(g):
        width = g["w"] + F.coalesce(g["wi"], F.lit(0.0)) / 12.0
        length = g["l"] + F.coalesce(g["li"], F.lit(0.0)) / 12.0
        return F.struct(
            floor_round(width).alias("width"), floor_round(length).alias("length"),
            F.when(upper.contains("M"), "m").otherwise("ft").alias("unit"),
            floor_round(width * length).alias("areaApprox"),
        )

    def parts(found):
        names = enumerate(["w", "wi", "l", "li"], 1)
        return F.when(found != "", let(F.struct(*[_number(F.regexp_extract(found, DIMENSION, i)).alias(n) for i, n in names]), build))

    may = upper.contains("X") & ~upper.rlike(ROAD_WORDS)
    return F.when(may, let(F.regexp_extract(clean, DIMENSION, 0), parts))


def parse_area(clean) -> Column:
    upper = F.upper(_c(clean))
    unit = (
        F.when(upper.contains("SQ.M") | upper.contains("SQM"), "sqm")
        .when(upper.contains("ACRE"), "acres")
        .when(upper.contains("CENT"), "cents")
        .when(upper.contains("GUNTHA"), "guntha")
        .otherwise("sqft")
    )
    value = _number(F.when(_any_in(upper, ["SQ", "ACRES", "HECTARES", "CENTS", "GUNTHA"]), F.regexp_extract(upper, AREA, 1)))
    return F.when(value.isNotNull(), F.struct(value.alias("areaValue"), unit.alias("unit")))


def parse_road(clean) -> Column:
    upper = F.upper(_c(clean))
    width = _number(F.when(_any_in(upper, ["ROAD", "STREET", "AVENUE", "LANE", "PATHWAY", "OW", "O.W"]), F.regexp_extract(upper, ROAD, 1)))
    named = upper.contains("ROAD") | upper.contains("STREET") | upper.contains("AVENUE")
    unit = F.when(upper.contains("M") & ~upper.contains("SQ"), "m").otherwise("ft")
    return F.when(
        width.isNotNull() | named,
        F.struct(_c(clean).alias("roadName"), width.alias("roadWidth"), unit.alias("unit")),
    )


def parse_plot_no(clean) -> Column:
    clean = _c(clean)
    upper = F.upper(clean)
    marked = F.nullif(F.when(_any_in(upper, ["P", "SITE"]), F.regexp_extract(upper, PLOT, 1)), F.lit(""))
    number = F.coalesce(marked, F.when(clean.rlike(BARE_NUMBER), clean))
    return F.when(
        number.isNotNull(),
        F.struct(number.alias("plotNumber"), F.concat(F.lit("PLOT-"), number).alias("formattedLabel")),
    )


def classify_clean(clean, dimension, area, road, plot) -> Column:
    """Class of a cleaned label, given its four parses, first match wins."""
    clean = _c(clean)
    return (
        F.when(clean == "", "OTHER")
        .when(_c(dimension).isNotNull(), "DIMENSION")
        .when(_c(area).isNotNull(), "AREA")
        .when(_c(road).isNotNull(), "ROAD_LABEL")
        .when(_c(plot).isNotNull(), "PLOT_LABEL")
        .when(F.upper(clean).rlike(GLOBAL_WORDS), "BOUNDARY_OR_GLOBAL")
        .otherwise("GENERAL_TEXT")
    )


def normalize_text(col) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(_c(col).cast("string"), F.lit(""))), "[^a-z0-9]", "")


def split_tags(col) -> Column:
    """Comma-separated tags, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(_c(col), ","), lambda t: F.trim(t)), lambda t: t != "")


def city_of(col) -> Column:
    return F.trim(F.split_part(_c(col), F.lit(","), F.lit(1)))


def split_notes(col) -> Column:
    """Notes of the form ``dimensions, road name``."""
    parts = F.split(_c(col), ",")
    rest = F.trim(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ","))
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("dimensions"), F.nullif(rest, F.lit("")).alias("roadName"))


def safe_file_name(col) -> Column:
    return F.regexp_replace(_c(col), r"[^a-zA-Z0-9._-]", "_")


def extension(col) -> Column:
    """Lower-case suffix without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(_c(col), r"\.([^./\\]+)$", 1))


def fixed_text(col, digits: int) -> Column:
    """Decimal text of a value rounded half-up, the same in every engine."""
    scaled = floor_round(col, digits).cast(f"decimal(28,{digits})")
    return scaled.cast("string")


def format_inr(col) -> Column:
    """Rupee text in crore, lakh or thousand."""
    v = F.coalesce(_c(col).cast("double"), F.lit(0.0))
    return (
        F.when(v >= 10000000, F.concat(F.lit("₹"), fixed_text(v / 10000000, 2), F.lit(" Cr")))
        .when(v >= 100000, F.concat(F.lit("₹"), fixed_text(v / 100000, 2), F.lit(" L")))
        .when(v >= 1000, F.concat(F.lit("₹"), fixed_text(v / 1000, 1), F.lit(" K")))
        .otherwise(F.concat(F.lit("₹"), F.floor(v + 0.5).cast("string")))
    )


def price_range(low, high) -> Column:
    low, high = _c(low), _c(high)
    text = F.concat(
        F.lit("₹"), F.format_number(F.floor(low), 0), F.lit(" – ₹"), F.format_number(F.floor(high), 0)
    )
    return F.when((low != 0) & (high != 0), text).otherwise(F.lit("Price on request"))


def rgb_hex(r, g, b) -> Column:
    """``#rrggbb`` of colour parts in 0–1."""

    def part(v):
        return F.least(F.greatest((_c(v) * 255).cast("int"), F.lit(0)), F.lit(255))

    return F.format_string("#%02x%02x%02x", part(r), part(g), part(b))


def status_label(col) -> Column:
    """Display name of a plot state; BOOKED keeps its own name."""
    s = F.upper(F.coalesce(_c(col), F.lit("AVAILABLE")))
    return (
        F.when(s == "RESERVED", "Reserved").when(s == "SOLD", "Sold").when(s == "BLOCKED", "Blocked")
        .when(s == "BOOKED", "Booked").otherwise("Available")
    )


def word_set(col) -> Column:
    return F.array_distinct(F.transform(_c(col), lambda w: F.upper(F.trim(w))))
