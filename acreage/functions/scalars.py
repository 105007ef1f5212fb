"""Dates, units, money arithmetic, calibration and projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from acreage import constants as K
from acreage.functions import rings as R
from acreage.functions.rings import _c, floor_round, let


def parse_ts(col, fallback) -> Column:
    """ISO-8601 text, ``Z`` accepted; ``fallback`` when absent or unreadable."""
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(_c(col), "Z$", "+00:00")), _c(fallback))


def parse_day(col) -> Column:
    return F.try_to_date(_c(col), "yyyy-MM-dd")


def format_day(col) -> Column:
    return F.coalesce(F.date_format(_c(col), "MMM d, yyyy"), F.lit("N/A"))


def clamp(col, low, high) -> Column:
    return F.least(F.greatest(_c(col), F.lit(float(low))), F.lit(float(high)))


def share(part, whole, times: float = 100.0) -> Column:
    """``part / whole × times``; 0 when the whole is 0."""
    return F.coalesce(_c(part) * times / F.nullif(_c(whole).cast("double"), F.lit(0.0)), F.lit(0.0))


def to_sqft(value, unit) -> Column:
    """Area in square feet for a stated unit; unknown units are taken as square feet."""
    u = F.lower(F.trim(_c(unit)))
    return _c(value) * (
        F.when(u.contains("acre"), K.ACRE_TO_SQFT)
        .when(u.contains("guntha"), K.GUNTHA_TO_SQFT)
        .when(u.contains("hectare"), K.HECTARE_TO_SQFT_CALIBRATION)
        .when(u.contains("sqm") | u.contains("meter"), K.SQM_TO_SQFT_CALIBRATION)
        .otherwise(1.0)
    )


def estimated_gdv(gross_sqft, rate) -> Column:
    """Gross development value: saleable share of the land at the base rate."""
    return _c(gross_sqft) * K.SALEABLE_SHARE * _c(rate)


def _scale(px_per_ft: Column, px_per_m: Column, method: str) -> Column:
    return F.struct(
        F.lit(True).alias("isCalibrated"), F.lit(method).alias("method"),
        floor_round(px_per_ft, 4).alias("pixelsPerFoot"), floor_round(px_per_m, 4).alias("pixelsPerMeter"),
        floor_round(1.0 / F.greatest(px_per_ft, F.lit(1e-6)), 4).alias("feetPerPixel"),
        floor_round(1.0 / F.greatest(px_per_m, F.lit(1e-6)), 4).alias("metersPerPixel"),
    )


def _proportional() -> Column:
    one = F.lit(1.0)
    return F.struct(
        F.lit(False).alias("isCalibrated"), F.lit("PROPORTIONAL_FALLBACK").alias("method"),
        one.alias("pixelsPerFoot"), F.lit(K.FEET_PER_METER_CALIBRATION).alias("pixelsPerMeter"),
        one.alias("feetPerPixel"), F.lit(0.3048).alias("metersPerPixel"),
    )


def calibrate_two_point(x1, y1, x2, y2, distance, unit) -> Column:
    pixels = F.hypot(_c(x2) - _c(x1), _c(y2) - _c(y1))
    ratio = pixels / F.nullif(_c(distance), F.lit(0.0))
    metric = F.upper(_c(unit)).isin("METERS", "METER", "M")
    ft = F.when(metric, ratio / K.FEET_PER_METER_CALIBRATION).otherwise(ratio)
    m = F.when(metric, ratio).otherwise(ratio * K.FEET_PER_METER_CALIBRATION)
    return F.when((_c(distance) > 0) & (pixels >= 1.0), _scale(ft, m, "TWO_POINT")).otherwise(_proportional())


def calibrate_area(pixel_area, gross, unit) -> Column:
    density = to_sqft(gross, unit) / F.nullif(_c(pixel_area), F.lit(0.0))
    px_per_ft = 1.0 / F.greatest(F.sqrt(F.greatest(density, F.lit(1e-6))), F.lit(1e-6))
    usable = (_c(pixel_area) > 100.0) & (_c(gross) > 0)
    return F.when(
        usable, _scale(px_per_ft, px_per_ft * K.FEET_PER_METER_CALIBRATION, "GROSS_AREA")
    ).otherwise(_proportional())


def geo_to_cad(ring) -> Column:
    """Lat/lng ring (x = lng, y = lat) to local feet, offset 20, with area, perimeter and extents."""

    def centre(r):
        return F.struct(
            r.alias("r"),
            (F.aggregate(r, F.lit(0.0), lambda a, p: a + p["y"]) / F.size(r)).alias("lat"),
            (F.aggregate(r, F.lit(0.0), lambda a, p: a + p["x"]) / F.size(r)).alias("lng"),
        )

    def metres(c):
        cos_lat = F.cos(F.radians(c["lat"]))
        local = F.transform(
            c["r"],
            lambda p: R.point(
                (p["x"] - c["lng"]) * K.METERS_PER_DEGREE_LAT * F.cos(F.radians(c["lat"])),
                (p["y"] - c["lat"]) * K.METERS_PER_DEGREE_LAT,
            ),
        )
        return F.struct(local.alias("m"), c["lat"].alias("lat"), c["lng"].alias("lng"), cos_lat.alias("cosLat"))

    def measure(v):
        return F.struct(
            *[v[k].alias(k) for k in ("m", "lat", "lng", "cosLat")],
            R.ring_area(v["m"]).alias("sqm"), R.ring_length(v["m"]).alias("metres"),
            R.bbox(F.transform(v["m"], lambda p: R.point(p["x"] * K.M_TO_FT, p["y"] * K.M_TO_FT))).alias("b"),
        )

    def build(v):
        b = v["b"]
        ring_ft = F.transform(
            v["m"],
            lambda p: R.point(
                floor_round(p["x"] * K.M_TO_FT - b["minX"] + 20, 1), floor_round(p["y"] * K.M_TO_FT - b["minY"] + 20, 1)
            ),
        )
        whole = lambda c: F.floor(c + 0.5).cast("double")
        return F.struct(
            ring_ft.alias("ring"), v["lat"].alias("refLat"), v["lng"].alias("refLng"), v["cosLat"].alias("cosLat"),
            b["minX"].alias("minX"), b["minY"].alias("minY"),
            whole(v["sqm"]).alias("areaSqm"), whole(v["sqm"] * K.SQM_TO_SQFT).alias("areaSqft"),
            whole(v["metres"]).alias("perimeterM"), whole(v["metres"] * K.M_TO_FT).alias("perimeterFt"),
            F.greatest(F.lit(50.0), whole(b["maxX"] - b["minX"])).alias("lengthFt"),
            F.greatest(F.lit(50.0), whole(b["maxY"] - b["minY"])).alias("breadthFt"),
        )

    return F.when(F.size(_c(ring)) >= 3, let(let(let(let(R.opened(ring), centre), metres), measure), build))


def cad_to_geo(ring, ref) -> Column:
    """Local feet back to lat/lng, given the reference struct made by ``geo_to_cad``."""
    ref = _c(ref)
    return F.transform(
        _c(ring),
        lambda p: R.point(
            ref["refLng"]
            + ((p["x"] - 20 + ref["minX"]) / K.M_TO_FT) / (K.METERS_PER_DEGREE_LAT * ref["cosLat"]),
            ref["refLat"] + ((p["y"] - 20 + ref["minY"]) / K.M_TO_FT) / K.METERS_PER_DEGREE_LAT,
        ),
    )


def orientation(w, h) -> Column:
    return F.when(_c(h) >= _c(w), "NORTH").otherwise("EAST")


def aspect_ratio(w, h) -> Column:
    return F.coalesce(floor_round(_c(w) / F.nullif(_c(h), F.lit(0.0))), F.lit(1.0))


def stable_plot_id(x, y, area) -> Column:
    """Same plot, same id: a hash of the rounded centroid and area."""
    seed = F.concat_ws(
        "-", floor_round(x, 1).cast("string"), floor_round(y, 1).cast("string"), floor_round(area, 0).cast("string")
    )
    return F.sha2(seed, 256)


def facing4(x, y, cx, cy) -> Column:
    """Quarter in which a centroid lies, seen from the extent centre (y grows northward)."""
    angle = F.degrees(F.atan2(_c(y) - _c(cy), _c(x) - _c(cx)))
    return (
        F.when((angle >= -45) & (angle < 45), "EAST").when((angle >= 45) & (angle < 135), "NORTH")
        .when((angle >= -135) & (angle < -45), "SOUTH").otherwise("WEST")
    )


def circle_ring(x, y, radius, sides: int = 16) -> Column:
    """Regular polygon standing for a circle."""
    step = 6.283185307179586 / sides
    return F.transform(
        F.sequence(F.lit(0), F.lit(sides - 1)),
        lambda i: R.point(_c(x) + _c(radius) * F.cos(i * step), _c(y) + _c(radius) * F.sin(i * step)),
    )


def booking_amounts(base_price, requested_total, booking_amount, paid_amount, payment_status=None) -> Column:
    """Total, paid, remaining and payment state of a booking command."""
    total = F.when(_c(base_price) > 0, _c(base_price)).otherwise(
        F.coalesce(F.nullif(_c(requested_total), F.lit(0)), F.lit(K.DEFAULT_BOOKING_TOTAL).cast("decimal(18,2)"))
    ).cast("decimal(18,2)")
    paid = F.coalesce(_c(paid_amount), _c(booking_amount)).cast("decimal(18,2)")
    remaining = F.greatest((total - paid).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    derived = F.when(remaining <= 0, "PAID").otherwise("PARTIAL")
    given = F.nullif(F.trim(_c(payment_status)), F.lit("")) if payment_status is not None else F.lit(None)
    return F.struct(
        total.alias("total"), paid.alias("paid"), remaining.alias("remaining"),
        F.upper(F.trim(F.coalesce(given.cast("string"), derived))).alias("payment_status"),
    )


def all_checked(checks) -> Column:
    """Every entry of a checklist map is true."""
    return F.forall(F.map_values(_c(checks)), lambda v: v)


def json_first(col, *paths: str) -> Column:
    """First non-null of several JSON paths."""
    return F.coalesce(*[F.get_json_object(_c(col), p) for p in paths])


def snap_to_grid(x, y, step: float) -> Column:
    return R.point(F.floor(_c(x) / step + 0.5) * step, F.floor(_c(y) / step + 0.5) * step)
