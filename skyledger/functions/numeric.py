"""Rounding, ground resolution and small numeric rules, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METERS_PER_DEGREE = 111320.0


def half_even(x: Column, digits: int = 2) -> Column:
    """Rounds ties to the even digit, on binary doubles."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def half_away(x: Column, digits: int = 6) -> Column:
    """Rounds ties away from zero, on binary doubles."""
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def valid_coverage(x: Column) -> Column:
    return finite(x) & x.between(0, 100)


def checked(value: Column, valid: Column, message: str) -> Column:
    """``value``, or an error where it is not valid."""
    return F.when(F.coalesce(valid, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def gsd_focal(altitude: Column, focal35: Column, width: Column, height: Column) -> Column:
    """Metres a pixel from altitude and 35 mm focal length (43.27 mm diagonal); null unless all are positive."""
    ok = (altitude > 0) & (focal35 > 0) & (width > 0) & (height > 0)
    return F.when(ok, altitude * 43.27 / (focal35 * F.hypot(width.cast("double"), height.cast("double"))))


def gsd_fov(altitude: Column, hfov_deg: Column, width: Column) -> Column:
    """Metres a pixel from altitude and the horizontal field of view, 1 <= fov < 179."""
    ok = (altitude > 0) & (hfov_deg >= 1) & (hfov_deg < 179) & (width > 0)
    return F.when(ok, 2 * altitude * F.tan(F.radians(hfov_deg) / 2) / width)


def gsd(explicit: Column, altitude: Column, focal35: Column, width: Column, height: Column, hfov: float = 60.0) -> Column:
    """The given value, else from the focal length, else from an assumed field of view."""
    return F.coalesce(F.when(explicit > 0, explicit), gsd_focal(altitude, focal35, width, height), gsd_fov(altitude, F.lit(hfov), width))


def gsd_sensor(altitude: Column, sensor_mm: Column, focal_mm: Column, width: Column) -> Column:
    return altitude * sensor_mm / (focal_mm * width)


def area_from_pixels(pixels: Column, gsd_m: Column) -> Column:
    return F.when(gsd_m > 0, pixels * gsd_m * gsd_m)


def rational(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def dms(degrees: Column, minutes: Column, seconds: Column) -> Column:
    return F.abs(degrees) + F.abs(minutes) / 60 + F.abs(seconds) / 3600


def dms_lenient(num: Column, den: Column) -> Column:
    """Array rationals to degrees, denominators floored at 1."""
    part = lambda k: F.get(num, F.lit(k)) / F.greatest(F.get(den, F.lit(k)), F.lit(1))
    return part(0) + part(1) / 60 + part(2) / 3600


def hemisphere(value: Column, ref: Column) -> Column:
    r = F.upper(F.trim(ref))
    return F.when(r.isin("S", "W"), -F.abs(value)).when(r.isin("N", "E"), F.abs(value))


def signed_altitude(value: Column, ref: Column) -> Column:
    return F.when(ref == 1, -value).otherwise(value)


def gps_pair(lat: Column, lon: Column) -> Column:
    """struct<lat, lon>; both null outside the ranges and at exactly (0, 0)."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.struct(F.when(ok, lat).alias("lat"), F.when(ok, lon).alias("lon"))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes with x_min, y_min, x_max, y_max; 0 if disjoint."""
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    area = lambda x: (x["x_max"] - x["x_min"]) * (x["y_max"] - x["y_min"])
    return F.when((w > 0) & (h > 0), w * h / (area(a) + area(b) - w * h)).otherwise(F.lit(0.0))


def detector_scale(gsd_cm: Column) -> Column:
    return F.least(F.greatest(gsd_cm / 10, F.lit(0.1)), F.lit(4.0))


def stretch_8bit(v: Column, lo: Column, hi: Column, full_range: Column) -> Column:
    """16 to 8 bits: linear between two percentiles, or over the whole range."""
    plain = F.when(hi > lo, (v - lo) * 255.0 / (hi - lo)).otherwise(F.lit(0.0))
    return F.floor(F.least(F.greatest(F.when(full_range, v * 255.0 / 65535.0).otherwise(plain), F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")


def aspect_mismatch(south: Column, west: Column, north: Column, east: Column, width: Column, height: Column) -> Column:
    """How far the ground aspect ratio is from that of the pixels."""
    ground = (east - west) * F.cos(F.radians((south + north) / 2)) / (north - south)
    return F.abs(ground / (width / height) - 1)


def magnitude_level(x: Column) -> Column:
    """Level of a change: from 15 high, from 5 medium."""
    return F.when(x >= 15, "tinggi").when(x >= 5, "sedang").otherwise("rendah")


def direction(change: Column) -> Column:
    return F.when(change > 0, "bertambah").when(change < 0, "berkurang").otherwise("tetap")
