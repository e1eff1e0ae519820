"""Vegetation indices and pixel classes. The families keep their own formulas; none stands for another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Default thresholds of the coverage indices.
THRESHOLDS = {"exg": 0.10, "exr": 0.0, "vari": 0.03}


def coverage_index(method: str, r: Column, g: Column, b: Column) -> Column:
    """On values from 0 to 1."""
    forms = {"exg": 2 * g - r - b, "exr": 1.4 * r - g, "vari": (g - r) / (g + r - b + EPS)}
    if method.lower() not in forms:
        raise ValueError(f"unknown index {method!r}")
    return forms[method.lower()]


def detection_index(method: str, r: Column, g: Column, b: Column) -> Column:
    """On values from 0 to 255: chromatic ExG and ExR, clamped VARI."""
    total = r + g + b
    share = lambda x: F.when(total == 0, F.lit(0.0)).otherwise(x / total)
    den = g + r - b
    forms = {
        "exg": 2 * share(g) - share(r) - share(b),
        "exr": share(g) - 1.4 * share(r),
        "vari": F.when(F.abs(den) < 1, F.lit(0.0)).otherwise(F.least(F.greatest((g - r) / den, F.lit(-1.0)), F.lit(1.0))),
    }
    if method.lower() not in forms:
        raise ValueError(f"unknown index {method!r}")
    return forms[method.lower()]


def masked(index: Column, threshold: float) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold outside 0 to 1")
    return index > threshold


def is_vegetation(r: Column, g: Column, b: Column) -> Column:
    """Excess green on 0 to 255, strictly above 20."""
    return 2 * g - r - b > 20


def coverage_class(pct: Column, low: float = 30.0, medium: float = 60.0) -> Column:
    if not 0 <= low <= medium <= 100:
        raise ValueError("thresholds must rise within 0 to 100")
    return F.when(pct <= low, "low").when(pct <= medium, "medium").otherwise("high")


def hsl(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue in degrees, saturation and lightness of values from 0 to 1."""
    top, bottom = F.greatest(r, g, b), F.least(r, g, b)
    delta, light = top - bottom, (top + bottom) / 2
    sat = F.when(delta < EPS, 0.0).otherwise(delta / F.when(light <= 0.5, top + bottom + EPS).otherwise(2.0 - top - bottom + EPS))
    hue = F.when(delta < EPS, 0.0).when(top == r, 60.0 * ((g - b) / delta)).when(top == g, 60.0 * ((b - r) / delta + 2.0)).otherwise(60.0 * ((r - g) / delta + 4.0))
    return {"hue": F.pmod(hue, F.lit(360.0)), "saturation": sat, "lightness": light}


def vari(r: Column, g: Column, b: Column) -> Column:
    """VARI of the condition family: denominator floored, result clamped."""
    den = g + r - b
    safe = F.when(F.abs(den) < EPS, F.lit(EPS)).otherwise(den)
    return F.least(F.greatest((g - r) / safe, F.lit(-1.0)), F.lit(1.0))


def rbvi(r: Column, b: Column) -> Column:
    return (r - b) / (r + b + EPS)


def is_canopy(r: Column, g: Column, b: Column, exg: float = 0.05, darkest: float = 0.08, brightest: float = 0.92) -> Column:
    total = r + g + b + EPS
    return ((2 * g - r - b) / total > exg) & (g > r) & (total / 3 > darkest) & (total / 3 < brightest)


def condition(index: Column, canopy: Column, vigorous: float = 0.15, moderate: float = 0.05) -> Column:
    """3 vigorous, 2 moderate, 1 severe, 0 off the canopy."""
    return F.when(~canopy, 0).when(index >= vigorous, 3).when(index >= moderate, 2).otherwise(1)


def is_yellowing(r: Column, g: Column, b: Column, canopy: Column, hue_min: float = 50.0, hue_max: float = 75.0, sat_min: float = 0.20) -> Column:
    x = hsl(r, g, b)
    return canopy & x["hue"].between(hue_min, hue_max) & (x["saturation"] > sat_min)


def is_browning(r: Column, g: Column, b: Column, canopy: Column, min_rbvi: float = 0.15, ratio: float = 0.90) -> Column:
    return canopy & (rbvi(r, b) > min_rbvi) & (r > ratio * g)


def dominant(vigorous: Column, moderate: Column, severe: Column) -> Column:
    """Ties go to the healthier class; none without pixels."""
    return F.when(vigorous + moderate + severe == 0, "none").when((vigorous >= moderate) & (vigorous >= severe), "vigorous").when(moderate >= severe, "moderate").otherwise("severe")


def dominant_of_cell(vigorous: Column, moderate: Column, severe: Column) -> Column:
    """Ties go to the less healthy class, unlike in a whole image."""
    return F.when((severe >= moderate) & (severe >= vigorous), "severe").when(moderate >= vigorous, "moderate").otherwise("vigorous")


def overlay(channel: Column, mask: Column, tint: float, alpha: float = 0.4) -> Column:
    """A channel blended with a tint where the mask holds."""
    return F.when(mask, ((1 - alpha) * channel + alpha * tint).cast("int")).otherwise(channel.cast("int"))
