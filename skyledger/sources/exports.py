"""Sinks: CSV of indicators, GeoJSON of plots and zones, JSON of a dashboard, an HTML report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, indices, text
from ..functions.numeric import half_away
from . import rasters


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def feature(rings: Column, **properties: Column) -> Column:
    """A GeoJSON feature as text; rings are closed."""
    shape = F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: geo.closed(r)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*(v.alias(k) for k, v in properties.items())).alias("properties"), shape.alias("geometry")))


def write_features(features: DataFrame, path: str, col: str = "feature", *order: str) -> None:
    """Features as GeoJSON lines, one in each line, so that no task or driver holds a collection."""
    (features.orderBy(*order) if order else features).select(col).write.mode("overwrite").text(path)


def feature_collection(features: DataFrame, limit: int = 10_000, col: str = "feature") -> str:
    """One document for a map view, of at most ``limit`` features; more are an error."""
    rows = [r[0] for r in features.select(col).limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"more than {limit} features: use write_features")
    return '{"type":"FeatureCollection","features":[' + ",".join(rows) + "]}"


def zone_features(zones: DataFrame, n: int, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells of a zonation with their ids, rings and rounded percentages."""
    x = lambda k: F.lit(west) + (east - west) * k / n
    y = lambda k: F.lit(north) - (north - south) * k / n
    ring = geo.box_ring(x(F.col("col")), y(F.col("row") + 1), x(F.col("col") + 1), y(F.col("row")))
    cell = F.format_string("r%dc%d", F.col("row") + 1, F.col("col") + 1)
    return zones.withColumn("cell_id", cell).withColumn("feature", feature(F.array(ring), cell_id=cell, coverage_percentage=half_away(F.col("coverage_percentage"), 6)))


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def html_report(title: str, sections: dict[str, DataFrame], limit: int = 200) -> str:
    """A page with a table for each section, of at most ``limit`` rows: a report's length is its feature."""
    escape = lambda c: text.html_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = [f"<h1>{title}</h1>"]
    for name, df in sections.items():
        rows = df.limit(limit).select(*(escape(c).alias(c) for c in df.columns)).collect()
        head = "".join(f"<th>{c}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{v}</td>" for v in r) + "</tr>" for r in rows)
        out.append(f"<h2>{name}</h2><table><tr>{head}</tr>{body}</table>")
    return "<!doctype html><meta charset=utf-8>" + "".join(out)


# Red, green, blue and alpha of condition classes; others are transparent.
CONDITION_COLOURS = {3: (46, 160, 67, 210), 2: (230, 180, 40, 210), 1: (200, 60, 40, 210)}


def save_masks(cells: DataFrame, folder: str, mask: str = "mask", name: str = "name") -> DataFrame:
    """One gray PNG per name of cells (name, x, y, mask): white where the mask holds, else black."""
    return rasters.save_images(cells.withColumn("v", F.when(F.col(mask), 255).otherwise(0)), folder, name, bands=("v",))


def save_conditions(cells: DataFrame, folder: str, condition: str = "condition", name: str = "name") -> DataFrame:
    """One PNG with transparency per name of cells (name, x, y, condition), classes in their colours."""
    band = lambda k: F.coalesce(*(F.when(F.col(condition) == c, v[k]) for c, v in CONDITION_COLOURS.items()), F.lit(0))
    return rasters.save_images(cells.withColumns({b: band(k) for k, b in enumerate("rgba")}), folder, name, bands=("r", "g", "b", "a"))


def condition_zone(rings: Column, row: Column, col: Column, total: Column, vigorous: Column, moderate: Column, severe: Column) -> Column:
    """GeoJSON feature of a grid cell with the shares of its canopy's classes."""
    canopy = vigorous + moderate + severe
    share = lambda n, of: half_away(F.when(of == 0, 0.0).otherwise(n * 100.0 / of))
    named = indices.dominant_of_cell(vigorous, moderate, severe)
    most = F.when(named == "severe", severe).when(named == "moderate", moderate).otherwise(vigorous)
    return feature(
        rings, cell_id=F.format_string("r%dc%d", row + 1, col + 1), row=row, col=col, total_pixels=total, canopy_pixels=canopy, canopy_pct=share(canopy, total), vigorous_pct=share(vigorous, canopy), moderate_stress_pct=share(moderate, canopy),
        severe_stress_pct=share(severe, canopy), dominant_condition=F.when(canopy == 0, "none").when(named == "vigorous", named).otherwise(F.concat(named, F.lit("_stress"))), dominant_pct=share(most, canopy),
    )
