"""Metrics objects in JSON: scalar members as rows, with units."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units of known metrics.
UNITS = {
    "%": ("coverage_percentage", "vigorous_pct", "moderate_stress_pct", "severe_stress_pct", "yellowing_pct", "browning_pct", "vegetation_coverage_pct", "canopy_pct", "dominant_pct"),
    "m²": ("vegetation_area_sqm", "total_area_sqm", "area_m2"),
    "m": ("perimeter_m",),
    "m/px": ("gsd_m",),
    "°": ("mean_hue_deg",),
    "px": ("total_pixels", "vegetation_pixels", "canopy_pixels", "green_coverage"),
    "items": ("tree_count", "grid_cells", "plots_analyzed"),
}


def unit(key: Column) -> Column:
    pairs = chain.from_iterable((F.lit(k), F.lit(u)) for u, keys in UNITS.items() for k in keys)
    return F.try_element_at(F.create_map(*pairs), key)


def flattened(df: DataFrame, json_col: str, unit_for: str = "any") -> DataFrame:
    """One row per scalar member: key, value, text_value, unit; other members are dropped.

    Numbers give a value, strings a text, booleans both. ``unit_for``: "any", or "number" for units on numbers alone.
    """
    # Values come as the JSON they are written in, so their kind shows in their first character.
    # from_json gives strings bare, so the kind is taken from a variant.
    rows = df.withColumn("_v", F.try_parse_json(F.col(json_col))).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_v").outer())).drop("pos", "_v").withColumnRenamed("value", "_value")
    kind = F.schema_of_variant("_value")
    number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    rows = rows.withColumn("_number", number).withColumn("_kind", kind).filter(F.col("_number") | F.col("_kind").isin("STRING", "BOOLEAN"))
    flag = F.try_variant_get("_value", "$", "boolean")
    return rows.select(
        *df.columns, "key",
        F.when(F.col("_number"), F.try_variant_get("_value", "$", "double")).when(F.col("_kind") == "BOOLEAN", flag.cast("double")).alias("value"),
        F.when(F.col("_kind") == "STRING", F.try_variant_get("_value", "$", "string")).when(F.col("_kind") == "BOOLEAN", flag.cast("string")).alias("text_value"),
        (unit(F.col("key")) if unit_for == "any" else F.when(F.col("_number"), unit(F.col("key")))).alias("unit"),
    )
