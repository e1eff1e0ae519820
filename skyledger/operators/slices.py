"""Metrics of many slices merged into one value per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_away


def is_count(key: Column) -> Column:
    """Keys that add up: counts, pixels, totals and trees, but no shares."""
    low = F.lower(key)
    return low.rlike("count|pixel|total|trees") & ~low.rlike("pct|percent|ratio")


def merged(metrics: DataFrame, group: str, slice_id: str) -> DataFrame:
    """(group, key, value, text_value) of metrics (group, slice, key, value, text_value).

    Counts are summed; other numbers are means weighted by the slice's sampled (else total) pixels if
    every slice has the key, plain means if not; texts are the first by slice. A single slice stays as it is. Percentages
    of vegetation are computed anew from the summed pixels.
    """
    pixels = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    weights = metrics.groupBy(group, slice_id).agg(F.greatest(F.coalesce(pixels("sampled_pixels"), pixels("total_pixels"), F.lit(1.0)), F.lit(1.0)).alias("_w"))
    slices = weights.groupBy(group).agg(F.count("*").alias("_slices"))
    rows = metrics.join(weights, [group, slice_id])
    n = F.count("value")
    text = F.min_by("text_value", F.when(F.col("text_value").isNotNull() & (F.col("text_value") != ""), F.col(slice_id)))
    agg = rows.groupBy(group, "key").agg(F.sum("value").alias("_sum"), n.alias("_n"), F.sum(F.col("value") * F.col("_w")).alias("_vw"), F.sum(F.when(F.col("value").isNotNull(), F.col("_w"))).alias("_ws"), text.alias("text_value")).join(slices, group)
    mean = F.when(F.col("_n") == F.col("_slices"), F.col("_vw") / F.col("_ws")).otherwise(F.col("_sum") / F.col("_n"))
    value = F.when(F.col("_n") == 0, None).when(F.col("_slices") == 1, F.col("_sum")).when(is_count(F.col("key")), half_away(F.col("_sum"), 0)).otherwise(half_away(mean, 4))
    out = agg.select(group, "key", value.alias("value"), F.when(F.col("_n") == 0, F.col("text_value")).alias("text_value"), "_slices")
    total = out.groupBy(group).agg(F.max(F.when(F.col("key") == "vegetation_pixels", F.col("value"))).alias("_veg"), F.coalesce(pixels("sampled_pixels"), pixels("total_pixels")).alias("_all"))
    again = F.col("key").isin("coverage_percentage", "vegetation_coverage_pct") & (F.col("_all") > 0) & F.col("_veg").isNotNull() & (F.col("_slices") > 1)
    return out.join(total, group).withColumn("value", F.when(again, half_away(F.col("_veg") / F.col("_all") * 100, 4)).otherwise(F.col("value"))).drop("_veg", "_all", "_slices")
