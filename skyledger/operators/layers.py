"""Map layers: stack order, sectors, kinds, edits, dependants, reconciling; lookups by prefix and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reordered(layers: DataFrame, start: int, end: int, z: str = "z_index") -> DataFrame:
    """The layer at ``start`` moved to ``end`` in a stack numbered from 0; the others close up. No shuffle."""
    n = layers.count()
    if not (0 <= start < n and 0 <= end < n):
        raise ValueError("no such place in the stack")
    at = F.col(z)
    moved = F.when(at == start, end).when((at > start) & (at <= end), at - 1).when((at >= end) & (at < start), at + 1).otherwise(at)
    return layers.withColumn(z, moved.cast(layers.schema[z].dataType))


def faded(layers: DataFrame, layer, opacity: float, key: str = "layer_id") -> DataFrame:
    if not 0 <= opacity <= 1:
        raise ValueError("opacity must be 0 to 1")
    return layers.withColumn("opacity", F.when(F.col(key) == layer, F.lit(float(opacity))).otherwise(F.col("opacity")))


def sectors(layers: DataFrame, name: str = "layer_name", kind: str = "display_type") -> DataFrame:
    """Layers but overlays, their names "Name - Sector" taken apart; without a sector it is Umum."""
    parts = F.split(F.col(name), " - ")
    rows = layers.filter(F.coalesce(F.col(kind), F.lit("")) != "image_overlay")
    return rows.withColumns({"sector": F.coalesce(F.get(parts, F.lit(1)), F.lit("Umum")), name: parts[0]})


# Names of geometry kinds.
KINDS = {"polygon": "Polygon", "point": "Point", "line": "Line", "image_overlay": "Overlay"}


def geometry_kinds(layers: DataFrame, features: DataFrame, key: str = "layer_id") -> DataFrame:
    """``layers`` with geom_type: Overlay for overlays, else that of all features, Mixed for several; the display type's without features."""
    plain = F.when(F.col("type") == "LineString", "Line").otherwise(F.col("type"))
    seen = features.groupBy(key).agg(F.min(plain).alias("_a"), F.max(plain).alias("_b"))
    own = F.coalesce(*(F.when(F.col("display_type") == k, v) for k, v in KINDS.items()))
    kind = F.when(F.col("display_type") == "image_overlay", "Overlay").when(F.col("_a").isNull(), own).when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("Mixed")
    return layers.join(seen, key, "left").withColumn("geom_type", kind).drop("_a", "_b")


def manual_edits(features: DataFrame, key: str = "layer_id", edited: str = "edited_fields", custom: str = "custom_fields") -> DataFrame:
    """Per layer its edited features, custom fields, and whether there is either."""
    n = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    out = features.groupBy(key).agg(F.count_if(n(edited) > 0).alias("edited_features"), F.max(n(custom)).cast("long").alias("custom_fields"))
    return out.withColumn("has_edits", (F.col("edited_features") > 0) | (F.col("custom_fields") > 0))


def dependents(layers: DataFrame, key: str = "layer_id", **children: DataFrame) -> DataFrame:
    """``layers`` with the number of rows that each of ``children`` has for them."""
    for name, rows in children.items():
        layers = layers.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return layers


def reconciled(images: DataFrame, layers: DataFrame, key: str = "layer_id") -> DataFrame:
    """What to do with either side's orphans: register an image without a layer, remove a raster layer without an image."""
    add = images.select(key).distinct().join(layers.select(key), key, "left_anti").select(key, F.lit("register").alias("action"))
    drop = layers.filter("display_type = 'image_overlay'").select(key).distinct().join(images.select(key), key, "left_anti").select(key, F.lit("remove").alias("action"))
    return add.unionByName(drop)


def resolved(table: DataFrame, wanted: str, key: str = "id", name: str = "name") -> DataFrame:
    """The one row with that id, or whose id or name begins so; no such row, or several, are errors. Reads at most two rows to the driver."""
    rows = table.filter(F.col(key).cast("string") == wanted)
    if rows.isEmpty():
        rows = table.filter(F.startswith(F.col(key).cast("string"), F.lit(wanted)) | F.startswith(F.col(name), F.lit(wanted)))
    hits = rows.select(key).limit(2).collect()
    if len(hits) != 1:
        raise ValueError(f"{'ambiguous' if hits else 'unknown'}: {wanted!r}")
    return rows


def timeline(sessions: DataFrame, start: str, end: str, least: float = 6.0) -> DataFrame:
    """``sessions`` with left and width, in percent of the whole range; a range below 30 s is one full bar.

    The range is one row, joined by broadcast.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    whole = sessions.agg(F.min(ms(start)).alias("_lo"), F.max(ms(end)).alias("_hi"))
    span = (F.col("_hi") - F.col("_lo")).cast("double")
    left = (ms(start) - F.col("_lo")) / F.nullif(span, F.lit(0.0)) * 100
    raw = (F.greatest(ms(end), ms(start)) - ms(start)) / F.nullif(span, F.lit(0.0)) * 100
    width = F.greatest(F.lit(least), F.least(100 - left, F.when(raw == 0, least).otherwise(raw)))
    full = span < 30_000
    out = sessions.crossJoin(F.broadcast(whole))
    return out.withColumn("width_percent", F.when(full, 100.0).otherwise(width)).withColumn("left_percent", F.when(full, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(100 - F.col("width_percent"), left)))).drop("_lo", "_hi")


def spread(numbered: DataFrame, count: int, place: str = "rank") -> DataFrame:
    """``count`` rows spread evenly over rows numbered from 1: places int(k * n / count); all of them if count is below 1 or not below n."""
    n = numbered.count()
    if count <= 0 or count >= n:
        return numbered
    i, step = F.col(place) - 1, n / count
    k = F.floor(i / step)
    hit = lambda j: (j >= 0) & (j < count) & (F.floor(j * step) == i)
    return numbered.filter(hit(k) | hit(k + 1))


def bars(items: DataFrame, value: str, full: float = 240.0) -> DataFrame:
    """``items`` with bar_width: value over the largest, times ``full``, rounded, 1 at least."""
    top = items.agg(F.greatest(F.max(value), F.lit(2.220446049250313e-16)).alias("_top"))
    width = F.floor(F.col(value) / F.col("_top") * full + 0.5)
    return items.crossJoin(F.broadcast(top)).withColumn("bar_width", F.least(F.greatest(width.cast("double"), F.lit(1.0)), F.lit(full))).drop("_top")


def shares(items: DataFrame, value: str) -> DataFrame:
    """``items`` with share: rounded percent of the total of positive values; 0 without any."""
    positive: Column = F.greatest(F.col(value), F.lit(0))
    total = items.agg(F.sum(positive).alias("_total"))
    return items.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("_total") > 0, F.floor(positive * 100.0 / F.col("_total") + 0.5)).otherwise(0).cast("long")).drop("_total")


def stacked(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Height of the stack at each label: the sum of what is above zero."""
    return rows.groupBy(label).agg(F.sum(F.greatest(F.col(value), F.lit(0))).alias("total"))


def of_category(layers: DataFrame, category: str) -> DataFrame:
    return layers.filter(F.col("category") == category)


def shown(layers: DataFrame, layer, visible: bool, key: str = "layer_id") -> DataFrame:
    return layers.withColumn("is_visible", F.when(F.col(key) == layer, F.lit(visible)).otherwise(F.col("is_visible")))
