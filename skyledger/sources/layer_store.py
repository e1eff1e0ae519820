"""Layer documents in a folder, either a file each or a folder each, broken ones among them."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload, text
from .scratch import opened

# Colours of broken layers and overlays.
BROKEN, OVERLAY = "#E74C3C", "#3498DB"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, format, part, v, length, mtime_ms): {id}.json, {id}/layer.json and {id}/features/*.json below ``folder``; v is null where a file is no JSON. Hidden names and bad ids are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(folder)
    # Spark's readers pass over files of 0 bytes; they are listed by name.
    fs, at = opened(folder)
    bare = [(x.path, 0, x.mtime_ns // 1_000_000) for x in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if x.is_file and not x.size and x.path.endswith(".json")]
    empty = spark.createDataFrame(bare, "path string, length long, mtime_ms long").select("path", F.lit("").alias("text"), "length", "mtime_ms")
    files = files.select("path", F.decode("content", "UTF-8").alias("text"), "length", F.unix_millis("modificationTime").alias("mtime_ms")).union(empty)
    # Listed paths start with the store's name and the folder.
    top = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_replace(F.substring_index("path", f"/{top}/", -1), "^/+", "")
    parts = F.split(below, "/")
    rows = files.select(parts.alias("_p"), F.try_parse_json("text").alias("v"), "length", "mtime_ms")
    n, first = F.size("_p"), F.col("_p")[0]
    flat = n == 1
    part = F.when(flat | ((n == 2) & (F.get("_p", F.lit(1)) == "layer.json")), "layer").when((n == 3) & (F.get("_p", F.lit(1)) == "features"), "feature")
    rows = rows.select(F.when(flat, text.stem(first)).otherwise(first).alias("id"), F.when(flat, "flat").otherwise("decomposed").alias("format"), part.alias("part"), "v", "length", "mtime_ms")
    return rows.filter(text.valid_result_id(F.col("id")))


def _said(v: Column, path: str) -> Column:
    return F.when(payload.kind(payload.member(v, path)) == "string", F.try_variant_get(v, path, "string"))


def summaries(docs: DataFrame) -> DataFrame:
    """One row per layer of ``documents``: name, features, geometry kind, colour, icon, thumbnail, edits, token; a broken one says so in its name and counts nothing.

    A folder hides a file of the same id. A layer needs a name and a display type; a feature file that
    is broken is left out, in a file for all features any broken feature breaks the layer.
    """
    v, ways = F.col("v"), ("Polygon", "Point", "LineString")
    layer = docs.filter("part = 'layer'").select("id", "format", "v", "length", "mtime_ms")
    kind_ = _said(v, "$.display_preference.type")
    listed = F.when(payload.kind(payload.member(v, "$.spatial_results")) == "array", F.try_variant_get(v, "$.spatial_results", "array<variant>"))
    features = docs.filter("part = 'feature'").select("id", "format", payload.member(v, "$.result").alias("f"))
    own = layer.filter("format = 'flat'").select("id", "format", F.explode(listed).alias("f"))
    good = _said(F.col("f"), "$.geometry.type").isin(*ways)
    edited = F.coalesce(F.size(F.try_variant_get("f", "$.edited_fields", "array<variant>")) > 0, F.lit(False))
    picture = F.coalesce(*(F.nullif(F.trim(_said(F.col("f"), p)), F.lit("")) for p in ("$.image_url", "$.properties.image_url")))
    seen = features.unionByName(own).select("id", "format", F.coalesce(good, F.lit(False)).alias("_good"), _said(F.col("f"), "$.geometry.type").alias("_type"), edited.alias("_edited"), picture.alias("_picture"), F.monotonically_increasing_id().alias("_k"))
    per = seen.groupBy("id", "format").agg(F.count_if("_good").alias("_n"), F.count_if(~F.col("_good")).alias("_bad"), F.min(F.when(F.col("_good"), F.col("_type"))).alias("_a"), F.max(F.when(F.col("_good"), F.col("_type"))).alias("_b"), F.coalesce(F.bool_or(F.col("_good") & F.col("_edited")), F.lit(False)).alias("_edited"), F.min_by("_picture", F.when(F.col("_good") & F.col("_picture").isNotNull(), F.col("_k"))).alias("_picture"))
    ids = docs.groupBy("id").agg(F.when(F.count_if(F.col("format") == "decomposed") > 0, "decomposed").otherwise("flat").alias("format"))
    rows = ids.join(layer, ["id", "format"], "left").join(per, ["id", "format"], "left").withColumns({"_kind": kind_, "_name": _said(v, "$.layer_name")})
    flat_list = (F.col("format") == "decomposed") | listed.isNotNull() & (F.coalesce("_bad", F.lit(0)) == 0)
    fine = F.coalesce(F.col("_name").isNotNull() & F.col("_kind").isin("polygon", "point", "line", "image_overlay") & flat_list, F.lit(False))
    rows = rows.withColumn("is_corrupted", ~fine)
    short = F.when(F.col("_a") == "LineString", "Line").otherwise(F.col("_a"))
    names = F.when(F.col("_kind") == "image_overlay", "Overlay").when(F.coalesce("_n", F.lit(0)) == 0, F.initcap("_kind")).when(F.col("_a") == F.col("_b"), short).otherwise("Mixed")
    custom = F.exists(F.coalesce(F.try_variant_get(v, "$.display_preference.fields", "array<variant>"), F.array().cast("array<variant>")), lambda f: F.coalesce(F.try_variant_get(f, "$.custom", "boolean"), F.lit(False)))
    keep = lambda c, other=None: F.when(F.col("is_corrupted"), F.lit(other)).otherwise(c)
    missing = F.col("length").isNull()
    broken = F.concat("id", F.when(missing, " (layer.json hilang)").otherwise(" (Metadata rusak)"))
    own_picture = F.nullif(F.trim(_said(v, "$.display_preference.image_url")), F.lit(""))
    return rows.select(
        "id", F.when(F.col("is_corrupted"), broken).otherwise(F.col("_name")).alias("layer_name"), keep(F.coalesce("_n", F.lit(0)), 0).alias("feature_count"), keep(names, "Unknown").alias("geom_type"),
        keep(F.when(F.col("_kind") == "image_overlay", OVERLAY).otherwise(F.coalesce(_said(v, "$.display_preference.color"), F.lit(""))), BROKEN).alias("display_color"),
        keep(F.when(F.col("_kind") == "point", F.when(F.trim(_said(v, "$.display_preference.icon")) != "", _said(v, "$.display_preference.icon")))).alias("icon"), keep(F.coalesce(own_picture, "_picture")).alias("thumbnail_url"),
        F.col("format").alias("format_type"), "is_corrupted", keep(_said(v, "$.updated_at")).alias("updated_at"), keep(F.coalesce("_edited", F.lit(False)) | custom, False).alias("has_manual_edits"),
        keep(payload.concurrency_token(_said(v, "$.updated_at"), F.col("length"), F.col("mtime_ms")), "0_0").alias("concurrency_token"),
    )
