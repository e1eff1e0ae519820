"""Edits of layers that hold only if nobody else was faster: conditional merges of layers and of their features' properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload, text

# Properties that nobody may set.
RESERVED = ("image_url", "photo_url", "thumbnail_url", "image", "edited_fields", "source", "geometry", "properties", "__proto__", "constructor", "prototype")


def judged(layers: DataFrame, patches: DataFrame, edits: DataFrame) -> DataFrame:
    """(layer_id, seq, status): what becomes of each patch.

    ``patches`` has layer_id, seq, expected (a token, or null for any), layer_name, color, icon (null: as it
    was). unknown: no such layer; conflict: another token, or a patch of the same layer before it;
    invalid: a bad name or colour, or an edit that isn't allowed; else applied. All of a patch applies or nothing.
    ``edits`` has layer_id, seq and a problem.
    """
    faults = edits.groupBy("layer_id", "seq").agg(F.bool_or(F.col("problem").isNotNull()).alias("_fault"))
    own = patches.join(layers.select("layer_id", F.col("token").alias("_token"), F.lit(True).alias("_there")), "layer_id", "left").join(faults, ["layer_id", "seq"], "left")
    no = lambda c: F.coalesce(~c, F.lit(False))
    bad = no(text.valid_name(F.col("layer_name"))) | no(text.valid_hex_color(F.col("color"))) | F.coalesce("_fault", F.lit(False))
    rows = own.withColumn("_state", F.when(F.col("_there").isNull(), "unknown").when(bad, "invalid").when(F.coalesce(F.col("expected") != F.col("_token"), F.lit(False)), "conflict").otherwise("applied"))
    first = rows.filter("_state = 'applied'").groupBy("layer_id").agg(F.min("seq").alias("_first"))
    return rows.join(first, "layer_id", "left").select("layer_id", "seq", F.when((F.col("_state") == "applied") & (F.col("seq") > F.col("_first")), "conflict").otherwise(F.col("_state")).alias("status"))


def judged_edits(features: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` (layer_id, seq, feature, key, value, field_kind, custom, remove) with the old value and a problem, null if there is none.

    ``features`` has layer_id, feature, key and value (VARIANT), one row per property, and one with a null key for each feature.
    """
    there = features.filter("key is null").select("layer_id", "feature", F.lit(True).alias("_there"))
    old = features.filter("key is not null").select("layer_id", "feature", "key", F.col("value").alias("old"))
    rows = edits.join(there, ["layer_id", "feature"], "left").join(old, ["layer_id", "feature", "key"], "left")
    removal = F.when(~F.coalesce("custom", F.lit(False)), "not_custom")
    setting = F.when(F.col("key").isin(*RESERVED), "reserved").otherwise(payload.edit_problem(F.col("old"), F.col("value"), F.col("field_kind")))
    return rows.withColumn("problem", F.when(F.col("_there").isNull(), "no_feature").when(F.col("remove"), removal).otherwise(setting)).drop("_there")


def merged(layers: DataFrame, patches: DataFrame, status: DataFrame, now: Column) -> DataFrame:
    """``layers`` (layer_id, layer_name, color, icon, updated_at, token) after the applied patches; a patched layer's token is its new time."""
    wins = patches.join(status.filter("status = 'applied'").select("layer_id", "seq"), ["layer_id", "seq"]).select("layer_id", F.trim("layer_name").alias("_name"), F.col("color").alias("_color"), F.trim("icon").alias("_icon"), F.lit(True).alias("_new"))
    at = F.when(F.col("_new"), now)
    out = layers.join(wins, "layer_id", "left").withColumns({"layer_name": F.coalesce("_name", "layer_name"), "color": F.coalesce("_color", "color"), "icon": F.coalesce("_icon", "icon"), "updated_at": F.coalesce(at, "updated_at"), "token": F.coalesce(at, "token")})
    return out.select(*layers.columns)


def merged_features(features: DataFrame, edits: DataFrame, status: DataFrame) -> DataFrame:
    """``features`` (layer_id, feature, key, value, edited) after the edits of applied patches; an edited property is marked, a removed one is gone. Of several edits of a property the last by ``place`` holds."""
    keys = ["layer_id", "feature", "key"]
    done = edits.join(status.filter("status = 'applied'").select("layer_id", "seq"), ["layer_id", "seq"])
    last = done.groupBy(*keys).agg(F.max_by(F.struct("value", "remove"), F.col("place")).alias("_e"))
    kept = features.join(last, keys, "left")
    # Null keys stand for the features themselves and meet no edit.
    kept = kept.filter(F.col("_e").isNull() | ~F.col("_e.remove")).select(*keys, F.when(F.col("_e").isNull(), F.col("value")).otherwise(F.col("_e.value")).alias("value"), (F.col("edited") | F.col("_e").isNotNull()).alias("edited"))
    new = last.filter("not _e.remove").join(features.filter("key is not null").select(*keys), keys, "left_anti").select(*keys, F.col("_e.value").alias("value"), F.lit(True).alias("edited"))
    return kept.unionByName(new)
