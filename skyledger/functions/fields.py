"""Fields of map features: kinds, texts of values, and the list of fields that a layer shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import payload, text


def kind_of(v: Column) -> Column:
    """number, boolean or text of a VARIANT."""
    k = payload.kind(v)
    return F.when(k.isin("number", "boolean"), k).otherwise("text")


def number_text(x: Column) -> Column:
    """Up to four digits behind a comma, points between thousands."""
    plain = F.regexp_replace(F.format_number(F.round(x, 4), 4), r"\.?0+$", "")
    return F.translate(F.when(plain.isin("-0", ""), "0").otherwise(plain), ",.", ".,")


def value_text(v: Column, unit: Column, kind: Column) -> Column:
    """A value as it is shown, with its unit: Ya or Tidak, a number, or trimmed text; "-" for none. What is no number shows as nothing in a number's field."""
    k = F.coalesce(payload.kind(v), F.lit("null"))
    said = F.try_variant_get(v, "$", "string")
    number = F.when(k == "number", F.try_variant_get(v, "$", "double")).when(k == "boolean", F.try_variant_get(v, "$", "boolean").cast("double")).when(k == "string", F.when(F.trim(said) == "", 0.0).otherwise(F.trim(said).try_cast("double")))
    flag = F.coalesce(kind, F.lit("")) == "boolean"
    shown = (
        F.when((k == "boolean") | flag, F.when(payload.truthy(v) | k.isin("array", "object"), "Ya").otherwise("Tidak")).when((k == "number") | (F.coalesce(kind, F.lit("")) == "number"), F.coalesce(number_text(number), F.lit("")))
        .when(k == "string", F.trim(said)).otherwise("")
    )
    return F.when(k == "null", "-").when(F.trim(unit) != "", F.concat(shown, F.lit(" "), F.trim(unit))).otherwise(shown)


def displayed(saved: DataFrame, properties: DataFrame, known: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    """(layer_id, place, key, label, unit, kind, custom): a layer's saved fields, then the keys its features have besides, in the order they are first seen (ties by key).

    ``saved`` has layer_id, place and the fields; ``properties`` has layer_id, feature, position, key and
    value (VARIANT); ``known`` has key, label, unit and kind of standard fields. Cases don't matter for what is known.
    """
    first = properties.filter(~F.col("key").isin(*reserved)).groupBy("layer_id", F.lower("key").alias("_key")).agg(F.min_by(F.struct("key", kind_of(F.col("value")).alias("kind")), F.struct("feature", "position", "key")).alias("_f"), F.min(F.struct("feature", "position", "key")).alias("_at"))
    fresh = first.join(saved.select("layer_id", F.lower("key").alias("_key")), ["layer_id", "_key"], "left_anti")
    named = fresh.join(known.select(F.lower("key").alias("_key"), F.col("label").alias("_label"), F.col("unit").alias("_unit"), F.col("kind").alias("_kind")), "_key", "left")
    has = F.col("_label").isNotNull()
    row = F.struct(F.col("_at").alias("at"), F.col("_f.key").alias("key"), F.coalesce("_label", text.humanized(F.col("_f.key"))).alias("label"), F.col("_unit").alias("unit"), F.when(has, F.col("_kind")).otherwise(F.col("_f.kind")).alias("kind"))
    # A layer's fields are few; they are put in order in one row.
    listed = named.groupBy("layer_id").agg(F.array_sort(F.collect_list(row)).alias("_new")).join(saved.groupBy("layer_id").agg(F.count("*").alias("_n")), "layer_id", "left")
    new = listed.select("layer_id", F.coalesce("_n", F.lit(0)).alias("_n"), F.posexplode("_new").alias("_k", "r")).select("layer_id", (F.col("_n") + F.col("_k")).cast("int").alias("place"), "r.key", "r.label", "r.unit", "r.kind", F.lit(False).alias("custom"))
    return saved.select("layer_id", F.col("place").cast("int").alias("place"), "key", "label", "unit", "kind", "custom").unionByName(new)


def orientation_warning(orientation: Column) -> Column:
    """A note where a picture's orientation isn't the normal 1."""
    return F.when(orientation != 1, F.format_string("EXIF Orientation bernilai %d (bukan 1/Normal). Rotasi EXIF diabaikan demi menjaga orientasi georeferensi North-up.", orientation))


def assumed_crs(west: Column, east: Column, south: Column, north: Column) -> Column:
    """4326 for a box in degrees; null else."""
    return F.when((west >= -180) & (east <= 180) & (south >= -90) & (north <= 90), 4326)


# Extensions of world files by that of the picture, first ones first.
WORLD_FILES = {"jpg": ("jgw", "wld", "jpgw", "jpegw"), "jpeg": ("jgw", "wld", "jpgw", "jpegw"), "png": ("pgw", "wld", "pngw"), "tif": ("tfw", "wld", "tiffw"), "tiff": ("tfw", "wld", "tiffw")}


def world_files(images: DataFrame, files: DataFrame) -> DataFrame:
    """(path, world_file) of each image: the first candidate beside it, lower case before upper; null without one."""
    ext = text.extension(F.col("path"))
    wanted = F.array(F.lit("wld"))
    for k, names in WORLD_FILES.items():
        wanted = F.when(ext == k, F.array(*map(F.lit, names))).otherwise(wanted)
    both = F.flatten(F.transform(wanted, lambda x: F.array(x, F.upper(x))))
    start = F.regexp_replace("path", r"\.[^./\\]*$", "")
    asked = images.select("path", F.posexplode(both).alias("_k", "_ext")).withColumn("_file", F.concat(start, F.lit("."), "_ext"))
    found = asked.join(files.select(F.col("path").alias("_file")).distinct(), "_file").groupBy("path").agg(F.min_by("_file", "_k").alias("world_file"))
    return images.select("path").join(found, "path", "left")
