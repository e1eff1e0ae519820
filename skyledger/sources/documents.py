"""Text and JSON sources: plots from GeoJSON, layers, world files, projections, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text

RINGS = "array<array<array<double>>>"
FEATURE = f"struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: {RINGS}>>"


def plots(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, name, rings, reason) of the features in GeoJSON files; reason says why one is skipped, null for a plot.

    A file that is neither a Feature nor a FeatureCollection gives one row with reason "not_geojson".
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    kind = F.get_json_object("value", "$.type")
    many = F.from_json(F.get_json_object("value", "$.features"), f"array<{FEATURE}>")
    one = F.array(F.from_json("value", FEATURE))
    rows = files.withColumn("_kind", kind).select("path", "_kind", F.posexplode_outer(F.when(kind == "FeatureCollection", many).when(kind == "Feature", one)).alias("_k", "_f"))
    rings = F.transform(F.col("_f.geometry.coordinates"), lambda r: geo.closed(r))
    reason = (
        F.when(F.col("_kind").isNull() | ~F.col("_kind").isin("Feature", "FeatureCollection"), "not_geojson")
        .when(F.col("_f.geometry").isNull() | F.col("_f.geometry.type").isNull(), "no_geometry")
        .when(F.col("_f.geometry.type") != "Polygon", "not_a_polygon")
        .when(~F.coalesce(geo.valid_polygon(F.col("rings")), F.lit(False)), "bad_ring")
    )
    out = rows.withColumn("rings", rings).withColumn("reason", reason)
    return out.select("path", (F.col("_k") + 1).alias("number"), text.plot_name(F.col("_k") + 1, F.try_element_at("_f.properties", F.lit("name"))).alias("name"), "rings", "reason")


def measured(plots_: DataFrame, rings: str = "rings") -> DataFrame:
    """Plots with area and perimeter, which are stored once and not computed at every read."""
    return plots_.withColumns({"area_m2": geo.polygon_area(F.col(rings)), "perimeter_m": geo.polygon_perimeter(F.col(rings))})


def layers(spark: SparkSession, path: str) -> DataFrame:
    """Layer documents; one that can't be parsed is a row with is_corrupted and its file as id."""
    files = spark.read.text(path, wholetext=True).select(text.basename(F.col("_metadata.file_path")).alias("file"), "value")
    v = F.try_parse_json("value")
    get = lambda k, t="string": F.try_variant_get(v, f"$.{k}", t)
    return files.select(
        "file", F.coalesce(get("layer_id"), text.stem(F.col("file"))).alias("layer_id"), F.coalesce(get("layer_name"), F.lit("")).alias("layer_name"),
        F.coalesce(F.size(F.from_json(F.get_json_object("value", "$.spatial_results"), "array<string>")), F.lit(0)).alias("n_features"), (v.isNull() | get("layer_id").isNull()).alias("is_corrupted"),
    )


def world_file(content: Column) -> Column:
    """struct<a, d, b, e, c, f> of the six lines; null if they aren't six numbers."""
    lines = F.filter(F.transform(F.split(content, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = lambda k: F.get(lines, F.lit(k)).try_cast("double")
    names = ("a", "d", "b", "e", "c", "f")
    return F.when((F.size(lines) == 6) & F.forall(lines, lambda x: x.try_cast("double").isNotNull()), F.struct(*(n(k).alias(x) for k, x in enumerate(names))))


def world_envelope(w: Column, width: Column, height: Column) -> dict[str, Column]:
    """Outer bounds: lines 5 and 6 give the centre of the first pixel. Null for rotated images."""
    ok = (F.abs(w["d"]) <= 1e-9) & (F.abs(w["b"]) <= 1e-9)
    x0, y0 = w["c"] - w["a"] / 2, w["f"] - w["e"] / 2
    x1, y1 = x0 + w["a"] * width, y0 + w["e"] * height
    return {"x_min": F.when(ok, F.least(x0, x1)), "y_min": F.when(ok, F.least(y0, y1)), "x_max": F.when(ok, F.greatest(x0, x1)), "y_max": F.when(ok, F.greatest(y0, y1))}


def prj_epsg(content: Column) -> Column:
    """EPSG code by names in the WKT, else by its authority tag."""
    up = F.upper(content)
    has = lambda *names: F.greatest(*(up.contains(n) for n in names)) if len(names) > 1 else up.contains(names[0])
    return (
        F.when(has("32750", "UTM ZONE 50S", "UTM_ZONE_50S"), 32750).when(has("32650", "UTM ZONE 50N", "UTM_ZONE_50N"), 32650).when(has("3857", "PSEUDO-MERCATOR", "WEB_MERCATOR"), 3857)
        .when(up.contains("PROJCS"), F.regexp_extract(up, r'.*AUTHORITY\["EPSG","?(\d+)', 1).try_cast("int")).when(has("4326", "GCS_WGS_1984"), 4326)
        .otherwise(F.regexp_extract(up, r'.*AUTHORITY\["EPSG","?(\d+)', 1).try_cast("int"))
    )


def sidecar_envelope(content: Column) -> Column:
    """[[south, west], [north, east]] from any of the accepted shapes of a sidecar; null if none fits or the bounds are not in order."""
    d = "double"
    v = F.try_parse_json(content)
    get = lambda p: F.try_variant_get(v, p, d)
    shapes = []
    for root in ("$", "$.bounds", "$.bbox"):
        shapes.append([get(f"{root}.{k}") for k in ("south", "west", "north", "east")])
        shapes.append([get(f"{root}[0][0]"), get(f"{root}[0][1]"), get(f"{root}[1][0]"), get(f"{root}[1][1]")])
        shapes.append([get(f"{root}[1]"), get(f"{root}[0]"), get(f"{root}[3]"), get(f"{root}[2]")])
    return F.coalesce(*(F.when(geo.valid_bounds(w, s, e, n), F.array(F.array(s, w), F.array(n, e))) for s, w, n, e in shapes))


#: The parts of a Pascal VOC annotation that are read.
VOC = "filename string, object array<struct<bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"


def voc_boxes(xml: Column) -> Column:
    """struct<file, boxes> of an annotation: whole numbers, cut off; a corner that isn't told is 0, boxes without extent are left out. Null where there is no XML."""
    v = F.from_xml(xml, VOC)
    corner = lambda o, k: F.coalesce(o["bndbox"][k], F.lit(0.0)).cast("int")
    boxes = F.transform(F.coalesce(v["object"], F.array().cast("array<struct<bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>")), lambda o: F.struct(*(corner(o, k.replace("_", "")).alias(k) for k in ("x_min", "y_min", "x_max", "y_max"))))
    good = F.filter(boxes, lambda b: (b["x_max"] > b["x_min"]) & (b["y_max"] > b["y_min"]))
    return F.when(v.isNotNull() & v["filename"].isNotNull() | (F.size(good) > 0), F.struct(F.coalesce(v["filename"], F.lit("")).alias("file"), good.alias("boxes")))


def training_rows(annotations: DataFrame, label: str = "Tree", file: str = "file", boxes: str = "boxes") -> DataFrame:
    """(file, x_min, y_min, x_max, y_max, label), a row per box; a picture without any is one row of zeros."""
    none = F.array(F.struct(*(F.lit(0).alias(k) for k in ("x_min", "y_min", "x_max", "y_max"))))
    rows = annotations.select(F.col(file).alias("file"), F.explode(F.when(F.size(boxes) > 0, F.col(boxes)).otherwise(none)).alias("b"))
    return rows.select("file", "b.*", F.lit(label).alias("label"))
