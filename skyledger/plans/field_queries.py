"""Registered queries over fields, texts of changes, crowns, tiles, world files and orders of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, numeric
from ..operators import detections, layers, temporal
from . import standins as s
from .registry import query


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 8 AS k, p_retailprice AS v, p_size AS n FROM part),
    t AS (SELECT *, replace(replace(replace(rtrim(rtrim(format('{:,.2f}', v), '0'), '.'), ',', 'x'), '.', ','), 'x', '.') AS money FROM p)
    SELECT id, CASE WHEN k IN (0, 1, 4) THEN 'number' WHEN k = 2 THEN 'boolean' ELSE 'text' END AS kind, CASE k WHEN 0 THEN money || ' m²' WHEN 1 THEN n::VARCHAR WHEN 2 THEN CASE WHEN n % 2 = 0 THEN 'Ya' ELSE 'Tidak' END WHEN 3 THEN 'some text kg' WHEN 4 THEN 'Ya' WHEN 5 THEN '-' WHEN 6 THEN '' ELSE '12,5 m' END AS shown FROM t""")
def field_texts(spark, sf_dir):
    """Numbers with points and commas, flags, text, a number in a flag's field, null, text in a number's field, text that reads as a number."""
    k, n, v = F.col("p_partkey") % 8, F.col("p_size"), F.col("p_retailprice")
    raw = F.when(k == 0, v.cast("string")).when(k == 1, n.cast("string")).when(k == 2, (n % 2 == 0).cast("string")).when(k == 3, '"  some text "').when(k == 4, n.cast("string")).when(k == 5, "null").when(k == 6, '"none"').otherwise('" 12.50 "')
    unit = F.when(k == 0, " m² ").when(k == 3, "kg").when(k == 7, "m").when(k == 5, "ha").otherwise(" ")
    kind = F.when(k == 4, "boolean").when(k >= 6, "number")
    rows = s.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.parse_json(raw).alias("v"), unit.alias("u"), kind.alias("k"))
    return rows.select("id", fields.kind_of(F.col("v")).alias("kind"), fields.value_text(F.col("v"), F.col("u"), F.col("k")).alias("shown"))


@query("""WITH d AS (SELECT l_orderkey AS layer_id, l_linenumber AS feature, l_suppkey % 6 AS a, l_partkey % 6 AS b FROM lineitem WHERE l_orderkey % 5 <> 0), n AS (SELECT ['Height_m', 'height_M', 'species_name', 'source', 'ok', 'dbh'] AS names),
    p AS (SELECT layer_id, feature, 0 AS pos, names[1 + a::INT] AS key, 'number' AS kind FROM d, n UNION ALL SELECT layer_id, feature, 1, names[1 + b::INT], 'text' FROM d, n WHERE a <> b),
    f AS (SELECT layer_id, lower(key) AS k, min_by(key, (feature, pos, key, kind)) AS key, min_by(kind, (feature, pos, key, kind)) AS kind, min((feature, pos, key)) AS seen FROM p WHERE key <> 'source' GROUP BY 1, 2),
    s AS (SELECT DISTINCT layer_id FROM d WHERE layer_id % 2 = 0), w AS (SELECT f.* FROM f LEFT JOIN s USING (layer_id) WHERE NOT (s.layer_id IS NOT NULL AND k = 'dbh')),
    o AS (SELECT w.*, row_number() OVER (PARTITION BY layer_id ORDER BY seen) - 1 + (CASE WHEN layer_id % 2 = 0 THEN 1 ELSE 0 END) AS place FROM w)
    SELECT layer_id, place::INT AS place, key, CASE WHEN k = 'height_m' THEN 'Tinggi' ELSE array_to_string(list_transform(string_split(key, '_'), lambda x: upper(x[1]) || x[2:]), ' ') END AS label, CASE WHEN k = 'height_m' THEN 'm' END AS unit, CASE WHEN k = 'height_m' THEN 'number' ELSE kind END AS kind, false AS custom FROM o
    UNION ALL SELECT layer_id, 0, 'DBH', 'Own', 'cm', 'number', true FROM s""")
def display_fields(spark, sf_dir):
    """Saved fields of every second layer, then keys of features by first sight, known ones named by a list."""
    names = F.array(*map(F.lit, ("Height_m", "height_M", "species_name", "source", "ok", "dbh")))
    d = s.table(spark, sf_dir, "lineitem").filter("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("layer_id"), F.col("l_linenumber").alias("feature"), (F.col("l_suppkey") % 6).cast("int").alias("a"), (F.col("l_partkey") % 6).cast("int").alias("b"))
    one = d.select("layer_id", "feature", F.lit(0).alias("position"), F.get(names, F.col("a")).alias("key"), F.parse_json(F.lit("1")).alias("value"))
    two = d.filter("a <> b").select("layer_id", "feature", F.lit(1).alias("position"), F.get(names, F.col("b")).alias("key"), F.parse_json(F.lit('"x"')).alias("value"))
    saved = d.filter("layer_id % 2 = 0").select("layer_id").distinct().select("layer_id", F.lit(0).alias("place"), F.lit("DBH").alias("key"), F.lit("Own").alias("label"), F.lit("cm").alias("unit"), F.lit("number").alias("kind"), F.lit(True).alias("custom"))
    known = spark.createDataFrame([("HEIGHT_M", "Tinggi", "m", "number")], "key string, label string, unit string, kind string")
    return fields.displayed(saved, one.union(two), known, ("source",))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS a, left(o_orderpriority, 1) AS b, (o_custkey % 21) - 10 AS c, o_totalprice AS t FROM orders)
    SELECT id, CASE WHEN a <> b THEN id || ': ' || a || ' -> ' || b END AS classes, id || ': ' || CASE WHEN c >= 0 THEN '+' ELSE '' END || c || ' pohon (' || CASE WHEN c > 0 THEN 'bertambah' WHEN c < 0 THEN 'berkurang' ELSE 'tetap' END || ')' AS counts, 'Perubahan: ' || (c / 2)::DOUBLE || ' percentage points' AS coverage FROM o""")
def change_texts(spark, sf_dir):
    c = F.col("o_custkey") % 21 - 10
    return s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), temporal.class_change_text(F.col("o_orderkey"), F.col("o_orderstatus"), F.left("o_orderpriority", F.lit(1))).alias("classes"), temporal.count_change_text(F.col("o_orderkey"), c, numeric.direction(c)).alias("counts"), temporal.coverage_change_text(c / 2).alias("coverage"))


@query("""WITH p AS (SELECT p_partkey AS id, (p_size - 1) / 4.0::DOUBLE AS gsd, (p_partkey % 9)::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS x2, (p_size % 5) / 3.0::DOUBLE AS score, (p_partkey % 300)::INT AS w, (p_size * 7)::INT AS h FROM part),
    c AS (SELECT *, greatest(3.0::DOUBLE, 1.5::DOUBLE / (greatest(gsd, 0.01) / 100)) AS low FROM p)
    SELECT id, low AS min_px, greatest(2 * low, 12.0::DOUBLE / (greatest(gsd, 0.01) / 100)) AS max_px, greatest(4, floor(0.25::DOUBLE * low * low))::INT AS min_area_px, CASE WHEN x2 > x THEN x / 0.5 END AS x_min, CASE WHEN x2 > x THEN x2 / 0.5 END AS x_max, CASE WHEN x2 > x THEN round(least(greatest(score, 0), 1), 3) END AS confidence, ((w // 64) * (h // 64))::BIGINT AS tiles FROM c""")
def crown_rules(spark, sf_dir):
    """Crown sizes, boxes of resized pictures, and numbers of whole tiles."""
    k, n = F.col("p_partkey"), F.col("p_size")
    rows = s.table(spark, sf_dir, "part").select(k.alias("id"), ((n - 1) / 4.0).alias("gsd"), (k % 9).cast("double").alias("x_min"), (k % 7).cast("double").alias("x_max"), F.lit(0.0).alias("y_min"), F.lit(1.0).alias("y_max"), ((n % 5) / 3.0).alias("confidence"), (k % 300).cast("int").alias("width"), (n * 7).cast("int").alias("height"))
    limits = rows.select("id", *(v.alias(c) for c, v in detections.crown_limits(F.col("gsd"), 1.5, 12.0).items()))
    boxes = detections.rescaled(rows.select("id", "x_min", "x_max", "y_min", "y_max", "confidence"), F.lit(0.5)).select("id", "x_min", "x_max", "confidence")
    tiles = detections.full_tiles(rows.select("id", "width", "height"), 64).groupBy("id").agg(F.count("*").alias("tiles"))
    return limits.join(boxes, "id", "left").join(tiles, "id", "left").fillna(0, ["tiles"])


@query("""WITH i AS (SELECT c_custkey AS id, 'd/' || c_custkey || '.' || ['JPG', 'png', 'tiff', 'bmp'][1 + (c_custkey % 4)::INT] AS path FROM customer),
    f AS (SELECT c_custkey AS id, unnest(CASE c_custkey % 5 WHEN 0 THEN ['wld', 'JGW', 'pngw'] WHEN 1 THEN ['WLD'] WHEN 2 THEN ['tiffw', 'pgw'] WHEN 3 THEN ['jgw', 'TFW', 'tfw'] ELSE [] END) AS ext FROM customer),
    w AS (SELECT * FROM (VALUES (0, 0, 'jgw'), (0, 1, 'wld'), (0, 2, 'jpgw'), (0, 3, 'jpegw'), (1, 0, 'pgw'), (1, 1, 'wld'), (1, 2, 'pngw'), (2, 0, 'tfw'), (2, 1, 'wld'), (2, 2, 'tiffw'), (3, 0, 'wld')) AS v(k, n, ext)),
    c AS (SELECT i.id, min_by(f.ext, w.n * 2 + (f.ext <> w.ext)::INT) AS ext FROM i JOIN f USING (id) JOIN w ON w.k = i.id % 4 AND w.ext = lower(f.ext) GROUP BY i.id)
    SELECT path, CASE WHEN c.ext IS NOT NULL THEN 'd/' || id || '.' || c.ext END AS world_file FROM i LEFT JOIN c USING (id)""")
def world_file_candidates(spark, sf_dir):
    k = F.col("c_custkey")
    rows = s.table(spark, sf_dir, "customer")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), n.cast("int"))
    images = rows.select(F.concat(F.lit("d/"), k.cast("string"), F.lit("."), pick(("JPG", "png", "tiff", "bmp"), k % 4)).alias("path"))
    there = F.get(F.array(*(F.array(*map(F.lit, e)) if e else F.array().cast("array<string>") for e in (("wld", "JGW", "pngw"), ("WLD",), ("tiffw", "pgw"), ("jgw", "TFW", "tfw"), ()))), (k % 5).cast("int"))
    files = rows.select(k, F.explode(there).alias("e")).select(F.concat(F.lit("d/"), k.cast("string"), F.lit("."), "e").alias("path"))
    return fields.world_files(images, files)


@query("""SELECT l_returnflag AS label, sum(CASE WHEN l_linenumber % 2 = 0 THEN (l_quantity - 20)::BIGINT * (l_quantity > 20)::INT ELSE l_quantity::BIGINT END)::BIGINT AS total FROM lineitem GROUP BY 1""")
def stacked_totals(spark, sf_dir):
    """Heights of stacks: negative parts don't count."""
    v = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") - 20).otherwise(F.col("l_quantity")).cast("long")
    return layers.stacked(s.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), v.alias("value")), "label", "value")
