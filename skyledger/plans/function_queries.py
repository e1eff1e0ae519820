"""Registered queries over column functions: validation, formats, times, numbers, positions, colours, projections. The SQL states each rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, indices, metrics, numeric, text, times
from ..operators import catalog, detections, temporal
from . import standins as s
from .registry import query

_TEXTS = "['plot-1', ' a b ', '', 'Café ☕', '#1F3', '#12ab9F', '#12345', 'ortho_77', 'ortho_', 'a/b.c/d e.JPG', 'snake_case_key', '9bcd', '3f2504e0-4f89-11d3-9a0c-0305e82c3301', 'manual-7', 'x' || repeat('y', 99), 'say \"hi\", <b>&''x''</b>', 'L_1234567890.jpg', 'L_12.jpg', 'dir\\\\file.tar.gz', 'none']"
_PICK = f"t AS (SELECT c_custkey AS id, c_mktsegment AS segment, {_TEXTS}[1 + (c_custkey % 20)::INT] AS x FROM customer)"


def _texts(spark, sf_dir):
    values = ["plot-1", " a b ", "", "Café ☕", "#1F3", "#12ab9F", "#12345", "ortho_77", "ortho_", "a/b.c/d e.JPG", "snake_case_key", "9bcd", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "manual-7", "x" + "y" * 99, "say \"hi\", <b>&'x'</b>", "L_1234567890.jpg", "L_12.jpg", "dir\\\\file.tar.gz", "none"]
    k = F.col("c_custkey")
    return s.table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_mktsegment").alias("segment"), F.get(F.array(*map(F.lit, values)), (k % 20).cast("int")).alias("x"))


@query(f"""WITH {_PICK} SELECT id, length(trim(x)) BETWEEN 1 AND 100 AS name, length(trim(x)) BETWEEN 1 AND 10 AS short_name, regexp_full_match(x, '[A-Za-z0-9_-]{{1,64}}') AS result_id, regexp_full_match(x, '#([0-9A-Fa-f]{{3}}|[0-9A-Fa-f]{{6}})') AS hex_color,
    regexp_full_match(x, '[a-z][a-z0-9_]{{0,39}}') AND x <> 'none' AS field_key, regexp_full_match(x, 'ortho_[0-9]+') AS ortho_id, regexp_full_match(x, '[a-z0-9_-]+') AS plugin_id, regexp_full_match(lower(x), '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') AS uuid, regexp_full_match(x, 'L_[0-9]{{10,}}\\.(jpg|jpeg|png|webp)') AS owned FROM t""")
def text_rules(spark, sf_dir):
    """Names, notes, identifiers, colours, field keys and photos that are accepted or not."""
    x = F.col("x")
    return _texts(spark, sf_dir).select(
        "id", text.valid_name(x).alias("name"), text.valid_name(x, 10).alias("short_name"), text.valid_result_id(x).alias("result_id"), text.valid_hex_color(x).alias("hex_color"), text.valid_field_key(x, ("none",)).alias("field_key"), text.valid_ortho_id(x).alias("ortho_id"),
        text.valid_plugin_id(x).alias("plugin_id"), text.valid_uuid(x).alias("uuid"), text.owned_photo(F.lit("L"), x).alias("owned"),
    )


@query(f"""WITH {_PICK}, p AS (SELECT *, regexp_extract(x, '[^/\\\\]*$') AS base FROM t)
    SELECT id, CASE WHEN contains(x, ',') OR contains(x, '"') OR contains(x, chr(10)) THEN '"' || replace(x, '"', '""') || '"' ELSE x END AS csv, replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, coalesce(nullif(trim(x), ''), 'Plot ' || id) AS plot,
        CASE WHEN x = '' THEN 'layer' ELSE left(regexp_replace(x, '[^A-Za-z0-9_-]', '_', 'g'), 64) END AS layer, base, lower(regexp_extract(base, '\\.([^.]*)$', 1)) AS extension, regexp_replace(base, '\\.[^.]*$', '') AS stem, regexp_replace(x, '\\.[^.]*$', '') || ' (' || id || ')' || regexp_extract(x, '(\\.[^.]*)$', 1) AS suffixed,
        array_to_string(list_transform(string_split(x, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS human, CASE WHEN starts_with(x, 'manual-') THEN x ELSE 'manual-' || x END AS manual, printf('%s-m-%04d', x, id) AS detection, left(x, 8) AS short FROM p""")
def text_forms(spark, sf_dir):
    """Cells, markup, names of plots, layers and files, headings, ids."""
    x, k = F.col("x"), F.col("id")
    return _texts(spark, sf_dir).select(
        "id", text.csv_cell(x).alias("csv"), text.html_escape(x).alias("html"), text.plot_name(k, x).alias("plot"), text.layer_id(x).alias("layer"), text.basename(x).alias("base"), text.extension(x).alias("extension"), text.stem(x).alias("stem"), text.suffixed(x, k).alias("suffixed"),
        text.humanized(x).alias("human"), text.manual_id(x).alias("manual"), text.detection_id(x, F.lit("m"), k).alias("detection"), text.short_id(x).alias("short"),
    )


@query("""WITH q AS (SELECT l_orderkey AS id, l_linenumber AS line, l_quantity * 300 + 0.3 AS v, l_returnflag AS unit, CASE l_linenumber WHEN 1 THEN 4326 WHEN 2 THEN 3857 WHEN 3 THEN 2154 ELSE 32600 + l_orderkey % 170 END AS crs FROM lineitem)
    SELECT id, line, CASE WHEN v >= 10000 THEN printf('%.2f ha', v / 10000) ELSE printf('%.1f m²', v) END AS area, CASE WHEN v >= 1000 THEN printf('%.2f km', v / 1000) ELSE printf('%.1f m', v) END AS length, (CASE WHEN v / 100 >= 100 THEN printf('%.0f', v / 100) ELSE printf('%.2f', v / 100) END) || ' ' || unit AS indicator,
        CASE WHEN l < 60 THEN l || 's' WHEN l < 3600 THEN (l // 60) || 'm ' || lpad((l % 60)::VARCHAR, 2, '0') || 's' ELSE (l // 3600) || 'h ' || lpad((l % 3600 // 60)::VARCHAR, 2, '0') || 'm' END AS duration,
        CASE line % 3 WHEN 0 THEN line * 10 END AS percent, CASE line % 3 WHEN 0 THEN 'at ' || id END AS message, CASE unit WHEN 'A' THEN 'm/px' WHEN 'N' THEN 'items' END AS default_unit, 'EPSG:' || crs || CASE WHEN crs = 4326 THEN ' (WGS84 Geodetic)' WHEN crs = 3857 THEN ' (Web Mercator)' WHEN crs BETWEEN 32601 AND 32660 THEN ' (UTM Zone ' || crs - 32600 || 'N)' WHEN crs BETWEEN 32701 AND 32760 THEN ' (UTM Zone ' || crs - 32700 || 'S)' ELSE '' END AS crs FROM (SELECT *, (v // 1)::BIGINT AS l FROM q)""")
def quantity_texts(spark, sf_dir):
    """Areas, lengths, indicators, durations, progress lines and units."""
    k = F.col
    v = k("l_quantity") * 300 + 0.3
    line = F.when(k("l_linenumber") % 3 == 0, F.format_string('PROGRESS:{"percent":%d,"message":"at %d"}', k("l_linenumber") * 10, k("l_orderkey"))).when(k("l_linenumber") % 3 == 1, "percent 5").otherwise("")
    p = text.progress(line)
    name = F.when(k("l_returnflag") == "A", "gsd_m").when(k("l_returnflag") == "N", "tree_count").otherwise("health")
    code = F.when(k("l_linenumber") == 1, 4326).when(k("l_linenumber") == 2, 3857).when(k("l_linenumber") == 3, 2154).otherwise(32600 + k("l_orderkey") % 170)
    return s.table(spark, sf_dir, "lineitem").select(
        k("l_orderkey").alias("id"), k("l_linenumber").alias("line"), text.area_text(v).alias("area"), text.length_text(v).alias("length"), text.indicator_text(v / 100, k("l_returnflag")).alias("indicator"), times.duration_text((v * 1000).cast("long")).alias("duration"),
        p["percent"].alias("percent"), p["message"].alias("message"), metrics.unit(name).alias("default_unit"), text.crs_name(code).alias("crs"),
    )


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS t0, o_orderdate + INTERVAL (o_orderkey % 4000) MILLISECOND AS made, o_orderkey % 4 AS k, o_orderstatus AS st FROM orders)
    SELECT id, CASE k WHEN 0 THEN t0 WHEN 1 THEN t0 END AS exif, CASE WHEN k = 3 THEN 'soon' ELSE strftime(t0, '%Y-%m-%dT%H:%M:%S.000Z') END AS shown, greatest(datediff('day', t0::DATE, DATE '1996-01-01'), 0)::INT AS age, (datediff('day', t0::DATE, made::DATE + (k)::INT) + 1)::INT AS span,
        NOT (k <> 1 AND epoch_ms(made) - epoch_ms(t0) <= 2000) AS has_range, CASE WHEN st = 'F' OR k = 0 THEN 3 ELSE 2 END AS stage FROM o""")
def time_rules(spark, sf_dir):
    """Camera times, shown times, ages, spans, placeholder ranges and stages of sessions."""
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    raw = F.date_format(at, "yyyy:MM:dd HH:mm:ss")
    made = F.timestamp_millis(F.unix_millis(at.cast("timestamp")) + F.col("o_orderkey") % 4000)
    exif = F.when(k == 0, F.concat(F.lit("  "), raw, F.lit("\0\0"))).when(k == 1, raw).when(k == 2, F.replace(raw, F.lit(":"), F.lit("-"))).otherwise("")
    shown = F.when(k == 3, "soon").otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return s.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), times.exif_time(exif).alias("exif"), times.display_time(shown).alias("shown"), times.age_days(at, F.lit("1996-01-01").cast("date")).alias("age"), times.span_days(at, F.date_add(made, k.cast("int"))).alias("span"),
        times.has_image_range(at, F.when(k == 1, F.date_add(at, 1).cast("timestamp_ntz")).otherwise(at), made).alias("has_range"), times.session_stage(F.when(F.col("o_orderstatus") == "F", "archived").otherwise("open"), k == 0).alias("stage"),
    )


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 5 AS k, (p_size - 5)::DOUBLE AS alt, (p_partkey % 7 * 10)::DOUBLE AS focal, 4000 AS w, 3000 AS h, p_retailprice AS v, (p_partkey % 400) - 20 AS c FROM part)
    SELECT id, CASE WHEN k = 0 THEN 0.5 WHEN alt > 0 AND focal > 0 THEN alt * 43.27 / (focal * 5000) WHEN alt > 0 THEN 2 * alt * tan(radians(60.0) / 2) / w END AS gsd, alt * 13.2 / (8.8 * w) AS sensor, CASE WHEN alt > 0 THEN id * alt * alt END AS area,
        CASE WHEN k <> 0 THEN alt / k END AS ratio, abs(alt) + 30 / 60.0::DOUBLE + 18 / 3600.0::DOUBLE AS degrees, 10 + 30 / 60.0::DOUBLE + (CASE WHEN k = 0 THEN 36 ELSE 36 / k::DOUBLE END) / 3600 AS lenient, CASE k WHEN 0 THEN -abs(alt) WHEN 1 THEN abs(alt) WHEN 2 THEN -abs(alt) WHEN 3 THEN abs(alt) END AS side,
        CASE WHEN k = 1 THEN -alt ELSE alt END AS height, CASE WHEN c BETWEEN -90 AND 90 AND NOT (c = 0) THEN c::DOUBLE END AS lat, CASE WHEN c BETWEEN -90 AND 90 AND NOT (c = 0) THEN c::DOUBLE END AS lon, least(greatest(alt / 10, 0.1), 4.0) AS scale,
        CASE WHEN k = 0 THEN floor(least(greatest(c * 255.0::DOUBLE / 65535, 0), 255) + 0.5) ELSE floor(least(greatest((c - 50) * 255.0::DOUBLE / 200, 0), 255) + 0.5) END::INT AS stretched, c BETWEEN 0 AND 100 AS coverage FROM p""")
def number_rules(spark, sf_dir):
    """Ground resolution by three ways, areas, rationals, degrees, hemispheres, heights, positions, scales, stretches, coverage."""
    n = F.col("p_partkey")
    k, alt, focal, c = n % 5, (F.col("p_size") - 5).cast("double"), (n % 7 * 10).cast("double"), n % 400 - 20
    w, h, at = F.lit(4000), F.lit(3000), c.cast("double")
    pair = numeric.gps_pair(at, at)
    refs = F.get(F.array(F.lit("S"), F.lit(" n "), F.lit("w"), F.lit("E"), F.lit("?")), k.cast("int"))
    return s.table(spark, sf_dir, "part").select(
        n.alias("id"), numeric.gsd(F.when(k == 0, 0.5), alt, focal, w, h).alias("gsd"), numeric.gsd_sensor(alt, F.lit(13.2), F.lit(8.8), w).alias("sensor"), numeric.area_from_pixels(n, alt).alias("area"), numeric.rational(alt, k).alias("ratio"), numeric.dms(alt, F.lit(-30.0), F.lit(18.0)).alias("degrees"),
        numeric.dms_lenient(F.array(F.lit(10), F.lit(30), F.lit(36)), F.array(F.lit(1), F.lit(0), k.cast("int"))).alias("lenient"), numeric.hemisphere(alt, refs).alias("side"), numeric.signed_altitude(alt, k).alias("height"), pair["lat"].alias("lat"), pair["lon"].alias("lon"), numeric.detector_scale(alt).alias("scale"),
        numeric.stretch_8bit(at, F.lit(50.0), F.lit(250.0), k == 0).alias("stretched"), numeric.valid_coverage(at).alias("coverage"),
    )


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, ((l_partkey * 31 + l_linenumber * 17) % 256)::DOUBLE AS r, ((l_orderkey * 13 + l_suppkey * 7) % 256)::DOUBLE AS g, ((l_partkey + l_orderkey) % 256)::DOUBLE AS b FROM lineitem),
    u AS (SELECT *, r / 255 AS x, g / 255 AS y, b / 255 AS z, r + g + b AS t, g + r - b AS d FROM p),
    v AS (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo, CASE WHEN t = 0 THEN 0 ELSE 2 * (g / t) - r / t - b / t END AS exg, CASE WHEN t = 0 THEN 0 ELSE g / t - 1.4::DOUBLE * (r / t) END AS exr, CASE WHEN abs(d) < 1 THEN 0 ELSE least(greatest((g - r) / d, -1), 1) END AS vari FROM u),
    c AS (SELECT *, hi - lo AS dl, CASE WHEN hi - lo < 1e-6 THEN 0 WHEN hi = x THEN 60 * ((y - z) / (hi - lo)) WHEN hi = y THEN 60 * ((z - x) / (hi - lo) + 2) ELSE 60 * ((x - y) / (hi - lo) + 4) END AS h0, (hi + lo) / 2 AS light, (2 * y - x - z) / (x + y + z + 1e-6) > 0.05 AND y > x AND (x + y + z + 1e-6) / 3 > 0.08 AND (x + y + z + 1e-6) / 3 < 0.92 AS canopy, (x - z) / (x + z + 1e-6) AS rb FROM v),
    e AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS hue, CASE WHEN dl < 1e-6 THEN 0 WHEN light <= 0.5 THEN dl / (hi + lo + 1e-6) ELSE dl / (2.0 - hi - lo + 1e-6) END AS sat FROM c)
    SELECT id, line, exg, exr, vari, round(hue, 9) AS hue, round(sat, 9) AS saturation, light AS lightness, rb AS rbvi, canopy AND hue BETWEEN 50 AND 75 AND sat > 0.2 AS yellowing, canopy AND rb > 0.15 AND x > 0.9 * y AS browning, CASE WHEN g > r THEN floor(0.6::DOUBLE * r + 0.4::DOUBLE * 200) ELSE r END::INT AS overlay FROM e""")
def colour_rules(spark, sf_dir):
    """Indices of the detection family, hue, saturation, lightness, red-blue index, yellowing, browning and tints."""
    k = F.col
    r, g, b = ((k("l_partkey") * 31 + k("l_linenumber") * 17) % 256).cast("double"), ((k("l_orderkey") * 13 + k("l_suppkey") * 7) % 256).cast("double"), ((k("l_partkey") + k("l_orderkey")) % 256).cast("double")
    rows = s.table(spark, sf_dir, "lineitem").select(k("l_orderkey").alias("id"), k("l_linenumber").alias("line"), r.alias("r"), g.alias("g"), b.alias("b"))
    unit, full = [k(c) / 255 for c in "rgb"], [k(c) for c in "rgb"]
    hsl, canopy = indices.hsl(*unit), indices.is_canopy(*unit)
    return rows.select(
        "id", "line", *(indices.detection_index(m, *full).alias(m) for m in ("exg", "exr", "vari")), F.round(hsl["hue"], 9).alias("hue"), F.round(hsl["saturation"], 9).alias("saturation"), hsl["lightness"].alias("lightness"), indices.rbvi(unit[0], unit[2]).alias("rbvi"),
        indices.is_yellowing(*unit, canopy).alias("yellowing"), indices.is_browning(*unit, canopy).alias("browning"), indices.overlay(k("r"), k("g") > k("r"), 200.0).alias("overlay"),
    )


@query("""WITH p AS (SELECT o_orderkey AS id, (o_orderkey % 120)::DOUBLE AS v, (o_orderkey % 7)::DOUBLE AS m, (o_custkey % 5)::DOUBLE AS w, o_orderkey % 3 AS k FROM orders),
    a AS (SELECT *, v - w * 20 AS change FROM p)
    SELECT id, CASE WHEN m + w + k = 0 THEN 'none' WHEN m >= w AND m >= k THEN 'vigorous' WHEN w >= k THEN 'moderate' ELSE 'severe' END AS dominant, CASE WHEN k >= w AND k >= m THEN 'severe' WHEN w >= m THEN 'moderate' ELSE 'vigorous' END AS of_cell, change, CASE WHEN change > 0 THEN 'bertambah' WHEN change < 0 THEN 'berkurang' ELSE 'tetap' END AS direction,
        CASE WHEN abs(change) >= 15 THEN 'tinggi' WHEN abs(change) >= 5 THEN 'sedang' ELSE 'rendah' END AS magnitude,
        CASE WHEN least(m + 4, w + 5) > greatest(m, w) AND least(3, k + 2) > greatest(0, k) THEN (least(m + 4, w + 5) - greatest(m, w)) * (least(3, k + 2) - greatest(0, k)) / (12 + 10 - (least(m + 4, w + 5) - greatest(m, w)) * (least(3, k + 2) - greatest(0, k))) ELSE 0 END::DOUBLE AS iou FROM a""")
def comparison_rules(spark, sf_dir):
    """Dominant classes of images and cells, direction and level of a change, overlap of boxes."""
    n = F.col("o_orderkey")
    v, m, w, k = (n % 120).cast("double"), (n % 7).cast("double"), (F.col("o_custkey") % 5).cast("double"), n % 3
    change = v - w * 20
    a = {"x_min": m, "x_max": m + 4, "y_min": F.lit(0.0), "y_max": F.lit(3.0)}
    b = {"x_min": w, "x_max": w + 5, "y_min": k.cast("double"), "y_max": (k + 2).cast("double")}
    return s.table(spark, sf_dir, "orders").select(n.alias("id"), indices.dominant(m, w, k).alias("dominant"), indices.dominant_of_cell(m, w, k).alias("of_cell"), change.alias("change"), numeric.direction(change).alias("direction"), numeric.magnitude_level(F.abs(change)).alias("magnitude"), numeric.iou(a, b).alias("iou"))


@query("""WITH p AS (SELECT o_orderkey AS id, ((o_orderkey * 37) % 3600) / 10.0::DOUBLE - 180 AS lon, ((o_orderkey * 53) % 1600) / 10.0::DOUBLE - 80 AS lat, o_orderkey % 4 AS k, (o_custkey % 9 + 1)::DOUBLE AS s FROM orders),
    b AS (SELECT *, s * 0.01 AS g, cos(radians(lat)) AS c FROM p)
    SELECT id, round(lon, 6) AS mercator_lon, round(lat, 6) AS mercator_lat, round(lon, 5) AS utm_lon, round(lat, 5) AS utm_lat, k <> 3 AS coordinate, k IN (0, 1) AS ring, round(lon - 4000 * g / 2 / (111320 * c), 9) AS west, round(lat - 3000 * g / 2 / 111320, 9) AS south, round(lon + 4000 * g / 2 / (111320 * c), 9) AS east, round(lat + 3000 * g / 2 / 111320, 9) AS north,
        round(lon + 10.5 / 64 * s, 9) AS cell_lon, round(lat + s - 20.5 / 48 * s, 9) AS cell_lat, CASE WHEN s > 1 AND s < 3 THEN round(lon + 1, 9) END AS common_west, round(abs(s / 64 * 111320 * cos(radians(lat + s / 2)) * (s / 48 * 111320)), 4) AS cell_m2 FROM b WHERE abs(lon) < 179 AND abs(lat) < 79""")
def position_rules(spark, sf_dir):
    """Projections there and back, valid places and rings, bounds from a resolution, cell centres, common rectangles, cell areas."""
    n = F.col("o_orderkey")
    rows = s.table(spark, sf_dir, "orders").select(n.alias("id"), ((n * 37 % 3600) / 10.0 - 180).alias("lon"), ((n * 53 % 1600) / 10.0 - 80).alias("lat"), (n % 4).alias("k"), (F.col("o_custkey") % 9 + 1).cast("double").alias("s")).filter("abs(lon) < 179 and abs(lat) < 79")
    lon, lat, k, size = (F.col(c) for c in ("lon", "lat", "k", "s"))
    zone, south = F.floor((lon + 180) / 6).cast("int") + 1, lat < 0
    rows = rows.select("*", *(v.alias(f"_m{c}") for c, v in geo.mercator(lat, lon).items()), *(v.alias(f"_u{c}") for c, v in geo.utm(lat, lon, zone, south).items()))
    code = F.when(south, zone + 32700).otherwise(zone + 32600)
    merc, utm = geo.to_wgs84(F.col("_mx"), F.col("_my"), F.lit(3857)), geo.to_wgs84(F.col("_ueasting"), F.col("_unorthing"), code)
    box = geo.bounds_from_gsd(lat, lon, size * 0.01, F.lit(4000), F.lit(3000))
    own = {"west": lon, "south": lat, "east": lon + size, "north": lat + size}
    common = geo.intersected(own, {"west": lon + 1, "south": lat, "east": lon + 5, "north": lat + 1})
    ring = F.array(F.array(lon, lat), F.array(lon + 0.5, lat), F.array(lon + 0.5, lat + 0.5), F.when(k == 1, F.array(lon, lat + 0.5)).otherwise(F.array(lon, lat)), F.when(k == 2, F.array(lon, lat + 0.1)).when(k == 3, F.array(lon)).otherwise(F.array(lon, lat)))
    center = geo.pixel_center(F.lit(10), F.lit(20), own, F.lit(64), F.lit(48))
    at = lambda c, digits=9: F.round(c, digits)
    return rows.select(
        "id", at(merc["lon"], 6).alias("mercator_lon"), at(merc["lat"], 6).alias("mercator_lat"), at(utm["lon"], 5).alias("utm_lon"), at(utm["lat"], 5).alias("utm_lat"), geo.valid_coordinate(lon, F.when(k == 3, lat + 200).otherwise(lat)).alias("coordinate"), geo.valid_ring(ring).alias("ring"), *(at(box[c]).alias(c) for c in ("west", "south", "east", "north")),
        at(center["lon"]).alias("cell_lon"), at(center["lat"]).alias("cell_lat"), F.when(size < 3, at(common["west"])).alias("common_west"), at(geo.pixel_area(own["west"], own["south"], own["east"], own["north"], F.lit(64), F.lit(48)), 4).alias("cell_m2"),
    )


@query("""WITH d AS (SELECT l_orderkey AS image_id, l_linenumber AS seq, (l_quantity * 2)::INT / 100.0::DOUBLE AS confidence FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, seq) AS n FROM d WHERE confidence >= 0.5)
    SELECT image_id, seq, printf('%d-tree-%04d', image_id, n) AS detection_id FROM k""")
def numbered_detections(spark, sf_dir):
    """Detections from a confidence on, numbered in each image from the most confident."""
    rows = s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), ((F.col("l_quantity") * 2).cast("int") / 100.0).alias("confidence"))
    return detections.numbered(detections.filter_confidence(rows, 0.5), "tree").select("image_id", "seq", "detection_id")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey = 7 THEN 'Field seven' ELSE c_name END AS name, CASE WHEN c_custkey = 9 THEN 'archived' ELSE c_mktsegment END AS status, round(abs(c_acctbal) / 100 - 100, 2) AS change FROM customer WHERE c_nationkey = 3 OR c_nationkey IS NULL""")
def session_edits(spark, sf_dir):
    """Sessions of a project after a new name and a new status, with a change of coverage."""
    rows = s.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"), F.col("c_nationkey").alias("project_id"), "c_acctbal")
    rows = catalog.updated(catalog.renamed(rows, 7, "Field seven"), "id", 9, status="archived").filter(catalog.in_project(3))
    return rows.select("id", "name", "status", F.round(temporal.coverage_change(F.lit(100.0), F.abs("c_acctbal") / 100), 2).alias("change"))
