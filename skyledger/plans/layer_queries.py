"""Payload documents, comparisons, map layers, and column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload, text, times
from ..operators import catalog, comparisons, layers
from . import standins as s
from .registry import query


_DOCS = """d AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, (o_orderkey % 100)::INT AS w, (o_custkey % 50)::INT AS b FROM orders),
    t AS (SELECT id, k, CASE k WHEN 0 THEN printf('{"parameters":{"image_bounds":[%d,%d,%d,%d.5]}}', w, b, w + 2, b + 1) WHEN 1 THEN printf('{"parameters":{"image_bounds":"[%d,%d,%d,%d.5]"}}', w, b, w + 2, b + 1)
        WHEN 2 THEN printf('{"parameters":{},"aoi":{"geometry":{"coordinates":[[[%d,%d],["x",1],[%d,%d],[%d,%d.5]]]}}}', w, b, w + 2, b, w + 2, b + 1) WHEN 3 THEN printf('{"parameters":{"image_bounds":[%d,%d,%d,%d]}}', w + 2, b, w, b + 1)
        WHEN 4 THEN printf('{"aoi":{"geometry":{"coordinates":[%d,%d,%d,%d]}}}', w + 3, b, w, b + 1) WHEN 5 THEN printf('{"aoi":[%d,%d,%d,%d]}', w, b, w + 3, b + 1)
        WHEN 6 THEN printf('{"aoi":{"geometry":{"coordinates":[[[%d,%d],[%d,%d]]]}},"parameters":{"image_bounds":" "}}', w, b, w + 2, b + 1) ELSE printf('{"parameters":{"image_bounds":[%d,"x",%d,%d,%d]}}', w, b, w + 1, b + 1) END AS doc FROM d)"""


def _payloads(spark, sf_dir):
    """Documents with an override as array or text, a ring with a bad point, an override out of order, a box in any order, an area that is no geometry, a ring of two points, and an override with a text in it."""
    k, w, b = F.col("o_orderkey") % 8, (F.col("o_orderkey") % 100).cast("int"), (F.col("o_custkey") % 50).cast("int")
    f = F.format_string
    doc = (
        F.when(k == 0, f('{"parameters":{"image_bounds":[%d,%d,%d,%d.5]}}', w, b, w + 2, b + 1)).when(k == 1, f('{"parameters":{"image_bounds":"[%d,%d,%d,%d.5]"}}', w, b, w + 2, b + 1))
        .when(k == 2, f('{"parameters":{},"aoi":{"geometry":{"coordinates":[[[%d,%d],["x",1],[%d,%d],[%d,%d.5]]]}}}', w, b, w + 2, b, w + 2, b + 1)).when(k == 3, f('{"parameters":{"image_bounds":[%d,%d,%d,%d]}}', w + 2, b, w, b + 1))
        .when(k == 4, f('{"aoi":{"geometry":{"coordinates":[%d,%d,%d,%d]}}}', w + 3, b, w, b + 1)).when(k == 5, f('{"aoi":[%d,%d,%d,%d]}', w, b, w + 3, b + 1))
        .when(k == 6, f('{"aoi":{"geometry":{"coordinates":[[[%d,%d],[%d,%d]]]}},"parameters":{"image_bounds":" "}}', w, b, w + 2, b + 1)).otherwise(f('{"parameters":{"image_bounds":[%d,"x",%d,%d,%d]}}', w, b, w + 1, b + 1))
    )
    return s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.try_parse_json(doc).alias("v"))


_NUMBERS = "list_transform(list_filter({0}::JSON[], lambda x: json_type(x) IN ('BIGINT', 'UBIGINT', 'DOUBLE')), lambda x: x::DOUBLE)"
_PARTS = f"""o AS (SELECT *, json_extract(doc, '$.parameters.image_bounds') AS raw, json_extract(doc, '$.aoi.geometry') AS geom FROM t),
    n AS (SELECT *, CASE json_type(raw) WHEN 'ARRAY' THEN raw WHEN 'VARCHAR' THEN CASE WHEN trim(raw->>'$') <> '' THEN (raw->>'$')::JSON END END AS inside, json_extract(geom, '$.coordinates') AS c FROM o),
    v AS (SELECT *, {_NUMBERS.format("inside")} AS over, CASE WHEN json_type(c) = 'ARRAY' THEN {_NUMBERS.format("c")} END AS box, CASE WHEN json_type(json_extract(c, '$[0]')) = 'ARRAY' THEN json_extract(c, '$[0]')::JSON[] END AS points FROM n),
    r AS (SELECT *, list_filter(points, lambda p: json_type(json_extract(p, '$[0]')) IN ('BIGINT', 'UBIGINT', 'DOUBLE') AND json_type(json_extract(p, '$[1]')) IN ('BIGINT', 'UBIGINT', 'DOUBLE')) AS good, len(over) = 4 AND over[3] > over[1] AND over[4] > over[2] AS ok FROM v),
    q AS (SELECT *, list_transform(good, lambda p: json_extract(p, '$[0]')::DOUBLE) AS xs, list_transform(good, lambda p: json_extract(p, '$[1]')::DOUBLE) AS ys FROM r),
    e AS (SELECT *, [list_min(xs), list_min(ys), list_max(xs), list_max(ys)] AS ring FROM q)"""


@query(f"""WITH {_DOCS}, {_PARTS}, f AS (SELECT id, CASE WHEN ok THEN over WHEN len(good) >= 3 THEN ring WHEN len(box) = 4 THEN box ELSE [-1.0, -2.0, 1.0, 2.0]::DOUBLE[] END AS b FROM e)
    SELECT id, b[1] AS west, b[2] AS south, b[3] AS east, b[4] AS north FROM f""")
def payload_bounds(spark, sf_dir):
    """Override, else ring, else four numbers, else the GPS bounds -1, -2, 1, 2; the SQL reads the same documents."""
    out = _payloads(spark, sf_dir).select("id", payload.bounds(F.col("v"), F.array(F.lit(-1.0), F.lit(-2.0), F.lit(1.0), F.lit(2.0))).alias("b"))
    return out.select("id", *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))))


@query(f"""WITH {_DOCS}, {_PARTS}, f AS (SELECT id, CASE WHEN ok THEN over WHEN json_type(geom) = 'OBJECT' THEN CASE WHEN len(points) > 0 AND len(good) = len(points) THEN ring END WHEN id % 3 <> 0 THEN [-1.0, -2.0, 1.0, 2.0]::DOUBLE[] END AS b FROM e)
    SELECT id, b[1] AS west, b[2] AS south, b[3] AS east, b[4] AS north FROM f""")
def image_bounds(spark, sf_dir):
    """A geometry that is there decides, good or not; else GPS bounds where position, resolution and altitude are told, which every third document lacks."""
    meta = F.try_parse_json(F.when(F.col("id") % 3 == 0, '{"gps":{"lat":1},"resolution":{},"relative_altitude":3}').otherwise('{"gps":{"lat":1},"resolution":"4x3","relative_altitude":3}'))
    out = _payloads(spark, sf_dir).select("id", payload.image_bounds(F.col("v"), meta, F.array(F.lit(-1.0), F.lit(-2.0), F.lit(1.0), F.lit(2.0))).alias("b"))
    return out.select("id", *(F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))))


@query("""WITH e AS (SELECT event_id AS id, event_id % 6 AS k, (event_id % 40) / 8.0::DOUBLE AS x FROM events)
    SELECT id, CASE WHEN k IN (0, 1, 2) THEN 0.1 WHEN k IN (3, 4) THEN x END AS threshold, CASE WHEN k IN (3, 4) THEN x END AS number, CASE k WHEN 0 THEN false WHEN 1 THEN false WHEN 3 THEN x <> 0 ELSE true END AS truthy FROM e""")
def payload_parameters(spark, sf_dir):
    """Thresholds that are missing, null, "auto", a number, text with a number, and other text."""
    k, x = F.col("event_id") % 6, ((F.col("event_id") % 40) / 8.0).cast("string")
    doc = F.when(k == 0, "{}").when(k == 1, '{"t":null}').when(k == 2, '{"t":" AUTO "}').when(k == 3, F.concat(F.lit('{"t":'), x, F.lit("}"))).when(k == 4, F.concat(F.lit('{"t":" '), x, F.lit('"}'))).otherwise('{"t":"none"}')
    v = F.col("v")
    rows = s.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.try_parse_json(doc).alias("v"))
    return rows.select("id", payload.threshold(v, "$.t", F.lit(0.1)).alias("threshold"), payload.number_or_text(v, "$.t").alias("number"), payload.truthy(payload.member(v, "$.t")).alias("truthy"))


_KINDS = "['1.5', 'null', 'true', '[1]', '{\"a\":1}', '\"' || repeat('ab', (l_linenumber * 20 + l_quantity)::INT) || '\"']"


@query(f"""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, {_KINDS} AS v, (l_orderkey % 7)::INT AS i, (l_partkey % 6)::INT AS j, ['number', 'boolean', 'text', NULL, 'shape'][1 + l_suppkey % 5] AS field FROM lineitem),
    d AS (SELECT id, line, field, v[1 + i]::JSON AS old, v[1 + j]::JSON AS new FROM p),
    k AS (SELECT *, CASE json_type(old) WHEN 'DOUBLE' THEN 'n' WHEN 'BOOLEAN' THEN 'b' WHEN 'VARCHAR' THEN 's' WHEN 'NULL' THEN 'z' WHEN 'ARRAY' THEN 'c' WHEN 'OBJECT' THEN 'c' END AS a,
                 CASE json_type(new) WHEN 'DOUBLE' THEN 'n' WHEN 'BOOLEAN' THEN 'b' WHEN 'VARCHAR' THEN 's' WHEN 'NULL' THEN 'z' ELSE 'c' END AS b, length(new->>'$') > 200 AS long FROM d)
    SELECT id, line, CASE
        WHEN a IS NULL THEN CASE WHEN field = 'number' THEN CASE WHEN b <> 'n' THEN 'wrong_type' END WHEN field = 'boolean' THEN CASE WHEN b <> 'b' THEN 'wrong_type' END WHEN field = 'shape' THEN 'unknown_kind' WHEN b = 's' THEN CASE WHEN long THEN 'too_long' END WHEN b <> 'z' THEN 'wrong_type' END
        WHEN a = 'c' THEN 'nested' WHEN a IN ('n', 'b') THEN CASE WHEN b <> a THEN 'wrong_type' END WHEN b = 's' THEN CASE WHEN long THEN 'too_long' END WHEN a = 's' OR b = 'c' THEN 'wrong_type' END AS problem FROM k""")
def edit_rules(spark, sf_dir):
    """Edits of numbers, nulls, flags, arrays, objects, text and properties that aren't there, by kind of field."""
    k = F.col
    text = F.concat(F.lit('"'), F.repeat(F.lit("ab"), (k("l_linenumber") * 20 + k("l_quantity")).cast("int")), F.lit('"'))
    values = F.array(F.lit("1.5"), F.lit("null"), F.lit("true"), F.lit("[1]"), F.lit('{"a":1}'), text)
    fields = F.array(*map(F.lit, ("number", "boolean", "text", None, "shape")))
    rows = s.table(spark, sf_dir, "lineitem").select(k("l_orderkey").alias("id"), k("l_linenumber").alias("line"), F.get(fields, (k("l_suppkey") % 5).cast("int")).alias("field"), F.try_parse_json(F.get(values, (k("l_orderkey") % 7).cast("int"))).alias("a"), F.try_parse_json(F.get(values, (k("l_partkey") % 6).cast("int"))).alias("b"))
    return rows.select("id", "line", payload.edit_problem(k("a"), k("b"), k("field")).alias("problem"))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'v' || s_suppkey WHEN s_suppkey % 3 = 1 THEN s_suppkey || '_' || s_nationkey ELSE '0_0' END AS token, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN 'f' || s_nationkey END AS thumbnail FROM supplier""")
def layer_tokens(spark, sf_dir):
    k, m = F.col("s_suppkey"), F.col("s_suppkey") % 3
    rows = s.table(spark, sf_dir, "supplier").withColumns({"at": F.when(m == 0, F.concat(F.lit(" v"), k.cast("string"))).when(m == 1, " "), "size": F.when(m != 2, k)})
    own = F.when(k % 4 == 0, F.concat(F.lit(" "), "s_name")).when(k % 4 == 1, "  ")
    urls = F.array(F.lit(" "), F.lit(None).cast("string"), F.when(k % 4 == 1, F.concat(F.lit("f"), F.col("s_nationkey").cast("string"))))
    return rows.select(k.alias("id"), payload.concurrency_token(F.col("at"), F.col("size"), F.col("s_nationkey")).alias("token"), payload.thumbnail(own, urls).alias("thumbnail"))


@query("""SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 3 <> 0 AND (c_custkey % 2 = 0 OR c_nationkey % 2 = 0) AND c_acctbal > 0 AND c_custkey % 11 <> 0 AS compatible,
    CASE WHEN c_acctbal <= 0 THEN 'no_gps' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'bad_format' END AS problem FROM customer""")
def compatible_targets(spark, sf_dir):
    rows, k = s.table(spark, sf_dir, "customer"), F.col("c_custkey")
    mimes, gps = F.array(F.lit("building"), F.lit("Machinery")), F.col("c_acctbal") > 0
    needs = F.when(k % 11 == 0, F.array(F.lit("GPS"), F.lit("depth"))).otherwise(F.array(F.lit("GPS")))
    ok = payload.compatible(mimes, F.lit("Image"), F.col("c_nationkey") % 2 == 0, needs, F.col("c_mktsegment"), F.when(k % 3 == 0, "plot").otherwise("IMAGE"), k % 2 == 1, {"gps": gps, "altitude": F.lit(True)})
    return rows.select(k.alias("id"), ok.alias("compatible"), payload.preflight(F.lit(True), mimes, gps, F.col("c_mktsegment")).alias("problem"))


@query("SELECT event_id AS id, user_id AS project_id, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def comparison_history(spark, sf_dir):
    """The latest 200 records (the history's own limit) of a table and what was appended to it."""
    rows = s.results(spark, sf_dir).select("id", F.col("session_id").alias("project_id"), "created_at", "plugin_id")
    table = comparisons.appended(rows.filter("plugin_id in ('view', 'click')"), rows.filter("plugin_id not in ('view', 'click')"))
    return comparisons.history(table, limit=200).select("id", "project_id", "created_at")


@query(f"""WITH {s.IMAGES}, r AS (SELECT user_id AS id, CASE WHEN bool_or(event_type = 'view' AND value IS NOT NULL) THEN max_by(value, (ts, event_id)) FILTER (event_type = 'view' AND value IS NOT NULL) ELSE max_by(value, (ts, event_id)) FILTER (event_type = 'click' AND value IS NOT NULL) END AS v FROM events GROUP BY 1)
    SELECT i.id AS image_id, CASE WHEN v IS NOT NULL THEN greatest(least(v, 100), 0) WHEN i.id % 2 = 0 THEN (i.id % 100)::DOUBLE END AS coverage_percent, CASE WHEN v IS NOT NULL THEN 'plugin:p' WHEN i.id % 2 = 0 THEN 'builtin:exg' END AS source FROM images i LEFT JOIN r USING (id)""")
def coverage_source(spark, sf_dir):
    """Stored coverage of images, the newest view before the newest click, else a computed one."""
    images = s.images(spark, sf_dir).select(F.col("id").alias("image_id"))
    runs = s.results(spark, sf_dir).select(F.col("session_id").alias("image_id"), F.col("plugin_id").alias("key"), "value", F.lit("p").alias("plugin_id"), "created_at", "id")
    fallback = images.filter("image_id % 2 = 0").withColumn("coverage_percent", (F.col("image_id") % 100).cast("double"))
    return comparisons.coverage_for(images, runs, fallback, ("view", "click"))


@query("""WITH e AS (SELECT *, 'f' || event_id AS path, CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END AS k FROM events WHERE event_id % 4 <> 0)
    SELECT user_id AS image_id, path AS file_path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k, ts DESC, event_id DESC) AS r FROM e WHERE k IS NOT NULL AND event_id % 3 <> 0) WHERE r = 1""")
def latest_artifact(spark, sf_dir):
    path = F.when(F.col("id") % 4 != 0, F.concat(F.lit("f"), F.col("id").cast("string")))
    rows = s.results(spark, sf_dir).select(F.col("session_id").alias("image_id"), F.col("plugin_id").alias("key"), F.when(F.col("id") % 3 == 0, "text/csv").otherwise("image/png").alias("format"), path.alias("file_path"), "created_at", "id")
    return comparisons.latest_artifact(rows, ["view", "purchase"], "image/")


@query(f"""WITH {s.IMAGES}, o AS (SELECT session_id, max_by(id, (captured_at, id)) AS image, max(captured_at) AS at FROM images WHERE captured_at IS NOT NULL GROUP BY 1), c AS (SELECT c_custkey AS id, c_nationkey AS p FROM customer)
    SELECT a.id AS before, b.id AS after, CASE WHEN ok THEN x.image END AS before_image, CASE WHEN ok THEN y.image END AS after_image, CASE WHEN ok THEN date_diff('day', x.at::DATE, y.at::DATE) END AS days, CASE WHEN ok THEN (y.image % 64 - x.image % 64)::DOUBLE END AS change,
        CASE WHEN a.p <> b.p THEN 'session_mismatch' WHEN NOT ok THEN 'no_dated_images' END AS problem
    FROM c a JOIN c b ON b.id = a.id + 1 + a.id % 25 LEFT JOIN o x ON x.session_id = a.id LEFT JOIN o y ON y.session_id = b.id, LATERAL (SELECT a.p = b.p AND x.image IS NOT NULL AND y.image IS NOT NULL AS ok)""")
def sessions_compared(spark, sf_dir):
    sessions = s.sessions(spark, sf_dir)
    pairs = sessions.select(F.col("id").alias("before"), (F.col("id") + 1 + F.col("id") % 25).alias("after"))
    seen = s.images(spark, sf_dir).select("session_id", F.col("id").alias("image_id"), "captured_at", (F.col("id") % 64).cast("double").alias("coverage"))
    return comparisons.sessions_compared(pairs, sessions, seen)


@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Umum' ELSE p_brand END AS sector, count(*) AS layers, min(p_type) AS first_name FROM part WHERE p_size % 10 <> 0 GROUP BY 1""")
def layer_sectors(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.concat_ws(" - ", "p_type", "p_brand", "p_name"))
    rows = s.table(spark, sf_dir, "part").select(name.alias("layer_name"), F.when(F.col("p_size") % 10 == 0, "image_overlay").otherwise("polygon").alias("display_type"))
    return layers.sectors(rows).groupBy("sector").agg(F.count("*").alias("layers"), F.min("layer_name").alias("first_name"))


_LAYERS = "l AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'image_overlay' WHEN 1 THEN 'point' WHEN 2 THEN 'line' ELSE 'polygon' END AS kind FROM orders), f AS (SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_returnflag = 'A' THEN 'Point' WHEN l_returnflag = 'R' THEN 'Line' ELSE 'Polygon' END AS kind FROM lineitem)"


def _layers(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    kind = F.when(k == 0, "image_overlay").when(k == 1, "point").when(k == 2, "line").otherwise("polygon")
    rows = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("layer_id"), kind.alias("display_type"))
    of = F.when(F.col("l_returnflag") == "A", "Point").when(F.col("l_returnflag") == "R", "LineString").otherwise("Polygon")
    return rows, s.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("layer_id"), of.alias("type"), F.col("l_linenumber").alias("n"), "l_quantity")


@query(f"""WITH {_LAYERS}, k AS (SELECT id, count(DISTINCT kind) AS kinds, min(kind) AS kind FROM f GROUP BY 1)
    SELECT l.id AS layer_id, l.kind AS display_type, CASE WHEN l.kind = 'image_overlay' THEN 'Overlay' WHEN kinds IS NULL THEN upper(l.kind[1]) || l.kind[2:] WHEN kinds = 1 THEN k.kind ELSE 'Mixed' END AS geom_type FROM l LEFT JOIN k USING (id)""")
def layer_geometry_kinds(spark, sf_dir):
    return layers.geometry_kinds(*_layers(spark, sf_dir))


@query("""SELECT l_orderkey AS layer_id, count(*) FILTER (l_quantity > 40) AS edited_features, max(l_linenumber % 3) AS custom_fields, count(*) FILTER (l_quantity > 40) > 0 OR max(l_linenumber % 3) > 0 AS has_edits FROM lineitem GROUP BY 1""")
def layer_edits(spark, sf_dir):
    rows = _layers(spark, sf_dir)[1].withColumns({"edited_fields": F.when(F.col("l_quantity") > 40, F.array(F.lit("name"))), "custom_fields": F.array_repeat(F.lit("x"), F.col("n") % 3)})
    return layers.manual_edits(rows)


@query(f"WITH {_LAYERS} SELECT l.id AS layer_id, l.kind AS display_type, (SELECT count(*) FROM f WHERE f.id = l.id) AS features, (SELECT count(*) FROM f WHERE f.id = l.id AND n > 3) AS photos FROM l")
def layer_dependents(spark, sf_dir):
    rows, features = _layers(spark, sf_dir)
    return layers.dependents(rows, features=features, photos=features.filter("n > 3"))


@query("""WITH i AS (SELECT DISTINCT user_id AS id FROM events), l AS (SELECT o_custkey AS id, o_orderpriority AS p FROM orders) SELECT id AS layer_id, 'register' AS action FROM i WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT DISTINCT id, 'remove' FROM l WHERE p = '1-URGENT' AND id NOT IN (SELECT id FROM i)""")
def layer_reconcile(spark, sf_dir):
    images = s.results(spark, sf_dir).select(F.col("session_id").alias("layer_id"))
    rows = s.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("layer_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "image_overlay").otherwise("polygon").alias("display_type"))
    return layers.reconciled(images, rows)


@query("SELECT n_nationkey AS layer_id, CASE WHEN n_nationkey = 3 THEN 10 WHEN n_nationkey BETWEEN 4 AND 10 THEN n_nationkey - 1 ELSE n_nationkey END AS z_index, CASE WHEN n_nationkey = 7 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS opacity FROM nation")
def layer_stack(spark, sf_dir):
    rows = s.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("layer_id"), F.col("n_nationkey").alias("z_index"), F.lit(1.0).alias("opacity"))
    return layers.faded(layers.reordered(rows, 3, 10), 7, 0.5)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE starts_with(n_name, 'NATION_7')")
def resolve_prefix(spark, sf_dir):
    """The one nation whose name begins so."""
    rows = s.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return layers.resolved(rows, "NATION_7")


@query("""WITH g AS (SELECT o_custkey AS id, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), w AS (SELECT min(epoch_ms(a)) AS lo, max(epoch_ms(b)) - min(epoch_ms(a)) AS span FROM g), r AS (SELECT id, (epoch_ms(a) - lo)::DOUBLE / span * 100 AS l, (epoch_ms(b) - epoch_ms(a))::DOUBLE / span * 100 AS x FROM g, w), q AS (SELECT id, l, greatest(6.0::DOUBLE, least(100 - l, CASE WHEN x = 0 THEN 6.0::DOUBLE ELSE x END)) AS width FROM r)
    SELECT id, round(width, 6) AS width_percent, round(greatest(0.0::DOUBLE, least(100 - width, l)), 6) AS left_percent FROM q""")
def session_timeline(spark, sf_dir):
    rows = s.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return layers.timeline(rows, "a", "b").select("id", F.round("width_percent", 6).alias("width_percent"), F.round("left_percent", 6).alias("left_percent"))


@query("""WITH r AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders), n AS (SELECT count(*) AS n FROM r) SELECT id FROM r WHERE i IN (SELECT floor(k * (n / 64.0::DOUBLE))::BIGINT FROM n, range(64) t(k))""")
def spread_images(spark, sf_dir):
    """64 images spread evenly over all by date: the feature is the sample."""
    rows = catalog.numbered(s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate"), "o_orderdate", "id")
    return layers.spread(rows, 64).select("id")


@query("""WITH t AS (SELECT l_returnflag AS label, sum(l_quantity::BIGINT) AS total FROM lineitem GROUP BY 1) SELECT label, total, greatest(1, least(240, floor(total / (max(total) OVER ()) * 240 + 0.5)))::DOUBLE AS bar_width, floor(total * 100.0::DOUBLE / (sum(total) OVER ()) + 0.5)::BIGINT AS share FROM t""")
def chart_shares(spark, sf_dir):
    rows = s.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.sum(F.col("l_quantity").cast("long")).alias("total"))
    return layers.shares(layers.bars(rows, "total"), "total")


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS destination, CASE WHEN value IS NOT NULL THEN printf('%.4f %s', value, event_type) ELSE 'n/a' END AS shown, CASE event_id % 3 WHEN 0 THEN 'Pohon: t' WHEN 1 THEN 'Petak: p' ELSE 'Fitur #' || (event_id + 1) END AS name,
    CASE event_id % 3 WHEN 0 THEN 't_' WHEN 1 THEN 'p' ELSE 'feat_' || lpad((event_id + 1)::VARCHAR, greatest(4, length((event_id + 1)::VARCHAR))::INT, '0') END AS feature_id, 'exec_' || strftime(ts, '%Y%m%d') || '_0123abcd' AS job, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'b' END AS first_text FROM events""")
def display_texts(spark, sf_dir):
    k, kind = F.col("event_id"), F.col("event_type")
    props = F.when(k % 3 == 0, F.create_map(F.lit("tree_id"), F.when(k >= 0, "t/"))).when(k % 3 == 1, F.create_map(F.lit("plot_id"), F.lit("p"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return s.table(spark, sf_dir, "events").select(
        k.alias("id"), text.destination_name(F.concat(F.lit("a/"), F.when(k % 3 == 0, "..").otherwise(kind))).alias("destination"), text.value_text(F.col("value"), F.lit("n/a"), kind).alias("shown"),
        F.replace(text.feature_name(props, k), F.lit("/")).alias("name"), text.feature_id(props, k).alias("feature_id"), text.job_id(F.col("ts"), F.lit("0123abcd-0000-0000-0000-000000000000")).alias("job"),
        text.first_text(F.lit(" "), F.when(k % 2 == 0, F.concat(F.lit(" "), kind)), F.lit("b")).alias("first_text"),
    )


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 123 MILLISECOND ELSE TIMESTAMP '2020-01-01' END AS parsed, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || '123' AS stored, greatest(0, epoch_ms(o_orderdate) - epoch_ms(TIMESTAMP '1995-01-01')) AS elapsed FROM orders")
def time_texts(spark, sf_dir):
    at = F.col("o_orderdate")
    raw = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".1239876"))
    parsed = times.parsed_time(F.when(F.col("o_orderkey") % 2 == 0, F.concat(raw, F.lit("Z"))).otherwise("soon"), F.lit("2020-01-01").cast("timestamp"))
    return s.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), parsed.cast("timestamp_ntz").alias("parsed"), times.stored_time(times.camera_time(raw)).alias("stored"), times.elapsed_ms(F.lit("1995-01-01").cast("timestamp_ntz"), at).alias("elapsed"),
    )


@query("SELECT lower(event_type) AS alias_key, min_by(f, a) AS field FROM (SELECT event_type, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS a, 'f' || event_id % 2 AS f FROM events) GROUP BY 1")
def metadata_aliases(spark, sf_dir):
    k = F.col("event_id") % 2
    rows = s.table(spark, sf_dir, "events").select(F.when(k == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("alias"), F.concat(F.lit("f"), k.cast("string")).alias("field"))
    return text.aliases(rows)
