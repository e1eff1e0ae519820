"""Registered queries over documents: parameters, plots, results, patches. The SQL reads the same texts by its own JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payload
from ..operators import parameters, patches
from ..sources import documents
from . import standins as s
from .registry import query

_SCHEMA = '{"parameters":[{"name":"flag","type":"boolean"},{"name":"label","type":"string"},{"name":"mode","type":"select","options":["fast",3,"good"]},{"name":"limit","type":"number","min":0.5,"max":30},{"name":"old","type":"range"}]}'
_VALUES = ['true', '"fast"', '"slow"', '0.25', '12', '31', 'null', '[1]']
_NAMES = ["flag", "label", "mode", "limit", "old", "other"]


@query(f"""WITH d AS (SELECT l_orderkey AS id, l_linenumber AS line, {_NAMES}[1 + (l_partkey % 6)::INT] AS key, {_VALUES}[1 + (l_suppkey % 8)::INT] AS a, {_VALUES}[1 + (l_orderkey % 8)::INT] AS b FROM lineitem),
    t AS (SELECT id, line, key AS k, a::JSON AS v FROM d UNION ALL SELECT id, line, 'limit', b::JSON FROM d WHERE key <> 'limit'),
    p AS (SELECT json_extract_string(x, '$.name') AS k, json_extract_string(x, '$.type') AS t, json_extract(x, '$.options') AS o, json_extract_string(x, '$.min')::DOUBLE AS lo, json_extract_string(x, '$.max')::DOUBLE AS hi FROM (SELECT unnest(('{_SCHEMA}'::JSON->'parameters')::JSON[]) AS x)),
    j AS (SELECT *, CASE WHEN json_type(v) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN v::DOUBLE END AS n FROM t LEFT JOIN p USING (k)),
    r AS (SELECT id, line, k AS key, CASE WHEN t IS NULL THEN 'unknown' WHEN t = 'boolean' THEN CASE WHEN json_type(v) <> 'BOOLEAN' THEN 'not a boolean' END WHEN t = 'string' THEN CASE WHEN json_type(v) <> 'VARCHAR' THEN 'not a string' END
        WHEN t = 'select' THEN CASE WHEN NOT coalesce(json_type(v) = 'VARCHAR' AND json_contains(o, v), false) THEN 'not an option' END WHEN t = 'number' THEN CASE WHEN n IS NULL THEN 'not a number' WHEN n < lo THEN 'below minimum' WHEN n > hi THEN 'above maximum' END ELSE 'unsupported type' END AS problem FROM j)
    SELECT * FROM r WHERE problem IS NOT NULL""")
def parameter_problems(spark, sf_dir):
    """A row for each fault of parameters against a schema of five, some of them unknown or of a type that isn't supported."""
    k = F.col
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    key, a, b = pick(_NAMES, k("l_partkey") % 6), pick(_VALUES, k("l_suppkey") % 8), pick(_VALUES, k("l_orderkey") % 8)
    doc = F.when(key == "limit", F.format_string('{"%s":%s}', key, a)).otherwise(F.format_string('{"%s":%s,"limit":%s}', key, a, b))
    rows = s.table(spark, sf_dir, "lineitem").select(k("l_orderkey").alias("id"), k("l_linenumber").alias("line"), F.try_parse_json(doc).alias("v"))
    return parameters.problems(rows, F.parse_json(F.lit(_SCHEMA)))


@query("""WITH d AS (SELECT o_orderkey AS id, (o_orderkey % 8)::INT AS k, (o_custkey % 90)::INT AS w FROM orders),
    p AS (SELECT id, k, w, '[[' || w || ',1],["x",2],[' || w + 1 || ',1],[' || w || ',2]]' AS ring FROM d)
    SELECT id, CASE WHEN k IN (0, 1) THEN 2 WHEN k = 2 THEN 0 END AS plots, CASE WHEN k IN (0, 1) THEN 'plot_1' END AS first_id, CASE WHEN k IN (0, 1) THEN 'b' END AS last_id, CASE WHEN k IN (0, 1) THEN 6 END AS points, CASE WHEN k IN (0, 1) THEN w::DOUBLE END AS lon,
        CASE k WHEN 3 THEN 'bad JSON' WHEN 4 THEN 'not an array' WHEN 5 THEN 'no polygon: plot_2' WHEN 6 THEN 'too few points: c' END AS problem FROM p""")
def plot_requests(spark, sf_dir):
    """Plots as array and text, none, bad JSON, no array, a plot without a polygon, a short one, and blank text."""
    k, w = F.col("o_orderkey") % 8, (F.col("o_custkey") % 90).cast("int")
    ring = F.format_string('[[%d,1],["x",2],[%d,1],[%d,2]]', w, w + 1, w)
    two = F.format_string('[{"polygon":%s},{"plot_id":"b","polygon":%s}]', ring, ring)
    doc = (
        F.when(k == 0, F.format_string('{"plots":%s}', two)).when(k == 1, F.format_string('{"plots":"%s"}', F.replace(two, F.lit('"'), F.lit('\\"')))).when(k == 2, '{"plots":[]}').when(k == 3, '{"plots":"[{"}').when(k == 4, '{"plots":"{}"}')
        .when(k == 5, F.format_string('{"plots":[{"polygon":%s},{}]}', ring)).when(k == 6, '{"plots":[{"plot_id":"c","polygon":[[1,2]]}]}').otherwise('{"plots":"  "}')
    )
    # A document is parsed once: written where it is used, it would be parsed at each use.
    rows = s.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.try_parse_json(doc).alias("v")).select("id", payload.plot_requests(F.col("v")).alias("r"))
    p = F.col("r.plots")
    points = F.when(F.size(p) > 0, F.aggregate(p, F.lit(0), lambda n, x: n + F.size(x["ring"])))
    return rows.select("id", F.when(p.isNotNull(), F.size(p)).alias("plots"), F.get(p, F.lit(0))["plot_id"].alias("first_id"), F.try_element_at(p, F.lit(-1))["plot_id"].alias("last_id"), points.alias("points"), F.get(F.get(F.get(p, F.lit(0))["ring"], F.lit(0)), F.lit(0)).alias("lon"), F.col("r.problem").alias("problem"))


_RESULT = """CASE event_id % 5 WHEN 0 THEN '{"execution_id":"e' || event_id || '","status":"success","execution_time_ms":' || user_id || ',"metrics":{"a":1,"b":' || props || '},"artifacts":{"mask":{"file_path":"m.png","format":"png","bounds":[1,"x",2,3,4]},"grid":{"file_path":"../out2/g.json"}},"error":null}'
    WHEN 1 THEN '{"status":7,"execution_time_ms":-4,"artifacts":{"up":{"file_path":"a/../../x"},"abs":{"file_path":"/run/out/deep/./f"}}}' WHEN 2 THEN '{"execution_id":3,"execution_time_ms":1.5,"metrics":[1],"artifacts":{"none":{}},"error":"no"}' WHEN 3 THEN props ELSE '{"artifacts":{"out":{"file_path":"/run/out"},"side":{"file_path":"/run/outer/f"}}}' END"""


@query(f"""WITH d AS (SELECT event_id AS id, event_id % 5 AS k, user_id, ({_RESULT})::JSON AS v FROM events), a AS (SELECT id, k, user_id, v, unnest(json_keys(coalesce(json_extract(v, '$.artifacts'), '{{}}'::JSON))) AS key FROM d),
    r AS (SELECT id, count(*) AS n, string_agg(key || '=' || CASE key WHEN 'mask' THEN '/run/out/m.png' WHEN 'abs' THEN '/run/out/deep/f' ELSE 'outside' END, ' ' ORDER BY key) AS paths FROM a GROUP BY id)
    SELECT id, CASE WHEN json_type(v->'execution_id') = 'VARCHAR' THEN v->>'execution_id' ELSE '' END AS job_id, CASE WHEN json_type(v->'status') = 'VARCHAR' THEN v->>'status' ELSE 'failure' END AS status, CASE WHEN json_type(v->'execution_time_ms') = 'UBIGINT' THEN (v->>'execution_time_ms')::BIGINT ELSE 0 END AS execution_time_ms,
        CASE WHEN json_type(v->'metrics') = 'OBJECT' THEN len(json_keys(v->'metrics')) ELSE 0 END::INT AS metrics, coalesce(n, 0)::INT AS artifacts, coalesce(paths, '') AS paths, CASE WHEN k = 0 THEN 4 END::INT AS bounds, CASE WHEN json_type(v->'error') = 'VARCHAR' THEN v->>'error' END AS error FROM d LEFT JOIN r USING (id)""")
def execution_results(spark, sf_dir):
    """Result documents with missing and mistyped parts, and whether their files lie below the output folder."""
    # Parsed once, and its artifacts read once: they are columns of their own before they are used.
    rows = s.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.try_parse_json(F.expr(_RESULT.replace("::JSON", ""))).alias("v"))
    rows = rows.select("id", payload.execution_result(F.col("v")).alias("r")).select("id", "r.*")
    a = F.col("artifacts")
    at = F.transform(a, lambda x: F.concat(x["key"], F.lit("="), F.coalesce(payload.inside(F.lit("/run/out/"), x["file_path"]), F.lit("outside"))))
    out = rows.select("id", "job_id", "status", "execution_time_ms", F.size("metrics").alias("metrics"), F.size(a).alias("artifacts"), F.concat_ws(" ", at).alias("paths"), F.size(F.get(F.filter(a, lambda x: x["bounds"].isNotNull()), F.lit(0))["bounds"]).alias("bounds"), "error")
    return out.withColumn("bounds", F.when(F.col("bounds") >= 0, F.col("bounds")))


@query("""WITH l AS (SELECT s_suppkey AS layer_id, s_name AS layer_name, 'v' || s_nationkey AS token FROM supplier),
    p AS (SELECT c_custkey % 150 AS layer_id, c_custkey AS seq, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'v0' ELSE 'v' || c_nationkey END AS expected, CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 3 <> 0 THEN ' ' || c_name || ' ' END AS name, CASE c_custkey % 7 WHEN 0 THEN 'red' WHEN 1 THEN '#00ff00' END AS color FROM customer),
    j AS (SELECT p.*, l.token, l.layer_id IS NOT NULL AS there FROM p LEFT JOIN l USING (layer_id)),
    k AS (SELECT *, CASE WHEN NOT there THEN 'unknown' WHEN trim(name) = '' OR color = 'red' THEN 'invalid' WHEN expected <> token THEN 'conflict' ELSE 'applied' END AS state FROM j),
    f AS (SELECT layer_id, min(seq) AS first FROM k WHERE state = 'applied' GROUP BY layer_id),
    r AS (SELECT k.*, CASE WHEN state = 'applied' AND seq > first THEN 'conflict' ELSE state END AS status FROM k LEFT JOIN f USING (layer_id))
    SELECT l.layer_id, coalesce(trim(r.name), l.layer_name) AS layer_name, coalesce(r.color, '#111111') AS color, CASE WHEN r.seq IS NOT NULL THEN 'now' ELSE l.token END AS token, (SELECT count(*) FROM r x WHERE x.layer_id = l.layer_id AND x.status = 'conflict') AS conflicts, (SELECT count(*) FROM r x WHERE x.layer_id = l.layer_id AND x.status = 'invalid') AS invalid,
        (SELECT count(*) FROM r x WHERE x.status = 'unknown') AS unknown FROM l LEFT JOIN r ON r.layer_id = l.layer_id AND r.status = 'applied'""")
def layer_patches(spark, sf_dir):
    """Patches with right, stale and no tokens, bad names and colours, and several for a layer."""
    k = F.col
    layers = s.table(spark, sf_dir, "supplier").select(k("s_suppkey").alias("layer_id"), k("s_name").alias("layer_name"), F.lit("#111111").alias("color"), F.lit("").alias("icon"), F.lit("then").alias("updated_at"), F.concat(F.lit("v"), k("s_nationkey").cast("string")).alias("token"))
    n = k("c_custkey")
    expected = F.when(n % 4 == 1, "v0").when(n % 4 > 1, F.concat(F.lit("v"), k("c_nationkey").cast("string")))
    name = F.when(n % 5 == 0, " ").when(n % 3 != 0, F.concat(F.lit(" "), k("c_name"), F.lit(" ")))
    asked = s.table(spark, sf_dir, "customer").select((n % 150).alias("layer_id"), n.alias("seq"), expected.alias("expected"), name.alias("layer_name"), F.when(n % 7 == 0, "red").when(n % 7 == 1, "#00ff00").alias("color"), F.lit(None).cast("string").alias("icon"))
    none = asked.select("layer_id", "seq", F.lit(None).cast("string").alias("problem")).limit(0)
    status = patches.judged(layers, asked, none)
    per = status.groupBy("layer_id").agg(F.count_if(k("status") == "conflict").alias("conflicts"), F.count_if(k("status") == "invalid").alias("invalid"))
    unknown = status.groupBy().agg(F.count_if(k("status") == "unknown").alias("unknown"))
    out = patches.merged(layers, asked, status, F.lit("now")).join(per, "layer_id", "left").fillna(0, ["conflicts", "invalid"])
    # One row, the count of patches for no layer.
    return out.select("layer_id", "layer_name", "color", "token", "conflicts", "invalid").crossJoin(F.broadcast(unknown))


_PROPS = """['1', '"a"', 'true', '{"x":1}', 'null']"""


@query(f"""WITH f AS (SELECT DISTINCT l_orderkey AS layer_id FROM lineitem WHERE l_orderkey % 4 = 0), p AS (SELECT l_orderkey AS layer_id, 'k' || l_linenumber AS key, {_PROPS}[1 + (min(l_partkey) % 5)::INT]::JSON AS value FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY 1, 2),
    e AS (SELECT o_orderkey AS layer_id, 'k' || (1 + o_custkey % 5) AS key, {_PROPS}[1 + (o_orderkey // 4 % 5)::INT]::JSON AS value, o_orderkey % 3 = 0 AS remove, o_orderkey % 2 = 0 AS custom FROM orders),
    j AS (SELECT e.*, p.value AS old, f.layer_id IS NOT NULL AS there, json_type(p.value) AS a, json_type(e.value) AS b FROM e LEFT JOIN f USING (layer_id) LEFT JOIN p USING (layer_id, key)),
    r AS (SELECT *, CASE WHEN NOT there THEN 'no_feature' WHEN remove THEN CASE WHEN NOT custom THEN 'not_custom' END WHEN old IS NULL THEN CASE WHEN b NOT IN ('VARCHAR', 'NULL') THEN 'wrong_type' END WHEN a = 'OBJECT' THEN 'nested' WHEN a IN ('UBIGINT', 'BOOLEAN', 'VARCHAR') AND a <> b THEN 'wrong_type' WHEN a = 'NULL' AND b = 'OBJECT' THEN 'wrong_type' END AS problem FROM j),
    g AS (SELECT * FROM r WHERE problem IS NULL),
    o AS (SELECT layer_id, key, coalesce(g.value, p.value) AS value, g.layer_id IS NOT NULL AS edited FROM p LEFT JOIN g USING (layer_id, key) WHERE g.remove IS NULL OR NOT g.remove UNION ALL SELECT layer_id, key, value, true FROM g ANTI JOIN p USING (layer_id, key) WHERE NOT remove)
    SELECT layer_id, key, value::VARCHAR AS value, edited FROM o""")
def feature_edits(spark, sf_dir):
    """Properties of features after edits that set, remove, change the type or meet nothing."""
    k = F.col
    values = F.array(F.lit("1"), F.lit('"a"'), F.lit("true"), F.lit('{"x":1}'), F.lit("null"))
    held = s.table(spark, sf_dir, "lineitem").filter("l_orderkey % 4 = 0").groupBy(k("l_orderkey").alias("layer_id"), F.concat(F.lit("k"), k("l_linenumber").cast("string")).alias("key")).agg(F.min("l_partkey").alias("_p"))
    held = held.select("layer_id", F.lit(0).alias("feature"), "key", F.parse_json(F.get(values, (k("_p") % 5).cast("int"))).alias("value"), F.lit(False).alias("edited"))
    bare = held.select("layer_id", "feature").distinct().select("layer_id", "feature", F.lit(None).cast("string").alias("key"), F.parse_json(F.lit("null")).alias("value"), F.lit(False).alias("edited"))
    features, n = held.union(bare), k("o_orderkey")
    edits = s.table(spark, sf_dir, "orders").select(n.alias("layer_id"), n.alias("seq"), F.lit(0).alias("place"), F.lit(0).alias("feature"), F.concat(F.lit("k"), (k("o_custkey") % 5 + 1).cast("string")).alias("key"), F.parse_json(F.get(values, (F.floor(n / 4) % 5).cast("int"))).alias("value"), F.lit(None).cast("string").alias("field_kind"), (n % 2 == 0).alias("custom"), (n % 3 == 0).alias("remove"))
    judged = patches.judged_edits(features, edits)
    layers = bare.select("layer_id", F.lit("t").alias("token"))
    asked = edits.select("layer_id", "seq", F.lit(None).cast("string").alias("expected"), F.lit(None).cast("string").alias("layer_name"), F.lit(None).cast("string").alias("color"), F.lit(None).cast("string").alias("icon"))
    out = patches.merged_features(features, judged, patches.judged(layers, asked, judged))
    return out.filter("key is not null").select("layer_id", "key", F.to_json("value").alias("value"), "edited")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_size AS a, (p_partkey % 50)::INT AS b FROM part)
    SELECT 'f' || id || '.jpg' AS file, b AS x_min, 1 AS y_min, b + a AS x_max, 9 AS y_max, 'Tree' AS label FROM p WHERE k IN (0, 1) UNION ALL SELECT 'f' || id || '.jpg', 0, 0, 7, 8, 'Tree' FROM p WHERE k = 1
    UNION ALL SELECT 'f' || id || '.jpg', 0, 0, 0, 0, 'Tree' FROM p WHERE k = 2""")
def annotation_rows(spark, sf_dir):
    """Training rows of annotations with one box, with two and a flat one, with none; what is no XML has none."""
    n = F.col("p_partkey")
    k, a, b = n % 4, F.col("p_size"), (n % 50).cast("int")
    box = F.format_string("<object><name>x</name><bndbox><xmin>%d.9</xmin><ymin>1</ymin><xmax>%d</xmax><ymax>9.2</ymax></bndbox></object>", b, b + a)
    more = F.lit("<object><bndbox><xmax>7</xmax><ymax>8</ymax></bndbox></object><object><bndbox><xmin>5</xmin><ymin>5</ymin><xmax>5</xmax><ymax>6</ymax></bndbox></object>")
    body = F.when(k == 0, box).when(k == 1, F.concat(box, more)).otherwise("")
    doc = F.when(k == 3, "no xml").otherwise(F.format_string("<annotation><filename>f%d.jpg</filename>%s</annotation>", n, body))
    rows = s.table(spark, sf_dir, "part").select(documents.voc_boxes(doc).alias("v")).filter("v is not null").select("v.*")
    return documents.training_rows(rows)


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 7 AS k, c_nationkey AS n FROM customer)
    SELECT id, CASE WHEN k IN (0, 1) THEN 'C' || n END AS third, CASE WHEN k IN (0, 1) THEN '#00AA0' || 3 END AS colour, CASE k WHEN 2 THEN 'ids' WHEN 3 THEN 'ids' WHEN 4 THEN 'names or colours' WHEN 5 THEN 'not a list' END AS problem,
        CASE WHEN k % 3 = 0 THEN n::DOUBLE + 0.5 END AS latitude, CASE k % 3 WHEN 1 THEN 'not a point' WHEN 2 THEN 'no two numbers' END AS points_problem FROM c""")
def class_lists(spark, sf_dir):
    """Lists of classes that are right, too short, with a wrong id or colour, no list, none; and collections of points."""
    c, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    k = c % 7
    one = lambda i, name, colour: F.concat(F.lit(f'{{"id":{i},"name":"'), name, F.lit(f'","color":"{colour}"}}'))
    plain = [one(i, F.concat(F.lit("C"), nation) if i == 3 else F.lit(f"n{i}"), f"#00aa0{i}") for i in range(1, 6)]
    listed = lambda rows: F.concat(F.lit("["), F.concat_ws(",", *rows), F.lit("]"))
    doc = F.when(k < 2, listed(plain)).when(k == 2, listed(plain[:4])).when(k == 3, listed([*plain[:4], plain[0]])).when(k == 4, listed([*plain[:4], one(5, F.lit("n5"), "#12")])).when(k == 5, '{"id":1}').otherwise("[]")
    place = F.when(c % 7 % 3 == 0, F.concat(F.lit('{"type":"Point","coordinates":[1,'), nation, F.lit(".5]}"))).when(c % 7 % 3 == 1, '{"type":"Polygon","coordinates":[]}').otherwise('{"type":"Point","coordinates":[1]}')
    points = F.concat(F.lit('{"features":[{"geometry":'), place, F.lit("}]}"))
    rows = s.table(spark, sf_dir, "customer").select(c.alias("id"), payload.class_definitions(F.parse_json(doc)).alias("d"), payload.tree_points(F.parse_json(points)).alias("p"))
    third = F.get(F.filter("d.classes", lambda x: x["id"] == 3), F.lit(0))
    return rows.select("id", third["name"].alias("third"), third["color"].alias("colour"), F.col("d.problem").alias("problem"), F.get("p.points", F.lit(0))["latitude"].alias("latitude"), F.col("p.problem").alias("points_problem"))
