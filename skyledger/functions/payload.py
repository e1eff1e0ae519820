"""Payloads and result documents in JSON, read as VARIANT: bounds, rings, parameters, edit rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geo

_KINDS = {"VOID": "null", "BOOLEAN": "boolean", "STRING": "string", "ARRAY": "array", "OBJECT": "object"} | dict.fromkeys(("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT"), "number")


def kind(v: Column) -> Column:
    """null, number, boolean, string, array or object; null where there is no value at all. ``v`` is computed once."""
    word = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in _KINDS.items() for x in pair)), word)


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _with(x: Column, fn) -> Column:
    """``fn`` of ``x``, which is computed once: nothing is shared inside lambdas and branches otherwise."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def number(v: Column, path: str = "$") -> Column:
    """The number at ``path``; null for text and other kinds."""
    return F.when(kind(member(v, path)) == "number", F.try_variant_get(v, path, "double"))


def number_or_text(v: Column, path: str = "$") -> Column:
    """A number, or text that reads as one."""
    k = kind(member(v, path))
    return F.when(k == "number", F.try_variant_get(v, path, "double")).when(k == "string", F.trim(F.try_variant_get(v, path, "string")).try_cast("double"))


def truthy(v: Column) -> Column:
    """Empty text, arrays and objects, 0, null and a missing value are false."""
    k = kind(v)
    text = F.try_variant_get(v, "$", "string")
    return F.coalesce(
        F.when(k == "boolean", F.try_variant_get(v, "$", "boolean")).when(k == "number", F.try_variant_get(v, "$", "double") != 0).when(k == "string", text != "")
        .when(k == "array", F.to_json(v) != "[]").when(k == "object", F.to_json(v) != "{}"), F.lit(False),
    )


def threshold(v: Column, path: str, default: Column) -> Column:
    """A threshold: missing, null or "auto" is ``default``; what is neither a number nor reads as one is null."""
    k = kind(member(v, path))
    auto = k.isNull() | (k == "null") | ((k == "string") & (F.lower(F.trim(F.try_variant_get(v, path, "string"))) == "auto"))
    return F.when(auto, default).otherwise(number_or_text(v, path))


def _numbers(v: Column) -> Column:
    return F.array_compact(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: number(x)))


def _ordered(b: Column) -> Column:
    return _with(b, lambda x: F.when((F.size(x) == 4) & (F.get(x, F.lit(2)) > F.get(x, F.lit(0))) & (F.get(x, F.lit(3)) > F.get(x, F.lit(1))), x))


def bounds_override(parameters: Column) -> Column:
    """[west, south, east, north] of ``image_bounds``, an array or one in a string; null unless it has four numbers in order."""
    raw = member(parameters, "$.image_bounds")
    inner = F.when(kind(raw) == "string", F.try_parse_json(F.try_variant_get(raw, "$", "string"))).when(kind(raw) == "array", raw)
    return _ordered(_numbers(inner))


def aoi_ring(payload: Column) -> Column:
    """First ring of the area of interest without malformed points; null with fewer than 3."""
    points = F.try_variant_get(payload, "$.aoi.geometry.coordinates[0]", "array<variant>")
    good = F.filter(F.transform(points, lambda p: F.array(number(p, "$[0]"), number(p, "$[1]"))), lambda p: p[0].isNotNull() & p[1].isNotNull())
    return _with(good, lambda r: F.when(F.size(r) >= 3, r))


def aoi_bounds(payload: Column) -> Column:
    """Box of the ring; without a ring, the geometry's coordinates if they hold four numbers, in whatever order."""
    box = lambda r: F.when(r.isNotNull(), F.array(*(geo.bbox(r)[k] for k in ("west", "south", "east", "north"))))
    four = _with(_numbers(member(payload, "$.aoi.geometry.coordinates")), lambda x: F.when(F.size(x) == 4, x))
    return F.coalesce(_with(aoi_ring(payload), box), four)


def bounds(payload: Column, gps: Column | None = None) -> Column:
    """Override, else area of interest, else ``gps``."""
    found = [bounds_override(member(payload, "$.parameters")), aoi_bounds(payload)]
    return F.coalesce(*found, *([gps] if gps is not None else []))


def geometry_bounds(geometry: Column) -> Column:
    """Box of the first ring of a geometry, all of whose points must be good; else null."""
    points = F.try_variant_get(geometry, "$.coordinates[0]", "array<variant>")
    ring = _with(F.transform(points, lambda p: F.array(number(p, "$[0]"), number(p, "$[1]"))), lambda r: F.when((F.size(r) > 0) & F.forall(r, lambda p: p[0].isNotNull() & p[1].isNotNull()), r))
    return _with(ring, lambda r: F.when(r.isNotNull(), F.array(*(geo.bbox(r)[k] for k in ("west", "south", "east", "north")))))


def image_bounds(payload: Column, metadata: Column, gps: Column) -> Column:
    """Override, else the area of interest's geometry, else ``gps`` where position, resolution and altitude are told.

    A geometry that is there decides: if it is malformed there are no bounds, and the position isn't tried.
    """
    geometry = member(payload, "$.aoi.geometry")
    told = truthy(member(metadata, "$.gps")) & truthy(member(metadata, "$.resolution")) & truthy(member(metadata, "$.relative_altitude"))
    return F.coalesce(bounds_override(member(payload, "$.parameters")), F.when(truthy(geometry), geometry_bounds(geometry)).when(told, gps))


def edit_problem(old: Column, new: Column, field_kind: Column | None = None, most: int = 200) -> Column:
    """Why ``old`` may not become ``new``: nested, wrong_type, too_long or unknown_kind; null if it may.

    A property that isn't there (``old`` is null) goes by the kind of its field: number, boolean, or
    text, which is also meant where none is told. An old null may become text, a number or a flag.
    """
    a, b = kind(old), F.coalesce(kind(new), F.lit("null"))
    field = F.coalesce(field_kind, F.lit("text")) if field_kind is not None else F.lit("text")
    long = F.char_length(F.try_variant_get(new, "$", "string")) > most
    text = F.when(b == "string", F.when(long, "too_long"))
    by_kind = (
        F.when(field.isin("number", "boolean"), F.when(b != field, "wrong_type")).when(field != "text", "unknown_kind").when(b == "string", text).when(b != "null", "wrong_type")
    )
    return (
        F.when(a.isNull(), by_kind).when(a.isin("array", "object"), "nested").when(a.isin("number", "boolean"), F.when(b != a, "wrong_type"))
        .when(b == "string", text).when((a == "string") | b.isin("array", "object"), "wrong_type")
    )


def concurrency_token(updated_at: Column, length: Column, mtime_ms: Column) -> Column:
    """The document's own time, else length and time of its file; 0_0 without a file."""
    file = F.when(length.isNotNull(), F.concat_ws("_", length.cast("string"), F.coalesce(mtime_ms, F.lit(0)).cast("string")))
    return F.coalesce(F.nullif(F.trim(updated_at), F.lit("")), file, F.lit("0_0"))


def thumbnail(layer_url: Column, feature_urls: Column) -> Column:
    """The layer's picture, else that of the first feature that has one."""
    blank = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(blank(layer_url), F.get(F.filter(F.transform(feature_urls, blank), lambda x: x.isNotNull()), F.lit(0)))


def compatible(mimes: Column, granularity: Column, aoi_ok: Column, needs: Column, mime: Column, target: Column, has_aoi: Column, has: dict[str, Column]) -> Column:
    """Whether an input rule takes a target; names are matched without case, and an unknown need is not met."""
    met = lambda n: F.coalesce(*(F.when(F.lower(n) == k, c) for k, c in has.items()), F.lit(False))
    return F.exists(mimes, lambda m: F.lower(m) == F.lower(mime)) & (F.lower(granularity) == F.lower(target)) & (~has_aoi | aoi_ok) & F.forall(needs, met)


def preflight(gps_required: Column, formats: Column, has_gps: Column, format_: Column) -> Column:
    """Why an image is refused: no_gps or bad_format; null if it isn't. Null rules ask for nothing."""
    return F.when(F.coalesce(gps_required, F.lit(False)) & ~has_gps, "no_gps").when(formats.isNotNull() & ~F.exists(formats, lambda f: F.lower(f) == F.lower(format_)), "bad_format")


def parameter_definitions(definitions: Column) -> Column:
    """array<struct<name, type, options, least, most>> of ``parameters`` of a schema document; options are those that are text."""
    said = lambda d, path: F.when(kind(member(d, path)) == "string", F.try_variant_get(d, path, "string"))
    many = lambda v, path: F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))

    def one(d: Column) -> Column:
        options = F.transform(F.filter(many(d, "$.options"), lambda o: kind(o) == "string"), lambda o: F.try_variant_get(o, "$", "string"))
        return F.struct(said(d, "$.name").alias("name"), F.coalesce(said(d, "$.type"), F.lit("")).alias("type"), options.alias("options"), number(d, "$.min").alias("least"), number(d, "$.max").alias("most"))

    return F.transform(many(definitions, "$.parameters"), one)


def parameter_problem(d: dict[str, Column], held: Column, value: Column) -> Column:
    """Why a value of the kind ``held`` breaks its definition (type, options, least, most; without a type it is unknown); null if it doesn't.

    A parameter is a boolean, string, select (text among its options) or number (between min and max).
    """
    t, k, n = d["type"], F.coalesce(held, F.lit("null")), F.try_variant_get(value, "$", "double")
    return (
        F.when(t.isNull(), "unknown").when(t.isin("boolean", "string"), F.when(k != t, F.concat(F.lit("not a "), t)))
        .when(t == "select", F.when((k != "string") | ~F.coalesce(F.array_contains(d["options"], F.try_variant_get(value, "$", "string")), F.lit(False)), "not an option"))
        .when(t == "number", F.when(k != "number", "not a number").when(n < d["least"], "below minimum").when(n > d["most"], "above maximum")).otherwise("unsupported type")
    )


def plot_requests(parameters: Column) -> Column:
    """struct<plots: array<struct<plot_id, ring>>, problem> of the ``plots`` parameter, an array or one in a string; a plot without an id is named by its place.

    The first fault is the problem, and there are no plots then: bad JSON, no array, a plot without a polygon, or one with fewer than 3 good points.
    """
    def plot(item: Column, k: Column) -> Column:
        name = F.coalesce(F.when(kind(member(item, "$.plot_id")) == "string", F.try_variant_get(item, "$.plot_id", "string")), F.concat(F.lit("plot_"), (k + 1).cast("string")))
        pairs = F.transform(F.try_variant_get(item, "$.polygon", "array<variant>"), lambda p: F.array(number(p, "$[0]"), number(p, "$[1]")))
        return F.struct(name.alias("plot_id"), F.filter(pairs, lambda p: p[0].isNotNull() & p[1].isNotNull()).alias("ring"))

    def inner(x: Column) -> Column:
        text = F.when(x["items"].isNull() & (kind(x["raw"]) == "string"), F.try_variant_get(x["raw"], "$", "string"))
        return F.struct(x["items"].alias("items"), F.when(F.trim(text) != "", text).alias("text"))

    def parsed(x: Column) -> Column:
        return F.struct(x["items"].alias("items"), (x["items"].isNotNull() | x["text"].isNotNull()).alias("asked"), F.try_parse_json(x["text"]).alias("v"))

    def read(x: Column) -> Column:
        items = F.coalesce(x["items"], F.try_variant_get(x["v"], "$", "array<variant>"))
        return F.struct(x["asked"].alias("asked"), (x["items"].isNull() & x["v"].isNull()).alias("bad"), F.transform(items, plot).alias("plots"))

    def first(x: Column) -> Column:
        return F.struct(x.alias("x"), F.get(F.filter(x["plots"], lambda p: p["ring"].isNull() | (F.size(p["ring"]) < 3)), F.lit(0)).alias("wrong"))

    def whole(y: Column) -> Column:
        x, wrong = y["x"], y["wrong"]
        problem = (
            F.when(~x["asked"], None).when(x["bad"], "bad JSON").when(x["plots"].isNull(), "not an array")
            .when(wrong.isNotNull() & wrong["ring"].isNull(), F.concat(F.lit("no polygon: "), wrong["plot_id"])).when(wrong.isNotNull(), F.concat(F.lit("too few points: "), wrong["plot_id"]))
        )
        return F.struct(F.when(x["asked"] & problem.isNull(), x["plots"]).alias("plots"), problem.alias("problem"))

    # No type is taken of the list or of an outline: that would go through all of it.
    start = F.struct(member(parameters, "$.plots").alias("raw"), F.try_variant_get(parameters, "$.plots", "array<variant>").alias("items"))
    return _with(_with(_with(_with(_with(start, inner), parsed), read), first), whole)


def execution_result(v: Column) -> Column:
    """struct<job_id, status, execution_time_ms, metrics, artifacts, error> of a result document; what is missing or of another type has its default: empty, failure, 0."""
    said = lambda path: F.when(kind(member(v, path)) == "string", F.try_variant_get(v, path, "string"))
    held = lambda path: F.try_variant_get(v, path, "map<string, variant>")
    took = F.try_variant_get(v, "$.execution_time_ms", "bigint")
    whole = F.schema_of_variant(member(v, "$.execution_time_ms")) == "BIGINT"

    def artifact(k: Column, a: Column) -> Column:
        inner = lambda path: F.coalesce(F.when(kind(member(a, path)) == "string", F.try_variant_get(a, path, "string")), F.lit(""))
        return F.struct(k.alias("key"), inner("$.file_path").alias("file_path"), inner("$.format").alias("format"), _numbers(member(a, "$.bounds")).alias("bounds"))

    none = F.create_map().cast("map<string, variant>")
    listed = _with(F.coalesce(held("$.artifacts"), none), lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: _with(F.try_element_at(m, k), lambda a: artifact(k, a))))
    return F.struct(
        F.coalesce(said("$.execution_id"), F.lit("")).alias("job_id"), F.coalesce(said("$.status"), F.lit("failure")).alias("status"), F.coalesce(F.when(whole & (took >= 0), took), F.lit(0)).cast("long").alias("execution_time_ms"),
        F.coalesce(held("$.metrics"), none).alias("metrics"), listed.alias("artifacts"), said("$.error").alias("error"),
    )


def inside(folder: Column, path: Column) -> Column:
    """``path``, taken from ``folder`` unless it is absolute, without "." and "..", if it lies below ``folder``; else null."""
    clean = lambda p: F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x)))
    joined = lambda parts: F.concat(F.lit("/"), F.concat_ws("/", parts))
    at = joined(clean(F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path))))
    return _with(at, lambda p: F.when(p.startswith(F.concat(joined(clean(folder)), F.lit("/"))), p))


def class_definitions(v: Column) -> Column:
    """struct<classes: array<struct<id, name, color>>, problem> of a list of five land-cover classes with ids 1 to 5, names that differ and colours as #RRGGBB; null classes without a list."""
    items = F.try_variant_get(v, "$", "array<variant>")
    said = lambda x, path: F.try_variant_get(x, path, "string")
    read = F.transform(items, lambda x: F.struct(number(x, "$.id").cast("int").alias("id"), said(x, "$.name").alias("name"), F.upper(said(x, "$.color")).alias("color")))

    def judged(c: Column) -> Column:
        ids = F.array_sort(F.transform(c, lambda x: x["id"]))
        bad = F.exists(c, lambda x: x["name"].isNull() | ~F.coalesce(x["color"].rlike("^#[0-9A-F]{6}$"), F.lit(False))) | (F.size(F.array_distinct(F.transform(c, lambda x: x["name"]))) != 5)
        problem = F.when((F.size(c) != 5) | ~F.coalesce(ids == F.array(*map(F.lit, range(1, 6))), F.lit(False)), "ids").when(bad, "names or colours")
        return F.struct(F.when(problem.isNull(), c).alias("classes"), problem.alias("problem"))

    empty = F.struct(F.lit(None).cast("array<struct<id:int,name:string,color:string>>").alias("classes"), F.when(~kind(v).isin("array", "null"), "not a list").alias("problem"))
    return F.when(F.size(items) > 0, _with(read, judged)).otherwise(empty)


def tree_points(v: Column) -> Column:
    """struct<points: array<struct<latitude, longitude>>, problem> of a collection of points; one feature that is no point of two numbers spoils it."""
    items = F.coalesce(F.try_variant_get(v, "$.features", "array<variant>"), F.array().cast("array<variant>"))
    read = F.transform(items, lambda x: F.struct((F.coalesce(F.try_variant_get(x, "$.geometry.type", "string"), F.lit("")) == "Point").alias("is_point"), number(x, "$.geometry.coordinates[1]").alias("latitude"), number(x, "$.geometry.coordinates[0]").alias("longitude")))

    def judged(p: Column) -> Column:
        problem = F.when(F.exists(p, lambda x: ~x["is_point"]), "not a point").when(F.exists(p, lambda x: x["latitude"].isNull() | x["longitude"].isNull()), "no two numbers")
        return F.struct(F.when(problem.isNull(), F.transform(p, lambda x: F.struct(x["latitude"].alias("latitude"), x["longitude"].alias("longitude")))).alias("points"), problem.alias("problem"))

    return _with(read, judged)
