"""Column functions and operators with values worked out by hand."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from skyledger.functions import geo, indices, metrics, numeric, payload, text, times
from skyledger.operators import blur, catalog, detections, imports, parameters, pixels, slices
from skyledger.plans import registry
from skyledger.sources import documents, exports, images
from skyledger.streaming import queues

SQUARE = "array(array(array(0D,0D),array(1D,0D),array(1D,1D),array(0D,1D),array(0D,0D)))"


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_rounding_families(spark):
    r = one(spark, a=numeric.half_even(F.lit(0.125)), b=numeric.half_even(F.lit(0.375)), c=numeric.half_away(F.lit(-0.5), 0), d=numeric.half_away(F.lit(2.5), 0))
    assert tuple(r) == (0.12, 0.38, -1.0, 3.0)


def test_levels_and_classes(spark):
    r = one(spark, a=numeric.magnitude_level(F.lit(5.0)), b=numeric.magnitude_level(F.lit(15.0)), c=numeric.magnitude_level(F.lit(4.999)), d=indices.coverage_class(F.lit(30.0)), e=indices.coverage_class(F.lit(60.1)))
    assert tuple(r) == ("sedang", "tinggi", "rendah", "low", "high")
    r = one(spark, a=indices.dominant(F.lit(2), F.lit(2), F.lit(2)), b=indices.dominant_of_cell(F.lit(2), F.lit(2), F.lit(2)), c=indices.dominant(F.lit(0), F.lit(0), F.lit(0)))
    assert tuple(r) == ("vigorous", "severe", "none")
    with pytest.raises(ValueError):
        indices.coverage_index("ndvi", F.lit(1), F.lit(1), F.lit(1))


def test_vegetation_pixels(spark):
    rows = spark.createDataFrame([(0, 255, 0), (255, 0, 0), (255, 255, 255), (0, 0, 0)], "r int, g int, b int")
    assert [r[0] for r in rows.select(indices.is_vegetation(F.col("r"), F.col("g"), F.col("b"))).collect()] == [True, False, False, False]
    hue = indices.hsl(F.lit(1.0), F.lit(1.0), F.lit(0.0))
    assert abs(one(spark, h=hue["hue"])[0] - 60) < 1e-6


def test_geometry(spark):
    r = one(spark, area=geo.polygon_area(F.expr(SQUARE)), around=geo.polygon_perimeter(F.expr(SQUARE)), inside=geo.in_polygon(F.lit(0.5), F.lit(0.5), F.expr(SQUARE)), out=geo.in_polygon(F.lit(1.5), F.lit(0.5), F.expr(SQUARE)), ok=geo.valid_polygon(F.expr(SQUARE)))
    assert abs(r["area"] - 12363718145) < 1e6 and abs(r["around"] - 444763) < 50 and (r["inside"], r["out"], r["ok"]) == (True, False, True)
    u = geo.utm(F.lit(-6.2), F.lit(106.8), F.lit(48), F.lit(True))
    back = geo.from_utm(u["easting"], u["northing"], F.lit(48), F.lit(True))
    r = one(spark, lat=back["lat"], lon=back["lon"], far=geo.mercator(F.lit(86.0), F.lit(0.0))["x"])
    assert abs(r["lat"] + 6.2) < 1e-7 and abs(r["lon"] - 106.8) < 1e-7 and r["far"] is None
    hole = F.expr("array(array(array(0D,0D),array(4D,0D),array(4D,4D),array(0D,4D),array(0D,0D)), array(array(1D,1D),array(2D,1D),array(2D,2D),array(1D,2D),array(1D,1D)))")
    assert tuple(one(spark, a=geo.in_polygon(F.lit(1.5), F.lit(1.5), hole), b=geo.in_polygon(F.lit(3.0), F.lit(3.0), hole))) == (False, True)


def test_text_and_time(spark):
    r = one(spark, a=text.humanized(F.lit("mean_hueDeg")), b=text.suffixed(F.lit("a.b.jpg"), F.lit(2)), c=text.coordinates(F.lit("1,2\nx\n3, 4")), d=text.csv_cell(F.lit('a"b,c')), e=text.plot_name(F.lit(3), F.lit("  ")), f=times.exif_time(F.lit("2024:01:02 03:04:05\0")).cast("string"), g=times.exif_time(F.lit("2024-01-02")))
    assert tuple(r) == ("Mean HueDeg", "a.b (2).jpg", [[2.0, 1.0], [4.0, 3.0]], '"a""b,c"', "Plot 3", "2024-01-02 03:04:05", None)
    r = one(spark, a=text.image_format(F.unhex(F.lit("FFD8FF00")), F.lit("jpg")), b=text.image_format(F.unhex(F.lit("FFD8FF00")), F.lit("dng")), c=text.image_format(F.unhex(F.lit("00")), F.lit("png")))
    assert tuple(r) == ("jpeg", "magic_mismatch", "unsupported_format")


def test_metrics_keep_scalars(spark):
    rows = spark.createDataFrame([(1, '{"coverage_percentage": 43.1, "k": 3, "s": "x", "b": true, "n": null, "o": {"a": 1}}'), (2, "bad"), (3, None), (4, "[1]")], "id int, m string")
    got = {r["key"]: (r["value"], r["text_value"], r["unit"]) for r in metrics.flattened(rows, "m").collect()}
    assert got == {"coverage_percentage": (43.1, None, "%"), "k": (3.0, None, None), "s": (None, "x", None), "b": (1.0, "true", None)}


def test_kinds(spark):
    docs = ["null", "1", "1.5", "1e300", "123456789012345678901234567890", "true", '"ARRAY<x"', "[]", "[1]", "{}", '{"a":[1]}', "bad"]
    rows = spark.createDataFrame([(d,) for d in docs], "d string").select("d", payload.kind(F.try_parse_json("d")).alias("k"))
    assert [r["k"] for r in rows.collect()] == ["null", *["number"] * 4, "boolean", "string", "array", "array", "object", "object", None]


def test_parameter_problems(spark):
    schema = '{"parameters":[{"name":"n","type":"number","min":0,"max":2},{"name":"n","type":"string"},{"name":"s","type":"select","options":["a",3]},{"type":"string"},{"name":"x","type":7},5]}'
    docs = ['{"n":3,"s":"3","x":1}', '{"n":1,"s":"a"}', '{"n":null,"y":1,"s":null}', "{}", "[1]", "null", "bad", '"{}"']
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, d string").select("id", F.try_parse_json("d").alias("v"))
    out = parameters.problems(rows, F.parse_json(F.lit(schema)))
    whole = {(k, None, "not an object") for k in (4, 5, 6, 7)}
    assert {tuple(r) for r in out.collect()} == {(0, "n", "above maximum"), (0, "s", "not an option"), (0, "x", "unsupported type"), (2, "n", "not a number"), (2, "s", "not an option"), (2, "y", "unknown")} | whole
    # The schema is read beside the documents: no lambda of it, nor of the judgement, runs for each of them.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan[: plan.index("Aggregate")] and "lambda" in plan


def test_plot_requests(spark):
    """An outline or list of another kind; a point counts only as two numbers."""
    docs = ['{"plots":{"a":1}}', '{"plots":3}', '{"plots":null}', "{}", '{"plots":"null"}', '{"plots":"[]"}', '{"plots":[{"polygon":"[[1,2]]"}]}', '{"plots":[7]}', '{"plots":[{"plot_id":4,"polygon":[[0,0],["1",1],[true,1],[2,0],[1,1,9]]}]}']
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, d string").select("id", payload.plot_requests(F.try_parse_json("d")).alias("r")).orderBy("id").collect()
    assert [r["r"]["problem"] for r in rows] == [None, None, None, None, "not an array", None, "no polygon: plot_1", "no polygon: plot_1", None]
    assert [r["r"]["plots"] for r in rows[:6]] == [None] * 5 + [[]] and [tuple(p) for p in rows[8]["r"]["plots"]] == [("plot_1", [[0.0, 0.0], [2.0, 0.0], [1.0, 1.0]])]


@pytest.mark.parametrize("name", ["plot_requests", "execution_results"])
def test_documents_are_parsed_once(spark, sf_dir, name):
    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # One for the document; plots that come as text are another.
    assert plan.count("parseJson(") == {"plot_requests": 2, "execution_results": 1}[name]


def test_execution_result_parts_of_other_kinds(spark):
    docs = ['{"metrics":"{}","artifacts":[1]}', '{"metrics":null,"artifacts":{"a":3,"b":{"file_path":"x","bounds":"[1]"},"c":{"bounds":[1,"2",true]},"d":null}}', "{}", "bad"]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, d string").select("id", payload.execution_result(F.try_parse_json("d")).alias("r")).orderBy("id")
    rows = rows.select(F.size("r.metrics").alias("m"), F.transform("r.artifacts", lambda x: F.struct(x["key"], x["file_path"], x["bounds"])).alias("a")).collect()
    assert [r["m"] for r in rows] == [0] * 4 and [tuple(x) for x in rows[1]["a"]] == [("a", "", None), ("b", "x", None), ("c", "", [1.0]), ("d", "", None)] and [r["a"] for r in (rows[0], *rows[2:])] == [[]] * 3


def test_slices(spark):
    rows = spark.createDataFrame([("p", 1, "sampled_pixels", 100.0, None), ("p", 2, "sampled_pixels", 300.0, None), ("p", 1, "vegetation_pixels", 10.0, None), ("p", 2, "vegetation_pixels", 90.0, None), ("p", 1, "coverage_percentage", 10.0, None), ("p", 2, "coverage_percentage", 30.0, None), ("p", 1, "mean_x", 1.0, None), ("p", 2, "mean_x", 2.0, None), ("p", 1, "only", 7.0, None), ("p", 2, "label", None, "dense"), ("q", 1, "tree_count", 1.5, None)], "g string, s int, key string, value double, text_value string")
    got = {(r["g"], r["key"]): (r["value"], r["text_value"]) for r in slices.merged(rows, "g", "s").collect()}
    assert got == {("p", "sampled_pixels"): (400.0, None), ("p", "vegetation_pixels"): (100.0, None), ("p", "coverage_percentage"): (25.0, None), ("p", "mean_x"): (1.75, None), ("p", "only"): (7.0, None), ("p", "label"): (None, "dense"), ("q", "tree_count"): (1.5, None)}


def test_upsert_and_latest_metric(spark):
    old = spark.createDataFrame([("a", 1, 40.0), ("b", 1, 1.0)], "k string, at int, v double")
    new = spark.createDataFrame([("a", 2, 52.5)], "k string, at int, v double")
    assert {tuple(r) for r in catalog.upsert(old, new, ["k"], "at").collect()} == {("a", 2, 52.5), ("b", 1, 1.0)}
    runs = spark.createDataFrame([(1, "x", 9, 1, 1.0), (1, "y", 1, 2, 2.0), (1, "y", 5, 3, 3.0), (1, "y", 6, 4, None)], "image_id int, key string, created_at int, id int, value double")
    assert [tuple(r) for r in catalog.latest_metric(runs, ["y", "x"]).collect()] == [(1, "y", 3.0)]


def test_blur(spark):
    rows = spark.createDataFrame([(1, 100.0), (1, 101.0), (1, 99.0), (1, 100.5), (1, 99.5), (1, 20.0), (2, 5.0)], "session_id int, score double")
    got = {r["score"]: r["b"] for r in blur.leave_one_out(rows).withColumn("b", blur.is_blurry(F.col("score"), F.col("others_mean"), F.col("others_std"), F.col("others_n"))).collect()}
    assert got[20.0] and got[5.0] and not got[100.0]


def test_boxes(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 11.0, 11.0, 0.8), (1, 3, 50.0, 50.0, 60.0, 60.0, 0.7)], "image_id int, seq int, x_min double, y_min double, x_max double, y_max double, confidence double")
    kept = detections.suppressed(rows, 0.5)
    assert sorted(r["seq"] for r in kept.collect()) == [1, 3]
    assert sorted(r["detection_id"] for r in detections.numbered(kept, "m").collect()) == ["1-m-0001", "1-m-0002"]


@pytest.mark.parametrize("most", [7, 60, 20_000])
def test_boxes_of_images_of_any_size(spark, most):
    """Dense, sparse and nameless images, settled at once, in rounds and by clusters."""
    rng = random.Random(3)
    rows = [(i, k, float(x := rng.randrange(span)), float(y := rng.randrange(span)), x + float(rng.randrange(8, 12)), y + 9.0, rng.randrange(4) / 4) for i, span, n in ((1, 20, 300), (2, 200, 300), (None, 40, 50), (3, 9, 1), (4, 60, 120)) for k in range(n)]
    want = set()
    for i in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == i), key=lambda r: (-r[6], *r[1:6])):
            both = [(min(r[4], o[4]) - max(r[2], o[2]), min(r[5], o[5]) - max(r[3], o[3]), (r[4] - r[2]) * (r[5] - r[3]) + (o[4] - o[2]) * (o[5] - o[3])) for o in kept]
            if not any(w > 0 and h > 0 and w * h > 0.4 * (s - w * h) for w, h, s in both):
                kept.append(r)
        want |= set(kept)
    d = spark.createDataFrame(rows, "image_id int, seq int, x_min double, y_min double, x_max double, y_max double, confidence double")
    assert sorted(map(tuple, detections.suppressed(d, 0.4, most=most).collect()), key=str) == sorted(want, key=str)


def test_small_images_need_no_components(spark, monkeypatch):
    monkeypatch.setattr(detections.components, "connected", lambda links: pytest.fail("rounds of components"))
    rows = spark.createDataFrame([(1, k, 0.0, 0.0, 10.0, 10.0, 0.5) for k in range(9)], "image_id int, seq int, x_min double, y_min double, x_max double, y_max double, confidence double")
    assert [r["seq"] for r in detections.suppressed(rows, 0.5).collect()] == [0]


def test_counts_in_plots_join_places_and_shapes_once(spark, monkeypatch):
    """A hundred points at each of two places and fifty plots of each of two shapes are four pairs at most."""
    met, join = [], pixels.in_plots
    monkeypatch.setattr(pixels, "in_plots", lambda *a, **k: met.append(join(*a, **k)) or met[-1])
    points = spark.range(300).selectExpr("id", "if(id < 200, id % 2 + 0.5D, null) as lon", "0.5D as lat")
    plots = spark.range(100).selectExpr("id as plot_id", f"if(id % 2 = 0, {SQUARE}, {SQUARE.replace('1D', '3D')}) as rings")
    got = {r["plot_id"]: r["inside"] for r in pixels.counts_in_plots(points, plots).collect()}
    assert got == {k: 200 if k % 2 else 100 for k in range(100)} and met[0].count() == 3


def test_change_patches(spark):
    cells = [(1, x, y, "gain") for x, y in ((0, 0), (1, 0), (5, 5))] + [(1, 9, 9, None)]
    got = [tuple(r) for r in detections.change_patches(spark.createDataFrame(cells, "img int, x int, y int, change string"), 2.0, 3.0).collect()]
    assert got == [(1, "gain", 0, 2, 4.0, 0, 0, 1, 0)]


def test_tiles_and_zones(spark):
    sizes = spark.createDataFrame([(1, 100, 100), (2, 3000, 500)], "id int, width int, height int")
    got = sorted((r["id"], r["slice_index"], r["col_offset"], r["slice_width"]) for r in pixels.tiles(sizes).collect())
    assert got == [(1, 0, 0, 100), (2, 0, 0, 1024), (2, 1, 992, 1024), (2, 2, 1984, 1016)]
    px = spark.createDataFrame([(x, 0, True) for x in range(4)], "x int, y int, m boolean")
    assert {(r["row"], r["col"], r["total_pixels"]) for r in pixels.zonation(px, 4, 2, 2, F.col("m")).collect()} == {(0, 0, 2), (0, 1, 2), (1, 0, 0), (1, 1, 0)}
    small = {(r["x"], r["y"]): r["r"] for r in pixels.box_filtered(spark.createDataFrame([(1, x, y, 10 * x, 0, 0) for x in range(4) for y in range(2)], "img int, x int, y int, r int, g int, b int"), 4, 2, 2).collect()}
    assert small == {(0, 0): 5, (1, 0): 25}


def test_import_plan(spark):
    new = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, "h2"), (4, "h3")], "seq int, content_hash string")
    old = spark.createDataFrame([("img9", "h2"), ("img8", None)], "image_id string, content_hash string")
    assert {r["seq"]: r["duplicate_of"] for r in imports.plan(new, old).collect()} == {1: None, 2: "1", 3: "img9", 4: None}


def ifd(entries, at):
    """A little-endian directory whose values all fit, or lie at given places."""
    return struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI4s", t, k, n, v) for t, k, n, v in entries) + b"\0\0\0\0"


def jpeg():
    rat = lambda *x: b"".join(struct.pack("<II", a, b) for a, b in x)
    lat, lon, alt = rat((6, 1), (30, 1), (0, 1)), rat((106, 1), (0, 1), (36, 1)), rat((1205, 10))
    base = 8
    main_at, gps_at = base, base + 2 + 12 * 2 + 4
    data_at = gps_at + 2 + 12 * 5 + 4
    main = ifd([(271, 2, 3, b"DJI\0"), (34853, 4, 1, struct.pack("<I", gps_at))], main_at)
    gps = ifd([(1, 2, 2, b"S\0\0\0"), (2, 5, 3, struct.pack("<I", data_at)), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, struct.pack("<I", data_at + 24)), (6, 5, 1, struct.pack("<I", data_at + 48))], gps_at)
    tiff = b"II*\0" + struct.pack("<I", main_at) + main + gps + lat + lon + alt
    seg = lambda m, b: b"\xff" + bytes([m]) + struct.pack(">H", len(b) + 2) + b
    xmp = b'http://ns.adobe.com/xap/1.0/\0<x drone-dji:RelativeAltitude="+80.5" />'
    return b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + tiff) + seg(0xE1, xmp) + seg(0xC0, b"\x08" + struct.pack(">HH", 300, 400) + b"\x03") + b"\xff\xda"


def test_image_headers(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg())
    (tmp_path / "bad.jpg").write_bytes(b"\xff\xd8\xff\xe1\x00\x20Exif\0\0II*\0\xff\xff")
    (tmp_path / "empty.jpg").write_bytes(b"x")
    got = {text_of(r["path"]): r for r in images.metadata(images.files(spark, str(tmp_path))).collect()}
    a = got["a.jpg"]
    assert (a["width"], a["height"], a["make"], a["latitude"], round(a["longitude"], 6), a["altitude_m"], a["relative_altitude"], a["progressive"]) == (400, 300, "DJI", -6.5, 106.01, 120.5, 80.5, False)
    assert got["bad.jpg"]["width"] is None and got["empty.jpg"]["kind"] is None
    rows = {text_of(r["path"]): r["format"] for r in imports.candidates(images.files(spark, str(tmp_path))).collect()}
    assert rows == {"a.jpg": "jpeg", "bad.jpg": "jpeg", "empty.jpg": "magic_mismatch"}

def far_tiff(far=5 << 20):
    """A TIFF whose main, sub, EXIF and GPS directories and XMP packet all lie past ``far``."""
    xmp = b'<x drone-dji:RelativeAltitude="+80.5" />'
    rat = struct.pack("<6I", 6, 1, 30, 1, 0, 1)
    long = lambda tag, v: (tag, 4, 1, struct.pack("<I", v))
    sub_at = far + 2 + 12 * 6 + 4
    exif_at = sub_at + 2 + 12 * 2 + 4
    gps_at = exif_at + 2 + 12 + 4
    rat_at = gps_at + 2 + 12 * 4 + 4
    main = [long(256, 160), long(257, 120), (700, 1, len(xmp), struct.pack("<I", rat_at + 24)), long(330, sub_at), long(34665, exif_at), long(34853, gps_at)]
    place = struct.pack("<I", rat_at)
    body = ifd(main, far) + ifd([long(256, 4000), long(257, 3000)], sub_at) + ifd([(34855, 3, 1, struct.pack("<HH", 100, 0))], exif_at)
    body += ifd([(1, 2, 2, b"S\0\0\0"), (2, 5, 3, place), (3, 2, 2, b"E\0\0\0"), (4, 5, 3, place)], gps_at) + rat + xmp
    return b"II*\0" + struct.pack("<I", far) + bytes(far - 8) + body


def test_image_headers_that_lie_far_into_the_file(spark, tmp_path):
    (tmp_path / "a.dng").write_bytes(far_tiff())
    segment = b"\xff\xe3\xff\xff" + bytes(0xFFFD)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8" + segment * 70 + jpeg()[2:])
    cols = ("kind", "width", "height", "iso", "latitude", "longitude", "relative_altitude")
    got = {text_of(r["path"]): tuple(r[c] for c in cols) for r in images.metadata(images.files(spark, str(tmp_path))).collect()}
    assert got == {"a.dng": ("tiff", 4000, 3000, 100, -6.5, 6.5, 80.5), "b.jpg": ("jpeg", 400, 300, None, -6.5, pytest.approx(106.01), 80.5)}


def text_of(path):
    return path.rsplit("/", 1)[1]


def test_png_pixels(spark, tmp_path):
    raw = b"\0" + bytes([255, 0, 0, 0, 255, 0]) + b"\0" + bytes([0, 0, 255, 9, 8, 7])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in images.pixels(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (255, 0, 0), (1, 0): (0, 255, 0), (0, 1): (0, 0, 255), (1, 1): (9, 8, 7)}


def test_png_pixels_shrink_by_area(spark, tmp_path):
    raw = b"".join(b"\0" + bytes(v for x in range(4) for v in (10 * x, y, 200 if (x, y) == (1, 1) else 0)) for y in range(2))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    (tmp_path / "p.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    got = lambda n: {(r["x"], r["y"]): (r["r"], r["g"], r["b"]) for r in images.pixels(spark, str(tmp_path), n).collect()}
    assert got(2) == {(0, 0): (5, 1, 50), (1, 0): (25, 1, 0)}
    assert got(4) == got(None)


def test_geojson_round_trip(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 1]]
    feats = [{"type": "Feature", "properties": {"name": " A "}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": []}}, {"type": "Feature", "properties": None, "geometry": None}]
    (tmp_path / "p.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    (tmp_path / "q.geojson").write_text("nope")
    rows = documents.plots(spark, str(tmp_path)).collect()
    assert sorted((r["name"] or "", r["reason"] or "") for r in rows if r["number"]) == [("A", ""), ("Plot 2", "not_a_polygon"), ("Plot 3", "no_geometry")]
    assert [r["reason"] for r in rows if not r["number"]] == ["not_geojson"]
    good = documents.measured(documents.plots(spark, str(tmp_path)).filter("reason is null"))
    made = json.loads(exports.feature_collection(good.select(exports.feature(F.col("rings"), name=F.col("name")).alias("feature"))))
    assert made["features"][0]["geometry"]["coordinates"] == [[[float(a), float(b)] for a, b in [*ring, ring[0]]]]


def test_sidecars(spark):
    w = documents.world_file(F.lit("0.5\n0\n0\n-0.5\n10.25\n19.75\n"))
    e = documents.world_envelope(w, F.lit(4), F.lit(2))
    assert tuple(one(spark, **e)) == (10.0, 19.0, 12.0, 20.0)
    for shape in ('{"south":1,"west":2,"north":3,"east":4}', "[[1,2],[3,4]]", "[2,1,4,3]", '{"bounds":[[1,2],[3,4]]}'):
        assert one(spark, a=documents.sidecar_envelope(F.lit(shape)))[0] == [[1.0, 2.0], [3.0, 4.0]]
    assert one(spark, a=documents.sidecar_envelope(F.lit("[[3,2],[1,4]]")))[0] is None


def test_queue_scores_each_item_once(spark, tmp_path):
    q, out = str(tmp_path / "q"), str(tmp_path / "out")
    spark.range(5).select(F.col("id").alias("image_id")).write.parquet(q)
    run = lambda: queues.scored_queue(spark, q, "image_id long", lambda b: b.withColumn("score", F.col("image_id") * 2.0), out, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.range(5, 7).select(F.col("id").alias("image_id")).write.mode("append").parquet(q)
    run()
    assert sorted(r["image_id"] for r in spark.read.parquet(out).collect()) == list(range(7))


def test_progress_is_thinned(spark, tmp_path):
    rows = spark.createDataFrame([("j", 0, 1, "a"), ("j", 50, 1, "a"), ("j", 100, 2, "a"), ("j", 350, 2, "a")], "job_id string, ms long, percent int, message string")
    rows.select("job_id", F.timestamp_millis("ms").alias("ts"), "percent", "message").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("job_id string, ts timestamp, percent int, message string").parquet(str(tmp_path / "in"))
    run = queues.thinned(stream).writeStream.format("memory").queryName("thinned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r["percent"], int(r["ts"].timestamp() * 1000) % 1000) for r in spark.sql("select * from thinned order by ts").collect()] == [(1, 0), (2, 100), (2, 350)]
