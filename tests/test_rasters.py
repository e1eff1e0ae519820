"""GeoTIFF directories, chunks, averages and clips against plain arrays, on files that the tests write."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.operators import clips
from skyledger.operators import pixels as px
from skyledger.functions import geo
from skyledger.sources import exports, rasters, tiff
from skyledger.sources.scratch import saved

rng = np.random.default_rng(7)
KEYS = lambda crs, point=1: [1, 1, 0, 2, 1025, 0, 1, point, 2048 if crs == 4326 else 3072, 0, 1, crs]
GEO = {"tiepoint": [0.0, 0.0, 0.0, 110.0, -7.0, 0.0], "scale": [0.001, 0.001, 0.0], "geokeys": KEYS(4326)}


def picture(h, w, n=3, dtype="u1"):
    return rng.integers(3, np.iinfo(dtype).max, (h, w, n)).astype(dtype)


def put(folder, **files):
    for name, data in files.items():
        (folder / f"{name}.tif").write_bytes(data)


def by_name(df, *cols):
    return {r["path"].rsplit("/", 1)[1].removesuffix(".tif"): tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def dirs_of(spark, folder):
    return saved(rasters.directories(rasters.files(spark, str(folder))), "dirs")


def chained(*parts):
    """Files with one directory each, as one file with a chain of directories."""
    out = bytearray(parts[0])
    link = None
    for k, data in enumerate(parts):
        base = 0 if k == 0 else len(out)
        if k:
            out += data
        at = struct.unpack_from("<I", data, 4)[0]
        n = struct.unpack_from("<H", data, at)[0]
        for e in range(n):
            p = base + at + 2 + 12 * e
            tag, kind, many = struct.unpack_from("<HHI", out, p)
            size = {1: 1, 2: 1, 3: 2, 4: 4, 12: 8}[kind] * many
            where = struct.unpack_from("<I", out, p + 8)[0]
            if size > 4:
                struct.pack_into("<I", out, p + 8, where + base)
            if tag in (273, 324):
                q = where + base if size > 4 else p + 8
                for j in range(many):
                    struct.pack_into("<I", out, q + 4 * j, struct.unpack_from("<I", out, q + 4 * j)[0] + base)
        if link is not None:
            struct.pack_into("<I", out, link, base + at)
        link = base + at + 2 + 12 * n
        out += b"\0" * (len(out) % 2)
    return bytes(out)


def test_directories_problems_and_details(spark, tmp_path):
    rgb = picture(30, 40)
    put(
        tmp_path, fine=tiff.written(rgb, 5, 2, rows_per_strip=10, extra={"software": "field cam", "nodata": " 0 "}), tiled=tiff.written(picture(33, 40, 4), 8, tile=(16, 16)), deep=tiff.written(picture(5, 6, 1, "u2"), 1),
        planes=tiff.written(rgb, extra={"planar": 2}), palette=tiff.written(rgb, photometric=3), cmyk=tiff.written(picture(4, 4, 4), photometric=5), ycc=tiff.written(rgb, photometric=6), zstd=tiff.written(rgb, extra={"compression": 50000}),
        one_bit=tiff.written(rgb, extra={"bits": [1, 1, 1]}), junk=b"not a picture", short=b"II*", cut=tiff.written(rgb)[:60], empty=b"",
    )
    dirs = dirs_of(spark, tmp_path)
    problems = by_name(dirs.filter("ifd = 0").select("path", rasters.problem().alias("p")), "p")
    want = {"fine": None, "tiled": None, "deep": None, "planes": "separate planes", "palette": "palette", "cmyk": "CMYK", "ycc": "YCbCr without JPEG", "zstd": "compression", "one_bit": "bit depth", "junk": "signature", "short": "signature", "cut": "signature"}
    assert {k: v for k, v in problems.items() if k != "empty"} == want and problems.get("empty", "signature") == "signature"
    limits = by_name(dirs.filter("ifd = 0").select("path", rasters.problem(max_bytes=10**7, max_side=39, max_pixels=100).alias("p")), "p")
    assert limits["fine"] == "too wide" and limits["deep"] is None
    got = by_name(rasters.technical(dirs), "width", "height", "bands", "bit_depth", "sample_format", "compression", "layout", "chunk_width", "chunk_height", "total_chunks", "photometric_interpretation", "has_alpha", "nodata_value", "software")
    assert got["fine"] == (40, 30, 3, 8, "uint8", "LZW", "stripped", 40, 10, 3, "RGB", False, 0.0, "field cam")
    assert got["tiled"] == (40, 33, 4, 8, "uint8", "Deflate / Adobe ZIP", "tiled", 16, 16, 9, "RGB", True, None, None)
    assert got["deep"] == (6, 5, 1, 16, "uint16", "None (Uncompressed)", "stripped", 6, 5, 1, "BlackIsZero (Grayscale)", False, None, None)


def test_big_files_with_64_bit_offsets_and_the_other_byte_order(spark, tmp_path):
    entries = [(256, 3, 1, struct.pack("<HHHH", 3, 0, 0, 0)), (257, 3, 1, struct.pack("<HHHH", 2, 0, 0, 0)), (258, 3, 1, struct.pack("<HHHH", 8, 0, 0, 0)), (259, 3, 1, struct.pack("<HHHH", 1, 0, 0, 0)), (262, 3, 1, struct.pack("<HHHH", 1, 0, 0, 0)), (273, 16, 1, struct.pack("<Q", 16)), (279, 16, 1, struct.pack("<Q", 6))]
    big = b"II+\0" + struct.pack("<HHQ", 8, 0, 24) + bytes([9, 8, 7, 6, 5, 4, 0, 0]) + struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQ", *e[:3]) + e[3] for e in entries) + struct.pack("<Q", 0)
    words = [(256, 1), (257, 2), (258, 16), (259, 1), (262, 1), (273, 8), (277, 1), (278, 2), (279, 4)]
    mm = b"MM\0*" + struct.pack(">I", 12) + struct.pack(">HH", 513, 40_000) + struct.pack(">H", len(words)) + b"".join(struct.pack(">HHI", t, 4, 1) + struct.pack(">I", v) for t, v in words) + b"\0" * 4
    put(tmp_path, big=big, mm=mm)
    got = {(r["path"].rsplit("/", 1)[1], r["y"], r["x"]): (r["r"], r["a"]) for r in rasters.pixels(rasters.chunks(dirs_of(spark, tmp_path))).collect()}
    assert got == {("mm.tif", 0, 0): (513, 65535), ("mm.tif", 1, 0): (40_000, 65535)} | {("big.tif", y, x): (9 - 3 * y - x, 255) for y in range(2) for x in range(3)}


@pytest.mark.parametrize("shape", [{"rows_per_strip": 9}, {"rows_per_strip": 40}, {"tile": (16, 16)}, {"tile": (32, 16)}])
def test_pixels_of_strips_and_tiles_equal_the_picture(spark, tmp_path, shape):
    pictures = {f"c{c}p{p}n{n}{d}": (picture(25, 31, n, d), c, p) for c, p, n, d in [(1, 1, 3, "u1"), (5, 2, 3, "u1"), (8, 2, 4, "u1"), (32773, 1, 1, "u1"), (5, 1, 1, "u2"), (32946, 2, 3, "u2")]}
    put(tmp_path, **{k: tiff.written(v, c, p, **shape) for k, (v, c, p) in pictures.items()})
    got = {k: np.zeros((25, 31, 4), int) for k in pictures}
    rows = rasters.pixels(rasters.chunks(dirs_of(spark, tmp_path)), rows_at_once=100).collect()
    for r in rows:
        got[r["path"].rsplit("/", 1)[1][:-4]][r["y"], r["x"]] = r["r"], r["g"], r["b"], r["a"]
    assert len(rows) == 25 * 31 * len(pictures)
    for k, (v, _, _) in pictures.items():
        n = v.shape[2]
        assert (got[k][..., :3] == (v[..., :3] if n >= 3 else np.repeat(v[..., :1], 3, 2))).all(), k
        assert (got[k][..., 3] == (v[..., 3] if n == 4 else np.iinfo(v.dtype).max)).all(), k


def test_damaged_chunks_are_left_out_and_nodata_is_transparent(spark, tmp_path):
    v = picture(20, 8)
    v[3, 4], v[5, 5], v[6, 6] = (0, 2, 1), (0, 3, 0), (77, 77, 77)
    raw = bytearray(tiff.written(v, 8, rows_per_strip=10))
    at = tiff.directories(lambda a, n: bytes(raw[a : a + n]))[0]["strip_offsets"][1]
    raw[at : at + 6] = b"broken"
    white = np.full((2, 2, 1), 255, np.uint8)
    put(tmp_path, hurt=bytes(raw), zero=tiff.written(v, extra={"nodata": "0"}), value=tiff.written(v, extra={"nodata": "77"}), white=tiff.written(white, photometric=0))
    rows = rasters.pixels(rasters.chunks(dirs_of(spark, tmp_path)))
    n = by_name(rows.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("a") == 0).alias("none"), F.max(F.struct("a", "r")).alias("top")), "n", "none")
    assert n["hurt"] == (80, 0) and n["zero"] == (160, 1) and n["value"] == (160, 1) and n["white"] == (4, 0)
    assert {(r["r"], r["a"]) for r in rows.filter("path like '%white.tif'").collect()} == {(0, 255)}


def test_georeferences(spark, tmp_path):
    v = picture(20, 10)
    put(
        tmp_path, area=tiff.written(v, extra=GEO), point=tiff.written(v, extra=GEO | {"geokeys": KEYS(4326, 2)}), tied=tiff.written(v, extra=GEO | {"tiepoint": [2.0, 3.0, 0.0, 110.0, -7.0, 0.0]}), utm=tiff.written(v, extra={"tiepoint": [0.0, 0.0, 0.0, 400000.0, 9_200_000.0, 0.0], "scale": [2.0, 3.0], "geokeys": KEYS(32749)}),
        mercator=tiff.written(v, extra={"tiepoint": [0.0, 0.0, 0.0, 12_000_000.0, -800_000.0, 0.0], "scale": [2.0, 3.0], "geokeys": KEYS(3857)}), turned=tiff.written(v, extra=GEO | {"transformation": [1.0, 0.5, 0.0, 0.0, 0.5, 1.0] + [0.0] * 10}), plain=tiff.written(v),
        no_scale=tiff.written(v, extra={"tiepoint": GEO["tiepoint"]}), minus=tiff.written(v, extra=GEO | {"scale": [0.001, -1.0]}), no_keys=tiff.written(v, extra={k: GEO[k] for k in ("tiepoint", "scale")}), cut=tiff.written(v, extra=GEO | {"geokeys": [1, 1, 0, 9, 1025, 0, 1, 1]}),
        own=tiff.written(v, extra=GEO | {"geokeys": KEYS(32767)}), odd=tiff.written(v, extra=GEO | {"geokeys": KEYS(2154)}), both=tiff.written(v, extra=GEO | {"geokeys": [1, 1, 0, 2, 3072, 0, 1, 32767, 2048, 0, 1, 4326]}), short=tiff.written(v, extra=GEO | {"tiepoint": [0.0, 0.0]}),
    )
    got = by_name(rasters.georeferenced(dirs_of(spark, tmp_path)), "wrong", "crs", "rotation", "south", "west", "north", "east")
    near = lambda a, b: all(x == y or isinstance(x, float) and math.isclose(x, y, abs_tol=1e-9) for x, y in zip(a, b, strict=True))
    assert near(got["area"], (None, 4326, None, -7.02, 110.0, -7.0, 110.01))
    assert near(got["point"], (None, 4326, None, -7.0195, 109.9995, -6.9995, 110.0095))
    assert near(got["tied"], (None, 4326, None, -7.017, 109.998, -6.997, 110.008))
    assert near(got["both"], got["area"])
    assert got["utm"][:2] == (None, 32749) and math.isclose(got["utm"][3], -7.2374, abs_tol=1e-3) and math.isclose(got["utm"][4], 110.0946, abs_tol=1e-3)
    assert got["mercator"][0] is None and math.isclose(got["mercator"][4], math.degrees(12_000_000 / 6378137), abs_tol=1e-9)
    assert got["turned"][0] == "rotated" and math.isclose(got["turned"][2], math.atan2(0.5, 1.0))
    assert {k: got[k][0] for k in ("plain", "no_scale", "minus", "no_keys", "cut", "own", "odd", "short")} == {
        "plain": "no tie point", "no_scale": "no pixel scale", "minus": "pixel scale not positive", "no_keys": "no key directory", "cut": "cut key directory", "own": "no coordinate system", "odd": "coordinate system not known", "short": "short tie point",
    }
    assert got["odd"][1] is None and got["odd"][3] is None


def test_overviews(spark, tmp_path):
    part = lambda w, h: tiff.written(np.zeros((h, w, 1), np.uint8), 8)
    put(tmp_path, none=part(90, 80), fit=chained(part(90, 10), part(70, 8), part(45, 5), part(44, 50), part(20, 3)), tie=chained(part(90, 10), part(60, 10), part(10, 60)), small=chained(part(90, 10), part(30, 5)))
    dirs = dirs_of(spark, tmp_path)
    assert by_name(rasters.best_overview(dirs, 40), "overview") == {"none": None, "fit": 2, "tie": 1, "small": None}
    assert dirs.filter("path like '%fit.tif'").count() == 5
    second = rasters.pixels(rasters.chunks(dirs.filter("path like '%fit.tif' and ifd = 2")))
    assert second.count() == 45 * 5


def test_even_sample_of_chunks(spark):
    row = lambda tiled, across, down: (f"{tiled}{across}x{down}", 0, tiled, across * 16, down * 16, 16 if tiled else across * 16, 16, list(range(across * down)), [1] * (across * down))
    made = [row(True, 8, 8), row(True, 40, 3), row(True, 20, 30), row(False, 1, 64), row(False, 1, 200)]
    df = spark.createDataFrame([(*r, None, None, 3, 2) for r in made], "path string, ifd int, tiled boolean, width long, height long, chunk_width long, chunk_height long, offsets array<long>, counts array<long>, problem string, extra array<int>, samples int, photometric int")
    got = {}
    for r in rasters.evenly_sampled(rasters.chunks(df)).select("path", "chunk").collect():
        got.setdefault(r[0], set()).add(r[1])
    for tiled, across, down in [(True, 8, 8), (True, 40, 3), (True, 20, 30), (False, 1, 64), (False, 1, 200)]:
        n = across * down
        if n <= 64:
            want = set(range(n))
        elif tiled:
            a, d = min(8, across), min(8, down)
            want = {s * (down - 1) // (d - 1) * across + t * (across - 1) // (a - 1) for s in range(d) for t in range(a)}
        else:
            want = {s * (n - 1) // 63 for s in range(64)}
        assert got[f"{tiled}{across}x{down}"] == want


def box(v, ow, oh):
    """Area average of (rows, columns, 4), colours weighted as sums over alpha."""
    h, w, _ = v.shape
    out = np.zeros((oh, ow, 4))
    for j in range(oh):
        for i in range(ow):
            s, weight = np.zeros(4), 0.0
            for y in range(int(j * h / oh), min(h, math.ceil((j + 1) * h / oh))):
                for x in range(int(i * w / ow), min(w, math.ceil((i + 1) * w / ow))):
                    a = max(0, min(x + 1, (i + 1) * w / ow) - max(x, i * w / ow)) * max(0, min(y + 1, (j + 1) * h / oh) - max(y, j * h / oh))
                    s, weight = s + a * v[y, x], weight + a
            out[j, i] = [*(s[:3] / (s[3] / 255)), s[3] / weight] if s[3] / 255 > 0.001 else 0
    return np.floor(np.clip(out, 0, 255) + 0.5)


@pytest.mark.parametrize("shape", [{"rows_per_strip": 7}, {"tile": (16, 16)}])
def test_area_average_over_chunks(spark, tmp_path, shape):
    v = picture(37, 50)
    v[:12, :12] = 0
    deep = (picture(37, 50, 1, "u2").astype(int) % 3000 + 1000).astype("u2")
    put(tmp_path, plain=tiff.written(v, 5, **shape), holes=tiff.written(v, 8, extra={"nodata": "0"}, **shape), deep=tiff.written(deep, 8, 2, **shape), small=tiff.written(v[:9, :9], **shape))
    chunks = rasters.chunks(dirs_of(spark, tmp_path))
    spread = px.percentiles_16bit(rasters.pixels(rasters.evenly_sampled(chunks.filter("bits = 16"))), "r", 0.005, 0.995, "path")
    lo, hi = spread.select("lo", "hi").first()
    got = {}
    for r in rasters.resampled(chunks, 20, spread).collect():
        got.setdefault(r["path"].rsplit("/", 1)[1][:-4], {})[r["y"], r["x"]] = (r["r"], r["g"], r["b"], r["a"])
    solid = lambda x: np.concatenate((x, np.full_like(x[..., :1], 255)), axis=2).astype(float)
    holes = solid(v)
    holes[(v <= 2).all(2)] = 0
    want = {"plain": box(solid(v), 20, 15), "holes": box(holes, 20, 15), "small": solid(v[:9, :9]), "deep": box(np.concatenate((np.repeat((np.clip(deep.astype(float), lo, hi) - lo) * 255 / (hi - lo), 3, 2), np.full((37, 50, 1), 255.0)), axis=2), 20, 15)}
    for k, w in want.items():
        assert {(y, x) for y in range(w.shape[0]) for x in range(w.shape[1])} == set(got[k])
        assert max(abs(np.array(c) - w[y, x]).max() for (y, x), c in got[k].items()) <= (1 if k == "deep" else 0), k


def test_black_borders(spark, tmp_path):
    v = picture(40, 40)
    dark = v.copy()
    dark[:, 0] = 1
    right = v.copy()
    right[0, -1] = 0
    deep = picture(40, 40, 1, "u2") | 0x8000
    low = deep.copy()
    low[-1, :] = 400
    put(tmp_path, plain=tiff.written(v, tile=(16, 16)), left=tiff.written(dark, tile=(16, 16)), left_strips=tiff.written(dark, rows_per_strip=7), left_one=tiff.written(dark), right=tiff.written(right, tile=(32, 32)), deep=tiff.written(deep, rows_per_strip=9), low=tiff.written(low, rows_per_strip=9), low_one=tiff.written(low))
    assert by_name(rasters.black_borders(dirs_of(spark, tmp_path)), "black_border") == {"plain": False, "left": True, "left_strips": True, "left_one": False, "right": False, "deep": False, "low": True, "low_one": False}


RINGS = {
    "box": [[[110.0102, -7.0101], [110.0298, -7.0101], [110.0298, -7.0303], [110.0102, -7.0303], [110.0102, -7.0101]]],
    "hole": [[[110.0, -7.0], [110.05, -7.0], [110.05, -7.04], [110.0, -7.04], [110.0, -7.0]], [[110.01, -7.01], [110.02, -7.01], [110.02, -7.02], [110.01, -7.02], [110.01, -7.01]]],
    "slant": [[[110.03, -6.99], [110.07, -7.02], [110.04, -7.05], [110.03, -6.99]]], "outside": [[[111.0, -7.0], [111.1, -7.0], [111.1, -7.1], [111.0, -7.0]]], "line": [[[110.0, -7.0], [110.01, -7.01]]],
}


def inside(x, y, ring):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


@pytest.mark.parametrize("shape", [{"rows_per_strip": 16}, {"tile": (16, 16)}])
def test_plots_from_chunks_equal_the_whole_raster(spark, tmp_path, shape):
    v = picture(40, 50)
    (tmp_path / "in").mkdir()
    put(tmp_path / "in", ortho=tiff.written(v, 5, extra=GEO, **shape))
    dirs = dirs_of(spark, tmp_path / "in")
    refs = saved(rasters.georeferenced(dirs).filter("wrong is null"), "refs")
    path = refs.first()["path"]
    plots = spark.createDataFrame([(k, path, r) for k, r in RINGS.items()], "plot_id string, path string, rings array<array<array<double>>>")
    got = {r["plot_id"]: (r["total_pixels"], r["vegetation_pixels"]) for r in clips.plot_coverage(plots, refs, dirs, F.col("g") > F.col("r")).collect()}
    want = {}
    for k, rings in RINGS.items():
        cells = [(y, x) for y in range(40) for x in range(50) if inside(110 + (x + 0.5) * 0.001, -7 - (y + 0.5) * 0.001, rings[0]) and not any(inside(110 + (x + 0.5) * 0.001, -7 - (y + 0.5) * 0.001, h) for h in rings[1:])]
        if cells and len(rings[0]) > 2:
            want[k] = (len(cells), sum(v[y, x, 1] > v[y, x, 0] for y, x in cells))
    assert got == want and set(got) == {"box", "hole", "slant"}

    w = saved(clips.windows(plots, refs, padding=3, chunk=16, overlap=4, single=20), "windows")
    cut = {}
    for r in clips.clipped(w, dirs).collect():
        cut.setdefault((r["plot_id"], r["slice_index"]), {})[r["y"], r["x"]] = (r["r"], r["g"], r["b"])
    for r in w.collect():
        c = cut[r["plot_id"], r["slice_index"]]
        assert c == {(y, x): tuple(v[y, x]) for y in range(r["row_offset"], r["row_offset"] + r["slice_height"]) for x in range(r["col_offset"], r["col_offset"] + r["slice_width"])}
    boxes = {r["plot_id"]: (r["col_offset"], r["row_offset"], r["slice_width"], r["slice_height"], r["total_slices"]) for r in clips.windows(plots, refs, padding=0).collect()}
    assert boxes["box"] == (10, 10, 20, 21, 1) and boxes["hole"] == (0, 0, 50, 40, 1)

    files = clips.save_slices(plots, refs, dirs, f"file://{tmp_path}/out", padding=0).collect()
    assert {r["name"] for r in files} == {"clip_box_slice_1_of_1", "clip_hole_slice_1_of_1", "clip_slant_slice_1_of_1"}
    back = spark.read.format("image").load(f"{tmp_path}/out/clip_box_slice_1_of_1.png").first()["image"]
    assert (back["width"], back["height"]) == (20, 21)
    assert (np.frombuffer(back["data"], np.uint8).reshape(21, 20, 3)[..., ::-1] == v[10:31, 10:30]).all()


def test_masks_and_conditions_are_pictures(spark, tmp_path):
    cells = spark.createDataFrame([("a", x, y, (x + y) % 3 == 0, (x + 2 * y) % 4) for x in range(5) for y in range(4)] + [("b", 0, 0, True, 9)], "name string, x int, y int, mask boolean, condition int")
    assert {r["name"]: (r["width"], r["height"]) for r in exports.save_masks(cells, f"file://{tmp_path}/masks").collect()} == {"a": (5, 4), "b": (1, 1)}
    gray = spark.read.format("image").load(f"{tmp_path}/masks/a.png").first()["image"]
    assert gray["nChannels"] == 1 and bytes(gray["data"]) == bytes(255 * ((x + y) % 3 == 0) for y in range(4) for x in range(5))
    assert exports.save_conditions(cells, f"file://{tmp_path}/classes").count() == 2
    seen = spark.read.format("image").load(f"{tmp_path}/classes/a.png").first()["image"]
    colours = np.frombuffer(seen["data"], np.uint8).reshape(4, 5, 4)[..., [2, 1, 0, 3]]
    want = {0: (0, 0, 0, 0), **exports.CONDITION_COLOURS}
    assert all(tuple(colours[y, x]) == want[(x + 2 * y) % 4] for y in range(4) for x in range(5))
    zone = spark.createDataFrame([(0, 1, 10, 3, 3, 2), (1, 0, 4, 0, 0, 0)], "row int, col int, total int, v int, m int, s int").select(exports.condition_zone(F.array(geo.box_ring(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))), *(F.col(c) for c in ("row", "col", "total", "v", "m", "s"))).alias("f"))
    a, b = (json.loads(r["f"])["properties"] for r in zone.collect())
    assert (a["cell_id"], a["canopy_pct"], a["vigorous_pct"], a["dominant_condition"], a["dominant_pct"]) == ("r1c2", 80.0, 37.5, "moderate_stress", 37.5)
    assert (b["cell_id"], b["canopy_pixels"], b["dominant_condition"], b["dominant_pct"]) == ("r2c1", 0, "none", 0.0)
