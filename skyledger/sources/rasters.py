"""Orthomosaics as GeoTIFF: directories, checks, georeference, overviews, and chunks decoded in parallel.

A raster is split by its strips or tiles: each is read by its byte range and decoded in a task of its
own, so no task holds a raster, and a plot reads only the chunks under it. Files are opened by
``pyarrow.fs``, in whatever store their address names. A chunk that is damaged or of a compression
that isn't read (JPEG among them) has no pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from . import tiff
from .scratch import opened

# Limits of an import, and names of compressions.
MAX_BYTES, MAX_SIDE, MAX_PIXELS, DISPLAY_SIDE = 250 * 1024 * 1024, 25_000, 500_000_000, 4096
READ_COMPRESSIONS = (1, 5, 7, 8, 32773, 32946)
COMPRESSIONS = {1: "None (Uncompressed)", 2: "CCITT 1D", 3: "Group 3 Fax", 4: "Group 4 Fax", 5: "LZW", 6: "Old JPEG", 7: "JPEG", 8: "Deflate / Adobe ZIP", 32773: "PackBits", 32946: "Deflate (PKZIP)", 34887: "LERC", 50000: "ZSTD"}

_ONE = {"width": "long", "height": "long", "bits": "int", "compression": "int", "photometric": "int", "samples": "int", "planar": "int", "predictor": "int"}
_MANY = {"extra": "int", "scale": "double", "tiepoint": "double", "transformation": "double", "geokeys": "int"}
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
DIRECTORY = "path string, length long, ifd int, problem string, order string, " + ", ".join(f"{k} {v}" for k, v in _ONE.items()) + ", tiled boolean, chunk_width long, chunk_height long, offsets array<long>, counts array<long>, " + ", ".join(f"{k} array<{v}>" for k, v in _MANY.items()) + ", nodata string, software string"
PIXELS = "path string, x int, y int, r int, g int, b int, a int"


def _schema(ddl: str) -> pa.Schema:
    kind = lambda k: pa.list_(_KINDS[k[6:-1]]) if k.startswith("array") else _KINDS[k]
    return pa.schema([(f.split()[0], kind(f.split()[1])) for f in ddl.split(", ")])


def _mapped(df: DataFrame, rows: Callable[[Iterator[dict]], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``mapInArrow`` whose function gets rows as dicts."""
    return df.mapInArrow(lambda batches: rows(r for b in batches for r in b.to_pylist()), ddl)


def _text(raw: tuple | None) -> str | None:
    return raw[0].split(b"\0")[0].decode("utf-8", "replace").strip() or None if raw else None


def directory_row(tags: dict) -> dict:
    first = lambda name, other=None: tags[name][0] if tags.get(name) else other
    tiled = "tile_offsets" in tags
    out = {k: first(k) for k in _ONE} | {k: list(tags[k]) if k in tags else None for k in _MANY} | {"order": tags["order"], "nodata": _text(tags.get("nodata")), "software": _text(tags.get("software")), "tiled": tiled}
    out |= {"compression": first("compression", 1), "samples": first("samples", 1), "bits": first("bits", 1), "predictor": first("predictor", 1)}
    side = first("tile_height") if tiled else min(first("rows_per_strip", out["height"] or 0), out["height"] or 0)
    kind = "tile" if tiled else "strip"
    return out | {"chunk_width": first("tile_width") if tiled else out["width"], "chunk_height": side, "offsets": list(tags.get(f"{kind}_offsets", ())), "counts": list(tags.get(f"{kind}_counts", ()))}


def directories(files: DataFrame) -> DataFrame:
    """One row per directory of each file (path, length): 0 is the full picture, others are its overviews. A file without a TIFF signature is one row with a problem."""
    schema = _schema(DIRECTORY)

    def rows(files: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for file in files:
            fs, at = opened(file["path"])
            with fs.open_input_file(at) as f:
                size = f.size()
                read = lambda offset, n: f.read_at(min(n, size - offset), offset) if 0 <= offset < size else b""
                try:
                    found = [directory_row(d) for d in tiff.directories(read)] or [{"problem": "signature"}]
                except ValueError:
                    found = [{"problem": "signature"}]
            yield pa.RecordBatch.from_pylist([{"path": file["path"], "length": file["length"], "ifd": k} | d for k, d in enumerate(found)], schema=schema)

    return _mapped(files.select("path", F.col("length").cast("long").alias("length")), rows, DIRECTORY)


def files(spark: SparkSession, path: str, glob: str = "*.{tif,tiff,TIF,TIFF}") -> DataFrame:
    """(path, length), without contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")


def problem(max_bytes: int = MAX_BYTES, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS) -> Column:
    """Why a file isn't imported, the first of these that holds; null if it is."""
    c = F.col
    photo = c("photometric")
    return (
        F.when(c("length") > max_bytes, "too many bytes").when(c("problem").isNotNull(), c("problem")).when(c("width").isNull() | c("height").isNull() | (c("width") == 0) | (c("height") == 0), "no size")
        .when((c("width") > max_side) | (c("height") > max_side), "too wide").when(c("width") * c("height") > max_pixels, "too many pixels").when(c("planar") == 2, "separate planes")
        .when(photo == 3, "palette").when(photo == 5, "CMYK").when((photo == 6) & (c("compression") != 7), "YCbCr without JPEG").when(~c("compression").isin(*READ_COMPRESSIONS), "compression").when(~c("bits").isin(8, 16), "bit depth")
    )


def compression_name(code: Column) -> Column:
    out = F.concat(F.lit("Compression ID "), code.cast("string"))
    for k, name in COMPRESSIONS.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def has_alpha() -> Column:
    return F.coalesce(F.exists("extra", lambda e: e.isin(1, 2)), F.lit(False)) | F.coalesce((F.col("samples") == 4) & (F.col("photometric") == 2), F.lit(False))


def nodata_value() -> Column:
    return F.expr("try_cast(nodata AS double)")


def technical(dirs: DataFrame) -> DataFrame:
    """What is told of a file: bands, depth, compression, layout, chunks, alpha and nodata."""
    gray, rgb = F.col("photometric").isin(0, 1), F.col("photometric") == 2
    return dirs.filter("ifd = 0 and problem is null").select(
        "path", "width", "height", F.col("samples").alias("bands"), F.col("bits").alias("bit_depth"), F.when(F.col("bits") == 16, "uint16").otherwise("uint8").alias("sample_format"), compression_name(F.col("compression")).alias("compression"),
        F.when(F.col("tiled"), "tiled").otherwise("stripped").alias("layout"), "chunk_width", "chunk_height", F.size("offsets").cast("long").alias("total_chunks"), F.when(gray, "BlackIsZero (Grayscale)").when(rgb, "RGB").otherwise("Unknown").alias("photometric_interpretation"),
        has_alpha().alias("has_alpha"), nodata_value().alias("nodata_value"), "software",
    )


def best_overview(dirs: DataFrame, least: int = DISPLAY_SIDE) -> DataFrame:
    """(path, overview): the smallest directory after the first whose longer side has ``least`` pixels; null where there is none."""
    longest = F.greatest("width", "height")
    fit = F.when((F.col("ifd") > 0) & (longest >= least), F.struct(longest.alias("side"), "ifd"))
    return dirs.filter("problem is null").groupBy("path").agg(F.min(fit)["ifd"].alias("overview"))


def geo_keys(keys: Column) -> dict[str, Column]:
    """raster_type (2: pixels are points), crs and what is wrong with a key directory; only values that stand in it are read, the last of a key counts."""
    n = F.coalesce(F.get(keys, F.lit(3)), F.lit(0))
    rows = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.get(keys, 4 + 4 * k).alias("id"), F.get(keys, 5 + 4 * k).alias("place"), F.get(keys, 7 + 4 * k).alias("value")))
    last = lambda key, ok=lambda v: F.lit(True): F.try_element_at(F.filter(rows, lambda r: (r["place"] == 0) & (r["id"] == key) & ok(r["value"])), F.lit(-1))["value"]
    crs = F.coalesce(last(3072, lambda v: v != 32767), last(2048))
    wrong = F.when(keys.isNull(), "no key directory").when(F.size(keys) < 4, "short key directory").when(F.size(keys) < 4 + 4 * n, "cut key directory").when(crs.isNull(), "no coordinate system")
    return {"raster_type": F.coalesce(last(1025), F.lit(1)), "crs": crs, "wrong": wrong}


def georeferenced(dirs: DataFrame) -> DataFrame:
    """Pixel scale, origin, coordinate system and WGS84 envelope of each file, or what is wrong. Rotated rasters are refused, with their angle."""
    rows = dirs.filter("ifd = 0 and problem is null")
    at = lambda values, k: F.get(values, F.lit(k))
    t, tie, scale, keys = F.col("transformation"), F.col("tiepoint"), F.col("scale"), geo_keys(F.col("geokeys"))
    rotated = F.coalesce((F.size(t) >= 16) & ((F.abs(at(t, 1)) > 1e-9) | (F.abs(at(t, 4)) > 1e-9)), F.lit(False))
    wrong = (
        F.when(rotated, "rotated").when(tie.isNull(), "no tie point").when(F.size(tie) < 6, "short tie point").when(scale.isNull(), "no pixel scale").when(F.size(scale) < 2, "short pixel scale")
        .when((at(scale, 0) <= 0) | (at(scale, 1) <= 0), "pixel scale not positive").otherwise(keys["wrong"])
    )
    rows = rows.select("path", "width", "height", wrong.alias("wrong"), F.when(rotated, F.atan2(at(t, 1), at(t, 0))).alias("rotation"), keys["crs"].alias("crs"), (keys["raster_type"] == 2).alias("points"), at(scale, 0).alias("scale_x"), at(scale, 1).alias("scale_y"), (at(tie, 3) - at(tie, 0) * at(scale, 0)).alias("origin_x"), (at(tie, 4) + at(tie, 1) * at(scale, 1)).alias("origin_y"))
    half = F.when(F.col("points"), 0.5).otherwise(0.0)
    left, top = F.col("origin_x") - half * F.col("scale_x"), F.col("origin_y") + half * F.col("scale_y")
    right, bottom = F.col("origin_x") + (F.col("width") - half) * F.col("scale_x"), F.col("origin_y") - (F.col("height") - half) * F.col("scale_y")
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x in (left, right) for y in (top, bottom)))
    # The long projection formulas stand once, over rows of corners, with an aggregate after them.
    at_corners = rows.select("*", F.explode(corners).alias("_p"))
    place = geo.to_wgs84(F.col("_p.x"), F.col("_p.y"), F.col("crs"))
    keep = ["width", "height", "wrong", "rotation", "crs", "points", "scale_x", "scale_y", "origin_x", "origin_y"]
    bounds = [F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east")]
    rows = at_corners.withColumns(place).groupBy("path").agg(F.first(F.struct(*keep)).alias("_f"), F.least(F.count("lat"), F.count("lon")).alias("_n"), *bounds)
    rows = rows.select("path", "_f.*", "_n", "south", "west", "north", "east").withColumn("wrong", F.coalesce("wrong", F.when(F.col("_n") < 4, "coordinate system not known").when(~((F.col("south") < F.col("north")) & (F.col("west") < F.col("east"))), "no envelope")))
    ok = F.col("wrong").isNull()
    return rows.select("path", "width", "height", "wrong", "rotation", *(F.when(ok, F.col(c)).alias(c) for c in (*keep[4:], "south", "west", "north", "east")))


def chunks(dirs: DataFrame) -> DataFrame:
    """One row per strip or tile with its byte range and place: x0, y0, and the width and height of what lies in the picture."""
    across = F.ceil(F.col("width") / F.col("chunk_width")).cast("long")
    rows = dirs.filter("problem is null and chunk_width > 0 and chunk_height > 0 and width > 0 and height > 0").withColumn("_range", F.arrays_zip("offsets", "counts"))
    keep = [c for c in dirs.columns if c not in ("offsets", "counts", "geokeys", "scale", "tiepoint", "transformation", "problem", "software", "extra", "length")]
    rows = rows.select(*keep, has_alpha().alias("alpha"), F.size("offsets").alias("chunk_count"), across.alias("across"), F.posexplode("_range").alias("chunk", "_at")).select("*", F.col("_at.offsets").alias("offset"), F.col("_at.counts").alias("count")).drop("_at")
    rows = rows.withColumns({"x0": F.col("chunk") % F.col("across") * F.col("chunk_width"), "y0": F.floor(F.col("chunk") / F.col("across")) * F.col("chunk_height")}).filter("y0 < height")
    return rows.withColumns({"w": F.least(F.col("chunk_width"), F.col("width") - F.col("x0")), "h": F.least(F.col("chunk_height"), F.col("height") - F.col("y0"))})


def evenly_sampled(chunks: DataFrame, most: int = 64, side: int = 8) -> DataFrame:
    """All chunks of a picture with at most ``most``; else that many strips, or ``side`` by ``side`` tiles, evenly spread with the first and last among them."""
    down = F.ceil(F.col("height") / F.col("chunk_height")).cast("long")
    spread = lambda at, n, k: F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: at == F.floor(s * (n - 1) / (k - 1)))
    axis = lambda at, n: (n <= side) | spread(at, n, side)
    tile = axis(F.col("chunk") % F.col("across"), F.col("across")) & axis(F.floor(F.col("chunk") / F.col("across")), down)
    return chunks.filter(F.when(F.col("tiled"), (F.col("across") * down <= most) | tile).otherwise((F.col("chunk_count") <= most) | spread(F.col("chunk"), F.col("chunk_count"), most)))


def blended(block: np.ndarray, photometric: int | None, nodata: float | None) -> np.ndarray:
    """Red, green, blue and alpha of stored samples: gray is repeated, white-is-zero turned, nodata is transparent black. A nodata of 0 also takes nearly black."""
    n, top = block.shape[2], np.iinfo(block.dtype).max
    gray = top - block[..., :1] if photometric == 0 and n == 1 else block[..., :1]
    colour = block[..., :3] if n >= 3 else np.repeat(gray, 3, axis=2)
    alpha = block[..., 3:4] if n >= 4 else np.full_like(gray, top)
    out = np.concatenate((colour, alpha), axis=2)
    if nodata is not None:
        value = min(max(int(np.floor(nodata + 0.5)), 0), int(top))
        near = 2 if top == 255 else 500
        seen = block[..., :3] if n >= 3 else gray
        out[((seen <= near) if value == 0 else (seen == value)).all(axis=2)] = 0
    return out


def decoded(rows: Iterator[dict]) -> Iterator[tuple[dict, np.ndarray]]:
    """Chunks with their samples as they lie in the picture; the last one read is kept for rows that ask for it again."""
    last, block, name, f = None, None, None, None
    try:
        for c in rows:
            if (c["path"], c["ifd"], c["chunk"]) != last:
                last, block = (c["path"], c["ifd"], c["chunk"]), None
                if c["path"] != name:
                    if f:
                        f.close()
                    fs, at = opened(c["path"])
                    name, f = c["path"], fs.open_input_file(at)
                try:
                    stored_rows = c["chunk_height"] if c["tiled"] else c["h"]
                    block = tiff.samples(f.read_at(c["count"], c["offset"]), c | {"rows": stored_rows, "columns": c["chunk_width"]})[: c["h"], : c["w"]]
                except ValueError:
                    pass
            if block is not None:
                yield c, block
    finally:
        if f:
            f.close()


def _near(rows: DataFrame) -> DataFrame:
    """A task for each few chunks; those of a file come one after the other."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * n, "path", "chunk").sortWithinPartitions("path", "ifd", "chunk")


def pixels(chunks: DataFrame, raw: bool = False, rows_at_once: int = 1 << 17) -> DataFrame:
    """(path, x, y, r, g, b, a) of all pixels of the chunks, in the depth of the file; transparent ones have a = 0. With ``raw``, nodata isn't blanked."""
    rows = chunks.withColumn("_nodata", F.lit(None).cast("double") if raw else nodata_value())

    def run(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for c, block in decoded(rows):
            flat = blended(block, c["photometric"], c["_nodata"]).reshape(-1, 4).astype(np.int32)
            y, x = np.divmod(np.arange(len(flat)), c["w"])
            cols = [(x + c["x0"]).astype(np.int32), (y + c["y0"]).astype(np.int32), *flat.T]
            for k in range(0, len(flat), rows_at_once):
                part = [pa.array(np.ascontiguousarray(v[k : k + rows_at_once])) for v in cols]
                yield pa.RecordBatch.from_arrays([pa.repeat(c["path"], len(part[0])), *part], schema=_schema(PIXELS))

    return _mapped(_near(rows), run, PIXELS)


def black_borders(dirs: DataFrame) -> DataFrame:
    """(path, black_border): at least two corners are nearly black, which is how flights without a nodata tag pad their edges. Only chunks at corners are read."""
    few = chunks(dirs.filter("ifd = 0")).filter("not tiled and (chunk = 0 or chunk = chunk_count - 1) or tiled and (x0 = 0 or x0 + w = width) and (y0 = 0 or y0 + h = height)")
    top = F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")), F.struct((F.col("width") - 1).alias("x"), F.lit(0).cast("long").alias("y")))
    bottom = F.array(F.struct(F.lit(0).cast("long").alias("x"), (F.col("height") - 1).alias("y")), F.struct((F.col("width") - 1).alias("x"), (F.col("height") - 1).alias("y")))
    # A picture of one strip is judged by its upper corners.
    corners = few.select("path", "samples", "bits", F.when(F.col("tiled") | (F.col("chunk_count") > 1), F.concat(top, bottom)).otherwise(top).alias("_c")).distinct().select("path", "samples", "bits", F.explode("_c").alias("_c")).select("path", "samples", "bits", F.col("_c.x").cast("int").alias("x"), F.col("_c.y").cast("int").alias("y"))
    near = F.when(F.col("bits") == 16, 500).otherwise(2)
    black = (F.col("r") <= near) & ((F.col("samples") < 3) | (F.col("g") <= near) & (F.col("b") <= near))
    seen = corners.join(pixels(few.withColumn("photometric", F.lit(1)), raw=True), ["path", "x", "y"])
    return seen.groupBy("path").agg((F.count_if(black) >= 2).alias("black_border"))


def display_size(side: Column, longest: Column, target: int) -> Column:
    """Of a side when the longer one shrinks to ``target``; never more than it was."""
    return F.when(longest > target, F.greatest(F.floor(side * (target / longest) + 0.5), F.lit(1))).otherwise(side).cast("long")


def _overlap(at: int, n: int, size: int, out: int) -> tuple[int, np.ndarray]:
    """First output cell under source cells at..at+n, and how much of each source cell (rows) lies in each output cell from there."""
    step = size / out
    lo, hi = int(at / step), min(out, int(np.ceil((at + n) / step)))
    a, b = np.arange(at, at + n)[:, None], np.arange(lo, hi)[None, :]
    return lo, np.clip(np.minimum(a + 1, (b + 1) * step) - np.maximum(a, b * step), 0, None)


def resampled(chunks: DataFrame, target: int = DISPLAY_SIDE, stretch: DataFrame | None = None) -> DataFrame:
    """(path, x, y, r, g, b, a) in 8 bits, averaged by area down to a longer side of ``target``.

    Each chunk adds what it covers to the output cells over it, and only these sums are shuffled.
    ``stretch`` has lo and hi per path for 16-bit files, as ``percentiles_16bit`` gives them; others
    are scaled over the whole range, as are files that use nearly all of it. Colours are weighted by
    alpha, so transparent pixels don't darken edges.
    """
    rows = chunks.withColumn("_nodata", nodata_value()).withColumns({"_ow": display_size(F.col("width"), F.greatest("width", "height"), target), "_oh": display_size(F.col("height"), F.greatest("width", "height"), target)})
    rows = rows.withColumns({"lo": F.lit(0.0), "hi": F.lit(65535.0)}) if stretch is None else rows.join(stretch.select("path", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi")), "path", "left").fillna({"lo": 0.0, "hi": 65535.0})
    ddl = "path string, x int, y int, r double, g double, b double, a double, weight double"

    def run(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])
        for c, block in decoded(rows):
            v = blended(block, c["photometric"], c["_nodata"]).astype(float)
            if c["bits"] == 16:
                lo, hi = c["lo"], c["hi"]
                v = v * 255 / 65535 if lo <= 50 and hi >= 65400 else (np.clip(v, lo, hi) - lo) * 255 / max(hi - lo, 1.0)
            x, wx = _overlap(c["x0"], c["w"], c["width"], c["_ow"])
            y, wy = _overlap(c["y0"], c["h"], c["height"], c["_oh"])
            sums = np.einsum("ij,ikc,kl->jlc", wy, v, wx, optimize=True).reshape(-1, 4)
            yy, xx = np.divmod(np.arange(len(sums)), wx.shape[1])
            weight = np.outer(wy.sum(0), wx.sum(0)).ravel()
            yield pa.RecordBatch.from_arrays([pa.repeat(c["path"], len(sums)), *(pa.array(np.ascontiguousarray(k)) for k in ((xx + x).astype(np.int32), (yy + y).astype(np.int32), *sums.T, weight))], schema=schema)

    sums = _mapped(_near(rows), run, ddl).groupBy("path", "x", "y").agg(*(F.sum(k).alias(k) for k in ("r", "g", "b", "a", "weight")))
    seen = F.col("a") / 255
    byte = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")
    return sums.select("path", "x", "y", *(F.when(seen > 0.001, byte(F.col(k) / seen)).otherwise(0).alias(k) for k in "rgb"), F.when(seen > 0.001, byte(F.col("a") / F.col("weight"))).otherwise(0).alias("a"))


def save_images(pixels: DataFrame, folder: str, name: str = "name", form: str = "png", bands: tuple[str, ...] = ("r", "g", "b"), **options) -> DataFrame:
    """Writes one 8-bit file per name from (name, x, y, bands); returns (name, path, width, height, bytes). Cells without a pixel are black. A group is one picture; options go to the TIFF writer.

    Files are written under another name and then moved, so a task that is tried again leaves whole files only.
    """
    schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("bytes", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        picture = np.zeros((int(y.max()) + 1, int(x.max()) + 1, len(bands)), np.uint8)
        picture[y, x] = np.stack([table[b].to_numpy() for b in bands], axis=1)
        title = table["name"][0].as_py()
        data = tiff.png(picture) if form == "png" else tiff.written(picture, **options)
        path = f"{folder}/{title}.{form}"
        fs, at = opened(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        fresh = f"{at}.{np.random.default_rng().integers(1 << 62):x}"
        with fs.open_output_stream(fresh) as out:
            out.write(data)
        fs.move(fresh, at)
        return pa.table([[title], [path], [picture.shape[1]], [picture.shape[0]], [len(data)]], schema=schema)

    rows = pixels.select(F.col(name).cast("string").alias("name"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *(F.col(b).cast("int").alias(b) for b in bands))
    return rows.groupBy("name").applyInArrow(run, "name string, path string, width int, height int, bytes long")
