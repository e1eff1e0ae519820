"""Plots cut out of orthomosaics: pixel windows, slices, and only the chunks under them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..sources import rasters
from ..sources.scratch import saved
from . import pixels as px

CLIPPED = "plot_id string, slice_index int, path string, x int, y int, r int, g int, b int, a int"


def pixel_box(ring: Column, bounds: dict[str, Column], width: Column, height: Column, padding: int = 0) -> dict[str, Column]:
    """Columns and rows (min_col, min_row, max_col, max_row; max exclusive) under a ring of [lon, lat]; null with fewer than 3 points, without a size or bounds, or where the ring is outside."""
    b = geo.bbox(ring)
    w, s, e, n = (bounds[k] for k in ("west", "south", "east", "north"))
    ok = (F.size(ring) >= 3) & (width > 0) & (height > 0) & (s < n) & (w < e) & (b["east"] >= w) & (b["west"] <= e) & (b["north"] >= s) & (b["south"] <= n)
    # A border that falls on a pixel's edge up to rounding doesn't take the next pixel.
    tiny = 1e-7
    first = lambda at: F.greatest(F.floor(at + tiny - padding), F.lit(0))
    last = lambda at, size: F.least(F.greatest(F.ceil(at - tiny + padding), F.lit(0)), size)
    col = lambda lon: (lon - w) / (e - w) * width
    row = lambda lat: (n - lat) / (n - s) * height
    out = {
        "min_col": first(col(F.greatest(b["west"], w))), "max_col": last(col(F.least(b["east"], e)), width),
        "min_row": first(row(F.least(b["north"], n))), "max_row": last(row(F.greatest(b["south"], s)), height),
    }
    ok = ok & (out["min_col"] < out["max_col"]) & (out["min_row"] < out["max_row"])
    return {k: F.when(ok, v.cast("int")) for k, v in out.items()}


def windows(plots: DataFrame, refs: DataFrame, padding: int = 10, chunk: int = 1024, overlap: int = 32, single: int = 2048) -> DataFrame:
    """Slices of each plot (plot_id, path, rings) in its raster (path, width, height, bounds): one window where the plot is small, else windows that overlap. Plots outside have none."""
    bounds = {k: F.col(k) for k in ("west", "south", "east", "north")}
    rows = plots.select("plot_id", "path", "rings").join(refs.select("path", "width", "height", *bounds), "path")
    # Generated columns are computed once; plain ones would be copied into every expression that names them.
    box = pixel_box(F.col("rings")[0], bounds, F.col("width"), F.col("height"), padding)
    rows = rows.select("*", F.inline(F.array(F.struct(*(v.alias(k) for k, v in box.items()))))).filter("min_col is not null")
    sized = rows.select("plot_id", "path", "rings", *bounds, F.col("width").alias("raster_width"), F.col("height").alias("raster_height"), "min_col", "min_row", (F.col("max_col") - F.col("min_col")).alias("width"), (F.col("max_row") - F.col("min_row")).alias("height"))
    out = px.tiles(sized, chunk, overlap, single)
    step = chunk - overlap if chunk > overlap else chunk
    along = lambda side: F.greatest(F.ceil((F.col(side) - chunk) / step), F.lit(0)) + 1
    total = F.when((F.col("width") <= single) & (F.col("height") <= single), 1).otherwise(along("width") * along("height"))
    out = out.withColumns({"total_slices": total.cast("int"), "col_offset": F.col("min_col") + F.col("col_offset"), "row_offset": F.col("min_row") + F.col("row_offset")})
    return out.select("plot_id", "path", "rings", *bounds, "raster_width", "raster_height", F.col("slice_index").cast("int").alias("slice_index"), "total_slices", F.col("col_offset").cast("int").alias("col_offset"), F.col("row_offset").cast("int").alias("row_offset"), F.col("slice_width").cast("int").alias("slice_width"), F.col("slice_height").cast("int").alias("slice_height"))


def clipped(windows: DataFrame, dirs: DataFrame) -> DataFrame:
    """Pixels of windows, from the chunks that lie under them: a window is dealt to its chunks by their number, so the join is on equality. A chunk is decoded once for all windows that a task has of it."""
    tiles = rasters.chunks(dirs.filter("ifd = 0"))
    grid = dirs.filter("ifd = 0 and problem is null").select("path", F.col("chunk_width").alias("_cw"), F.col("chunk_height").alias("_ch"), F.ceil(F.col("width") / F.col("chunk_width")).alias("_across"))
    span = lambda at, size, step: F.explode(F.sequence(F.floor(at / step), F.floor((at + size - 1) / step)))
    rows = windows.select("plot_id", "path", "slice_index", "col_offset", "row_offset", "slice_width", "slice_height").join(grid, "path")
    rows = rows.withColumn("_r", span(F.col("row_offset"), F.col("slice_height"), F.col("_ch"))).withColumn("_c", span(F.col("col_offset"), F.col("slice_width"), F.col("_cw")))
    rows = rows.withColumn("chunk", (F.col("_r") * F.col("_across") + F.col("_c")).cast("int")).drop("_cw", "_ch", "_across", "_r", "_c")
    rows = rows.join(tiles, ["path", "chunk"]).withColumn("_nodata", rasters.nodata_value()).withColumn("plot_id", F.col("plot_id").cast("string"))
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "int": pa.int32()}[f.split()[1]]) for f in CLIPPED.split(", ")])

    def run(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        for c, block in rasters.decoded(rows):
            left, top = max(c["col_offset"], c["x0"]), max(c["row_offset"], c["y0"])
            right, bottom = min(c["col_offset"] + c["slice_width"], c["x0"] + c["w"]), min(c["row_offset"] + c["slice_height"], c["y0"] + c["h"])
            part = rasters.blended(block[top - c["y0"] : bottom - c["y0"], left - c["x0"] : right - c["x0"]], c["photometric"], c["_nodata"]).reshape(-1, 4).astype(np.int32)
            y, x = np.divmod(np.arange(len(part)), max(1, right - left))
            n = len(part)
            yield pa.RecordBatch.from_arrays([pa.repeat(c["plot_id"], n), pa.array(np.full(n, c["slice_index"], np.int32)), pa.repeat(c["path"], n), *(pa.array(np.ascontiguousarray(v)) for v in ((x + left).astype(np.int32), (y + top).astype(np.int32), *part.T))], schema=schema)

    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(4 * n, "path", "chunk").sortWithinPartitions("path", "ifd", "chunk").mapInArrow(lambda batches: run(r for b in batches for r in b.to_pylist()), CLIPPED)


def in_plot(clips: DataFrame, windows: DataFrame) -> DataFrame:
    """Clipped pixels whose centre lies in their plot, in its exterior and in no hole."""
    edges = windows.select(F.col("plot_id").cast("string").alias("plot_id"), "path", F.transform("rings", geo.edges).alias("_sides"), "west", "south", "east", "north", "raster_width", "raster_height").dropDuplicates(["plot_id", "path"])
    at = geo.pixel_center(F.col("x"), F.col("y"), {k: F.col(k) for k in ("west", "south", "east", "north")}, F.col("raster_width"), F.col("raster_height"))
    return clips.join(edges, ["plot_id", "path"]).filter(geo.in_polygon_edges(at["lon"], at["lat"], F.col("_sides"))).select(*clips.columns)


def plot_coverage(plots: DataFrame, refs: DataFrame, dirs: DataFrame, mask: Column) -> DataFrame:
    """Pixels of each plot, those of a mask over r, g and b, and their share, straight from the chunks of its raster: windows don't overlap here, so a pixel counts once. Transparent pixels are left out."""
    whole = saved(windows(plots, refs, padding=0, overlap=0, single=0), "windows")
    return px.coverage(in_plot(clipped(whole, dirs).filter("a > 0"), whole), mask, "plot_id", "path")


def save_slices(plots: DataFrame, refs: DataFrame, dirs: DataFrame, folder: str, padding: int = 10) -> DataFrame:
    """Writes the slices of each plot as PNG, named after the plot and the slice."""
    w = saved(windows(plots, refs, padding), "windows")
    of = w.select(F.col("plot_id").cast("string").alias("plot_id"), "path", "slice_index", "total_slices", "col_offset", "row_offset")
    rows = clipped(w, dirs).join(of, ["plot_id", "path", "slice_index"])
    name = F.format_string("clip_%s_slice_%d_of_%d", F.col("plot_id"), F.col("slice_index") + 1, F.col("total_slices"))
    return rasters.save_images(rows.select(name.alias("name"), (F.col("x") - F.col("col_offset")).alias("x"), (F.col("y") - F.col("row_offset")).alias("y"), "r", "g", "b"), folder)
