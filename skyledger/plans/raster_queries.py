"""Registered queries over GeoTIFF files that tasks write from the tables and other tasks read back. The SQL never sees the files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clips
from ..sources import rasters
from ..sources.scratch import fresh, saved
from . import standins as s
from .registry import query

#: Pictures are 64 by 48; their upper left corner is at 0 degrees east and 16 north, a pixel is half a degree.
_KEYS = [1, 1, 0, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326]
_OPTIONS = {"compression": 5, "predictor": 2, "tile": (16, 16), "extra": {"tiepoint": [0.0, 0.0, 0.0, 0.0, 16.0, 0.0], "scale": [0.5, 0.5, 0.0], "geokeys": _KEYS, "software": "skyledger", "nodata": "0"}}
_SEEN = f"{s.PIXELS}, seen AS (SELECT img, x, y, max(r * 65536 + g * 256 + b) AS v FROM px GROUP BY img, x, y), c AS (SELECT img, x, y, v // 65536 AS r, v // 256 % 256 AS g, v % 256 AS b, v // 65536 > 2 OR v // 256 % 256 > 2 OR v % 256 > 2 AS there FROM seen)"


def _directories(spark, sf_dir):
    """Directories of one file per stand-in image, whose cells without a pixel are black, and so without data."""
    px = s.pixels(spark, sf_dir)
    seen = px.groupBy("img", "x", "y").agg(F.max(F.col("r") * 65536 + F.col("g") * 256 + F.col("b")).alias("v"))
    # A black pixel in the last corner gives all pictures one size.
    corner = px.select("img").distinct().select("img", F.lit(63).alias("x"), F.lit(47).alias("y"), F.lit(0).alias("v"))
    cells = seen.union(corner).groupBy("img", "x", "y").agg(F.max("v").alias("v"))
    bands = cells.select(F.concat(F.lit("p"), F.col("img").cast("string")).alias("name"), "x", "y", F.floor(F.col("v") / 65536).alias("r"), (F.floor(F.col("v") / 256) % 256).alias("g"), (F.col("v") % 256).alias("b"))
    files = saved(rasters.save_images(bands, fresh(spark, "pictures"), form="tif", **_OPTIONS), "files")
    return saved(rasters.directories(files.select("path", F.col("bytes").alias("length"))), "directories")


def _img():
    return F.regexp_extract("path", r"p([0-9]+)\.tif$", 1).cast("int").alias("img")


@query(f"WITH {s.PIXELS} SELECT img, 64 AS width, 48 AS height, 3 AS bands, 8 AS bit_depth, 'LZW' AS compression, 'tiled' AS layout, 12 AS total_chunks, 'RGB' AS photometric, false AS has_alpha, 0.0::DOUBLE AS nodata, 4326 AS crs, -8.0::DOUBLE AS south, 0.0::DOUBLE AS west, 16.0::DOUBLE AS north, 32.0::DOUBLE AS east, NULL::VARCHAR AS problem, NULL::INT AS overview FROM (SELECT DISTINCT img FROM px)")
def raster_directory(spark, sf_dir):
    """Details, georeference, problem and overview of the files."""
    dirs = _directories(spark, sf_dir)
    t = rasters.technical(dirs).select("path", "width", "height", "bands", "bit_depth", "compression", "layout", "total_chunks", F.col("photometric_interpretation").alias("photometric"), "has_alpha", F.col("nodata_value").alias("nodata"))
    g = rasters.georeferenced(dirs).select("path", "crs", "south", "west", "north", "east")
    p = dirs.filter("ifd = 0").select("path", rasters.problem().alias("problem"))
    out = t.join(g, "path").join(p, "path").join(rasters.best_overview(dirs), "path")
    return out.select(_img(), "width", "height", "bands", "bit_depth", "compression", "layout", "total_chunks", "photometric", "has_alpha", "nodata", "crs", "south", "west", "north", "east", "problem", "overview")


@query(f"WITH {_SEEN} SELECT img, count(*) FILTER (there)::BIGINT AS pixels, coalesce(sum(r) FILTER (there), 0)::BIGINT AS r, coalesce(sum(g) FILTER (there), 0)::BIGINT AS g, coalesce(sum(b) FILTER (there), 0)::BIGINT AS b, coalesce(sum((x + 64 * y) * g) FILTER (there), 0)::BIGINT AS places FROM c GROUP BY img")
def raster_pixels(spark, sf_dir):
    """Pixels of all tiles, in their places, without those that have no data."""
    px = rasters.pixels(rasters.chunks(_directories(spark, sf_dir))).withColumn("_there", F.col("a") > 0)
    total = lambda v: F.coalesce(F.sum(F.when(F.col("_there"), v)), F.lit(0)).cast("long")
    return px.groupBy(_img()).agg(F.count_if("_there").alias("pixels"), *(total(F.col(k)).alias(k) for k in "rgb"), total((F.col("x") + 64 * F.col("y")) * F.col("g")).alias("places"))


@query(f"""WITH {_SEEN}, o AS (SELECT img, x // 4 AS x, y // 4 AS y, count(*) AS n, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM c WHERE there GROUP BY 1, 2, 3), i AS (SELECT DISTINCT img FROM px), f AS (SELECT img, unnest(range(16)) AS x, y FROM (SELECT img, unnest(range(12)) AS y FROM i))
    SELECT img, x::INT AS x, y::INT AS y, coalesce(floor(r / n + 0.5), 0)::INT AS r, coalesce(floor(g / n + 0.5), 0)::INT AS g, coalesce(floor(b / n + 0.5), 0)::INT AS b, coalesce(floor(255 * n / 16.0::DOUBLE + 0.5), 0)::INT AS a FROM f LEFT JOIN o USING (img, x, y)""")
def raster_display(spark, sf_dir):
    """Averages over 4 by 4 pixels, colours over those with data."""
    return rasters.resampled(rasters.chunks(_directories(spark, sf_dir)), 16).select(_img(), "x", "y", "r", "g", "b", "a")


@query(f"""WITH {_SEEN}, p AS (SELECT s_suppkey AS plot_id, (s_suppkey % 20)::INT AS img, (s_suppkey * 7 % 30)::DOUBLE AS lon, (s_suppkey * 5 % 15)::DOUBLE - 8 AS lat FROM supplier),
    e AS (SELECT plot_id, img, lon, lat, unnest([(lon, lat, lon + 2, lat + 0.25), (lon + 2, lat + 0.25, lon + 2.5, lat + 2), (lon + 2.5, lat + 2, lon + 0.5, lat + 1.5), (lon + 0.5, lat + 1.5, lon, lat)]) AS s FROM p),
    q AS (SELECT *, (x + 0.5::DOUBLE) / 64 * 32 AS px_lon, 16 - (y + 0.5::DOUBLE) / 48 * 24 AS px_lat FROM c WHERE there),
    k AS (SELECT plot_id, q.img, x, y, r, g, count(*) FILTER ((s[2] > px_lat) <> (s[4] > px_lat) AND px_lon < (s[3] - s[1]) * (px_lat - s[2]) / (s[4] - s[2]) + s[1]) % 2 = 1 AS inside FROM q JOIN e ON e.img = q.img AND px_lon BETWEEN lon AND lon + 2.5 AND px_lat BETWEEN lat AND lat + 2 GROUP BY ALL)
    SELECT plot_id::VARCHAR AS plot_id, count(*) AS total_pixels, count(*) FILTER (g > r) AS vegetation_pixels FROM k WHERE inside GROUP BY plot_id""")
def raster_plot_coverage(spark, sf_dir):
    """Coverage of plots from the tiles under them."""
    dirs = _directories(spark, sf_dir)
    refs = saved(rasters.georeferenced(dirs).filter("wrong is null"), "references")
    at = refs.select("path", _img().alias("_img"))
    plots = s.plots(spark, sf_dir).join(at, F.col("plot_id") % 20 == F.col("_img")).select("plot_id", "path", "rings")
    return clips.plot_coverage(plots, refs, dirs, F.col("g") > F.col("r")).select("plot_id", "total_pixels", "vegetation_pixels")
