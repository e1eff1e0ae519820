"""Pixel tables (img, x, y, bands): coverage, condition, zones, plots, change grids, tiles, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def coverage(pixels: DataFrame, mask: Column, *by: str) -> DataFrame:
    """Pixels, those of the mask, and their share in percent, by group; a group without pixels gives 0."""
    out = pixels.groupBy(*by).agg(F.count("*").alias("total_pixels"), F.count_if(mask).alias("vegetation_pixels"))
    return out.withColumn("coverage_percentage", F.when(F.col("total_pixels") == 0, 0.0).otherwise(F.col("vegetation_pixels") * 100.0 / F.col("total_pixels")))


def condition_stats(pixels: DataFrame, classes: Column, canopy: Column, *by: str) -> DataFrame:
    n = lambda k: F.count_if(canopy & (classes == k))
    out = pixels.groupBy(*by).agg(F.count_if(canopy).alias("canopy_pixels"), n(3).alias("vigorous"), n(2).alias("moderate"), n(1).alias("severe"))
    share = lambda c: F.when(F.col("canopy_pixels") == 0, 0.0).otherwise(F.col(c) * 100.0 / F.col("canopy_pixels"))
    return out.withColumns({f"{c}_pct": share(c) for c in ("vigorous", "moderate", "severe")})


def zone_of(place: Column, n: int, total: Column) -> Column:
    """Which of ``n`` zones holds a pixel, their bounds being i * total / n in whole numbers."""
    return F.floor(((place + 1) * n - 1) / total).cast("int")


def zonation(pixels: DataFrame, width: int, height: int, n: int, mask: Column, *by: str) -> DataFrame:
    """Coverage of an ``n`` by ``n`` grid; cells without pixels are rows too."""
    if not 1 <= n <= 64:
        raise ValueError("grid size must be 1 to 64")
    spark = pixels.sparkSession
    cells = pixels.select(*by, zone_of(F.col("y"), n, F.lit(height)).alias("row"), zone_of(F.col("x"), n, F.lit(width)).alias("col"), mask.alias("_m"))
    agg = cells.groupBy(*by, "row", "col").agg(F.count("*").alias("total_pixels"), F.count_if("_m").alias("vegetation_pixels"))
    grid = spark.range(n * n).select((F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    if by:
        # The grid has n * n rows, at most 4096.
        grid = pixels.select(*by).distinct().crossJoin(F.broadcast(grid))
    out = grid.join(agg, [*by, "row", "col"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_pixels", "vegetation_pixels")})
    return out.withColumn("coverage_percentage", F.when(F.col("total_pixels") == 0, 0.0).otherwise(F.col("vegetation_pixels") * 100.0 / F.col("total_pixels")))


def in_plots(points: DataFrame, plots: DataFrame, cell_deg: float = 1.0, how: str = "inner", lon: str = "lon", lat: str = "lat", rings: str = "rings") -> DataFrame:
    """Points joined with the plots that hold them.

    Points and the boxes of plots are dealt into cells of a grid; the join is on cells, then by box,
    then exact, over edges that are computed once a plot. A point lies in one cell, so no pair is found twice.
    """
    x, y = (F.floor(F.col(c) / cell_deg).cast("long") for c in (lon, lat))
    b = geo.bbox(F.col(rings)[0])
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell_deg).cast("long"), F.floor(hi / cell_deg).cast("long")))
    boxed = plots.withColumns({f"_{k}": v for k, v in b.items()} | {"_sides": F.transform(F.col(rings), geo.edges)}).withColumn("_cx", cells(F.col("_west"), F.col("_east"))).withColumn("_cy", cells(F.col("_south"), F.col("_north")))
    near = points.withColumn("_px", x).withColumn("_py", y)
    on = (F.col("_px") == F.col("_cx")) & (F.col("_py") == F.col("_cy")) & F.col(lon).between(F.col("_west"), F.col("_east")) & F.col(lat).between(F.col("_south"), F.col("_north"))
    return near.join(boxed, on & geo.in_polygon_edges(F.col(lon), F.col(lat), F.col("_sides")), how).drop("_px", "_py", "_cx", "_cy", "_west", "_south", "_east", "_north", "_sides")


def counts_in_plots(points: DataFrame, plots: DataFrame, cell_deg: float = 1.0, plot: str = "plot_id", lon: str = "lon", lat: str = "lat", rings: str = "rings") -> DataFrame:
    """(plot, inside): how many points each plot holds; plots without points have no row.

    Points at one place and plots of one shape meet once: pairs are those of distinct places and shapes.
    """
    places = points.groupBy(lon, lat).agg(F.count("*").alias("_n"))
    per = in_plots(places, plots.select(rings).distinct(), cell_deg, lon=lon, lat=lat, rings=rings).groupBy(rings).agg(F.sum("_n").alias("_n"))
    return plots.select(plot, rings).join(per, rings).groupBy(plot).agg(F.sum("_n").alias("inside"))


def source_index(k: Column, n: int, target: tuple[float, float], source: tuple[float, float], size: int) -> Column:
    """Index in the source axis that is nearest to the centre of target pixel ``k`` of ``n``; clamped."""
    at = target[0] + (k + 0.5) / n * (target[1] - target[0])
    return F.least(F.greatest(F.floor((at - source[0]) / (source[1] - source[0]) * size), F.lit(0)), F.lit(size - 1)).cast("int")


def change_grid(before: DataFrame, after: DataFrame, *by: str, mask: str = "mask") -> DataFrame:
    """Cells of two aligned grids with change: gain, loss or null."""
    keys = [*by, "x", "y"]
    rows = before.select(*keys, F.col(mask).alias("_a")).join(after.select(*keys, F.col(mask).alias("_b")), keys)
    return rows.select(*keys, F.when(~F.col("_a") & F.col("_b"), "gain").when(F.col("_a") & ~F.col("_b"), "loss").alias("change"))


def regridded(masks: DataFrame, targets: DataFrame, *by: str) -> DataFrame:
    """Cells of target grids with the value of the nearest cell of a source.

    ``masks`` has (keys, x, y, mask), ``targets`` per keys the source's and the target's size and bounds
    (s_width, s_west, ..., t_width, t_west, ...). Each target cell reads one source cell, so the join is
    on equality of places; source cells that aren't there read as null.
    """
    cells = targets.select("*", F.explode(F.sequence(F.lit(0), F.col("t_height") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.col("t_width") - 1)).alias("x"))

    def near(k: str, n: str, t: tuple[str, str], s: tuple[str, str], size: str) -> Column:
        at = F.col(t[0]) + (F.col(t[1]) - F.col(t[0])) * ((F.col(k) + 0.5) / F.col(n))
        return F.least(F.greatest(F.floor((at - F.col(s[0])) / (F.col(s[1]) - F.col(s[0])) * F.col(size)), F.lit(0)), F.col(size) - 1).cast("int")

    cells = cells.withColumns({"_x": near("x", "t_width", ("t_west", "t_east"), ("s_west", "s_east"), "s_width"), "_y": near("y", "t_height", ("t_north", "t_south"), ("s_north", "s_south"), "s_height")})
    source = masks.select(*by, F.col("x").alias("_x"), F.col("y").alias("_y"), "mask")
    return cells.select(*by, "x", "y", "_x", "_y").join(source, [*by, "_x", "_y"], "left").select(*by, "x", "y", "mask")


def change_over(before: DataFrame, after: DataFrame, grids: DataFrame, *by: str) -> DataFrame:
    """(keys, x, y, change) of two masks that need not share a grid, over their common footprint.

    ``grids`` has per keys both sizes and bounds (a_width, a_height, a_west, ..., b_width, ...). The
    common grid has the smaller width and the smaller height of the two; without a common footprint there are no rows.
    """
    of = lambda p: {k: F.col(f"{p}_{k}") for k in ("west", "south", "east", "north")}
    common = geo.intersected(of("a"), of("b"))
    shared = grids.select("*", *(v.alias(f"t_{k}") for k, v in common.items()), F.greatest(F.least("a_width", "b_width"), F.lit(1)).alias("t_width"), F.greatest(F.least("a_height", "b_height"), F.lit(1)).alias("t_height")).filter("t_west is not null")
    side = lambda p: shared.select(*by, *(F.col(f"{p}_{k}").alias(f"s_{k}") for k in ("width", "height", "west", "south", "east", "north")), *(f"t_{k}" for k in ("width", "height", "west", "south", "east", "north")))
    return change_grid(regridded(before, side("a"), *by), regridded(after, side("b"), *by), *by)


def tiles(sizes: DataFrame, chunk: int = 1024, overlap: int = 32, single: int = 2048) -> DataFrame:
    """Windows of images (with width and height): one if both sides are small, else chunks that overlap, row by row."""
    step = chunk - overlap if chunk > overlap else chunk
    small = (F.col("width") <= single) & (F.col("height") <= single)

    def starts(side: str) -> Column:
        # A window that reaches the end is the last.
        last = F.greatest(F.ceil((F.col(side) - chunk) / step), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), F.when(small, 0).otherwise(last)), lambda k: k * step)

    rows = sizes.withColumn("_small", small).select("*", F.posexplode(starts("height")).alias("_r", "row_offset")).select("*", F.size(starts("width")).alias("_n"), F.posexplode(starts("width")).alias("_c", "col_offset"))
    side = lambda s, at: F.when(F.col("_small"), F.col(s)).otherwise(F.least(F.lit(chunk), F.col(s) - F.col(at)))
    return rows.select(*sizes.columns, (F.col("_r") * F.col("_n") + F.col("_c")).alias("slice_index"), "row_offset", "col_offset", side("width", "col_offset").alias("slice_width"), side("height", "row_offset").alias("slice_height")).drop("_small")


def overlapping_tiles(sizes: DataFrame, tile: int, fraction: float = 0.25) -> DataFrame:
    """Detector tiles with a share of overlap that cover the whole image."""
    lap = max(1, int(tile * fraction))
    step = max(1, tile - lap)
    starts = lambda side: F.explode(F.sequence(F.lit(0), F.greatest(F.col(side) - lap, F.lit(1)) - 1, F.lit(step)))
    rows = sizes.withColumn("y_min", starts("height")).withColumn("x_min", starts("width"))
    return rows.withColumn("x_max", F.least(F.col("x_min") + tile, "width")).withColumn("y_max", F.least(F.col("y_min") + tile, "height"))


def shares(at: str, size: int | Column, out: int | Column) -> Column:
    """A row for each output cell that a pixel covers: struct<k, w>, the cell and the share."""
    lo, hi = F.col(at) * out / size, (F.col(at) + 1) * out / size
    cells = F.sequence(F.floor(lo).cast("int"), F.least(F.ceil(hi).cast("int") - 1, (out if isinstance(out, Column) else F.lit(out)) - 1))
    return F.explode(F.transform(cells, lambda k: F.struct(k.alias("k"), (F.least(hi, k + 1.0) - F.greatest(lo, k.cast("double"))).alias("w"))))


def box_filtered(pixels: DataFrame, width: int, height: int, target: int, bands: tuple[str, ...] = ("r", "g", "b"), img: str = "img") -> DataFrame:
    """Area average down to a longest side of ``target``; never up. A pixel gives each output pixel the share it covers."""
    scale = max(width, height) / target
    if scale <= 1:
        return pixels
    w, h = max(1, round(width / scale)), max(1, round(height / scale))

    rows = pixels.withColumn("_x", shares("x", width, w)).withColumn("_y", shares("y", height, h)).withColumn("_w", F.col("_x.w") * F.col("_y.w"))
    agg = rows.groupBy(img, F.col("_x.k").alias("x"), F.col("_y.k").alias("y")).agg(*(F.floor(F.sum(F.col(b) * F.col("_w")) / F.sum("_w") + 0.5).cast("int").alias(b) for b in bands))
    return agg


def percentiles_16bit(pixels: DataFrame, value: str = "v", low: float = 0.005, high: float = 0.995, *by: str) -> DataFrame:
    """(lo, hi, full_range) from a histogram of at most 65536 bins per group."""
    from pyspark.sql import Window

    bins = pixels.groupBy(*by, value).agg(F.count("*").alias("_n"))
    total = bins.groupBy(*by).agg(F.sum("_n").alias("_t"))
    joined = bins.crossJoin(total) if not by else bins.join(total, list(by))
    # A window over bins: 65536 rows at most in each group, whatever the number of pixels.
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = F.sum("_n").over(part.orderBy(value))
    marked = joined.withColumn("_run", run)
    at = lambda q: F.min(F.when(F.col("_run") >= F.col("_t") * q, F.col(value)))
    return marked.groupBy(*by).agg(at(low).alias("lo"), at(high).alias("hi")).withColumn("full_range", (F.col("lo") <= 50) & (F.col("hi") >= 65400))
