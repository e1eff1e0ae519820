"""Boxes and classes: duplicates by overlap, ids, counts, density, class statistics, components of change."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.scratch import saved
from . import components


def filter_confidence(d: DataFrame, threshold: float) -> DataFrame:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold outside 0 to 1")
    return d.filter(F.col("confidence") >= threshold)


def _hits(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which boxes of ``a`` (rows) overlap which of ``b`` (columns) by more than the limit."""
    side = lambda k: np.minimum(a[:, None, k + 2], b[None, :, k + 2]) - np.maximum(a[:, None, k], b[None, :, k])
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    w, h = side(0), side(1)
    both = w * h
    return (w > 0) & (h > 0) & (both > limit * (area(a)[:, None] + area(b)[None, :] - both))


def _greedy(kept: np.ndarray, box: np.ndarray, limit: float, block: int = 256) -> np.ndarray:
    """Mask of the boxes, in order of rank, that no kept one before them overlaps; ``kept`` are those of earlier batches."""
    free = np.ones(len(box), bool)
    for at in range(0, len(box), block):
        part, ok = box[at : at + block], free[at : at + block]
        for k in range(0, len(kept), 4096):
            ok &= ~_hits(kept[k : k + 4096], part, limit).any(axis=0)
        hit = _hits(part, part, limit)
        for k in np.flatnonzero(ok):
            if ok[k]:
                ok[k + 1 :] &= ~hit[k, k + 1 :]
        if at + block < len(box):
            kept = np.concatenate((kept, part[ok]))
    return free


_CORNERS = ("x_min", "y_min", "x_max", "y_max")


def _rank(*by: str) -> Column:
    """Place in the order of suppression; whatever is null comes last."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("confidence"), *map(F.asc_nulls_last, ("seq", *_CORNERS))))


def _settled(boxes: DataFrame, iou_threshold: float, *by: str) -> DataFrame:
    """Greedy suppression within groups. They stream through a task in order of rank, many groups a batch; it holds the kept boxes of one group only."""
    def settle(batches):
        kept = np.empty((0, 4))
        for batch in batches:
            first = batch.column("_place").to_numpy() == 1
            box = np.column_stack([batch.column(c).cast("double").to_numpy(zero_copy_only=False) for c in _CORNERS])
            mask = np.empty(len(box), bool)
            starts = [0, *(k for k in np.flatnonzero(first) if k)]
            for lo, hi in zip(starts, [*starts[1:], len(box)], strict=True):
                if first[lo : lo + 1].any():
                    kept = np.empty((0, 4))
                mask[lo:hi] = _greedy(kept, box[lo:hi], iou_threshold)
            kept = np.concatenate((kept, box[lo:hi][mask[lo:hi]]))
            yield batch.drop_columns(["_place"]).filter(pa.array(mask))

    return boxes.withColumn("_place", _rank(*by)).mapInArrow(settle, boxes.schema)


def _area(p: str) -> Column:
    return (F.col(f"{p}x_max") - F.col(f"{p}x_min")) * (F.col(f"{p}y_max") - F.col(f"{p}y_min"))


def conflicts(boxes: DataFrame, others: DataFrame, iou_threshold: float, image: str) -> DataFrame:
    """Links (u, v) between boxes and others (with a number ``_box``) of an image that overlap by more than the limit.

    Boxes meet in the cells of a grid, whose width is their image's ``_cell``; a pair is taken in the one
    cell that holds the corner of what the two share.
    """
    cell = lambda c: F.floor(F.col(c) / F.col("_cell"))
    own = lambda d: d.select(image, "_box", "_cell", *(F.col(c).cast("double").alias(c) for c in _CORNERS)).withColumn("_cx", F.explode(F.sequence(cell("x_min"), cell("x_max")))).withColumn("_cy", F.explode(F.sequence(cell("y_min"), cell("y_max"))))
    other = own(others).select(*(F.col(c).alias(f"o_{c}") for c in (image, "_box", "_cx", "_cy", *_CORNERS)))
    w, h = F.least("x_max", "o_x_max") - F.greatest("x_min", "o_x_min"), F.least("y_max", "o_y_max") - F.greatest("y_min", "o_y_min")
    here = (F.floor(F.greatest("x_min", "o_x_min") / F.col("_cell")) == F.col("_cx")) & (F.floor(F.greatest("y_min", "o_y_min") / F.col("_cell")) == F.col("_cy"))
    pairs = own(boxes).join(other, F.col(image).eqNullSafe(F.col(f"o_{image}")) & (F.col("_cx") == F.col("o__cx")) & (F.col("_cy") == F.col("o__cy")) & (F.col("_box") > F.col("o__box")) & here & (w > 0) & (h > 0))
    return pairs.filter(w * h > iou_threshold * (_area("") + _area("o_") - w * h)).select(F.col("_box").alias("u"), F.col("o__box").alias("v"))


def _clusters(rows: DataFrame, iou_threshold: float, image: str) -> DataFrame:
    """Boxes only bear on those that they overlap: an image is taken apart into groups that no overlap joins, and these are settled one by one."""
    groups = saved(components.connected(conflicts(rows, rows, iou_threshold, image)), "clusters")
    alone = rows.join(groups, rows["_box"] == groups["id"], "left_anti")
    joined = rows.join(groups, rows["_box"] == groups["id"]).drop("id")
    return alone.union(_settled(joined, iou_threshold, "component").select(*alone.columns))


def suppressed(boxes: DataFrame, iou_threshold: float = 0.5, image: str = "image_id", most: int = 20_000) -> DataFrame:
    """Greedy suppression per image: most confident first, equal ones by seq, then by place; a box goes if it overlaps a kept one by more than the limit.

    Images of at most ``most`` boxes stream through tasks, each settled at once. Of a larger one the
    first ``most`` are settled, and what they don't remove is the rest, which is treated in the same way
    while it halves: that is so where boxes lie densely. The last rest goes by clusters of overlaps.
    """
    side = F.greatest(*((F.col(f"{c}_max") - F.col(f"{c}_min")).cast("double") for c in "xy"))
    per = boxes.groupBy(F.col(image).alias("_image")).agg(F.count("*").alias("_n"), F.greatest(2 * F.avg(side), F.lit(1e-9)).alias("_cell"))
    # Images of more than ``most`` boxes: a row for each, so one for ``most`` boxes.
    large = saved(per.filter(F.col("_n") > most).drop("_n"), "images")
    if large.isEmpty():
        return _settled(boxes, iou_threshold, image)
    of_large = F.col(image).eqNullSafe(F.col("_image"))
    out = [_settled(boxes.join(F.broadcast(large), of_large, "left_anti"), iou_threshold, image)]
    rest, n = boxes.join(F.broadcast(large), of_large).drop("_image"), None
    while True:
        ranked = saved(rest.drop("_box", "_rank").withColumn("_rank", _rank(image)).withColumn("_box", F.monotonically_increasing_id()), "ranked")
        n = n or ranked.count()
        top = saved(_settled(ranked.filter(F.col("_rank") <= most).drop("_rank"), iou_threshold, image), "kept")
        out.append(top.select(*boxes.columns))
        below = ranked.filter(F.col("_rank") > most)
        # A box of the rest has the larger number of a link, as those of kept ones are made negative.
        gone = conflicts(below, top.withColumn("_box", -F.col("_box") - 1), iou_threshold, image).select(F.col("u").alias("_box")).distinct()
        rest = saved(below.join(gone, "_box", "left_anti"), "rest")
        left = rest.count()
        if left == 0:
            break
        if 2 * left > n:
            out.append(_clusters(rest, iou_threshold, image).select(*boxes.columns))
            break
        n = left
    return reduce(DataFrame.union, out)


def numbered(boxes: DataFrame, model: str, image: str = "image_id") -> DataFrame:
    w = Window.partitionBy(image).orderBy(F.desc("confidence"), "seq")
    return boxes.withColumn("detection_id", text.detection_id(F.col(image), F.lit(model), F.row_number().over(w)))


def counts(d: DataFrame, *by: str) -> DataFrame:
    return d.groupBy(*by).agg(F.count("*").alias("tree_count"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))


def density(count: Column, area_m2: Column, unit: str = "per_ha") -> Column:
    """Trees a m2 or ha; an error for an area that is not positive."""
    per = {"per_m2": 1.0, "per_ha": 10000.0}[unit]
    return F.when(area_m2 > 0, count * per / area_m2).otherwise(F.raise_error(F.lit("area must be positive")).cast("double"))


def class_statistics(pixels: DataFrame, label: str = "label", confidence: str = "confidence", *by: str, gsd_m: float | None = None) -> DataFrame:
    """Per class: pixels, percent of those analysed, mean confidence, area."""
    per = pixels.groupBy(*by, label).agg(F.count("*").alias("pixel_count"), F.avg(confidence).alias("mean_confidence"))
    total = per.groupBy(*by).agg(F.sum("pixel_count").alias("_t"))
    rows = per.join(total, list(by)) if by else per.crossJoin(total)
    area = F.col("pixel_count") * (gsd_m or 0) ** 2 if gsd_m else F.lit(None).cast("double")
    return rows.withColumn("percentage", F.col("pixel_count") * 100.0 / F.col("_t")).withColumn("area_m2", area).drop("_t")


def runs(cells: DataFrame, *by: str) -> DataFrame:
    """(keys, y, x0, x1) of cells that follow each other in a row."""
    w = Window.partitionBy(*by, "y").orderBy("x")
    rows = cells.select(*by, "y", "x").distinct().withColumn("_run", F.col("x") - F.row_number().over(w))
    return rows.groupBy(*by, "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_run")


def labelled_runs(cells: DataFrame, *by: str, block: int = 64) -> DataFrame:
    """Runs with the number of their 4-neighbour component (``component``, the least number of its runs).

    Runs of adjacent rows link where they overlap. They meet by row and block of columns, so a row of
    many runs isn't compared with all of the next one.
    """
    numbered = saved(runs(cells, *by).withColumn("run", F.monotonically_increasing_id()), "runs")
    spread = numbered.withColumn("_b", F.explode(F.sequence(F.floor(F.col("x0") / block), F.floor(F.col("x1") / block))))
    below = spread.select(*by, (F.col("y") - 1).alias("y"), "_b", F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("run").alias("v"))
    links = spread.join(below, [*by, "y", "_b"]).filter("x0 <= _x1 and _x0 <= x1").select(F.col("run").alias("u"), "v")
    found = components.connected(links)
    return numbered.join(found, numbered["run"] == found["id"], "left").withColumn("component", F.coalesce("component", "run")).drop("id")


def change_patches(changed: DataFrame, pixel_m2: float, min_area_m2: float = 0.0, image: str = "img") -> DataFrame:
    """(img, change, patch, pixels, area_m2, x_min, y_min, x_max, y_max) of connected cells; small ones are left out. Patches are numbered by their first cells, row by row."""
    rows = changed.filter("change is not null").select(F.col(image).cast("long").alias("img"), "change", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    parts = labelled_runs(rows, "img", "change").groupBy("img", "change", "component")
    out = parts.agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("pixels"), F.min("x0").alias("x_min"), F.min("y").alias("y_min"), F.max("x1").alias("x_max"), F.max("y").alias("y_max"), F.min(F.struct("y", "x0")).alias("_first"))
    out = out.withColumn("area_m2", F.col("pixels") * F.lit(float(pixel_m2))).filter(F.col("area_m2") >= min_area_m2)
    number = F.row_number().over(Window.partitionBy("img", "change").orderBy("_first")) - 1
    return out.select("img", "change", number.cast("long").alias("patch"), "pixels", "area_m2", "x_min", "y_min", "x_max", "y_max")


def majority(labels: DataFrame, segment: str = "segment", label: str = "label", least_share: float = 0.5) -> DataFrame:
    """Majority label of each segment without label 0, the lowest on ties; segments with too few labelled rows are left out."""
    per = labels.groupBy(segment, label).agg(F.count("*").alias("_n"))
    agg = per.groupBy(segment).agg(F.sum("_n").alias("_all"), F.sum(F.when(F.col(label) != 0, F.col("_n")).otherwise(0)).alias("_some"), F.max(F.when(F.col(label) != 0, F.struct("_n", (-F.col(label)).alias("_l")))).alias("_best"))
    return agg.filter((F.col("_some") > 0) & (F.col("_some") >= least_share * F.col("_all"))).select(segment, (-F.col("_best._l")).alias("majority_label"))


def is_validation(name: Column, fraction: float) -> Column:
    """A stable split by CRC-32 of the name."""
    return F.crc32(F.encode(name, "UTF-8")) % 1000 < fraction * 1000


def crown_limits(gsd_cm: Column, least_m: float = 1.0, most_m: float = 8.0) -> dict[str, Column]:
    """Crown sizes in pixels for a ground resolution: min_px, max_px and min_area_px."""
    gsd_m = F.greatest(gsd_cm, F.lit(0.01)) / 100.0
    low = F.greatest(F.lit(3.0), least_m / gsd_m)
    return {"min_px": low, "max_px": F.greatest(2 * low, most_m / gsd_m), "min_area_px": F.greatest(F.lit(4), F.floor(0.25 * low * low)).cast("int")}


def rescaled(boxes: DataFrame, scale: Column) -> DataFrame:
    """Boxes found on a resized picture in the pixels of the original; those without extent go, confidence is from 0 to 1."""
    rows = boxes.filter("x_max > x_min and y_max > y_min")
    return rows.withColumns({c: F.col(c) / scale for c in ("x_min", "y_min", "x_max", "y_max")} | {"confidence": F.bround(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), 3)})


def full_tiles(sizes: DataFrame, size: int) -> DataFrame:
    """Corners (x, y) of the tiles that lie in pictures (width, height) whole."""
    corners = lambda side: F.explode(F.when(F.col(side) >= size, F.sequence(F.lit(0), F.col(side) - size, F.lit(size))))
    return sizes.withColumn("y", corners("height")).withColumn("x", corners("width"))
