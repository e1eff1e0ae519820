"""Rings around cells of one class: edges that no neighbour shares, joined into closed outlines with holes."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import detections


def boundary(runs: DataFrame, *by: str) -> DataFrame:
    """(keys, component, x, y, x2, y2): straight sides between a component and what isn't of it, with the component on the right hand (y goes down).

    A run adds an interval to the line above it and takes one from the line below; where a run of the
    same component lies on the other side the two cancel. Lines are swept from end to end of intervals,
    so two rows a side of a run are shuffled, whatever its length.
    """
    keys = [*by, "component"]

    def swept(ends: list[tuple[Column, Column, int]]) -> DataFrame:
        events = runs.select(*keys, F.explode(F.array(*(F.struct(line.alias("line"), at.alias("at"), F.lit(d).alias("d")) for line, at, d in ends))).alias("_e")).select(*keys, "_e.*")
        events = events.groupBy(*keys, "line", "at").agg(F.sum("d").alias("d")).filter("d != 0")
        w = Window.partitionBy(*keys, "line").orderBy("at")
        out = events.select(*keys, "line", F.sum("d").over(w).alias("s"), F.col("at").alias("a"), F.lead("at").over(w).alias("b")).filter("s != 0")
        return out.select(*keys, "line", F.when(F.col("s") > 0, F.col("a")).otherwise(F.col("b")).alias("from"), F.when(F.col("s") > 0, F.col("b")).otherwise(F.col("a")).alias("to"))

    x0, x1, y = F.col("x0"), F.col("x1") + 1, F.col("y")
    level = swept([(y, x0, 1), (y, x1, -1), (y + 1, x0, -1), (y + 1, x1, 1)]).select(*keys, F.col("from").alias("x"), F.col("line").alias("y"), F.col("to").alias("x2"), F.col("line").alias("y2"))
    plumb = swept([(x0, y, -1), (x0, y + 1, 1), (x1, y, 1), (x1, y + 1, -1)]).select(*keys, F.col("line").alias("x"), F.col("from").alias("y"), F.col("line").alias("x2"), F.col("to").alias("y2"))
    return level.union(plumb)


def traced(sides: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of directed sides. Where two rings touch at a corner each turns right, so rings don't cross and parts that touch at a corner stay apart."""
    after = defaultdict(list)
    for x, y, x2, y2 in sides:
        after[x, y].append((x2, y2))
    rings = []
    for start in sorted(after, key=lambda p: (p[1], p[0])):
        while after[start]:
            ring, at, came = [start], start, None
            while True:
                ways = after[at]
                turn = lambda to: 0 if came is None else (came[0] * _sign(to[1] - at[1]) - came[1] * _sign(to[0] - at[0]))  # noqa: E731, B023
                to = max(ways, key=turn)
                ways.remove(to)
                came = (_sign(to[0] - at[0]), _sign(to[1] - at[1]))
                at = to
                ring.append(at)
                if at == start:
                    break
            rings.append(ring)
    return rings


def _sign(v: int) -> int:
    return (v > 0) - (v < 0)


def _area(ring: list[tuple[int, int]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def polygons(cells: DataFrame, *by: str) -> DataFrame:
    """(keys, component, cells, rings): one polygon per 4-neighbour component of cells (keys, x, y), in cell corners. The exterior comes first and is clockwise on the screen, holes follow the other way round.

    The outlines of a component are traced in one task, from its straight sides; its cells never are.
    """
    labelled = detections.labelled_runs(cells, *by)
    sizes = labelled.groupBy(*by, "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("cells"))
    sides = boundary(labelled, *by).select("component", *(F.col(c).cast("long").alias(c) for c in ("x", "y", "x2", "y2")))

    def run(table: pa.Table) -> pa.Table:
        rings = traced(list(zip(*(table[c].to_pylist() for c in ("x", "y", "x2", "y2")))))
        rings.sort(key=lambda r: (_area(r) < 0, r[0][1], r[0][0]))
        kinds = pa.schema([("component", pa.int64()), ("rings", pa.list_(pa.list_(pa.list_(pa.int64()))))])
        return pa.table([[table["component"][0].as_py()], [[[list(p) for p in r] for r in rings]]], schema=kinds)

    drawn = sides.groupBy("component").applyInArrow(run, "component long, rings array<array<array<long>>>")
    return sizes.join(drawn, "component").select(*by, "component", "cells", "rings")


def placed(rings: Column, bounds: dict[str, Column], width: Column, height: Column) -> Column:
    """Rings in degrees, from cell corners of a grid over bounds; row 0 is the northern one."""
    lon = lambda x: bounds["west"] + (bounds["east"] - bounds["west"]) * (x / width)
    lat = lambda y: bounds["north"] - (bounds["north"] - bounds["south"]) * (y / height)
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.array(lon(p[0]), lat(p[1]))))


def geojson(rings: Column, properties: Column) -> Column:
    """A feature; ``properties`` is a struct."""
    geometry = F.struct(F.lit("Polygon").alias("type"), rings.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))
