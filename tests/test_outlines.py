"""Patches, outlines and components on small grids against plain searches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skyledger.operators import components, detections, outlines


def grid_of(text):
    return [(x, y) for y, line in enumerate(text.split()) for x, c in enumerate(line) if c == "#"]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def inside(x, y, ring):
    return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:])) % 2 == 1


HOLE = "#####.. #...#.. #.#.#.# #...#.. #####.."
TOUCH = "##.... ##.... ..##.. ..##.. ....##"
PINCH = "##### #.#.# ##### #.#.# #####"
COMB = "#.#.#.#.# #.#.#.#.# #########"
ROW = "#" * 200 + " " + "." * 150 + "#" * 50


@pytest.mark.parametrize("text", [HOLE, TOUCH, PINCH, COMB, ROW, "#", "#.#.# .#.#. #.#.#"])
def test_rings_enclose_their_cells(spark, text):
    cells = grid_of(text)
    df = spark.createDataFrame([("k", x, y) for x, y in cells], "name string, x int, y int")
    rows = outlines.polygons(df, "name").collect()
    seen = Counter()
    for r in rows:
        rings = [[tuple(p) for p in ring] for ring in r["rings"]]
        assert all(ring[0] == ring[-1] and len(ring) >= 5 for ring in rings)
        assert area(rings[0]) > 0 and all(area(h) < 0 for h in rings[1:]) and sum(map(area, rings)) == r["cells"]
        # No two neighbouring points lie on one line with the next: sides are as long as they are straight.
        for ring in rings:
            assert all((a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(ring, ring[1:], ring[2:]))
        for x, y in cells:
            seen[x, y] += inside(x + 0.5, y + 0.5, rings[0]) and not any(inside(x + 0.5, y + 0.5, h) for h in rings[1:])
    assert seen == Counter({c: 1 for c in cells})
    if text == HOLE:
        assert sorted((r["cells"], len(r["rings"])) for r in rows) == [(1, 1), (1, 1), (16, 2)]
    if text == TOUCH:
        assert sorted(r["cells"] for r in rows) == [2, 4, 4]


def test_outlines_in_degrees_as_geojson(spark):
    df = spark.createDataFrame([("k", 0, 0), ("k", 1, 0)], "name string, x int, y int")
    b = {"west": F.lit(10.0), "south": F.lit(-1.0), "east": F.lit(12.0), "north": F.lit(1.0)}
    placed = outlines.polygons(df, "name").select("name", outlines.placed(F.col("rings"), b, F.lit(4), F.lit(2)).alias("rings"))
    text = placed.select(outlines.geojson(F.col("rings"), F.struct("name")).alias("f")).first()["f"]
    assert text == '{"type":"Feature","properties":{"name":"k"},"geometry":{"type":"Polygon","coordinates":[[[10.0,1.0],[11.0,1.0],[11.0,0.0],[10.0,0.0],[10.0,1.0]]]}}'


def test_patches_are_numbered_by_their_first_cells(spark):
    cells = grid_of("..## #... #..# ###.")
    df = spark.createDataFrame([(1, x, y, "gain") for x, y in cells] + [(1, 9, 9, "loss"), (1, 5, 5, None), (2, 0, 0, "gain")], "img int, x int, y int, change string")
    got = sorted(tuple(r) for r in detections.change_patches(df, 2.0, 2.0).collect())
    assert got == [(1, "gain", 0, 2, 4.0, 2, 0, 3, 0), (1, "gain", 1, 5, 10.0, 0, 1, 2, 3), (1, "gain", 2, 1, 2.0, 3, 2, 3, 2), (1, "loss", 0, 1, 2.0, 9, 9, 9, 9), (2, "gain", 0, 1, 2.0, 0, 0, 0, 0)]
    assert detections.change_patches(df, 2.0, 6.0).count() == 1 and detections.change_patches(df.limit(0), 1.0).count() == 0


def test_components_of_paths_and_random_links(spark):
    rng = random.Random(3)
    path = list(range(1000, 1100))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(links, "u long, v long")).collect()}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in near:
        todo, seen = [start], set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += near[x]
        assert got[start] == min(seen)
    assert set(got) == set(near)
