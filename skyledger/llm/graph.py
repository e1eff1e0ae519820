"""Connected components of a table of links, by alternating large and small stars.

Every step is an aggregation and a join; no list of neighbours is gathered, so a hub with millions
of links is only a skewed join key. State is cut after every round by a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links in a file.
ROWS = 1_000_000


def _large(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: every larger neighbour of a vertex is tied to the smallest vertex near it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: a vertex and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, max_rounds: int = 50, files: bool = False) -> DataFrame:
    """(id, component_id) for every id that has a link; component_id is the smallest id reachable. ``links`` has columns u and v.

    With ``files``, rounds are written in as many files as their links fill, not one for each partition.
    """
    edges = common.saved(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    for _ in range(max_rounds):
        now = _small(_large(edges))
        edges = common.saved(now.repartition(1 + state[0] // ROWS) if files else now, "edges")
        new = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
