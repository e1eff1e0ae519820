"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import saved


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of a link (u, v); component is the least id reachable.

    In a round every id is tied to the least id near it, and then to what that one is tied to, so paths
    shrink by half and more. The ties of a round are written before the next; it ends when none changed.
    """
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = saved(both, "links")
    ties = saved(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("up")), "ties")
    for _ in range(max_rounds):
        # The least id that a neighbour is tied to is offered to what an id is tied to, and to itself.
        near = both.join(ties.select(F.col("id").alias("v"), F.col("up").alias("_near")), "v").groupBy(F.col("u").alias("id")).agg(F.min("_near").alias("_near"))
        seen = ties.join(near, "id").select("id", "up", F.least("up", "_near").alias("least"))
        hooked = seen.groupBy(F.col("up").alias("id")).agg(F.min("least").alias("_hook"))
        now = seen.join(hooked, "id", "left").select("id", F.least("least", "_hook").alias("mid"), F.col("up").alias("_before"))
        jump = now.select(F.col("id").alias("mid"), F.col("mid").alias("_far"))
        now = saved(now.join(jump, "mid", "left").select("id", F.least("mid", "_far").alias("up"), "_before"), "ties")
        ties = now.select("id", "up")
        if now.filter("up != _before").isEmpty():
            return ties.select("id", F.col("up").alias("component"))
    raise RuntimeError("components did not settle")
