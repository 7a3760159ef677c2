"""Connected components by alternating large and small stars, each step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch

#: Edges of a node from which on it is a hub; more where so many nodes could be hubs that they were no small table.
HUB = 200
NAMES = "stars-a", "stars-b"
#: The tables of the steps; the result reads the last one.
STEPS = "stars-0", *(f"{n}-{part}" for n in NAMES for part in ("least", "large", "down", "small"))


def _linked(edges: DataFrame) -> DataFrame:
    """Both directions of each edge."""
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """Edges (u, v) with the least m of u, from ``least`` (u, m, n: edges of u).

    Edges of hubs get it by broadcast where they stand, so that no hub is dealt to one task. A hub has
    ``hub`` edges at least, which bounds the number of hubs.
    """
    hubs = least.filter(F.col("n") >= hub)
    of_hubs = edges.join(F.broadcast(hubs), "u").select("u", "v", "m")
    others = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.filter(F.col("n") < hub), "u").select("u", "v", "m")
    return of_hubs.unionByName(others)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) -> (u, root): the smallest node of each node's component; nodes without an edge are absent.

    Minima are pre-aggregated before each shuffle; hubs get theirs by broadcast.
    """
    state, before = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars-0"), None
    hub = max(HUB, 2 * state.count() // BROADCAST_ROWS + 1)
    for step in range(200):
        name = NAMES[step % 2]
        both = _linked(state)
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-least")
        large = _with_least(both.filter("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        down = scratch.table(large.distinct(), f"{name}-large").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = scratch.table(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), f"{name}-down")
        lifted = _with_least(down, least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        state = scratch.table(lifted.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-small")
        mark = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle in 200 steps")
    out = state.groupBy("u").agg(F.min("v").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("u"), "root").distinct())
