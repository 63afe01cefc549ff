"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is a few joins and partial aggregations.  A hub's edges are never gathered in one task: minima are
pre-aggregated, and the nodes that hold over a thousandth of the edges (so 2000 at most) hand out their minimum by
broadcast, while all others are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import stash, unstash

MAX_ROUNDS = 60
#: A node is a hub if it holds more than one edge in so many, and at least FEW_EDGES.
SHARE, FEW_EDGES = 1000, 100


def _minima(pairs: DataFrame) -> DataFrame:
    """(node, m, n): the least of each node's neighbours and itself, and how many it has."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return stash(least.select(F.col("u").alias("node"), F.least("u", "m").alias("m"), "n"), "minima")


def _with_minima(pairs: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """pairs with m, the minimum of u.  A hub's rows are dealt at random in the shuffled join, as they have theirs already."""
    hubs = F.broadcast(least.where(F.col("n") > limit).select(F.col("node").alias("u"), F.col("m").alias("hub_m")))  # 2 x SHARE rows at most
    told = pairs.join(hubs, "u", "left").withColumn("node", F.when(F.col("hub_m").isNull(), F.col("u")).otherwise(F.xxhash64("u", "v")))
    return told.join(least.select("node", "m"), "node", "left").select("u", "v", F.coalesce("hub_m", "m").alias("m"))


def _large_star(edges: DataFrame, limit: int) -> DataFrame:
    """The starred edges, stored; the table of edges goes."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both)
    starred = stash(_with_minima(both, least, limit).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "starred")
    unstash(edges, least)
    return starred


def _small_star(edges: DataFrame, limit: int) -> DataFrame:
    """The starred edges without repeats, stored; the table of edges goes."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minima(down)
    met = _with_minima(down, least, limit).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    every = met.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v")))
    starred = stash(every.where("u <> v").distinct(), "edges")
    unstash(edges, least)
    return starred


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v: long) -> (u, root): the smallest node that each node which has an edge can reach.

    Loops and repeated edges are allowed.  Rounds grow with the logarithm of the largest component.
    """
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = stash(edges.select("u", "v").where("u <> v").distinct(), "edges")
    before = sign(now)
    for _ in range(MAX_ROUNDS):
        limit = max(FEW_EDGES, before[0] // SHARE)
        # the large star hands the small star no more edges than it got, so one limit bounds the hubs of both
        now = _small_star(_large_star(now, limit), limit)
        after = sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
