"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """edges: longs a, b. Returns v, root for every end of an edge between two vertices; root is one vertex of the component.

    Each round maps every vertex to the smallest of itself and its neighbours and contracts the edges along this map. Even
    rounds go by vertex number, which takes in a star at once; odd rounds by a hash of the round, under which a path
    shrinks by a constant factor as well. Rounds are few (logarithmic), every one is a grouping with partial minima plus
    two joins whose one side has unique keys, and the edge table shrinks from round to round. Tables are cut each round.
    """
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    turn = 0
    while not live.isEmpty():
        rank = (lambda v: v) if turn % 2 == 0 else (lambda v, t=turn: F.xxhash64(v, F.lit(t)))
        both = live.union(live.select("b", "a"))
        near = both.groupBy(F.col("a").alias("v")).agg(F.min(F.struct(rank(F.col("b")).alias("by"), F.col("b").alias("to"))).alias("m"))
        to = cut(near.select("v", F.least(F.struct(rank(F.col("v")).alias("by"), F.col("v").alias("to")), "m")["to"].alias("r")))
        step = live.join(to.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a").join(to.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
        past, live = live, cut(step.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        discard(past)
        if labels is None:
            labels = to.select("v", F.col("r").alias("root"))
        else:
            labels = labels.join(to.select(F.col("v").alias("root"), "r"), "root", "left").select("v", F.coalesce("r", "root").alias("root"))
        turn += 1
        if turn % 4 == 0:
            labels = cut(labels)
    if labels is None:
        return live.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return labels
