"""Connected components of an undirected graph, as alternating large-star and small-star rounds.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014).  All
rounds are joins and partial aggregations, so a hub with a third of all edges
is pre-aggregated before its shuffle, and the joins that read its edges are
ordinary sort-merge joins that adaptive execution may split.  The driver only
sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.runtime import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (
        both.where(F.col("lo") > F.col("hi"))
        .join(least, F.col("hi") == F.col("u"))
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
    moved = (
        edges.join(least, F.col("hi") == F.col("u"))
        .where(F.col("lo") != F.col("m"))
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    )
    return moved.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node.

    ``component`` is the smallest node reachable.  Edges with a null end and
    loops are ignored; repeated edges count once; no edges give no rows.
    Nodes may be of any orderable type.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    pairs = pairs.where(F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.col("hi") != F.col("lo")))
    now = cut(pairs.select("hi", "lo").distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state[0] == 0 or tuple(state) == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        before = tuple(state)
        now = cut(_small_star(_large_star(now)))
