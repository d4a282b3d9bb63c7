"""Connected components of a graph given as edges, by repeated contraction to the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from almanac.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that has an edge; ``component`` is the smallest node of its component.

    edges: ``(a, b)`` of one ordered type; nulls don't count, loops and repeats are harmless. Alternates large-star and
    small-star steps, so the rounds grow with the logarithm of a component's size and no node's neighbours are
    gathered in one place; each round is checkpointed in the shared folder. It ends when a round changes nothing, never before.
    """
    given = edges.select(F.greatest("a", "b").alias("u"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.least("a", "b")).alias("v"))
    given = materialize(given.filter("u is not null").distinct())
    links = given.filter("v is not null")
    before = None
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours.
        both = links.filter("u <> v").unionAll(links.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.min(F.least("u", "v")).over(Window.partitionBy("u"))
        large = both.withColumn("m", low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and the node, are linked to the smallest of them.
        least = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", least)
        links = materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    # The nodes come from what was materialized, so that the edges are made only once.
    nodes = given.select(F.explode(F.array("u", "v")).alias("node")).filter("node is not null").distinct()
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))
