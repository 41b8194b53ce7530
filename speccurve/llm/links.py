"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speccurve.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``links`` (a, b).

    Every round points each node at its smallest neighbour, follows the
    pointers once more and contracts the links, until none is left; the number
    of rounds grows with the logarithm of the longest chain.  Minima are taken
    before the shuffle, and the joins are by key with one row per key on one
    side, so a node with very many links is split.  A link of a node with
    itself makes it a component; repeated links and nulls do no harm.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    nodes = None
    edges = stored(_both(links), "links")
    while True:
        near = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("up"))
        near = stored(near, "up")
        ahead = near.select(F.col("a").alias("up"), F.col("up").alias("far"))
        up = stored(near.join(ahead, "up").select("a", F.col("far").alias("up")), "up")
        dropped(near)
        if nodes is None:
            nodes = up.select(F.col("a").alias("node"), F.col("up").alias("component"))
        else:
            ends = up.select(F.col("a").alias("component"), "up")
            before = nodes
            nodes = stored(
                nodes.join(ends, "component", "left").select(
                    "node", F.coalesce("up", "component").alias("component")
                ),
                "nodes",
            )
            dropped(before)
        one = up.select("a", F.col("up").alias("x"))
        two = up.select(F.col("a").alias("b"), F.col("up").alias("y"))
        rest = edges.join(one, "a").join(two, "b").where("x <> y")
        contracted = stored(rest.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(),
                            "links")
        dropped(edges)
        edges = contracted
        if edges.isEmpty():
            return nodes


def extended(known: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links behind ``known`` and of further ``links``
    (a, b), from the old components and the new links alone."""
    if links.isEmpty():
        return known
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    fresh = ends.join(known, "node", "left_anti").withColumn("component", F.col("node"))
    nodes = stored(known.unionByName(fresh), "nodes")
    one = nodes.select(F.col("node").alias("a"), F.col("component").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("component").alias("y"))
    met = links.join(one, "a").join(two, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = components(met).select(F.col("node").alias("component"), F.col("component").alias("up"))
    return stored(
        nodes.join(merged, "component", "left").select(
            "node", F.coalesce("up", "component").alias("component")
        ),
        "nodes",
    )


def _both(links: DataFrame) -> DataFrame:
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.select("a", "b").union(back).distinct()
