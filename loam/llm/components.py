"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Pointer jumps in a round; a longer chain takes another round.
JUMPS = 3


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> (node, component): each node that has a link, with the smallest node it reaches.

    In each round every node points to its smallest neighbour or itself, pointers are followed a few times, and
    the links are carried over to what the nodes point to; at least half of the nodes that still have links go
    in each round. Nothing but the tables themselves holds nodes. No links give no rows."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = saved(edges, "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component"))
        parent = saved(parent, "parents")
        for _ in range(JUMPS):
            up = parent.select(F.col("node").alias("component"), F.col("component").alias("above")).filter("component <> above")
            parent = parent.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"))
        parent = saved(parent, "parents")
        if labels is None:
            labels = parent
        else:
            up = parent.select(F.col("node").alias("component"), F.col("component").alias("above"))
            labels = saved(labels.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component")), "labels")
        to = lambda c: parent.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))  # noqa: E731, B023
        moved = edges.join(to("a"), "a").join(to("b"), "b").filter("a_to <> b_to")
        edges = saved(moved.select(F.greatest("a_to", "b_to").alias("a"), F.least("a_to", "b_to").alias("b")).distinct(), "links")
    return links.sparkSession.createDataFrame([], "node long, component long") if labels is None else labels
