"""Connected components of a graph given as a table of edges, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b: long) the smallest node it can reach.

    Null and self edges add nothing; an empty table gives an empty one.  Labels and edges stay in tables; each round writes
    the labels to the shared folder, so a lost executor costs one round at most.  A round takes the least label among
    neighbours and then the label of that label, so long chains take a logarithmic number of rounds.
    """
    spark = edges.sparkSession
    plain = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct()
    # Written before it is turned round: run twice, a source that picks among equal links would leave some one-way.
    plain = shared.written(plain, "edges")
    both = shared.written(plain.union(plain.select("b", "a")).distinct(), "edges")
    labels = shared.written(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as component"), "labels")
    while True:
        # Edges are the large, possibly skewed side of plain joins between written tables, which Spark may split.
        heard = (
            both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        )
        near = labels.join(heard, labels.node == heard.a, "left").select(
            "node", F.col("component").alias("old"), F.expr("least(component, coalesce(heard, component))").alias("component")
        )
        near = shared.written(near, "labels")
        up = near.select(F.col("node").alias("via"), F.col("component").alias("jump"))
        after = near.join(up, near.component == up.via, "left").select(
            "node", "old", F.expr("least(component, coalesce(jump, component))").alias("component")
        )
        after = shared.written(after, "labels")
        labels = after.select("node", "component")
        if after.filter("component <> old").limit(1).count() == 0:
            return labels
