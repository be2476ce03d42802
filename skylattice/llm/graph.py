"""Connected components of a link table, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import stored


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b): component is the smallest node it reaches.

    In each round every node points to the smallest of itself and its neighbours, pointers are followed once more, and
    the links are redrawn between the nodes pointed to; links within one node go.  At most half of the linked nodes
    are left after a round, so the work shrinks geometrically.  Every round is written to the shared folder and read
    again: a checkpoint would carry the constraints of all rounds before into each plan.  An empty table of links
    gives an empty result; repeated links and links of a node to itself change nothing.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    links = stored(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    labels = None
    while True:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("near")).union(links.select("b", "a"))
        to = ends.groupBy("node").agg(F.least("node", F.min("near")).alias("to"))
        beyond = to.select(F.col("node").alias("via"), F.col("to").alias("beyond"))
        to = stored(to.join(beyond, F.col("to") == F.col("via")).select("node", F.col("beyond").alias("to")), "pointers")
        if labels is None:
            labels = to.withColumnRenamed("to", "component")
        else:
            labels = stored(labels.join(to, labels.component == to.node, "left").select(labels.node, F.coalesce("to", "component").alias("component")), "labels")
        from_a, from_b = to.toDF("a", "x"), to.toDF("b", "y")
        drawn = links.filter("a <> b").join(from_a, "a").join(from_b, "b").filter("x <> y")
        links = stored(drawn.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if not links.limit(1).count():
            return labels
