"""Connected components over an edge table, without a hot task or a table on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nothi.llm.common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """id, label for every end of an edge (a, b): label is the smallest id that it reaches.

    Each round every node follows its smallest neighbour, if that is smaller, and that one's own choice; nodes that meet become one, and edges
    inside it go. At least half of the nodes that have an edge go each round, so rounds are few and soon small. Tables between the joins are written to the
    shared folder, which leaves both sides of every join plain, so that Spark can split a node that many others have followed.
    """
    live = materialize(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = None
    while True:
        first = materialize(live.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), "parents")
        if labels is not None and first.isEmpty():
            return labels
        to = first.select(F.col("a").alias("p"), F.col("p").alias("next"))
        parent = materialize(first.join(to, "p").select("a", F.col("next").alias("p")), "parents")
        if labels is None:
            moved, done = parent.select(F.col("a").alias("id"), F.col("p").alias("label")), []
        else:
            moved, done = labels.join(parent.withColumnRenamed("a", "label"), "label", "left").select("id", F.coalesce("p", "label").alias("label")), [labels]
        labels = materialize(moved, "labels")
        half = materialize(live.join(parent, "a").select("b", F.col("p").alias("x")), "edges")
        ends = half.join(parent.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("p").alias("b"))
        done += [live, first, parent, half]
        live = materialize(ends.filter("a <> b").distinct(), "edges")
        for table in done:
            release(table)
