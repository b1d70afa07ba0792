"""Connected components of an undirected graph, with logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.llm.common import fresh_path, join_on_hot, stored


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again, so that its size is that of its files.

    A checkpoint would keep Spark's estimate, and a join's estimate is the product of both sides': over some rounds that is
    a number of megabytes of digits, which takes the driver seconds and hundreds of megabytes to multiply.
    """
    return stored(df, fresh_path(df.sparkSession, "components"))


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(node, label) after its components are merged along edges(a, b); at first a node's label is the node itself.

    A label is the least one of those that merge.

    Rounds work on labels, never on all nodes: a label that has edges goes over into the least of itself and its
    neighbours, or where that one goes, and edges inside what has merged drop out. At least half of the labels with edges
    merge in a round, and a star is gone in one. A label with very many neighbours is met by aggregation and by joins that
    Spark can split; the nodes learn their new label at the end, where one label may hold a third of them.
    """
    ends = edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    ends = ends.where("x <> y").select("x", "y")
    left = kept(ends.union(ends.select("y", "x")).toDF("a", "b").distinct())
    moved = None  # old label, new label
    while not left.isEmpty():
        to = kept(left.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("old"), F.least("a", "to").alias("to")))
        hop = kept(to.join(to.select(F.col("old").alias("to"), F.col("to").alias("new")), "to").select("old", "new"))
        if moved is None:
            moved = hop
        else:
            step = hop.select(F.col("old").alias("new"), F.col("new").alias("newest"))
            moved = kept(moved.join(step, "new", "left").select("old", F.coalesce("newest", "new").alias("new")))
        ends = left.join(hop.withColumnsRenamed({"old": "a", "new": "x"}), "a").join(hop.withColumnsRenamed({"old": "b", "new": "y"}), "b")
        left = kept(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if moved is None:
        return labels
    held = labels.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"))
    moved = kept(moved.join(held, moved["old"] == held["label"]).select("label", "new", "nodes"))
    out = join_on_hot(labels, moved, "label", "nodes", labels.count())
    return kept(out.select("node", F.coalesce("new", "label").alias("label")))
