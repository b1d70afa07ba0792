"""Mini-batches of a graph: seeds drawn by hash, and their neighbours layer by layer.

A draw is the k rows of least hash within a key. Spark keeps the k least of each key before the shuffle as well as after
it (a limit on row_number), so a node with very many neighbours sends k rows a task, and nobody sees all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.scalar import hash32
from meshloom.session import durable


@dataclass(frozen=True)
class Batch:
    """nodes(*by, node_id, hop): seeds have hop 0; edges(*by, layer, src, dst): from a neighbour to the node that drew it."""

    nodes: DataFrame
    edges: DataFrame


def least_hashed(rows: DataFrame, group: Sequence[str], keys: Sequence, order: str, take: int, seed: int = 42) -> DataFrame:
    """The `take` rows of each group with the least hashes of keys, ties by `order`."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_h", order))
    return rows.withColumn("_h", hash32(*keys, seed=seed)).withColumn("_k", place).where(F.col("_k") <= take).drop("_h", "_k")


def neighbour_batch(seeds: DataFrame, edges: DataFrame, size: int, layers: int, fan_out: int | None = None, step: int = 0, by: Sequence[str] = ("client_id",), edges_by: Sequence[str] = (), seed: int = 42) -> Batch:
    """A batch for each key of `by`: `size` of its seeds(*by, node_id), and `layers` times the neighbours of what is new.

    edges(*edges_by, src, dst); a node's neighbours are the sources of edges that end in it, at most fan_out of them, all
    if None. The hash depends on the step, so steps draw differently and a rerun draws the same. A node that is met again
    keeps its least hop and draws once. Fewer seeds than `size` are all taken; without seeds the batch is empty. What a
    layer adds is kept in shared storage, so draws are not repeated by the next one.
    """
    if size < 1 or layers < 0 or (fan_out is not None and fan_out < 1):
        raise ValueError("size and fan_out must be at least 1, layers at least 0")
    keys = [*by, "node_id"]
    frontier = durable(least_hashed(seeds.select(*keys).distinct(), by, ["node_id", F.lit(step)], "node_id", size, seed))
    nodes, found = frontier.withColumn("hop", F.lit(0)), None
    for k in range(layers):
        ends = edges.select(*edges_by, "src", F.col("dst").alias("node_id"))
        met = frontier.join(ends, [*edges_by, "node_id"]).select(*by, "src", F.col("node_id").alias("dst"))
        if fan_out is not None:
            met = least_hashed(met, [*by, "dst"], ["src", "dst", F.lit(k), F.lit(step)], "src", fan_out, seed)
        met = durable(met.select(*by, F.lit(k + 1).alias("layer"), "src", "dst"))
        found = met if found is None else found.unionByName(met)
        frontier = durable(met.select(*by, F.col("src").alias("node_id")).distinct().join(nodes, keys, "left_anti"))
        nodes = nodes.unionByName(frontier.withColumn("hop", F.lit(k + 1)))
    if found is None:
        found = frontier.where("false").select(*by, F.lit(0).alias("layer"), F.col("node_id").alias("src"), F.col("node_id").alias("dst"))
    return Batch(nodes, found)
