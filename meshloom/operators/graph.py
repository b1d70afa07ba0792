"""Graphs as DataFrames: nodes(node_id, x, ...), edges(src, dst), owners(node_id, client_id).

Whatever holds for one graph holds for many: `by` names further key columns, such as the client or the graph, and all of
them go through one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions.scalar import inverse_power, scaled, vector_sum
from meshloom.operators.ranking import positions

NORMS = ("none", "sym", "row")
#: Node ids that share a cell when a client's nodes are numbered.
ID_CELL = 1 << 16


def undirected(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    keys = [*by, "src", "dst"]
    return edges.select(*keys).union(edges.select(*by, F.col("dst"), F.col("src"))).distinct()


def with_self_loops(edges: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds a loop at every node, also where there is one already."""
    return edges.select(*by, "src", "dst").unionAll(nodes.select(*by, F.col("node_id").alias("src"), F.col("node_id").alias("dst")))


def degrees(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Out-degree of nodes with edges."""
    return edges.groupBy(*by, F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def hop_sum(nodes: DataFrame, edges: DataFrame, width: int, norm: str = "none", include_self: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Each node's feature sum over its out-neighbours (and itself): (*by, node_id, x).

    none adds plain features; row divides by the degree; sym weighs an edge by 1 / sqrt(deg(src) deg(dst)). Degrees
    count the loop. Duplicate edges add up. The sym weight is a product of two node factors, so features are scaled
    before and after the sum and edges never carry weights. Loops are not edges here but one more row per node, so the
    edges are moved once. Without include_self loops among the edges are left out, and norm must be none. Nodes without
    features count as zero and are not in the result unless they have neighbours with features.
    """
    if norm not in NORMS:
        raise ValueError(f"unknown norm {norm!r}")
    if norm != "none" and not include_self:
        raise ValueError("a norm needs the loop")
    keys = [*by, "node_id"]
    if not include_self:
        edges = edges.where("src <> dst")
    x = nodes.select(*keys, "x")
    factor = None
    if norm != "none":
        counted = degrees(edges, by).withColumnRenamed("degree", "d")
        counted = counted.unionByName(x.select(*keys, F.lit(1).cast("long").alias("d"))).groupBy(*keys).agg(F.sum("d").alias("d"))
        factor = counted.select(*keys, inverse_power(F.col("d"), 0.5 if norm == "sym" else 1.0).alias("f"))
    if norm == "sym":
        x = x.join(factor, keys).select(*keys, scaled(F.col("x"), F.col("f")).alias("x"))
    ends = edges.select(*by, "src", F.col("dst").alias("node_id"))
    sent = ends.join(x, keys).select(*by, F.col("src").alias("node_id"), "x")
    if include_self:
        sent = sent.unionByName(x)
    summed = sent.groupBy(*keys).agg(vector_sum(F.col("x"), width).alias("x"))
    if factor is not None:
        summed = summed.join(factor, keys).select(*keys, scaled(F.col("x"), F.col("f")).alias("x"))
    return summed


def client_feature_sum(nodes: DataFrame, edges: DataFrame, owners: DataFrame, width: int, norm: str = "none") -> DataFrame:
    """Each client's feature sum over the edges it holds: (client_id, node_id, x), only where it isn't zero.

    A client holds its nodes' features and the edges that end in them, and knows degrees of those edges only, so sym and
    row differ from the whole graph's. Every node has a loop at every client for the degrees, as a node that a client
    knows only by an edge counts too.
    """
    own = nodes.drop("client_id").join(owners, "node_id").select("client_id", "node_id", "x")
    held = edges.join(owners, edges["dst"] == owners["node_id"]).select("client_id", "src", "dst")
    if norm == "none":
        return hop_sum(own, held, width, norm, by=("client_id",))
    counts = degrees(held, ("client_id",)).withColumn("d", F.col("degree") + 1).drop("degree")
    power = 0.5 if norm == "sym" else 1.0
    keys = ["client_id", "node_id"]

    def weigh(df: DataFrame) -> DataFrame:
        d = F.coalesce("d", F.lit(1))
        return df.join(counts, keys, "left").select(*keys, scaled(F.col("x"), inverse_power(d, power)).alias("x"))

    x = weigh(own) if norm == "sym" else own
    return weigh(hop_sum(x, held, width, by=("client_id",)))


def global_sum(parts: DataFrame, width: int) -> DataFrame:
    """Sum over clients: (node_id, x)."""
    return parts.groupBy("node_id").agg(vector_sum(F.col("x"), width).alias("x"))


def k_hop_nodes(seeds: DataFrame, edges: DataFrame, hops: int, by: tuple[str, ...] = ()) -> DataFrame:
    """seeds(*by, node_id) and what can reach them over at most `hops` edges: distinct (*by, node_id)."""
    found = seeds.select(*by, "node_id").distinct()
    for _ in range(hops):
        step = found.join(edges.select(F.col("dst").alias("node_id"), "src"), "node_id").select(*by, F.col("src").alias("node_id"))
        found = found.union(step).distinct()
    return found


def induced(edges: DataFrame, members: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges with both ends among members(*by, node_id), for every key at once: (*by, src, dst)."""
    ends = edges.select("src", "dst")
    first = ends.join(members.select(*by, F.col("node_id").alias("src")), "src")
    return first.join(members.select(*by, F.col("node_id").alias("dst")), [*by, "dst"], "left_semi").select(*by, "src", "dst")


def client_views(edges: DataFrame, owners: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """Which nodes and edges a client works on: nodes(client_id, node_id, is_local, local_idx), edges(client_id, src, dst).

    hops 0: its own nodes; hops 2: also their neighbours, whose features it gets before training. Others are an error.
    """
    if hops not in (0, 2):
        raise ValueError("hops must be 0 or 2")
    seeds = owners.select("client_id", "node_id")
    members = k_hop_nodes(seeds, edges, 1 if hops == 2 else 0, ("client_id",))
    local = members.join(seeds.withColumn("is_local", F.lit(True)), ["client_id", "node_id"], "left")
    local = positions(local, ["client_id"], F.floor(F.col("node_id") / F.lit(ID_CELL)), ["node_id"], "local_idx")
    local = local.select("client_id", "node_id", F.coalesce("is_local", F.lit(False)).alias("is_local"), "local_idx")
    return local, induced(edges, members, ("client_id",))


def relabelled(edges: DataFrame, views: DataFrame) -> DataFrame:
    """Client edges by local index: (client_id, src, dst)."""
    idx = views.select("client_id", "node_id", "local_idx")
    a = edges.join(idx.withColumnRenamed("node_id", "src"), ["client_id", "src"]).withColumnRenamed("local_idx", "s")
    b = a.join(idx.withColumnRenamed("node_id", "dst"), ["client_id", "dst"])
    return b.select("client_id", F.col("s").alias("src"), F.col("local_idx").alias("dst"))


def row_normalised(weights: DataFrame) -> DataFrame:
    """(src, dst, w) with each row's weights divided by their sum; a row that sums to 0 becomes 0."""
    total = weights.groupBy("src").agg(F.sum("w").alias("t"))
    return weights.join(total, "src").select("src", "dst", F.when(F.col("t") != 0, F.col("w") / F.col("t")).otherwise(0.0).alias("w"))


def set_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_symdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Values of exactly one side."""
    return a.distinct().union(b.distinct()).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
