"""Graph layers as plans: nodes(*by, node_id, x), edges(*by, src, dst), models as tables.

A model is weights(*by, layer, w, b): w holds a row of input weights per output, b a number per output; with `by` every
client has its own model, and one plan runs them all. Weights are applied before neighbours are summed, so that what is
shuffled has the layer's output width.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.scalar import dot, log_softmax, relu, unit, vector_sum
from meshloom.operators.graph import degrees, hop_sum
from meshloom.operators.graph_blocks import LARGE, block_scores, graph_blocks
from meshloom.session import durable

#: (layer, inputs, outputs)
Shape = tuple[str, int, int]


def initial_weights(spark: SparkSession, shapes: Sequence[Shape], seed: int = 42, clients: int | None = None) -> DataFrame:
    """weights(layer, w, b) drawn uniformly within sqrt(6 / (inputs + outputs)) by hash; with `clients`, the same for each.

    The hash makes a reset or a rerun give the same numbers.
    """
    table = spark.createDataFrame(list(shapes), "layer string, inputs int, outputs int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    number = lambda i, j: (2 * unit(F.col("layer"), i, j, seed=seed) - 1) * F.sqrt(6.0 / (F.col("inputs") + F.col("outputs")))
    w = F.transform(upto(F.col("outputs")), lambda j: F.transform(upto(F.col("inputs")), lambda i: number(i, j)))
    out = table.select("layer", w.alias("w"), F.array_repeat(F.lit(0.0), F.col("outputs")).alias("b"))
    return out if clients is None else out.select(F.explode(F.sequence(F.lit(0), F.lit(clients - 1))).alias("client_id"), "*")


def linear(x: Column, w: Column) -> Column:
    """w x, a number per row of w."""
    return F.transform(w, lambda row: dot(x, row))


def plus(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def with_layer(rows: DataFrame, weights: DataFrame, layer: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with the columns w and b of one layer. A row per model is sent to all tasks: dealt by model, rows would go to as few tasks as there are models."""
    one = F.broadcast(weights.where(F.col("layer") == layer).select(*by, "w", "b"))
    return rows.join(one, list(by)) if by else rows.crossJoin(one)


def dense(rows: DataFrame, weights: DataFrame, layer: str, by: Sequence[str] = (), x: str = "x", bias: bool = True) -> DataFrame:
    """rows with column x replaced by w x (+ b)."""
    out = linear(F.col(x), F.col("w"))
    return with_layer(rows, weights, layer, by).withColumn(x, plus(out, F.col("b")) if bias else out).drop("w", "b")


def gcn_layer(nodes: DataFrame, edges: DataFrame, weights: DataFrame, layer: str, width: int, by: Sequence[str] = (), normalised: bool = True) -> DataFrame:
    """D^-1/2 (A + I) D^-1/2 X W + b, of output width `width`; without normalisation (A + I) X W + b."""
    moved = dense(nodes, weights, layer, by, bias=False)
    summed = hop_sum(moved, edges, width, "sym" if normalised else "none", by=tuple(by))
    return with_layer(summed, weights, layer, by).withColumn("x", plus(F.col("x"), F.col("b"))).drop("w", "b")


def neighbour_mean(nodes: DataFrame, edges: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Each node's mean over its out-neighbours, zeros where it has none; an edge that is there twice counts twice."""
    keys = [*by, "node_id"]
    summed = hop_sum(nodes, edges, width, include_self=False, by=tuple(by)).withColumnRenamed("x", "s")
    counted = degrees(edges.where("src <> dst"), tuple(by))
    joined = nodes.select(*keys).join(summed, keys, "left").join(counted, keys, "left")
    mean = F.transform("s", lambda v: v / F.col("degree"))
    return joined.select(*keys, F.coalesce(mean, F.array_repeat(F.lit(0.0), width)).alias("x"))


def sage_layer(nodes: DataFrame, edges: DataFrame, weights: DataFrame, layer: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """W_neighbours mean(neighbours) + W_self x + b; the layer's two matrices are `layer.neighbours` and `layer.self`."""
    keys = [*by, "node_id"]
    around = neighbour_mean(dense(nodes.select(*keys, "x"), weights, f"{layer}.neighbours", by, bias=False), edges, width, by)
    own = dense(nodes.select(*keys, "x"), weights, f"{layer}.self", by).withColumnRenamed("x", "own")
    return around.join(own, keys).select(*keys, plus(F.col("x"), F.col("own")).alias("x"))


def gin_layer(nodes: DataFrame, edges: DataFrame, weights: DataFrame, layer: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Two dense layers with a ReLU between them, over the sum of a node and its neighbours.

    The first matrix is applied before the sum, which it commutes with; its bias is added after.
    """
    moved = dense(nodes, weights, f"{layer}.0", by, bias=False)
    summed = with_layer(hop_sum(moved, edges, width, by=tuple(by)), weights, f"{layer}.0", by)
    inner = summed.withColumn("x", relu(plus(F.col("x"), F.col("b")))).drop("w", "b")
    return dense(inner, weights, f"{layer}.1", by)


def batch_norm(nodes: DataFrame, width: int, by: Sequence[str] = (), eps: float = 1e-5) -> DataFrame:
    """Each place of x less its mean over the model's nodes, over its deviation (with n, not n - 1)."""
    stats = [F.array(*[f(F.col("x")[i]) for i in range(width)]).alias(name) for f, name in ((F.avg, "mean"), (F.var_pop, "var"))]
    one = nodes.groupBy(*by).agg(*stats)
    joined = nodes.join(one, list(by)) if by else nodes.crossJoin(F.broadcast(one))
    scaled = F.transform("x", lambda v, i: (v - F.col("mean")[i]) / F.sqrt(F.col("var")[i] + eps))
    return joined.withColumn("x", scaled).drop("mean", "var")


def dropout(x: Column, share: float, *keys: str, seed: int = 42) -> Column:
    """x with places zeroed by a hash of the keys and the place, and the others scaled up to make up for it."""
    return F.transform(x, lambda v, i: F.when(unit(*keys, i, seed=seed) < share, F.lit(0.0)).otherwise(v / (1 - share)))


def add_pool(nodes: DataFrame, width: int, by: Sequence[str] = ("graph_id",)) -> DataFrame:
    """The sum of a graph's nodes: (*by, x)."""
    return nodes.groupBy(*by).agg(vector_sum(F.col("x"), width).alias("x"))


def activated(nodes: DataFrame, share: float = 0.0, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """ReLU, and dropout while training (share > 0)."""
    out = nodes.withColumn("x", relu(F.col("x")))
    return out.withColumn("x", dropout(F.col("x"), share, *by, "node_id", seed=seed)) if share else out


def _stack(layer: Callable, nodes: DataFrame, edges: DataFrame, weights: DataFrame, widths: Sequence[int], by: Sequence[str], share: float, normed: bool) -> DataFrame:
    last = len(widths) - 1
    for k, width in enumerate(widths):
        nodes = layer(nodes, edges, weights, f"conv{k}", width, by)
        if k < last:
            nodes = activated(batch_norm(nodes, width, by) if normed else nodes, share, by, seed=k)
    return nodes.withColumn("x", log_softmax(F.col("x")))


def gcn(nodes: DataFrame, edges: DataFrame, weights: DataFrame, widths: Sequence[int], by: Sequence[str] = (), share: float = 0.0, normed: bool = False, normalised: bool = True) -> DataFrame:
    """Log-probabilities by GCN layers conv0, conv1, ... of the given output widths, with batch norm if `normed`."""
    layer = lambda *a: gcn_layer(*a, normalised=normalised)
    return _stack(layer, nodes, edges, weights, widths, by, share, normed)


def aggregated_gcn(nodes: DataFrame, edges: DataFrame, weights: DataFrame, widths: Sequence[int], by: Sequence[str] = (), share: float = 0.0, normed: bool = False) -> DataFrame:
    """The same over features that are neighbourhood sums already: the first layer is a dense one."""

    def layer(n, e, w, name, width, by):
        return dense(n, w, name, by) if name == "conv0" else gcn_layer(n, e, w, name, width, by)

    return _stack(layer, nodes, edges, weights, widths, by, share, normed)


def sage(nodes: DataFrame, edges: DataFrame, weights: DataFrame, widths: Sequence[int], by: Sequence[str] = (), share: float = 0.0) -> DataFrame:
    return _stack(sage_layer, nodes, edges, weights, widths, by, share, False)


def gin(nodes: DataFrame, edges: DataFrame, weights: DataFrame, hidden: int, layers: int, by: Sequence[str] = ("graph_id",), model_by: Sequence[str] = (), blocks: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """Log-probabilities per graph: a dense layer, GIN layers with ReLU, the sum over nodes, a dense ReLU, the readout.

    by names the graph: graph_id, after the client whose model it is, model_by. blocks are those of graph_blocks of the
    same tables, if they are kept.
    """
    blocks = graph_blocks(nodes, edges, None, model_by, large) if blocks is None else blocks
    found = durable(block_scores(blocks, weights, layers, model_by))
    scores, apart = found.where("x IS NOT NULL").select(*by, "x"), found.where("x IS NULL").select(*by)
    if apart.isEmpty():
        return scores
    theirs = [df.join(F.broadcast(apart), list(by), "left_semi") for df in (nodes, edges)]  # few: each has LARGE rows
    return scores.unionByName(gin_by_joins(*theirs, weights, hidden, layers, by, model_by).select(*by, "x"))


def gin_by_joins(nodes: DataFrame, edges: DataFrame, weights: DataFrame, hidden: int, layers: int, by: Sequence[str] = ("graph_id",), model_by: Sequence[str] = ()) -> DataFrame:
    """The same for graphs of any size, by joins: no graph is in one task."""
    x = dense(nodes, weights, "pre", model_by)
    for k in range(layers):
        moved = dense(x, weights, f"conv{k}.0", model_by, bias=False)
        summed = with_layer(hop_sum(moved, edges, hidden, by=tuple(by)), weights, f"conv{k}.0", model_by)
        inner = summed.withColumn("x", relu(plus(F.col("x"), F.col("b")))).drop("w", "b")
        x = dense(inner, weights, f"conv{k}.1", model_by).withColumn("x", relu(F.col("x")))
    pooled = dense(add_pool(x, hidden, by), weights, "post", model_by).withColumn("x", relu(F.col("x")))
    return dense(pooled, weights, "readout", model_by).withColumn("x", log_softmax(F.col("x")))


def link_model(users: DataFrame, items: DataFrame, edges: DataFrame, weights: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Two SAGE layers on a graph of users and items: users(node_id, x), items(node_id, x), edges(src user, dst item).

    Items get ids behind the users' by a sign, so both kinds go through one plan; weights are those of layers conv0 and
    conv1. Returns the embeddings of users and of items, whose dot product is a pair's score.
    """
    nodes = users.select("node_id", "x").unionByName(items.select((-F.col("node_id") - 1).alias("node_id"), "x"))
    one = edges.select("src", (-F.col("dst") - 1).alias("dst"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    x = activated(sage_layer(nodes, both, weights, "conv0", width))
    x = sage_layer(x, both, weights, "conv1", width)
    return x.where("node_id >= 0"), x.where("node_id < 0").select((-F.col("node_id") - 1).alias("node_id"), "x")


#: name -> (forward pass, whether it has batch norm)
MODELS: dict[str, tuple[Callable, bool]] = {"gcn": (gcn, False), "gcn_normed": (gcn, True), "aggregated": (aggregated_gcn, False), "aggregated_normed": (aggregated_gcn, True), "sage": (sage, False)}


def choose_model(dataset: str, hops: int, kind: str = "gcn") -> str:
    """The name of the model for a dataset: SAGE if asked for or for products, aggregated layers from one hop on."""
    if kind == "graphsage" or "products" in dataset:
        return "sage"
    normed = "_normed" if "arxiv" in dataset else ""
    return ("aggregated" if hops >= 1 else "gcn") + normed
