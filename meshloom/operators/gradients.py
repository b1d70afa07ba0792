"""Gradients of whole models as plans: GIN over many graphs, the link model over two kinds of nodes, batch norm.

Errors go back the way values came: through a matrix by its transpose, through a neighbourhood sum by the same sum, since
edges are there both ways, through a pool by a join of graphs and nodes. A matrix's gradient is a sum of outer products,
made where the rows are (training.outer_sums); what is shuffled for it has the model's size. Activations are kept once in
shared storage, so nothing of the forward pass is computed again on the way back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions.scalar import bce_with_logits, dot, relu, scaled, vector_sum
from meshloom.operators.graph import degrees, hop_sum
from meshloom.operators.graph_blocks import LARGE, block_gradients, graph_blocks
from meshloom.operators.layers import add_pool, linear, plus, with_layer
from meshloom.operators.training import from_params, outer_sums, softmax_error, to_params
from meshloom.session import durable


def through(error: Column, w: Column, width: int) -> Column:
    """The transpose of w times an error: `width` numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.aggregate(F.zip_with(error, w, lambda e, row: e * row[i]), F.lit(0.0), lambda s, v: s + v))


def where_positive(error: Column, value: Column) -> Column:
    """An error through a ReLU that gave `value`."""
    return F.zip_with(error, value, lambda e, v: F.when(v > 0, e).otherwise(0.0))


def dense_gradient(rows: DataFrame, layer: str, error: str, value: str, outputs: int, inputs: int, by: Sequence[str]) -> DataFrame:
    """gradient(*by, layer, w, b) of a dense layer from rows with its outputs' errors and its inputs."""
    w = outer_sums(rows, error, value, inputs, by)
    b = rows.groupBy(*by).agg(vector_sum(F.col(error), outputs).alias("b"))
    joined = w.join(b, list(by)) if by else w.crossJoin(F.broadcast(b))
    return joined.select(*by, F.lit(layer).alias("layer"), "w", "b")


def gin_gradients(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, weights: DataFrame, widths: tuple[int, int, int], layers: int = 1, by: Sequence[str] = ("client_id",), blocks: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """Gradients (*by, layer, w, b) of a GIN by the mean negative log-likelihood of each model's graphs.

    graphs(*by, graph_id, y), nodes(*by, graph_id, node_id, x), edges(*by, graph_id, src, dst) both ways; widths are those
    of features, hidden layers and classes. The model is that of layers.gin: pre, conv0.0, conv0.1, ..., post, readout.
    A graph without nodes has no part in it. blocks are those of graph_blocks of the same tables, if they are kept.
    """
    blocks = graph_blocks(nodes, edges, graphs, by, large) if blocks is None else blocks
    sums = durable(block_gradients(blocks, weights, layers, by))
    apart = sums.where("large IS NOT NULL").select(*by, F.col("large").alias("graph_id"))
    sums = sums.where("large IS NULL").select(*by, "name", "pos", "v")
    if not apart.isEmpty():
        of_graph = [*by, "graph_id"]
        theirs = [df.join(F.broadcast(apart), of_graph, "left_semi") for df in (graphs, nodes, edges)]  # few: each has LARGE rows
        n = durable(theirs[0].join(theirs[1].select(*of_graph).distinct(), of_graph, "left_semi").groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n")))
        mean = to_params(gin_gradients_by_joins(*theirs, weights, widths, layers, by), by)
        more = _with(mean, n, by).select(*by, "name", "pos", (F.col("v") * F.col("n")).alias("v"))
        more = more.unionByName(n.select(*by, F.lit("").alias("name"), F.lit(0).cast("long").alias("pos"), F.col("n").alias("v")))
        sums = durable(sums.unionByName(more).groupBy(*by, "name", "pos").agg(F.sum("v").alias("v")))
    n = sums.where("name = ''").select(*by, F.col("v").alias("n"))
    return from_params(_with(sums.where("name <> ''"), n, by).select(*by, "name", "pos", (F.col("v") / F.col("n")).alias("v")), by)


def gin_gradients_by_joins(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, weights: DataFrame, widths: tuple[int, int, int], layers: int = 1, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """The same for graphs of any size, by joins: no graph is in one task."""
    features, hidden, classes = widths
    of_graph, of_node = [*by, "graph_id"], [*by, "graph_id", "node_id"]
    out = linear(F.col("x"), F.col("w"))
    x = with_layer(nodes.select(*of_node, "x"), weights, "pre", by).select(*of_node, plus(out, F.col("b")).alias("x"))
    held = []  # of each layer: its input x, its inner values h and its output z
    for k in range(layers):
        x = durable(x)
        moved = with_layer(x, weights, f"conv{k}.0", by).select(*of_node, out.alias("x"))
        summed = with_layer(hop_sum(moved, edges, hidden, by=tuple(of_graph)), weights, f"conv{k}.0", by)
        inner = summed.select(*of_node, relu(plus(F.col("x"), F.col("b"))).alias("h"))
        outer = with_layer(inner, weights, f"conv{k}.1", by).select(*of_node, "h", relu(plus(linear(F.col("h"), F.col("w")), F.col("b"))).alias("z"))
        held.append(durable(outer.join(x, of_node)))
        x = held[-1].select(*of_node, F.col("z").alias("x"))
    pooled = add_pool(x, hidden, of_graph).withColumnRenamed("x", "p").join(graphs.select(*of_graph, "y"), of_graph)
    post = with_layer(pooled, weights, "post", by).select(*of_graph, "y", "p", relu(plus(linear(F.col("p"), F.col("w")), F.col("b"))).alias("q"))
    scored = with_layer(post, weights, "readout", by).withColumn("r", softmax_error(plus(linear(F.col("q"), F.col("w")), F.col("b")), F.col("y")))
    counted = pooled.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    scored = scored.join(counted, list(by)) if by else scored.crossJoin(F.broadcast(counted))
    top = scored.withColumn("r", scaled(F.col("r"), 1 / F.col("n")))
    top = top.select(*of_graph, "p", "q", "r", where_positive(through(F.col("r"), F.col("w"), hidden), F.col("q")).alias("e"))
    top = durable(with_layer(top, weights, "post", by).withColumn("d", through(F.col("e"), F.col("w"), hidden)).drop("w", "b"))
    found = dense_gradient(top, "readout", "r", "q", classes, hidden, by).unionByName(dense_gradient(top, "post", "e", "p", hidden, hidden, by))

    # each node of a graph gets the error of the graph's sum
    error = nodes.select(*of_node).join(top.select(*of_graph, "d"), of_graph)
    for k in reversed(range(layers)):
        outer = with_layer(held[k].join(error, of_node), weights, f"conv{k}.1", by).withColumn("e", where_positive(F.col("d"), F.col("z")))
        outer = durable(outer.select(*of_node, "x", "h", "e", where_positive(through(F.col("e"), F.col("w"), hidden), F.col("h")).alias("i")))
        found = found.unionByName(dense_gradient(outer, f"conv{k}.1", "e", "h", hidden, hidden, by))
        bias = outer.groupBy(*by).agg(vector_sum(F.col("i"), hidden).alias("b"))
        sent = durable(hop_sum(outer.select(*of_node, F.col("i").alias("x")), edges, hidden, by=tuple(of_graph)).withColumnRenamed("x", "m").join(outer.select(*of_node, "x"), of_node))
        w = outer_sums(sent, "m", "x", hidden, by)
        joined = w.join(bias, list(by)) if by else w.crossJoin(F.broadcast(bias))
        found = found.unionByName(joined.select(*by, F.lit(f"conv{k}.0").alias("layer"), "w", "b"))
        error = with_layer(sent, weights, f"conv{k}.0", by).select(*of_node, through(F.col("m"), F.col("w"), hidden).alias("d"))
    below = durable(error.join(nodes.select(*of_node, "x"), of_node))
    return found.unionByName(dense_gradient(below, "pre", "d", "x", hidden, features, by))


# The link model: users and items with vectors of their own, two layers of which each kind has its own weights.

KINDS = ("user", "item")


def two_kinds(users: DataFrame, items: DataFrame) -> DataFrame:
    """nodes(kind, node_id, x) of users(id, x) and items(id, x); an item's id lies behind the users' by its sign."""
    one = users.select(F.lit("user").alias("kind"), F.col("id").cast("long").alias("node_id"), "x")
    return one.unionByName(items.select(F.lit("item").alias("kind"), (-F.col("id").cast("long") - 1).alias("node_id"), "x"))


def both_ways(edges: DataFrame) -> DataFrame:
    """edges(user_id, item_id) as edges(src, dst) from users to items and back, in ids of two_kinds."""
    one = edges.select(F.col("user_id").cast("long").alias("src"), (-F.col("item_id").cast("long") - 1).alias("dst"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def of_kind(nodes: DataFrame, kind: str, x: str = "x") -> DataFrame:
    """(id, x) of one kind's nodes."""
    at = F.col("node_id") if kind == "user" else -F.col("node_id") - 1
    return nodes.where(F.col("node_id") >= 0 if kind == "user" else F.col("node_id") < 0).select(at.alias("id"), F.col(x).alias("x"))


def _other(nodes: DataFrame) -> DataFrame:
    """nodes under the kind that they send to."""
    return nodes.withColumn("kind", F.when(F.col("kind") == "user", "item").otherwise("user"))


def kind_layer(nodes: DataFrame, both: DataFrame, weights: DataFrame, layer: str, width: int) -> DataFrame:
    """nodes(kind, node_id, x) after a layer: the receiving kind's matrix times the neighbours' mean, and its own part.

    weights(kind, layer, w, b) has `layer.neighbours` and `layer.self` of each kind. Matrices are applied before the mean.
    """
    keys, out = ["kind", "node_id"], linear(F.col("x"), F.col("w"))
    sent = with_layer(_other(nodes.select(*keys, "x")), weights, f"{layer}.neighbours", ("kind",)).select("node_id", out.alias("x"))
    around = hop_sum(sent, both, width, include_self=False).withColumnRenamed("x", "s").join(degrees(both), "node_id")
    own = with_layer(nodes.select(*keys, "x"), weights, f"{layer}.self", ("kind",)).select(*keys, plus(out, F.col("b")).alias("x"))
    joined = own.join(around, "node_id", "left")
    mean = F.transform("s", lambda v: v / F.col("degree"))
    return joined.select(*keys, F.when(F.col("s").isNull(), F.col("x")).otherwise(plus(F.col("x"), mean)).alias("x"))


def kind_layer_back(nodes: DataFrame, both: DataFrame, weights: DataFrame, layer: str, outputs: int, inputs: int) -> tuple[DataFrame, DataFrame]:
    """nodes(kind, node_id, x, e), the layer's inputs and its outputs' errors -> (gradient by kind, errors of the inputs).

    The mean's transpose: a node's error over its degree goes to each of its neighbours.
    """
    keys = ["kind", "node_id"]
    shared = nodes.select("node_id", "e").join(degrees(both), "node_id").select("node_id", F.transform("e", lambda v: v / F.col("degree")).alias("x"))
    sent = hop_sum(shared, both, outputs, include_self=False).withColumnRenamed("x", "t")
    zeros = F.array_repeat(F.lit(0.0), outputs)
    joined = durable(nodes.join(sent, "node_id", "left").withColumn("t", F.coalesce("t", zeros)))
    senders = _other(joined)
    found = dense_gradient(joined, f"{layer}.self", "e", "x", outputs, inputs, ("kind",))
    found = found.unionByName(dense_gradient(senders, f"{layer}.neighbours", "t", "x", outputs, inputs, ("kind",)).withColumn("b", zeros))
    own = with_layer(joined, weights, f"{layer}.self", ("kind",)).select(*keys, "x", "t", through(F.col("e"), F.col("w"), inputs).alias("own"))
    back = _other(with_layer(_other(own), weights, f"{layer}.neighbours", ("kind",)))
    return found, back.select(*keys, "x", plus(F.col("own"), through(F.col("t"), F.col("w"), inputs)).alias("e"))


def link_forward(nodes: DataFrame, both: DataFrame, weights: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(hidden, output) values of nodes(kind, node_id, x) under layers conv0, with ReLU, and conv1, kept in storage."""
    hidden = durable(kind_layer(nodes, both, weights, "conv0", width).withColumn("x", relu(F.col("x"))))
    return hidden, durable(kind_layer(hidden, both, weights, "conv1", width))


def pair_scores(pairs: DataFrame, output: DataFrame) -> DataFrame:
    """pairs(user_id, item_id, ...) with u, v, the output vectors, and score, their dot product."""
    users, items = of_kind(output, "user"), of_kind(output, "item")
    joined = pairs.join(users.select(F.col("id").alias("user_id"), F.col("x").alias("u")), "user_id").join(items.select(F.col("id").alias("item_id"), F.col("x").alias("v")), "item_id")
    return joined.withColumn("score", dot(F.col("u"), F.col("v")))


def link_model_gradients(pairs: DataFrame, nodes: DataFrame, both: DataFrame, weights: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(gradient(kind, layer, w, b), gradient(kind, node_id, x) of the nodes' own vectors) by the pairs' mean loss.

    pairs(user_id, item_id, y), the loss being binary cross-entropy of dot products. Nodes that no pair reaches over two
    edges have zeros. All widths are `width`.
    """
    hidden, output = link_forward(nodes, both, weights, width)
    scored = pair_scores(pairs, output)
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    errors = durable(scored.crossJoin(F.broadcast(n)).select("user_id", "item_id", "u", "v", ((1 / (1 + F.exp(-F.col("score"))) - F.col("y")) / F.col("n")).alias("e")))
    to_user = errors.groupBy(F.col("user_id").cast("long").alias("node_id")).agg(vector_sum(scaled(F.col("v"), F.col("e")), width).alias("e"))
    to_item = errors.groupBy((-F.col("item_id").cast("long") - 1).alias("node_id")).agg(vector_sum(scaled(F.col("u"), F.col("e")), width).alias("e"))
    zeros = F.array_repeat(F.lit(0.0), width)
    top = durable(hidden.join(to_user.unionByName(to_item), "node_id", "left").select("kind", "node_id", "x", F.coalesce("e", zeros).alias("e")))
    second, error = kind_layer_back(top, both, weights, "conv1", width, width)
    error = error.select("kind", "node_id", where_positive(F.col("e"), F.col("x")).alias("e"))
    first, vectors = kind_layer_back(nodes.join(error, ["kind", "node_id"]), both, weights, "conv0", width, width)
    return second.unionByName(first), vectors.select("kind", "node_id", F.col("e").alias("x"))


def moved_weights(weights: DataFrame, gradient: DataFrame, rate: float, by: Sequence[str] = ()) -> DataFrame:
    """weights(*by, layer, w, b) after a step against gradient(*by, layer, w, b); a layer without one stays."""
    keys = [*by, "layer"]
    step = lambda x, g: F.zip_with(x, g, lambda a, d: a - rate * d)
    joined = weights.join(gradient.select(*keys, F.col("w").alias("gw"), F.col("b").alias("gb")), keys, "left")
    w, b = F.zip_with("w", "gw", step), step("b", "gb")
    return joined.select(*keys, F.when(F.col("gw").isNull(), F.col("w")).otherwise(w).alias("w"), F.when(F.col("gb").isNull(), F.col("b")).otherwise(b).alias("b"))


def link_loss(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(bce_with_logits(F.col("score"), F.col("y").cast("double"))).alias("loss"), F.count(F.lit(1)).alias("n"))


# Batch norm that learns: out = scale * (x - mean) / sqrt(var + eps) + shift, by place and by model.


def moments(nodes: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, mean, var): counts, means and variances (with n) of each place, by partial sums."""
    stats = [F.array(*[f(F.col("x")[i]) for i in range(width)]).alias(name) for f, name in ((F.avg, "mean"), (F.var_pop, "var"))]
    return nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *stats)


def _with(rows: DataFrame, one: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.join(one, list(by)) if by else rows.crossJoin(F.broadcast(one))


def normalised(x: Column, mean: Column, var: Column, eps: float) -> Column:
    return F.transform(x, lambda v, i: (v - mean[i]) / F.sqrt(var[i] + eps))


def batch_norm_forward(nodes: DataFrame, affine: DataFrame, stats: DataFrame, by: Sequence[str] = (), eps: float = 1e-5) -> DataFrame:
    """x normed by stats(*by, mean, var), times scale plus shift of affine(*by, scale, shift).

    While training stats are the batch's moments; in evaluation the running ones.
    """
    joined = _with(_with(nodes, stats.select(*by, "mean", "var"), by), affine.select(*by, "scale", "shift"), by)
    hat = normalised(F.col("x"), F.col("mean"), F.col("var"), eps)
    out = F.transform(F.arrays_zip(hat.alias("h"), F.col("scale"), F.col("shift")), lambda z: z["h"] * z["scale"] + z["shift"])
    return joined.withColumn("x", out).drop("mean", "var", "scale", "shift")


def running_statistics(running: DataFrame, stats: DataFrame, by: Sequence[str] = (), momentum: float = 0.1) -> DataFrame:
    """running(*by, mean, var) after a batch with moments stats: momentum of the batch's mean and unbiased variance.

    A batch of one row has no unbiased variance and counts with 0.
    """
    batch = stats.select(*by, F.col("mean").alias("m"), F.transform("var", lambda v: v * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1))).alias("s"))
    mixed = lambda old, new: F.zip_with(old, new, lambda a, b: (1 - momentum) * a + momentum * b)
    return _with(running, batch, by).select(*by, mixed("mean", "m").alias("mean"), mixed("var", "s").alias("var"))


def merged_statistics(running: DataFrame, width: int) -> DataFrame:
    """running(client_id, mean, var) averaged over clients, as other parameters are, and given back to all of them."""
    one = running.agg(*[F.array(*[F.avg(F.col(c)[i]) for i in range(width)]).alias(c) for c in ("mean", "var")])
    return running.select("client_id").crossJoin(F.broadcast(one))


def batch_norm_back(nodes: DataFrame, errors: DataFrame, affine: DataFrame, width: int, by: Sequence[str] = (), eps: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """(gradient(*by, scale, shift), errors(*by, node_id, x) of the inputs) of batch norm over all of a model's nodes.

    nodes(*by, node_id, x) are its inputs, errors(*by, node_id, x) its outputs' errors. Two aggregates, as many numbers as
    places each: the moments, and the errors' sums alone and with the normed values.
    """
    keys = [*by, "node_id"]
    stats = durable(moments(nodes, width, by))
    joined = _with(nodes.select(*keys, "x").join(errors.select(*keys, F.col("x").alias("e")), keys), stats, by)
    hat = joined.select(*keys, "e", normalised(F.col("x"), F.col("mean"), F.col("var"), eps).alias("h"))
    sums = durable(hat.groupBy(*by).agg(vector_sum(F.zip_with("e", "h", lambda e, h: e * h), width).alias("scale"), vector_sum(F.col("e"), width).alias("shift")))
    known = _with(_with(_with(hat, stats.select(*by, "n", "var"), by), sums.select(*by, F.col("scale").alias("eh"), F.col("shift").alias("es")), by), affine.select(*by, "scale"), by)
    back = F.transform(
        F.arrays_zip("e", "h", "var", "eh", "es", "scale"),
        lambda z: z["scale"] / F.sqrt(z["var"] + eps) * (z["e"] - z["es"] / F.col("n") - z["h"] * z["eh"] / F.col("n")),
    )
    return sums, known.select(*keys, back.alias("x"))
