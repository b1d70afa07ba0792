"""Gradient steps as aggregates. Partial sums are made where the rows are; a client's rows are never in one place.

Models are weights(*by, layer, w, b) as in layers.py; long form is params(client_id, name, pos, v), which federate.py
averages. All randomness is hashed, so a task that runs again gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.functions.scalar import dot, log_softmax, relu, scaled, vector_sum
from meshloom.operators import federate
from meshloom.operators.graph import hop_sum
from meshloom.operators.layers import dense, linear, plus, with_layer
from meshloom.session import durable


def outer_sums(rows: DataFrame, left: str, right: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """(*by, w): the sum over rows of the outer product of two array columns, a row of w per place of `left`.

    Each Arrow batch gives one partial matrix per model; the shuffle adds up model-sized rows, whatever the input.
    """
    keys = rows.select(*by).schema.fields
    schema = T.StructType([*keys, T.StructField("i", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            for key, part in batch.groupby(list(by)) if by else [((), batch)]:
                sums = np.stack(part[left].to_numpy()).T @ np.stack(part[right].to_numpy())
                yield pd.DataFrame({**{k: [v] * len(sums) for k, v in zip(by, key)}, "i": np.arange(len(sums), dtype=np.int32), "g": list(sums)})

    partial = rows.select(*by, left, right).mapInPandas(run, schema)
    summed = partial.groupBy(*by, "i").agg(vector_sum(F.col("g"), width).alias("g"))
    return summed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "g"))).alias("w")).select(*by, F.col("w.g").alias("w"))


def softmax_error(scores: Column, y: Column) -> Column:
    """Probabilities less the one-hot label: the gradient of the negative log-likelihood by the scores."""
    return F.transform(log_softmax(scores), lambda v, j: F.exp(v) - F.when(j == y, 1.0).otherwise(0.0))


def readout_gradient(rows: DataFrame, weights: DataFrame, layer: str, inputs: int, outputs: int, by: Sequence[str] = ()) -> DataFrame:
    """rows(*by, x, y) -> gradient(*by, layer, w, b) of the mean negative log-likelihood of a dense softmax layer.

    A task adds up sums of the model's size over its rows, whose scores are one matrix product a batch; models come to
    every task whole.
    """
    models = {tuple(m[k] for k in by): (np.array(m["w"], float), np.array(m["b"], float)) for m in weights.where(F.col("layer") == layer).select(*by, "w", "b").collect()}
    schema = T.StructType([*rows.select(*by).schema.fields, T.StructField("name", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("v", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            for key, part in batch.groupby(list(by)) if by else [((), batch)]:
                if key not in models or not len(part):
                    continue
                w, b = models[key]
                x, y = np.stack(part["x"].to_numpy()), part["y"].to_numpy()
                scores = x @ w.T + b
                e = np.exp(scores - scores.max(1, keepdims=True))
                e /= e.sum(1, keepdims=True)
                there = np.flatnonzero((y >= 0) & (y < outputs))
                e[there, y[there].astype(int)] -= 1
                found = [(e.T @ x).ravel(), e.sum(0), np.array([float(len(part))])]
                sums[key] = [a + c for a, c in zip(sums[key], found)] if key in sums else found
        for key, found in sums.items():
            for name, v in zip((f"{layer}.weight", f"{layer}.bias", ""), found):
                yield pd.DataFrame({**{k: [u] * len(v) for k, u in zip(by, key)}, "name": name, "pos": np.arange(len(v)), "v": v})

    known = rows.where("x IS NOT NULL").select(*by, "x", F.coalesce("y", F.lit(-1)).alias("y"))
    total = known.mapInPandas(run, schema).groupBy(*by, "name", "pos").agg(F.sum("v").alias("v"))
    n = total.where("name = ''").select(*by, F.col("v").alias("n"))
    total = total.where("name <> ''")
    mean = total.join(F.broadcast(n), list(by)) if by else total.crossJoin(F.broadcast(n))  # a row per model
    return from_params(mean.select(*by, "name", "pos", (F.col("v") / F.col("n")).alias("v")), by)


def node_gradients(nodes: DataFrame, edges: DataFrame, weights: DataFrame, widths: tuple[int, int, int], by: Sequence[str] = ("client_id",)) -> DataFrame:
    """Gradients of a model of two layers over pre-aggregated features: conv0 dense with ReLU, conv1 a GCN layer.

    nodes(*by, node_id, x, y, is_train), edges(*by, src, dst) symmetric; the loss is the mean negative log-likelihood of
    the training nodes of each model. Since A is symmetric, errors go back over the same neighbourhood sum as scores go
    forward, and both have the width of the classes, not of the features.
    """
    features, hidden, classes = widths
    keys = [*by, "node_id"]
    first = dense(nodes.select(*keys, "x"), weights, "conv0", by).withColumn("h", relu(F.col("x"))).drop("x")
    moved = dense(first.select(*keys, F.col("h").alias("x")), weights, "conv1", by, bias=False)
    scores = with_layer(hop_sum(moved, edges, classes, "sym", by=tuple(by)), weights, "conv1", by)
    train = nodes.where("is_train")
    counts = train.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    # every node takes part, with zeros where it has no label: it counts in its neighbours' degrees
    labelled = scores.join(train.select(*keys, "y"), keys, "left").join(F.broadcast(counts), list(by))  # a row per model
    error = F.when(F.col("y").isNull(), F.array_repeat(F.lit(0.0), classes)).otherwise(scaled(softmax_error(plus(F.col("x"), F.col("b")), F.col("y")), 1 / F.col("n")))
    errors = durable(labelled.select(*keys, error.alias("x")))
    back = durable(hop_sum(errors, edges, classes, "sym", by=tuple(by)).withColumnRenamed("x", "t"))

    joined = back.join(first, keys)
    second_w = outer_sums(joined, "t", "h", hidden, by)
    second_b = errors.groupBy(*by).agg(vector_sum(F.col("x"), classes).alias("b"))
    # through the second matrix and the ReLU: only where the hidden value is above 0
    down = with_layer(joined, weights, "conv1", by)
    columns = F.transform(F.sequence(F.lit(0), F.lit(hidden - 1)), lambda i: F.aggregate(F.zip_with("t", "w", lambda t, row: t * row[i]), F.lit(0.0), lambda s, v: s + v))
    hidden_error = F.zip_with(columns, F.col("h"), lambda g, h: F.when(h > 0, g).otherwise(0.0))
    below = down.select(*keys, hidden_error.alias("d")).join(nodes.select(*keys, "x"), keys)
    first_w = outer_sums(below, "d", "x", features, by)
    first_b = below.groupBy(*by).agg(vector_sum(F.col("d"), hidden).alias("b"))
    one = first_w.join(first_b, list(by)).select(*by, F.lit("conv0").alias("layer"), "w", "b")
    return one.unionByName(second_w.join(second_b, list(by)).select(*by, F.lit("conv1").alias("layer"), "w", "b"))


def link_gradients(pairs: DataFrame, users: DataFrame, items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Gradients by users and items (id, x) of the mean binary cross-entropy of pairs(user_id, item_id, y)'s dot products.

    An error times the other side's vector, summed by user and by item; a popular item's sum begins on the map side.
    """
    scored = pairs.join(users.select(F.col("id").alias("user_id"), F.col("x").alias("u")), "user_id").join(items.select(F.col("id").alias("item_id"), F.col("x").alias("v")), "item_id")
    error = 1 / (1 + F.exp(-dot(F.col("u"), F.col("v")))) - F.col("y")
    n = pairs.agg(F.count(F.lit(1)).alias("n"))
    errors = scored.crossJoin(F.broadcast(n)).select("user_id", "item_id", "u", "v", (error / F.col("n")).alias("e"))
    by_user = errors.groupBy(F.col("user_id").alias("id")).agg(vector_sum(scaled(F.col("v"), F.col("e")), width).alias("x"))
    return by_user, errors.groupBy(F.col("item_id").alias("id")).agg(vector_sum(scaled(F.col("u"), F.col("e")), width).alias("x"))


def moved_vectors(vectors: DataFrame, gradient: DataFrame, rate: float) -> DataFrame:
    """(id, x) after a step against its gradient; an id without one stays."""
    joined = vectors.join(gradient.withColumnRenamed("x", "g"), "id", "left")
    return joined.select("id", F.when(F.col("g").isNull(), F.col("x")).otherwise(F.zip_with("x", "g", lambda a, g: a - rate * g)).alias("x"))


def to_params(weights: DataFrame, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """Long form: (*by, name, pos, v), with names layer.weight (row by row) and layer.bias."""
    w = weights.select(*by, F.concat("layer", F.lit(".weight")).alias("name"), F.posexplode(F.flatten("w")).alias("pos", "v"))
    b = weights.select(*by, F.concat("layer", F.lit(".bias")).alias("name"), F.posexplode("b").alias("pos", "v"))
    return w.unionByName(b).withColumn("pos", F.col("pos").cast("long"))


def from_params(params: DataFrame, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """weights(*by, layer, w, b) of long form; a group is one layer of one model."""
    part = F.regexp_extract("name", r"^(.*)\.(weight|bias)$", 1)
    flat = params.groupBy(*by, "name").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p")).select(*by, part.alias("layer"), F.col("name").endswith(".bias").alias("is_bias"), F.col("p.v").alias("v"))
    both = flat.groupBy(*by, "layer").agg(F.max(F.when(~F.col("is_bias"), F.col("v"))).alias("flat"), F.max(F.when(F.col("is_bias"), F.col("v"))).alias("b"))
    width = (F.size("flat") / F.size("b")).cast("int")
    rows = F.transform(F.sequence(F.lit(0), F.size("b") - 1), lambda j: F.slice("flat", j * width + 1, width))
    return both.select(*by, "layer", rows.alias("w"), "b")


def sgd(params: DataFrame, gradient: DataFrame, rate: float, decay: float = 0.0, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """params(*by, name, pos, v) less rate times (gradient + decay times v); a place without gradient has gradient 0."""
    keys = [*by, "name", "pos"]
    g = gradient.select(*keys, F.col("v").alias("g"))
    return params.join(g, keys, "left").select(*keys, (F.col("v") - rate * (F.coalesce("g", F.lit(0.0)) + decay * F.col("v"))).alias("v"))


def adam(state: DataFrame, gradient: DataFrame, step: int, rate: float = 1e-3, decay: float = 0.0, first: float = 0.9, second: float = 0.999, eps: float = 1e-8, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """state(*by, name, pos, v, m, s) after step number `step` (from 1): the moments m and s are part of the table."""
    keys = [*by, "name", "pos"]
    joined = state.join(gradient.select(*keys, F.col("v").alias("g")), keys, "left")
    g = F.coalesce("g", F.lit(0.0)) + decay * F.col("v")
    joined = joined.withColumn("m", first * F.col("m") + (1 - first) * g).withColumn("s", second * F.col("s") + (1 - second) * g * g)
    move = F.col("m") / (1 - first**step) / (F.sqrt(F.col("s") / (1 - second**step)) + eps)
    return joined.select(*keys, (F.col("v") - rate * move).alias("v"), "m", "s")


def with_moments(params: DataFrame) -> DataFrame:
    return params.withColumn("m", F.lit(0.0)).withColumn("s", F.lit(0.0))


def proximal_gradient(gradient: DataFrame, params: DataFrame, reference: DataFrame, mu: float, by: Sequence[str] = ("client_id",)) -> DataFrame:
    """gradient plus mu times the distance from reference(name, pos, v): that of mu / 2 times the squared distance."""
    keys = [*by, "name", "pos"]
    gap = params.join(reference.select("name", "pos", F.col("v").alias("r")), ["name", "pos"]).select(*keys, (mu * (F.col("v") - F.col("r"))).alias("p"))
    return gradient.join(gap, keys, "left").select(*keys, (F.col("v") + F.coalesce("p", F.lit(0.0))).alias("v"))


#: name -> (parameters of all clients, sizes(client_id, size), clients) -> merged (name, pos, v)
AGGREGATORS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {}


def register_aggregator(name: str):
    def add(f):
        AGGREGATORS[name] = f
        return f

    return add


@register_aggregator("mean")
def _mean(params: DataFrame, sizes: DataFrame, clients: int) -> DataFrame:
    return federate.mean(params, clients)


@register_aggregator("weighted")
def _weighted(params: DataFrame, sizes: DataFrame, clients: int) -> DataFrame:
    return federate.weighted_mean(params, sizes)


@register_aggregator("none")
def _none(params: DataFrame, sizes: DataFrame, clients: int) -> DataFrame | None:
    """Every client keeps its own: training without exchange."""
    return None


def rounds(params: DataFrame, local: Callable[[DataFrame, int], DataFrame], sizes: DataFrame, clients: int, count: int, aggregator: str = "mean", sampled: Callable[[int], list[int]] | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(round, params after it): every sampled client steps, the merged parameters go to all clients, sampled or not.

    Each round's table is kept in shared storage, so a lost executor repeats a round's work and never an earlier one's.
    """
    if aggregator not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {aggregator!r}")
    for r in range(count):
        chosen = None if sampled is None else sampled(r)
        mine = params if chosen is None else params.where(F.col("client_id").isin(chosen))
        moved = durable(local(mine, r))
        merged = AGGREGATORS[aggregator](moved, sizes, clients if chosen is None else len(chosen))
        if merged is None:
            rest = None if chosen is None else params.where(~F.col("client_id").isin(chosen))
            params = moved if rest is None else durable(moved.unionByName(rest))
        else:
            params = durable(merged.select(F.explode(F.sequence(F.lit(0), F.lit(clients - 1))).alias("client_id"), "name", "pos", "v"))
        yield r, params
