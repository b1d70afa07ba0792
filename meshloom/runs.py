"""Whole runs over the canonical tables: a validated specification, and a loop of rounds that are Spark jobs each.

A run returns its metrics as a table: (round, split, client_id, n, loss, value), value being accuracy or AUROC. What a
round leaves behind, parameters and metrics, is kept in shared storage.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.scalar import bce_with_logits, hash32, unit
from meshloom.operators import clustered, federate, gradients, graph, layers, metrics, minibatch, partition, privacy, temporal, training
from meshloom.operators.graph_blocks import graph_blocks
from meshloom.operators.lowrank import compressed, decompressed, factor_entries, factor_mean
from meshloom.session import durable
from meshloom.sources import tables as T

TASKS = ("NC", "GC", "LP")
PROTECTIONS = ("none", "masked", "private", "lowrank")
LINK_METHODS = temporal.SLIDING + temporal.EXPANDING
FEATURES, HIDDEN, CLASSES, VECTOR = 64, 16, 10, 8
#: A graph's classes; the widths of its nodes' features, of the layers, and how many GIN layers there are.
STATES = ("F", "O", "P")
GRAPH_WIDTHS, GIN_LAYERS = (2, 8, len(STATES)), 1


@dataclass(frozen=True)
class RunSpec:
    """What to run. Wrong values are an error here, before any job starts; what isn't given has the default below.

    task NC: nodes of one graph dealt out to clients, hops 0 or 2. GC: many small graphs. LP: pairs in time, by method.
    mu (GC): how strongly a step is drawn back to where the round began, which needs local steps after the first.
    protection of what clients send: masked or private feature sums, or low-rank parameters; one at most, NC only.
    batch_size > 0 (NC): each step takes so many of a client's training nodes, and fan_out neighbours a node, None for all.
    cluster (GC): clients train in clusters that split. buffers > 0 (LP): each step takes one of so many parts of the pairs.
    """

    task: str
    rounds: int = 5
    local_steps: int = 1
    rate: float = 0.1
    decay: float = 5e-4
    hops: int = 2
    norm: str = "none"
    aggregator: str | None = None
    protection: str = "none"
    privacy: privacy.PrivacySpec = field(default_factory=privacy.PrivacySpec)
    rank: int = 4
    mu: float = 0.0
    method: str = "STFL"
    days: int = 3
    sample: int | None = None
    batch_size: int = 0
    fan_out: int | None = None
    cluster: clustered.ClusterSpec | None = None
    buffers: int = 0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.task not in TASKS:
            raise ValueError(f"unknown task {self.task!r}")
        if self.task == "NC" and self.hops not in (0, 2):
            raise ValueError("hops must be 0 or 2")
        if self.norm not in graph.NORMS:
            raise ValueError(f"unknown norm {self.norm!r}")
        if self.protection not in PROTECTIONS:
            raise ValueError(f"unknown protection {self.protection!r}")
        if self.protection != "none" and self.task != "NC":
            raise ValueError("protection is for node classification")
        if self.aggregator is not None and self.aggregator not in training.AGGREGATORS:
            raise ValueError(f"unknown aggregator {self.aggregator!r}")
        if self.task == "LP" and self.method not in LINK_METHODS:
            raise ValueError(f"unknown method {self.method!r}")
        if self.cluster is not None and self.task != "GC":
            raise ValueError("clusters that split are for graph classification")
        if self.mu < 0 or (self.mu and (self.task != "GC" or self.local_steps < 2)):
            raise ValueError("mu must not be negative, and is for graph classification with more than one local step")
        if self.batch_size < 0 or self.buffers < 0 or (self.fan_out is not None and self.fan_out < 1):
            raise ValueError("batch_size and buffers must not be negative, fan_out at least 1")
        if self.rounds < 1 or self.local_steps < 1 or self.days < 1 or self.rate <= 0:
            raise ValueError("rounds, local_steps and days must be at least 1, and rate positive")

    @property
    def merge(self) -> str:
        """How parameters are merged: weighted by training size for graphs, not at all for static links, else the mean."""
        if self.aggregator:
            return self.aggregator
        return "weighted" if self.task == "GC" else "none" if self.method == "StaticGNN" and self.task == "LP" else "mean"


class Timers:
    """Wall time by phase, as rows (phase, seconds) in order of their end."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, float]] = []

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        start = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((name, time.perf_counter() - start))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "phase string, seconds double").groupBy("phase").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("times"))


def _sampler(spec: RunSpec, clients: int):
    """The clients of a round: all, or `sample` of them in turn."""
    if spec.sample is None:
        return None
    return lambda r: sorted({(i + spec.sample * r) % clients for i in range(spec.sample)})


def _collected(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def node_inputs(spark: SparkSession, sf_dir: str, spec: RunSpec) -> tuple[DataFrame, DataFrame]:
    """What clients train on: nodes(client_id, node_id, x, y, split) and edges(client_id, src, dst) both ways.

    With hops 2 features are sums over the neighbourhood, made by all clients together before training, and a client
    sees its neighbours' rows too, without their labels; with hops 0 its own features only.
    """
    nodes, edges, owners = T.nodes(spark, sf_dir), T.edges(spark, sf_dir), T.owners(spark, sf_dir)
    views, held = graph.client_views(edges, owners, spec.hops)
    if spec.hops == 0:
        x = nodes.select("node_id", "x")
    else:
        parts = graph.client_feature_sum(nodes, edges, owners, FEATURES, spec.norm)
        if spec.protection in ("masked", "private"):
            long = parts.select("client_id", "node_id", F.posexplode("x").alias("dim", "v"))
            keys = ("node_id", "dim")
            total = privacy.masked_sum(long, T.CLIENTS, *keys) if spec.protection == "masked" else privacy.private_sum(long, spec.privacy, *keys, release=0)
            x = total.groupBy("node_id").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("d")).select("node_id", F.col("d.v").alias("x"))
        else:
            x = graph.global_sum(parts, FEATURES)
    own = views.where("is_local").select("client_id", "node_id").join(nodes.select("node_id", F.col("label").alias("y"), "split"), "node_id")
    seen = views.select("client_id", "node_id").join(x, "node_id").join(own, ["client_id", "node_id"], "left")
    return durable(seen.select("client_id", "node_id", "x", "y", F.coalesce("split", F.lit("seen")).alias("split"))), durable(held)


def node_metrics(nodes: DataFrame, edges: DataFrame, params: DataFrame, split: str) -> DataFrame:
    """(client_id, split, n, loss, value) of each client's own nodes of a split; 0 for a client that has none."""
    out = layers.aggregated_gcn(nodes.select("client_id", "node_id", "x"), edges, training.from_params(params), [HIDDEN, CLASSES], ("client_id",))
    scored = out.join(nodes.where(F.col("split") == split).select("client_id", "node_id", "y"), ["client_id", "node_id"])
    loss = -F.element_at("x", F.col("y") + 1)
    right = (F.array_position("x", F.array_max("x")) - 1 == F.col("y")).cast("double")
    found = scored.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg(right).alias("value"))
    every = nodes.select("client_id").distinct().join(found, "client_id", "left")
    return every.na.fill(0, ["n", "loss", "value"]).select("client_id", F.lit(split).alias("split"), "n", "loss", "value")


def run_nodes(spark: SparkSession, sf_dir: str, spec: RunSpec) -> DataFrame:
    """Rounds of local gradient steps and merging; validation after each round, test after the last one only."""
    nodes, edges = node_inputs(spark, sf_dir, spec)
    labelled = nodes.withColumn("is_train", F.col("split") == "train")
    shapes = [("conv0", FEATURES, HIDDEN), ("conv1", HIDDEN, CLASSES)]
    params = durable(training.to_params(layers.initial_weights(spark, shapes, spec.seed, T.CLIENTS)))
    sizes = nodes.where("split = 'train'").groupBy("client_id").agg(F.count(F.lit(1)).alias("size"))

    def local(mine: DataFrame, r: int) -> DataFrame:
        for k in range(spec.local_steps):
            some, ends = labelled.join(mine.select("client_id").distinct(), "client_id", "left_semi"), edges
            if spec.batch_size:
                some, ends = node_batch(some, edges, spec, r * spec.local_steps + k)
            g = training.node_gradients(some, ends, durable(training.from_params(mine)), (FEATURES, HIDDEN, CLASSES))
            mine = durable(training.sgd(mine, training.to_params(g), spec.rate, spec.decay))
        return low_rank_round(mine, spec.rank) if spec.protection == "lowrank" else mine

    frames = []
    for r, params in training.rounds(params, local, sizes, T.CLIENTS, spec.rounds, spec.merge, _sampler(spec, T.CLIENTS)):
        frames.append(durable(node_metrics(nodes, edges, params, "val").withColumn("round", F.lit(r))))
    frames.append(node_metrics(nodes, edges, params, "test").withColumn("round", F.lit(spec.rounds - 1)))
    return _collected(frames).select("round", "split", "client_id", "n", "loss", "value")


def node_batch(labelled: DataFrame, edges: DataFrame, spec: RunSpec, step: int) -> tuple[DataFrame, DataFrame]:
    """One step's nodes, of which the seeds are trained on, and the edges that drew them, taken both ways."""
    seeds = labelled.where("is_train").select("client_id", "node_id")
    batch = minibatch.neighbour_batch(seeds, edges, spec.batch_size, 2, spec.fan_out, step, edges_by=("client_id",), seed=spec.seed)
    some = labelled.drop("is_train").join(batch.nodes.select("client_id", "node_id", (F.col("hop") == 0).alias("is_train")), ["client_id", "node_id"])
    return durable(some), durable(graph.undirected(batch.edges, ("client_id",)))


def low_rank_round(params: DataFrame, rank: int) -> DataFrame:
    """Parameters as they come out of compression: matrices by their triplets of `rank`, biases as they are."""
    weights = params.where(F.col("name").endswith(".weight"))
    matrices = training.from_params(params).select("client_id", F.concat("layer", F.lit(".weight")).alias("name"), F.posexplode("w").alias("i", "row")).select("client_id", "name", "i", F.posexplode("row").alias("j", "v"))
    width = matrices.groupBy("client_id", "name").agg((F.max("j") + 1).alias("width"))
    back = decompressed(compressed(matrices.withColumn("client_id", F.col("client_id").cast("int")), "fixed", rank))
    moved = back.join(width, ["client_id", "name"]).select("client_id", "name", (F.col("i") * F.col("width") + F.col("j")).cast("long").alias("pos"), "v")
    return durable(moved.unionByName(params.join(weights.select("client_id", "name").distinct(), ["client_id", "name"], "left_anti").select("client_id", "name", "pos", "v")))


def factor_round(matrices: DataFrame, rank: int) -> DataFrame:
    """The plain mean over clients of the factors of matrices(client_id, name, i, j, v): (name, side, k, pos, v)."""
    return factor_mean(factor_entries(compressed(matrices, "fixed", rank)))


def graph_inputs(spark: SparkSession, sf_dir: str, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """graphs(client_id, graph_id, y, split), nodes(client_id, graph_id, node_id, x) and edges(client_id, graph_id, src, dst).

    Each client's graphs are cut 80/10/10 by class into train, val and test. A graph without edges is left out.
    """
    graphs, edges = T.order_graphs(spark, sf_dir)
    dealt = partition.graph_chunks(graphs, T.CLIENTS, seed)
    cut = partition.stratified_split(dealt, "graph_id", "client_id", 0.8)
    half = hash32("graph_id", seed=seed + 1) < F.lit(1 << 31)
    split = F.when(F.col("is_train"), "train").when(half, "val").otherwise("test")
    y = F.array_position(F.array(*[F.lit(c) for c in STATES]), F.col("y")) - 1
    owned = durable(cut.select("client_id", "graph_id", split.alias("split")).join(graphs.select("graph_id", y.cast("int").alias("y")), "graph_id").select("client_id", "graph_id", "y", "split"))
    ends = durable(edges.join(owned.select("client_id", "graph_id"), "graph_id").select("client_id", "graph_id", "src", "dst"))
    d = graph.degrees(ends, ("client_id", "graph_id"))
    nodes = durable(d.select("client_id", "graph_id", "node_id", F.array(F.lit(1.0), F.log1p(F.col("degree").cast("double"))).alias("x")))
    return owned, nodes, ends


def graph_metrics(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, params: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(client_id, split, n, loss, value) of each client's graphs under its own model."""
    scored = layers.gin(nodes, edges, training.from_params(params), GRAPH_WIDTHS[1], GIN_LAYERS, ("client_id", "graph_id"), ("client_id",), blocks)
    joined = scored.join(graphs, ["client_id", "graph_id"])
    loss, right = -F.element_at("x", F.col("y") + 1), (F.array_position("x", F.array_max("x")) - 1 == F.col("y")).cast("double")
    return joined.groupBy("client_id", "split").agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg(right).alias("value"))


def run_graphs(spark: SparkSession, sf_dir: str, spec: RunSpec) -> DataFrame:
    """Graphs dealt out to clients, who train all layers of a GIN; metrics of all splits after each round.

    With mu > 0 a client's steps are drawn back to the merged parameters of the round before, where its first step begins;
    so the term acts from the second step on. With spec.cluster the clients train in clusters that split, whose rows come
    with those of the split "best": a client's best test accuracy over the models that it entered the cache with, in the
    last round.
    """
    graphs, nodes, edges = graph_inputs(spark, sf_dir, spec.seed)
    features, hidden, classes = GRAPH_WIDTHS
    train = durable(graphs.where("split = 'train'").join(nodes.select("client_id", "graph_id").distinct(), ["client_id", "graph_id"], "left_semi").select("client_id", "graph_id", "y"))
    blocks, of_train = (durable(graph_blocks(nodes, edges, some, ("client_id",))) for some in (None, train))
    shapes = [("pre", features, hidden), *[(f"conv{k}.{i}", hidden, hidden) for k in range(GIN_LAYERS) for i in (0, 1)], ("post", hidden, hidden), ("readout", hidden, classes)]
    params = durable(training.to_params(layers.initial_weights(spark, shapes, spec.seed, T.CLIENTS)))
    sizes = durable(train.groupBy("client_id").agg(F.count(F.lit(1)).alias("size")))

    def gradient(mine: DataFrame) -> DataFrame:
        return training.to_params(gradients.gin_gradients(train, nodes, edges, training.from_params(mine), GRAPH_WIDTHS, GIN_LAYERS, blocks=of_train))

    def local(mine: DataFrame, r: int) -> DataFrame:
        start = mine
        for k in range(spec.local_steps):
            g = gradient(mine)
            if spec.mu and k:
                gap = mine.join(start.select("client_id", "name", "pos", F.col("v").alias("r")), ["client_id", "name", "pos"])
                g = g.unionByName(gap.select("client_id", "name", "pos", (spec.mu * (F.col("v") - F.col("r"))).alias("v"))).groupBy("client_id", "name", "pos").agg(F.sum("v").alias("v"))
            mine = durable(training.sgd(mine, g, spec.rate, spec.decay))
        return mine

    columns = ("round", "split", "client_id", "n", "loss", "value")
    if spec.cluster is None:
        frames = []
        for r, params in training.rounds(params, local, sizes, T.CLIENTS, spec.rounds, spec.merge, _sampler(spec, T.CLIENTS)):
            frames.append(durable(graph_metrics(graphs, nodes, edges, params, blocks).withColumn("round", F.lit(r))))
        return _collected(frames).select(*columns)

    score = lambda p: graph_metrics(graphs, nodes, edges, p, blocks).where("split = 'test'").select("client_id", "value")
    norms = lambda p, r: federate.norms(gradient(p).where(F.col("name").startswith("conv")), "client_id")
    done = list(clustered.clustered_rounds(params, local, sizes, spec.rounds, spec.cluster, score, norms))
    frames = [graph_metrics(graphs, nodes, edges, c.params, blocks).withColumn("round", F.lit(c.number - 1)).select(*columns) for c in done]
    best = clustered.best_of_cache(done, score).join(sizes, "client_id")
    frames.append(best.select(F.lit(spec.rounds - 1).alias("round"), F.lit("best").alias("split"), "client_id", F.col("size").alias("n"), F.lit(None).cast("double").alias("loss"), "value"))
    return _collected(frames)


def link_days(spark: SparkSession, sf_dir: str, days: int) -> list[str]:
    """The last `days` months of the interactions: time steps of a run, as first days."""
    last = T.interactions(spark, sf_dir).agg(F.max("ts").alias("t"))
    starts = last.select(*[F.date_format(F.add_months(F.trunc("t", "month"), -k), "yyyy-MM-dd").alias(f"d{k}") for k in range(days, -1, -1)]).first()
    return [] if starts[0] is None else list(starts)


def run_links(spark: SparkSession, sf_dir: str, spec: RunSpec) -> DataFrame:
    """Time steps in order: the model learns from a slice in `rounds` steps and is scored on the slice after it.

    The model has a vector for each user and item and two layers over the slice's edges, with matrices for each kind of
    node; a step moves all of them. The slice slides by step or expands from the first one, by method. Clients are the
    regions, whose users are their own; a step's gradient is the mean over all clients' pairs, as if they merged after it.
    With spec.buffers a step takes one part of the pairs, drawn by hash.
    """
    x = durable(T.interactions(spark, sf_dir))
    # all steps look up the same pairs: they are told apart once, and lie where the lookups look for them
    known = durable(x.select("user_id", "item_id").repartition(T.parts_for(spark, sf_dir, "lineitem"), "user_id", "item_id").distinct())
    n_items = T.load(spark, sf_dir, "part").count()
    steps = link_days(spark, sf_dir, spec.days + 1)
    if len(steps) > 2:
        recent = durable(temporal.time_slice(x, F.lit(steps[0]).cast("timestamp"), F.lit(steps[-1]).cast("timestamp")))

    def drawn(column: str) -> DataFrame:
        ids = known.select(F.col(column).alias("id")).distinct() if column == "user_id" else spark.range(n_items).toDF("id")
        return ids.select("id", F.array(*[(2 * unit(F.lit(column), "id", F.lit(k), seed=spec.seed) - 1) / 2 for k in range(VECTOR)]).alias("x"))

    nodes = durable(gradients.two_kinds(drawn("user_id"), drawn("item_id")))
    named = [(f"{kind}.conv{k}.{part}", VECTOR, VECTOR) for kind in gradients.KINDS for k in (0, 1) for part in ("neighbours", "self")]
    w = layers.initial_weights(spark, named, spec.seed)
    weights = durable(w.select(F.substring_index("layer", ".", 1).alias("kind"), F.expr("substring(layer, instr(layer, '.') + 1)").alias("layer"), "w", "b"))
    frames = []

    pair = ["client_id", "user_id", "item_id"]

    def between(start: str, end: str) -> DataFrame:
        return temporal.time_slice(recent, F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")).select(*pair).distinct()

    if len(steps) > 2:
        # a pair's negatives are the same in every slice that it is in
        negative = durable(temporal.negatives(recent.select(*pair).distinct(), known, n_items, seed=spec.seed))

    def labelled(some: DataFrame) -> DataFrame:
        at = some.select(F.col("client_id").alias("_client"), F.col("user_id").alias("_user"), F.col("item_id").alias("_of"))
        mine = (F.col("client_id") == F.col("_client")) & (F.col("user_id") == F.col("_user")) & F.col("of").eqNullSafe(F.col("_of"))
        return durable(temporal.labelled(some, negative.join(at, mine, "left_semi")))

    for k, (start, end, after) in enumerate(zip(steps, steps[1:], steps[2:])):
        seen = durable(between(start if spec.method in temporal.SLIDING else steps[0], end))
        both, pairs = durable(gradients.both_ways(seen.select("user_id", "item_id").distinct())), labelled(seen)
        for r in range(spec.rounds):
            some = pairs
            if spec.buffers:
                part = F.pmod(hash32("user_id", "item_id", seed=spec.seed), F.lit(spec.buffers))
                some = pairs.where(part == F.pmod(hash32(F.lit(k), F.lit(r), seed=spec.seed), F.lit(spec.buffers)))
            g, v = gradients.link_model_gradients(some, nodes, both, weights, VECTOR)
            weights = durable(gradients.moved_weights(weights, g, spec.rate, ("kind",)))
            moved = F.zip_with("x", "g", lambda a, b: a - spec.rate * b)
            nodes = durable(nodes.join(v.select("kind", "node_id", F.col("x").alias("g")), ["kind", "node_id"]).select("kind", "node_id", moved.alias("x")))
        _, output = gradients.link_forward(nodes, both, weights, VECTOR)
        scored = durable(gradients.pair_scores(labelled(between(end, after)), output).select("client_id", "y", "score"))
        loss = scored.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.avg(bce_with_logits(F.col("score"), F.col("y").cast("double"))).alias("loss"))
        frames.append(durable(metrics.auroc(scored, "client_id").join(loss, "client_id").select(F.lit(k).alias("round"), F.lit("next").alias("split"), "client_id", "n", "loss", F.col("auroc").alias("value"))))
    return _collected(frames) if frames else spark.createDataFrame([], "round int, split string, client_id int, n long, loss double, value double")


def run(spark: SparkSession, sf_dir: str, spec: RunSpec) -> DataFrame:
    """The metrics of a run of any task."""
    return {"NC": run_nodes, "GC": run_graphs, "LP": run_links}[spec.task](spark, sf_dir, spec)


def weighted_summary(found: DataFrame) -> DataFrame:
    """(round, split, value): the mean over clients, weighted by their rows; 0 where there are none."""
    total = F.sum("n")
    return found.groupBy("round", "split").agg(F.coalesce(F.sum(F.col("value") * F.col("n")) / F.when(total != 0, total), F.lit(0.0)).alias("value"))


def private_budget(spec: RunSpec, spark: SparkSession) -> DataFrame:
    """What the run's releases spend: one per round of feature sums, which here is one."""
    return privacy.accountant(spark.createDataFrame([(0, spec.privacy.epsilon, spec.privacy.delta)], "round int, epsilon double, delta double"))


def cluster_round(params: DataFrame, before: DataFrame, clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every client's parameters of the round before plus its cluster's weighted mean change."""
    return federate.clusterwise(before, federate.deltas(params, before), clusters, sizes)
