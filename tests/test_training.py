"""Layers and gradients against dense numpy, and whole runs."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom import runs
from meshloom.operators import clusters, federate, layers, temporal, training
from meshloom.plans import q_models

N, FEATURES, HIDDEN, CLASSES = 7, 5, 4, 3


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(N, FEATURES)), rng.integers(0, CLASSES, N)
    pairs = {(a, b) for a in range(N) for b in range(N) if a != b and rng.random() < 0.3}
    pairs |= {(b, a) for a, b in pairs}
    nodes = spark.createDataFrame([(c, i, x[i].tolist(), int(y[i]), bool(i % 3 != c)) for c in range(2) for i in range(N)], "client_id int, node_id long, x array<double>, y int, is_train boolean")
    edges = spark.createDataFrame([(c, a, b) for c in range(2) for a, b in pairs], "client_id int, src long, dst long")
    a = np.eye(N)
    for s, t in pairs:
        a[s, t] = 1
    d = a.sum(1)
    return nodes, edges, x, y, a / np.sqrt(np.outer(d, d)), a


def log_softmax(z):
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def by_layer(weights, client=0):
    return {r["layer"]: (np.array(r["w"]), np.array(r["b"])) for r in weights.where(F.col("client_id") == client).collect()}


def by_node(df):
    return np.array([r["x"] for r in sorted(df.collect(), key=lambda r: r["node_id"])])


@pytest.fixture(scope="module")
def model(spark):
    drawn = layers.initial_weights(spark, [("conv0", FEATURES, HIDDEN), ("conv1", HIDDEN, CLASSES)], 3, 2)
    return drawn.withColumn("b", F.transform("b", lambda v, i: 0.1 * (i + 1)))


def test_forward_passes_are_the_dense_ones(small, model):
    nodes, edges, x, _, a, _ = small
    w = by_layer(model)
    hidden = np.maximum(a @ x @ w["conv0"][0].T + w["conv0"][1], 0)
    want = log_softmax(a @ hidden @ w["conv1"][0].T + w["conv1"][1])
    out = layers.gcn(nodes.select("client_id", "node_id", "x"), edges, model, [HIDDEN, CLASSES], ("client_id",))
    assert by_node(out.where("client_id = 0")) == pytest.approx(want)
    one = layers.aggregated_gcn(nodes.select("client_id", "node_id", "x"), edges, model, [HIDDEN, CLASSES], ("client_id",))
    dense = np.maximum(x @ w["conv0"][0].T + w["conv0"][1], 0)
    assert by_node(one.where("client_id = 1")) == pytest.approx(log_softmax(a @ dense @ w["conv1"][0].T + w["conv1"][1]))


def test_dropout_keeps_the_mean(spark):
    df = spark.range(2000).select("id", layers.dropout(F.array(F.lit(1.0), F.lit(2.0)), 0.25, "id").alias("x"))
    mean = df.agg(F.avg(F.col("x")[0]), F.avg(F.col("x")[1])).first()
    assert tuple(mean) == pytest.approx((1.0, 2.0), rel=0.1)


def test_gradients_are_finite_differences(small, model):
    nodes, edges, x, y, a, _ = small
    got = by_layer(training.node_gradients(nodes, edges, model, (FEATURES, HIDDEN, CLASSES)))
    w = by_layer(model)
    train = np.array([i % 3 != 0 for i in range(N)])

    def loss(w):
        hidden = np.maximum(x @ w["conv0"][0].T + w["conv0"][1], 0)
        out = log_softmax(a @ hidden @ w["conv1"][0].T + w["conv1"][1])
        return -out[np.arange(N), y][train].mean()

    for name in w:
        for part in (0, 1):
            want = np.zeros_like(w[name][part])
            for at in np.ndindex(want.shape):
                moved = []
                for step in (1e-5, -1e-5):
                    other = {k: [m.copy() for m in v] for k, v in w.items()}
                    other[name][part][at] += step
                    moved.append(loss(other))
                want[at] = (moved[0] - moved[1]) / 2e-5
            assert got[name][part] == pytest.approx(want, abs=1e-7), (name, part)


def test_long_form_round_trip_and_steps(model):
    p = training.to_params(model)
    back = by_layer(training.from_params(p))
    assert all(np.array_equal(back[k][i], v[i]) for k, v in by_layer(model).items() for i in (0, 1))
    g = p.withColumn("v", F.lit(2.0))
    want = [0.9 * r["v"] - 0.2 for r in p.orderBy("client_id", "name", "pos").collect()]
    assert [r["v"] for r in training.sgd(p, g, 0.1, 1.0).orderBy("client_id", "name", "pos").collect()] == pytest.approx(want)
    state = training.adam(training.with_moments(p), g, 1, 0.01)
    assert state.join(p.withColumnRenamed("v", "o"), ["client_id", "name", "pos"]).agg(F.max(F.abs(F.col("o") - F.col("v") - 0.01))).first()[0] < 1e-6


def test_rounds_merge_sampled_clients_and_tell_all(spark, model):
    p = training.to_params(model).where("name = 'conv1.bias'")
    sizes = spark.createDataFrame([(0, 1), (1, 3)], "client_id int, size long")
    local = lambda mine, r: mine.withColumn("v", F.col("v") + F.col("client_id") + 1)
    for how, sampled, want in (("mean", None, 1.5), ("weighted", None, 1.75), ("mean", lambda r: [1], 2.0)):
        (_, out), = training.rounds(p, local, sizes, 2, 1, how, sampled)
        gap = out.join(p.withColumnRenamed("v", "o"), ["client_id", "name", "pos"]).agg(F.min(F.col("v") - F.col("o")), F.max(F.col("v") - F.col("o")), F.count(F.lit(1))).first()
        assert tuple(gap) == pytest.approx((want, want, 6))
    with pytest.raises(ValueError):
        list(training.rounds(p, local, sizes, 2, 1, "no such"))


def test_link_model_is_two_mean_layers(spark):
    shapes = [(f"conv{k}.{side}", 2, 2) for k in range(2) for side in ("neighbours", "self")]
    w = layers.initial_weights(spark, shapes)
    users = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "node_id long, x array<double>")
    items = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.5, 0.0]), (2, [2.0, 1.0])], "node_id long, x array<double>")
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "src long, dst long")
    m = {r["layer"]: np.array(r["w"]) for r in w.collect()}
    x = np.array([[1, 0], [0, 1], [1, 1], [0.5, 0], [2, 1]], float)
    around = np.zeros((5, 5))
    for u, i in ((0, 0), (0, 1), (1, 1)):
        around[u, 2 + i] = around[2 + i, u] = 1
    around /= np.maximum(around.sum(1, keepdims=True), 1)
    h = np.maximum(around @ x @ m["conv0.neighbours"].T + x @ m["conv0.self"].T, 0)
    want = around @ h @ m["conv1.neighbours"].T + h @ m["conv1.self"].T
    u, i = layers.link_model(users, items, edges, w, 2)
    assert np.concatenate([by_node(u), by_node(i)]) == pytest.approx(want)


def test_models_are_chosen_by_data_set_and_hops():
    assert [layers.choose_model(*a) for a in (("cora", 0), ("cora", 2), ("ogbn-arxiv", 0), ("ogbn-arxiv", 1), ("ogbn-products", 0), ("cora", 0, "graphsage"))] == ["gcn", "aggregated", "gcn_normed", "aggregated_normed", "sage", "sage"]


def plain_warp(a, b):
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            cost[i, j] = (x - y) ** 2 + min(cost[i - 1, j], cost[i, j - 1], cost[i - 1, j - 1])
    return np.sqrt(cost[-1, -1])


def test_warp_distances_of_sequences_of_any_length(spark):
    rng = np.random.default_rng(2)
    seqs = [rng.normal(size=n).tolist() for n in (1, 3, 6)]
    got = clusters.pairwise_warp(spark.createDataFrame(list(enumerate(seqs)), "client_id int, s array<double>")).collect()
    assert {(r["a"], r["b"]): r["distance"] for r in got} == pytest.approx({(i, j): plain_warp(seqs[i], seqs[j]) for i in range(3) for j in range(i + 1, 3)})


def test_cut_separates_what_hardly_holds_together():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = int(rng.integers(2, 7))
        w = rng.random((n, n))
        w = w + w.T
        side = clusters.two_sides(w)
        cut = lambda s: sum(w[i, j] for i in range(n) for j in range(i) if s[i] != s[j])
        best = min(cut([(m >> i) & 1 for i in range(n)]) for m in range(1, 2**n - 1))
        assert 0 < side.sum() < n and cut(side) == pytest.approx(best)


def test_cluster_round_moves_clusters_apart(spark):
    before = spark.createDataFrame([(c, "w", 0, 1.0) for c in range(3)], "client_id int, name string, pos long, v double")
    after = before.withColumn("v", F.col("v") + F.col("client_id"))
    belongs = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "client_id int, cluster_id int")
    sizes = spark.createDataFrame([(0, 1), (1, 1), (2, 3)], "client_id int, size long")
    got = {r["client_id"]: r["v"] for r in runs.cluster_round(after, before, belongs, sizes).collect()}
    assert got == pytest.approx({0: 1.0, 1: 2.75, 2: 2.75})
    assert federate.max_update_norm(federate.deltas(after, before)).first()[0] == 2


@pytest.mark.parametrize("wrong", [{"task": "XX"}, {"task": "NC", "hops": 1}, {"task": "NC", "norm": "bogus"}, {"task": "LP", "method": "none"}, {"task": "GC", "protection": "masked"}, {"task": "NC", "protection": "all"}, {"task": "NC", "rounds": 0}, {"task": "NC", "aggregator": "median"}])
def test_wrong_specifications_are_refused(wrong):
    with pytest.raises(ValueError):
        runs.RunSpec(**wrong)


def test_a_step_lowers_the_training_loss_and_runs_report_by_split(spark, sf_dir):
    spec = runs.RunSpec(task="NC", rounds=1, rate=0.5, norm="row")
    nodes, edges = runs.node_inputs(spark, sf_dir, spec)
    p = training.to_params(layers.initial_weights(spark, [("conv0", 64, 16), ("conv1", 16, 10)], 42, 5))
    g = training.node_gradients(nodes.withColumn("is_train", F.col("split") == "train"), edges, training.from_params(p), (64, 16, 10))
    moved = training.sgd(p, training.to_params(g), 0.5)
    before, after = ({r["client_id"]: r["loss"] for r in runs.node_metrics(nodes, edges, x, "train").collect()} for x in (p, moved))
    assert len(before) == 5 and all(after[c] < before[c] for c in before)
    found = runs.run(spark, sf_dir, spec)
    assert {(r["round"], r["split"]) for r in found.collect()} == {(0, "val"), (0, "test")} and 0 <= runs.weighted_summary(found).first()["value"] <= 1


def test_timers_add_up_by_phase(spark):
    timers = runs.Timers()
    for name in ("a", "b", "a"):
        with timers.phase(name):
            pass
    assert {r["phase"]: r["times"] for r in timers.table(spark).collect()} == {"a": 2, "b": 1}


def test_rows_are_not_dealt_by_model(spark):
    rows = spark.range(100).select((F.col("id") % 2).cast("int").alias("client_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("x"))
    weights = layers.initial_weights(spark, [("conv0", 2, 3)], clients=2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = layers.with_layer(rows, weights, "conv0", ("client_id",))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(client_id" not in plan


def test_later_tries_of_negatives_are_made_where_the_first_has_an_edge(spark, monkeypatch):
    kept, real = [], temporal.durable
    monkeypatch.setattr(temporal, "durable", lambda df: kept.append(real(df)) or kept[-1])
    edges = spark.createDataFrame([(0, u, i) for u in range(20) for i in range(40) if (u * 7 + i) % 5 or u < 2], "client_id int, user_id long, item_id long")
    found = temporal.negatives(edges, edges, 40).collect()
    there, open_ = {(r["user_id"], r["item_id"]) for r in edges.collect()}, {u for u in range(2, 20)}
    assert len(found) == 2 * sum(r["user_id"] in open_ for r in edges.collect())
    assert not any((r["user_id"], r["item_id"]) in there for r in found)
    assert kept[0].count() == 2 * len(there) and kept[1].count() == kept[0].where("_edge is not null").count()


@pytest.mark.parametrize("void", [{"task": "GC", "mu": 0.01}, {"task": "NC", "mu": 0.01, "local_steps": 2}, {"task": "GC", "mu": -1.0, "local_steps": 2}])
def test_a_proximal_term_without_effect_is_refused(void):
    with pytest.raises(ValueError):
        runs.RunSpec(**void)


def test_the_proximal_term_of_train_graphs_changes_its_results(spark, sf_dir, monkeypatch):
    asked = []
    with monkeypatch.context() as m:
        m.setattr(runs, "run", lambda spark, sf_dir, spec: asked.append(spec))
        q_models.train_graphs(spark, sf_dir)
    spec = replace(asked[0], rounds=1)
    drawn, free = ({(r["split"], r["client_id"]): r["loss"] for r in runs.run(spark, sf_dir, s).collect()} for s in (spec, replace(spec, mu=0.0)))
    assert spec.mu > 0 and len(drawn) == 15 and all(abs(drawn[k] - free[k]) > 1e-9 for k in free)
