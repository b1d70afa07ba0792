"""Gradients against finite differences in numpy, batches, clusters that split, shares, and metrics with outliers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import clustered, clusters, gradients, layers, metrics, minibatch, shares, training


def log_softmax(z):
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def differences(loss, arrays):
    """The gradient of loss by each of a dict of arrays."""
    out = {}
    for name, a in arrays.items():
        out[name] = np.zeros_like(a)
        for at in np.ndindex(a.shape):
            ends = []
            for step in (1e-5, -1e-5):
                moved = {k: v.copy() for k, v in arrays.items()}
                moved[name][at] += step
                ends.append(loss(moved))
            out[name][at] = (ends[0] - ends[1]) / 2e-5
    return out


def arrays_of(weights, *by):
    out = {}
    for r in weights.collect():
        key = tuple(r[c] for c in (*by, "layer"))
        out[(*key, "w")], out[(*key, "b")] = np.array(r["w"]), np.array(r["b"], float)
    return out


def test_gin_gradients_are_finite_differences(spark):
    rng, hidden, classes = np.random.default_rng(1), 3, 3
    shapes = [("pre", 2, hidden), *[(f"conv{k}.{i}", hidden, hidden) for k in (0, 1) for i in (0, 1)], ("post", hidden, hidden), ("readout", hidden, classes)]
    weights = layers.initial_weights(spark, shapes, 5, 2).withColumn("b", F.transform("b", lambda v, i: 0.05 * (i + 1)))
    graphs, nodes, edges, dense = [], [], [], []
    for g in range(6):
        n, c = 3 + g % 3, g % 2
        x = rng.normal(size=(n, 2))
        pairs = {(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6}
        a = np.eye(n)
        for s, t in pairs:
            a[s, t] = a[t, s] = 1
            edges += [(c, g, s, t), (c, g, t, s)]
        graphs.append((c, g, int(g % classes)))
        nodes += [(c, g, i, x[i].tolist()) for i in range(n)]
        dense.append((c, a, x, g % classes))
    got = gradients.gin_gradients(
        spark.createDataFrame(graphs, "client_id int, graph_id long, y int"), spark.createDataFrame(nodes, "client_id int, graph_id long, node_id long, x array<double>"),
        spark.createDataFrame(edges, "client_id int, graph_id long, src long, dst long"), weights, (2, hidden, classes), 2,
    )
    got = arrays_of(got, "client_id")

    def loss_of(client):
        def loss(w):
            p = lambda layer: (w[client, layer, "w"].T, w[client, layer, "b"])
            put = lambda x, layer: x @ p(layer)[0] + p(layer)[1]
            out = []
            for c, a, x, y in dense:
                if c == client:
                    h = put(x, "pre")
                    for k in (0, 1):
                        h = np.maximum(put(np.maximum(put(a @ h, f"conv{k}.0"), 0), f"conv{k}.1"), 0)
                    out.append(-log_softmax(put(np.maximum(put(h.sum(0, keepdims=True), "post"), 0), "readout"))[0, y])
            return np.mean(out)

        return loss

    for client in (0, 1):
        mine = {k: v for k, v in arrays_of(weights, "client_id").items() if k[0] == client}
        for name, want in differences(loss_of(client), mine).items():
            assert got[name] == pytest.approx(want, abs=1e-7), name


def test_link_model_gradients_are_finite_differences(spark):
    rng, width = np.random.default_rng(2), 3
    edges, pairs = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 3)], [(0, 0, 1), (0, 2, 0), (1, 1, 1), (2, 0, 0), (3, 3, 1)]
    x = {"user": rng.normal(size=(4, width)), "item": rng.normal(size=(4, width))}
    users, items = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[k])], "id long, x array<double>") for k in ("user", "item"))
    named = [(f"{kind}.conv{k}.{part}", width, width) for kind in gradients.KINDS for k in (0, 1) for part in ("neighbours", "self")]
    w = layers.initial_weights(spark, named, 7).select(F.substring_index("layer", ".", 1).alias("kind"), F.substring("layer", 6, 99).alias("layer"), "w", F.transform("b", lambda v, i: F.when(F.col("layer").endswith("self"), 0.1 * i).otherwise(0.0)).alias("b"))
    nodes, both = gradients.two_kinds(users, items), gradients.both_ways(spark.createDataFrame(edges, "user_id long, item_id long"))
    found, vectors = gradients.link_model_gradients(spark.createDataFrame(pairs, "user_id long, item_id long, y int"), nodes, both, w, width)
    around = {"user": np.zeros((4, 4)), "item": np.zeros((4, 4))}
    for u, i in edges:
        around["user"][u, i] = around["item"][i, u] = 1
    mean = {k: a / np.maximum(a.sum(1, keepdims=True), 1) for k, a in around.items()}

    def loss(m):
        h = {k: m["x", k] for k in x}
        for k in (0, 1):
            h = {kind: mean[kind] @ h[other] @ m[kind, f"conv{k}.neighbours", "w"].T + h[kind] @ m[kind, f"conv{k}.self", "w"].T + m[kind, f"conv{k}.self", "b"] for kind, other in (("user", "item"), ("item", "user"))}
            h = {kind: np.maximum(v, 0) for kind, v in h.items()} if k == 0 else h
        s = np.array([h["user"][u] @ h["item"][i] for u, i, _ in pairs])
        y = np.array([p[2] for p in pairs])
        return np.mean(np.maximum(s, 0) - s * y + np.log1p(np.exp(-np.abs(s))))

    start = {k: v for k, v in arrays_of(w, "kind").items() if not (k[1].endswith("neighbours") and k[2] == "b")} | {("x", k): v for k, v in x.items()}
    want = differences(loss, start)
    got = arrays_of(found, "kind")
    for kind in x:
        sign = 1 if kind == "user" else -1
        rows = sorted((r for r in vectors.collect() if r["kind"] == kind), key=lambda r: sign * r["node_id"])
        got["x", kind] = np.array([r["x"] for r in rows])
    for name in start:
        assert got[name] == pytest.approx(want[name], abs=1e-7), name
    moved = arrays_of(gradients.moved_weights(w, found, 0.1, ("kind",)), "kind")
    assert moved["user", "conv0.self", "w"] == pytest.approx(start["user", "conv0.self", "w"] - 0.1 * want["user", "conv0.self", "w"])


def test_batch_norm_gradients_are_finite_differences(spark):
    rng, width, n = np.random.default_rng(3), 2, 5
    x, e = rng.normal(size=(n, width)), rng.normal(size=(n, width))
    scale, shift = np.array([1.5, 0.5]), np.array([0.1, -0.2])
    table = lambda a: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "node_id long, x array<double>")
    affine = spark.createDataFrame([(scale.tolist(), shift.tolist())], "scale array<double>, shift array<double>")

    def forward(m):
        return (m["x"] - m["x"].mean(0)) / np.sqrt(m["x"].var(0) + 1e-5) * m["scale"] + m["shift"]

    want = differences(lambda m: (forward(m) * e).sum(), {"x": x, "scale": scale, "shift": shift})
    sums, back = gradients.batch_norm_back(table(x), table(e), affine, width)
    assert [sums.first()[c] for c in ("scale", "shift")] == [pytest.approx(want[c], abs=1e-6) for c in ("scale", "shift")]
    by_node = lambda df: np.array([r["x"] for r in sorted(df.collect(), key=lambda r: r["node_id"])])
    assert by_node(back) == pytest.approx(want["x"], abs=1e-6)
    stats = gradients.moments(table(x), width)
    assert by_node(gradients.batch_norm_forward(table(x), affine, stats)) == pytest.approx(forward({"x": x, "scale": scale, "shift": shift}))
    running = gradients.running_statistics(spark.createDataFrame([([0.0, 0.0], [1.0, 1.0])], "mean array<double>, var array<double>"), stats).first()
    assert running["mean"] == pytest.approx(0.1 * x.mean(0)) and running["var"] == pytest.approx(0.9 + 0.1 * x.var(0, ddof=1))


def test_batches_hold_seeds_their_neighbours_and_no_more_than_the_fan_out(spark):
    hub = [(i, 0) for i in range(1, 60)] + [(100 + i, i) for i in range(1, 60)]
    edges = spark.createDataFrame(hub, "src long, dst long")
    seeds = spark.createDataFrame([(0, 0), (1, 5), (1, 6), (1, 7)], "client_id int, node_id long")
    whole = minibatch.neighbour_batch(seeds, edges, 2, 2)
    hops = {c: {h: {r["node_id"] for r in whole.nodes.where(f"client_id = {c} and hop = {h}").collect()} for h in (0, 1, 2)} for c in (0, 1)}
    assert hops[0] == {0: {0}, 1: set(range(1, 60)), 2: {100 + i for i in range(1, 60)}} and len(hops[1][0]) == 2 and hops[1][1] == {100 + i for i in hops[1][0]}
    few = minibatch.neighbour_batch(seeds, edges, 2, 2, 4)
    assert {r["count"] for r in few.edges.where("client_id = 0 and dst = 0").groupBy("dst").count().collect()} == {4}
    assert few.edges.where("client_id = 0 and layer = 2").count() == 4
    again = [sorted(map(tuple, minibatch.neighbour_batch(seeds, edges.repartition(n), 2, 2, 4, step=3).edges.collect())) for n in (1, 5)]
    assert again[0] == again[1] and again[0] != sorted(map(tuple, few.edges.collect()))
    nothing = minibatch.neighbour_batch(seeds.where("client_id > 9"), edges, 2, 0)
    assert nothing.nodes.count() == nothing.edges.count() == 0
    with pytest.raises(ValueError):
        minibatch.neighbour_batch(seeds, edges, 0, 1)


TARGETS = {0: (0.0, 0.0), 1: (0.1, 0.0), 2: (5.0, 5.0), 3: (5.0, 5.2), 4: (5.1, 5.0)}


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([(c, "w", i, v) for c, t in TARGETS.items() for i, v in enumerate(t)], "client_id int, name string, pos long, v double")


@pytest.mark.parametrize("method", clustered.METHODS)
def test_clients_that_want_different_models_end_in_different_clusters(spark, targets, method):
    keys = ["client_id", "name", "pos"]
    goal = targets.select(*keys, F.col("v").alias("t"))
    local = lambda p, r: p.join(goal, keys).select(*keys, (F.col("v") + 0.5 * (F.col("t") - F.col("v"))).alias("v"))
    score = lambda p: p.join(goal, keys).groupBy("client_id").agg((-F.sum(F.abs(F.col("t") - F.col("v")))).alias("value"))
    norms = lambda p, r: p.join(goal, keys).groupBy("client_id").agg(F.sqrt(F.sum((F.col("t") - F.col("v")) ** 2)).alias("norm"))
    sizes = spark.createDataFrame([(c, 10) for c in TARGETS], "client_id int, size long")
    spec = clustered.ClusterSpec(method, eps1=0.1, eps2=0.5, after=2, last=3, standardise=False)
    rounds = list(clustered.clustered_rounds(targets.withColumn("v", F.lit(0.0)), local, sizes, 7, spec, score, norms))
    ends = {r["client_id"]: r["cluster_id"] for r in rounds[-1].members.collect()}
    assert ends[0] == ends[1] == 0 and ends[2] == ends[3] == ends[4] == 2
    cut = [r for r in rounds if r.cached is not None]
    assert len(cut) == 1 and cut[0].number > 2 and cut[0].cached.count() == 5 and cut[0].decided.where("split").count() == 1
    best = {r["client_id"]: r["value"] for r in clustered.best_of_cache(rounds, score).collect()}
    last = {r["client_id"]: r["value"] for r in score(rounds[-1].params).collect()}
    assert all(best[c] >= last[c] for c in TARGETS) and best[2] > -1
    assert clustered.update_norms(targets, rounds[-1].members, sizes).count() == 2


def test_cut_covers_all_clients_once(spark):
    rows = [(0, 0, 1, 0.8), (0, 0, 2, 0.3), (0, 1, 2, 0.4), (7, 8, 9, 1.0)]
    sides = clusters.split_clusters(spark.createDataFrame(rows, "cluster_id int, a int, b int, similarity double"))
    assert {(r["cluster_id"], r["client_id"]): r["side"] for r in sides.collect()} == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (7, 8): 0, (7, 9): 1}
    members = spark.createDataFrame([(c, 0) for c in (0, 1, 2)] + [(5, 5), (8, 7), (9, 7)], "client_id int, cluster_id int")
    assert {tuple(r) for r in clustered.cut_members(members, sides).collect()} == {(0, 0), (1, 0), (2, 2), (5, 5), (8, 8), (9, 9)}


@pytest.mark.parametrize("wrong", [{"method": "none"}, {"last": 0}, {"after": -1}])
def test_wrong_cluster_specifications_are_refused(wrong):
    with pytest.raises(ValueError):
        clustered.ClusterSpec(**wrong)


def test_sums_are_exact_without_a_client_and_refused_without_enough(spark):
    clients = spark.createDataFrame([(c,) for c in range(5)], "client_id int")
    values = spark.createDataFrame([(c, k, (c - 2) * 1000 + k) for c in range(5) for k in range(3)], "client_id int, k int, q long")
    seeds = shares.pair_seeds(clients, 1234)
    held = shares.shared_out(seeds, clients, 3, 99)
    masked = shares.masked(values, seeds, "k")
    assert masked.join(values, ["client_id", "k"]).where("m = q").count() == 0
    for gone in ([], [3], [0, 4]):
        sent = masked.where(~F.col("client_id").isin(gone)) if gone else masked
        got = {r["k"]: r["q"] for r in shares.sum_of_present(sent, clients, held, 3, "k").collect()}
        assert got == {k: sum((c - 2) * 1000 + k for c in range(5) if c not in gone) for k in range(3)}
    with pytest.raises(Exception, match="fewer than 3 shares"):
        shares.sum_of_present(masked.where("client_id < 2"), clients, held, 3, "k").collect()


def test_shares_of_any_three_give_the_seed_and_field_inverses_hold(spark):
    clients = spark.createDataFrame([(c,) for c in range(5)], "client_id int")
    seeds = shares.pair_seeds(clients, 7)
    held = shares.shared_out(seeds, clients, 3, 8)
    for three in itertools.combinations(range(5), 3):
        back = shares.put_together(held.where(F.col("holder").isin(list(three))), 3)
        assert back.join(seeds, ["a", "b", "part", "v"]).count() == seeds.count() == 20
    one = spark.createDataFrame([(v,) for v in (1, 2, 3, 65537, shares.PRIME - 1)], "v long")
    assert {r[0] for r in one.select(shares.times(F.col("v"), shares.inverse(F.col("v")))).collect()} == {1}


def test_auroc_with_ties_and_an_outlier(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(round(rng.normal(), 1 + g)), int(rng.random() < 0.4)) for g in range(2) for _ in range(400)] + [(0, 1e12, 0), (0, -1e12, 1), (2, 0.5, 1)]
    got = {r["g"]: r["auroc"] for r in metrics.auroc(spark.createDataFrame(rows, "g int, score double, y int"), "g").collect()}
    for g in range(2):
        up, down = ([s for h, s, y in rows if h == g and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in up for b in down]))
    assert got[2] is None


def test_gin_blocks_equal_joins(spark):
    """Blocks of whole graphs and joins agree, with graphs that no block holds and with several models."""
    rng, shapes = np.random.default_rng(3), [("pre", 2, 3), ("conv0.0", 3, 3), ("conv0.1", 3, 3), ("conv1.0", 3, 3), ("conv1.1", 3, 3), ("post", 3, 3), ("readout", 3, 3)]
    weights = layers.initial_weights(spark, shapes, 5, 2).withColumn("b", F.transform("b", lambda v, i: 0.05 * (i + 1)))
    graphs = [(c, g, int((g + c) % 3)) for c in (0, 1) for g in range(12)]
    nodes = [(c, g, 5 * i, rng.normal(size=2).tolist()) for c, g, _ in graphs for i in range(30 if g == 7 else 2 + g % 4)]
    edges = {(c, g, i, j) for c, g, i, _ in nodes for d, h, j, _ in nodes if (c, g) == (d, h) and i < j and (i + j) % 3}
    edges = sorted(edges | {(c, g, j, i) for c, g, i, j in edges} | {(1, 3, 999, 0)})  # 999 is known by an edge only
    graphs = spark.createDataFrame([*graphs, (0, 99, 1)], "client_id int, graph_id long, y int")  # 99 has no nodes
    nodes, edges = spark.createDataFrame(nodes, "client_id int, graph_id long, node_id long, x array<double>"), spark.createDataFrame(edges, "client_id int, graph_id long, src long, dst long")
    by, model = ("client_id", "graph_id"), ("client_id",)
    flat = lambda df: {(r.client_id, r.name, r.pos): r.v for r in df.collect()}
    expected = flat(training.to_params(gradients.gin_gradients_by_joins(graphs, nodes, edges, weights, (2, 3, 3), 2)))
    scores = {(r.client_id, r.graph_id): r.x for r in layers.gin_by_joins(nodes, edges, weights, 3, 2, by, model).collect()}
    for large in (100, 1 << 21):
        got = flat(training.to_params(gradients.gin_gradients(graphs, nodes, edges, weights, (2, 3, 3), 2, large=large)))
        assert got.keys() == expected.keys() and np.allclose([got[k] for k in expected], list(expected.values()))
        got = {(r.client_id, r.graph_id): r.x for r in layers.gin(nodes, edges, weights, 3, 2, by, model, large=large).collect()}
        assert got.keys() == scores.keys() and np.allclose([got[k] for k in scores], list(scores.values()))


def test_gin_steps_take_few_jobs(spark):
    """A step over kept blocks plans no join per layer: it had more jobs than this for its layers alone."""
    from meshloom.operators.graph_blocks import graph_blocks

    weights = layers.initial_weights(spark, [("pre", 2, 3), ("conv0.0", 3, 3), ("conv0.1", 3, 3), ("post", 3, 3), ("readout", 3, 3)])
    graphs, nodes = spark.createDataFrame([(1, 2)], "graph_id long, y int"), spark.createDataFrame([(1, 1, [1.0, 2.0])], "graph_id long, node_id long, x array<double>")
    edges = spark.createDataFrame([], "graph_id long, src long, dst long")
    plan = gradients.gin_gradients(graphs, nodes, edges, weights, (2, 3, 3), by=(), blocks=graph_blocks(nodes, edges, graphs))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_readout_gradient_adds_up_in_batches(spark):
    """No lambda runs per row and place; a class that is missing or beyond the layer counts in no place."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 3)), [None if i == 5 else i % 4 for i in range(40)]
    rows = spark.createDataFrame([(i % 2, x[i].tolist(), y[i]) for i in range(40)], "client_id int, x array<double>, y int")
    got = training.readout_gradient(rows, layers.initial_weights(spark, [("readout", 3, 3)], 5, 2), "readout", 3, 3, ("client_id",))
    weights = arrays_of(layers.initial_weights(spark, [("readout", 3, 3)], 5, 2), "client_id")
    partial = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in partial and "log(" not in partial.lower()
    found = arrays_of(got, "client_id")
    for c in (0, 1):
        p = np.exp(x[c::2] @ weights[c, "readout", "w"].T + weights[c, "readout", "b"])
        e = p / p.sum(1, keepdims=True) - np.array([[v == j for j in range(3)] for v in y[c::2]])
        assert np.allclose(found[c, "readout", "w"], e.T @ x[c::2] / 20) and np.allclose(found[c, "readout", "b"], e.mean(0))


def test_mean_over_clients_scores_once(spark, sf_dir):
    from meshloom.plans import q_links

    assert "embeddings" not in q_links.mean_over_clients(spark, sf_dir)._jdf.queryExecution().toString()


def test_scores_are_made_where_a_cluster_is_cut_only(spark):
    targets = spark.createDataFrame([(c, "a", i, float(c // 3)) for c in range(6) for i in range(4)], "client_id int, name string, pos long, v double")
    sizes = spark.createDataFrame([(c, 1) for c in range(6)], "client_id int, size long")
    keys, asked = ["client_id", "name", "pos"], []

    def local(params, r):
        return params.join(targets.withColumnRenamed("v", "t"), keys).select(*keys, (F.col("v") + 0.5 * (F.col("t") - F.col("v"))).alias("v"))

    def score(params):
        asked.append(params)
        return params.groupBy("client_id").agg(F.avg("v").alias("value"))

    start = targets.select(*keys, F.lit(0.0).alias("v"))
    done = list(clustered.clustered_rounds(start, local, sizes, 4, clustered.ClusterSpec(eps1=1.0, eps2=0.01, after=2), score))
    cut = [r.number for r in done if r.cached is not None]
    assert cut and len(asked) == len(cut) < 4
    for r in done:
        if r.cached is not None:
            before = {x["client_id"]: x["value"] for x in done[r.number - 2].params.groupBy("client_id").agg(F.avg("v").alias("value")).collect()}
            for x in r.cached.collect():
                assert x["value"] == pytest.approx(before[x["client_id"]])
