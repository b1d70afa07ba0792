"""Queries on layers, gradients, optimisers and clusters of clients."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.functions.scalar import unit
from meshloom.operators import clusters, federate, graph, layers, temporal, training
from meshloom.plans.common import WIDTH, long_form, r4, r6, sql_hash
from meshloom.plans.q_links import AFTER, TEST, _negatives, _positives
from meshloom.plans.q_params import CLIENTS, _change
from meshloom.session import durable
from meshloom.sources import tables as T
from meshloom.sources.tables import cte

HIDDEN, CLASSES, LINK_WIDTH, GIN_HIDDEN = 16, 10, 4, 8
NODE_SHAPES = [("conv0", WIDTH, HIDDEN), ("conv1", HIDDEN, CLASSES)]
SAGE_SHAPES = [(f"conv0.{side}", WIDTH, HIDDEN) for side in ("neighbours", "self")]
GIN_SHAPES = [("pre", 2, GIN_HIDDEN), ("conv0.0", GIN_HIDDEN, GIN_HIDDEN), ("conv0.1", GIN_HIDDEN, GIN_HIDDEN), ("post", GIN_HIDDEN, GIN_HIDDEN), ("readout", GIN_HIDDEN, 3)]


def _reset_clients(spark, sf_dir):
    """A model for each client that owns nodes, drawn anew by hash: the same numbers for all, as after a reset."""
    clients = T.owners(spark, sf_dir).select("client_id").distinct()
    # a model is two rows
    return clients.join(F.broadcast(layers.initial_weights(spark, NODE_SHAPES)))


def initial_weights(spark, sf_dir):
    """Each client's two-layer model as drawn by hash, in long form."""
    return training.to_params(_reset_clients(spark, sf_dir)).withColumn("v", r6("v"))


def weights_round_trip(spark, sf_dir):
    """Each client's model from its long form: the sum of each layer's matrix and its sides."""
    w = training.from_params(training.to_params(_reset_clients(spark, sf_dir)))
    total = F.aggregate(F.flatten("w"), F.lit(0.0), lambda s, v: s + v)
    return w.select("client_id", "layer", F.size("w").alias("outputs"), F.size(F.col("w")[0]).alias("inputs"), r4(total).alias("total"))


def gcn_layer(spark, sf_dir):
    out = layers.gcn_layer(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), layers.initial_weights(spark, NODE_SHAPES), "conv0", HIDDEN)
    return long_form(out, "node_id")


def gcn_forward(spark, sf_dir):
    out = layers.gcn(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), layers.initial_weights(spark, NODE_SHAPES), [HIDDEN, CLASSES])
    return long_form(out, "node_id")


def aggregated_forward(spark, sf_dir):
    """Over neighbourhood sums as features: the first layer is dense."""
    e = T.edges(spark, sf_dir)
    x = graph.hop_sum(T.nodes(spark, sf_dir), e, WIDTH, "row")
    return long_form(layers.aggregated_gcn(x, e, layers.initial_weights(spark, NODE_SHAPES), [HIDDEN, CLASSES]), "node_id")


def sage_layer(spark, sf_dir):
    out = layers.sage_layer(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), layers.initial_weights(spark, SAGE_SHAPES), "conv0", HIDDEN)
    return long_form(out, "node_id")


def neighbour_mean(spark, sf_dir):
    return long_form(layers.neighbour_mean(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), WIDTH), "node_id")


def batch_norm(spark, sf_dir):
    return long_form(layers.batch_norm(T.nodes(spark, sf_dir).select("node_id", "x"), WIDTH), "node_id")


def _graph_nodes(spark, sf_dir):
    """Nodes of the order graphs with features (1, degree), and the edges."""
    _, edges = T.order_graphs(spark, sf_dir)
    d = graph.degrees(edges, ("graph_id",))
    return d.select("graph_id", "node_id", F.array(F.lit(1.0), F.col("degree").cast("double")).alias("x")), edges


def graph_pool(spark, sf_dir):
    nodes, _ = _graph_nodes(spark, sf_dir)
    return layers.add_pool(nodes, 2).select("graph_id", F.col("x")[0].alias("nodes"), F.col("x")[1].alias("ends"))


def gin_forward(spark, sf_dir):
    nodes, edges = _graph_nodes(spark, sf_dir)
    return long_form(layers.gin(nodes, edges, layers.initial_weights(spark, GIN_SHAPES), GIN_HIDDEN, 1), "graph_id")


def readout_gradient(spark, sf_dir):
    """Each client's gradient of one dense softmax layer over its training nodes."""
    rows = T.nodes(spark, sf_dir).where("split = 'train'").select("client_id", "x", F.col("label").alias("y"))
    w = layers.initial_weights(spark, [("readout", WIDTH, CLASSES)], clients=CLIENTS)
    g = training.readout_gradient(rows, w, "readout", WIDTH, CLASSES, ("client_id",))
    return training.to_params(g).withColumn("v", r6("v"))


def sgd_step(spark, sf_dir):
    p = T.params(spark, sf_dir)
    return training.sgd(p, _change(p), 0.5, 5e-4).withColumn("v", r6("v"))


def adam_step(spark, sf_dir):
    """Two steps along the same gradient."""
    p = T.params(spark, sf_dir)
    state, g = training.with_moments(p.select("client_id", "name", "pos", "v")), _change(p)
    for step in (1, 2):
        state = training.adam(state, g, step, 0.01)
    return state.select("client_id", "name", "pos", *[r6(c).alias(c) for c in ("v", "m")])


def proximal_gradient(spark, sf_dir):
    p = T.params(spark, sf_dir)
    return training.proximal_gradient(_change(p), p, federate.mean(p, CLIENTS), 0.1).withColumn("v", r6("v"))


def _pairs(spark, sf_dir):
    return temporal.labelled(_positives(spark, sf_dir), _negatives(spark, sf_dir))


def _vectors(spark, sf_dir, column):
    """A vector for every user or item of the pairs: hashed numbers between -1 and 1."""
    ids = _pairs(spark, sf_dir).select(F.col(column).alias("id")).distinct()
    return ids.select("id", F.array(*[2 * unit(F.lit(column), "id", F.lit(k)) - 1 for k in range(LINK_WIDTH)]).alias("x"))


def link_gradient(spark, sf_dir):
    """Gradients of the users' vectors by the loss over all labelled pairs."""
    pairs = durable(_pairs(spark, sf_dir))
    users, _ = training.link_gradients(pairs, _vectors(spark, sf_dir, "user_id"), _vectors(spark, sf_dir, "item_id"), LINK_WIDTH)
    return users.select("id", F.posexplode("x").alias("dim", "g")).withColumn("g", F.round(F.col("g") * 1000, 4) + F.lit(0.0))


def _monthly(spark, sf_dir):
    x = T.interactions(spark, sf_dir).groupBy("client_id", F.date_format("ts", "yyyy-MM").alias("round")).agg((F.count(F.lit(1)) / 100.0).alias("norm"))
    return clusters.sequences(x, 10)


def update_sequences(spark, sf_dir):
    return _monthly(spark, sf_dir).select("client_id", "rounds", F.posexplode("s").alias("i", "norm")).withColumn("norm", r4("norm"))


def warp_distances(spark, sf_dir):
    return clusters.pairwise_warp(_monthly(spark, sf_dir)).withColumn("distance", r4("distance"))


def warp_distances_standardised(spark, sf_dir):
    return clusters.pairwise_warp(_monthly(spark, sf_dir), True).withColumn("distance", r4("distance"))


def cluster_cut(spark, sf_dir):
    """The clients cut in two where the similarity of their updates is weakest."""
    similarity = federate.pairwise_cosine(_change(T.params(spark, sf_dir))).where("a <> b").withColumn("cluster_id", F.lit(0))
    return clusters.split_clusters(similarity)


def train_nodes(spark, sf_dir):
    """Three rounds of federated training over pre-aggregated features; metrics by round and split."""
    from meshloom.runs import RunSpec, run

    return run(spark, sf_dir, RunSpec(task="NC", rounds=3, local_steps=1, rate=0.5))


def train_links(spark, sf_dir):
    """Link prediction over two time steps: the model learns from a slice and is scored on the one after it."""
    from meshloom.runs import RunSpec, run

    return run(spark, sf_dir, RunSpec(task="LP", rounds=1, days=2, rate=5.0))


def train_graphs(spark, sf_dir):
    """Graph classification with a proximal term, which acts in the second local step; metrics by round."""
    from meshloom.runs import RunSpec, run

    return run(spark, sf_dir, RunSpec(task="GC", rounds=2, local_steps=2, rate=0.1, mu=0.01))


QUERIES = {f.__name__: f for f in (initial_weights, weights_round_trip, gcn_layer, gcn_forward, aggregated_forward, sage_layer, neighbour_mean, batch_norm, graph_pool, gin_forward, readout_gradient, sgd_step, adam_step, proximal_gradient, link_gradient, update_sequences, warp_distances, warp_distances_standardised, cluster_cut, train_nodes, train_links, train_graphs)}


def _w(name: str, layer: str, inputs: int, outputs: int) -> str:
    """A layer's matrix as rows (i, j, w): from place i to place j."""
    u = f"(({sql_hash(repr(layer), 'i', 'j')} + 0.5::DOUBLE) / 4294967296::DOUBLE)"
    return f"{name} AS (SELECT i, j, (2 * {u} - 1) * sqrt({6.0 / (inputs + outputs)!r}::DOUBLE) AS w FROM range({inputs}) a(i), range({outputs}) b(j))"


_H = cte("nodes", "xl", "edges") + ", h AS (SELECT src, dst FROM edges UNION ALL SELECT vec_id, vec_id FROM embeddings), d AS (SELECT src AS node_id, count(*)::DOUBLE AS d FROM h GROUP BY 1)"
#: The clients that own nodes.
_C = "c AS (SELECT DISTINCT (vec_id % 5)::INT AS client_id FROM embeddings)"
_W0, _W1 = _w("w0", "conv0", WIDTH, HIDDEN), _w("w1", "conv1", HIDDEN, CLASSES)


def _conv(name: str, source: str, w: str) -> str:
    """A GCN layer over source(node_id, dim, v)."""
    return (
        f"{name}_m AS (SELECT node_id, j AS dim, sum(v * w) AS v FROM {source} JOIN {w} ON i = dim GROUP BY ALL), "
        f"{name} AS (SELECT h.src AS node_id, dim, sum(v / sqrt(a.d) / sqrt(b.d)) AS v FROM h JOIN {name}_m m ON h.dst = m.node_id JOIN d a ON a.node_id = h.src JOIN d b ON b.node_id = h.dst GROUP BY ALL)"
    )


def _log_softmax(source: str, key: str = "node_id") -> str:
    return f"SELECT {key}, dim::INT AS dim, round(v - ln(sum(exp(v)) OVER (PARTITION BY {key})), 4) + 0.0 AS v FROM {source}"


_RELU = "AS (SELECT node_id, dim, greatest(v, 0) AS v FROM"
_MEAN = "nm AS (SELECT src AS node_id, dim, sum(v) / count(*) AS v FROM edges JOIN xl ON dst = node_id GROUP BY ALL)"
_GN = cte("graphs") + ", gn AS (SELECT graph_id, src AS node_id, unnest([0, 1]) AS dim, unnest([1.0::DOUBLE, count(*)::DOUBLE]) AS v FROM ge GROUP BY graph_id, src), gh AS (SELECT * FROM ge UNION ALL SELECT DISTINCT graph_id, src, src FROM ge)"


def _dense(name: str, source: str, w: str, keys: str, relu: bool) -> str:
    v = "greatest(sum(v * w), 0)" if relu else "sum(v * w)"
    return f"{name} AS (SELECT {keys}, j AS dim, {v} AS v FROM {source} JOIN {w} ON i = dim GROUP BY ALL)"


_GIN = ", ".join([
    _GN, *[_w(n, *shape) for n, shape in zip(("wp", "wa", "wb", "wo", "wr"), GIN_SHAPES)],
    _dense("p", "gn", "wp", "graph_id, node_id", False),
    "s AS (SELECT gh.graph_id, gh.src AS node_id, dim, sum(v) AS v FROM gh JOIN p ON p.graph_id = gh.graph_id AND p.node_id = gh.dst GROUP BY ALL)",
    _dense("a", "s", "wa", "graph_id, node_id", True), _dense("b", "a", "wb", "graph_id, node_id", True),
    "pool AS (SELECT graph_id, dim, sum(v) AS v FROM b GROUP BY ALL)", _dense("o", "pool", "wo", "graph_id", True), _dense("z", "o", "wr", "graph_id", False),
])
_P = cte("params")
_U = f"(({sql_hash('client_id', 'pos')} + 0.5::DOUBLE) / 4294967296::DOUBLE)"
_CH = f", ch AS (SELECT client_id, name, pos, v, v * ({_U} - 0.5::DOUBLE) AS g FROM params)"
_PAIRS = cte("inter") + f""", pos AS (SELECT DISTINCT client_id, user_id, item_id FROM inter WHERE ts >= '{TEST}' AND ts < '{AFTER}'),
 sl AS (SELECT client_id, user_id, item_id AS of, unnest(range(16)) AS kt FROM pos),
 cand AS (SELECT client_id, user_id, of, kt // 8 AS k, kt % 8 AS t, {sql_hash('user_id', 'of', 'kt')} % (SELECT count(*) FROM part) AS item_id FROM sl),
 fr AS (SELECT * FROM cand ANTI JOIN inter ON cand.user_id = inter.user_id AND cand.item_id = inter.item_id),
 lab AS (SELECT user_id, item_id, 1 AS y FROM pos UNION ALL SELECT user_id, arg_min(item_id, t), 0 FROM fr GROUP BY client_id, user_id, of, k)"""


def _vec(column: str) -> str:
    return f"(2 * (({sql_hash(repr(column), column, 'k')} + 0.5::DOUBLE) / 4294967296::DOUBLE) - 1)"


_SEQ = cte("inter") + ", m AS (SELECT client_id, strftime(ts, '%Y-%m') AS round, count(*) / 100.0::DOUBLE AS norm FROM inter GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY round DESC) AS k, count(*) OVER (PARTITION BY client_id) AS rounds FROM m), seq AS (SELECT client_id, list(norm ORDER BY round) AS s FROM r WHERE k <= 10 GROUP BY 1)"


def _warp(seq: str) -> str:
    """A cell of the cost table a step: the row before, and the row so far."""
    return seq.replace("WITH ", "WITH RECURSIVE ", 1) + """, st AS (SELECT a.client_id AS a, b.client_id AS b, a.s AS sa, b.s AS sb FROM q a JOIN q b ON a.client_id < b.client_id),
 f AS (SELECT a, b, sa, sb, 0 AS k, list_prepend(0.0::DOUBLE, list_transform(sb, lambda x: 'inf'::DOUBLE)) AS up, ['inf'::DOUBLE] AS cur FROM st
  UNION ALL SELECT a, b, sa, sb, k + 1, CASE WHEN (k + 1) % len(sb) = 0 THEN list_append(cur, c) ELSE up END, CASE WHEN (k + 1) % len(sb) = 0 THEN ['inf'::DOUBLE] ELSE list_append(cur, c) END
  FROM (SELECT *, pow(sa[k // len(sb) + 1] - sb[k % len(sb) + 1], 2) + least(up[k % len(sb) + 1], up[k % len(sb) + 2], cur[-1]) AS c FROM f WHERE k < len(sa) * len(sb)))
 SELECT a, b, round(sqrt(up[-1]), 4) AS distance FROM f WHERE k = len(sa) * len(sb)"""


ORACLE = {
    "initial_weights": f"WITH {_C}, {_W0}, {_W1} SELECT client_id, name, pos, v FROM c CROSS JOIN (SELECT 'conv0.weight' AS name, j * {WIDTH} + i AS pos, round(w, 6) AS v FROM w0 UNION ALL SELECT 'conv1.weight', j * {HIDDEN} + i, round(w, 6) FROM w1 UNION ALL SELECT 'conv0.bias', p, 0.0 FROM range({HIDDEN}) t(p) UNION ALL SELECT 'conv1.bias', p, 0.0 FROM range({CLASSES}) t(p))",
    "weights_round_trip": f"WITH {_C}, {_W0}, {_W1} SELECT client_id, layer, outputs, inputs, total FROM c CROSS JOIN (SELECT 'conv0' AS layer, {HIDDEN}::INT AS outputs, {WIDTH}::INT AS inputs, round(sum(w), 4) + 0.0 AS total FROM w0 UNION ALL SELECT 'conv1', {CLASSES}, {HIDDEN}, round(sum(w), 4) + 0.0 FROM w1)",
    "gcn_layer": f"{_H}, {_W0}, {_conv('c', 'xl', 'w0')} SELECT node_id, dim::INT AS dim, round(v, 4) + 0.0 AS v FROM c",
    "gcn_forward": f"{_H}, {_W0}, {_W1}, {_conv('c', 'xl', 'w0')}, r {_RELU} c), {_conv('z', 'r', 'w1')} " + _log_softmax("z"),
    "aggregated_forward": f"{_H}, {_W0}, {_W1}, g AS (SELECT h.src AS node_id, dim, sum(v) / any_value(d) AS v FROM h JOIN xl ON h.dst = xl.node_id JOIN d ON d.node_id = h.src GROUP BY h.src, dim), r AS (SELECT node_id, j AS dim, greatest(sum(v * w), 0) AS v FROM g JOIN w0 ON i = dim GROUP BY ALL), {_conv('z', 'r', 'w1')} " + _log_softmax("z"),
    "sage_layer": f"{_H}, {_w('wn', 'conv0.neighbours', WIDTH, HIDDEN)}, {_w('ws', 'conv0.self', WIDTH, HIDDEN)}, {_MEAN}, a AS (SELECT node_id, j AS dim, v * w AS v FROM nm JOIN wn ON i = dim UNION ALL SELECT node_id, j, v * w FROM xl JOIN ws ON i = dim) SELECT node_id, dim::INT AS dim, round(sum(v), 4) + 0.0 AS v FROM a GROUP BY ALL",
    "neighbour_mean": f"{_H}, {_MEAN} SELECT xl.node_id, xl.dim::INT AS dim, round(coalesce(nm.v, 0), 4) + 0.0 AS v FROM xl LEFT JOIN nm USING (node_id, dim)",
    "batch_norm": cte("xl") + " SELECT node_id, dim::INT AS dim, round((v - avg(v) OVER p) / sqrt(var_pop(v) OVER p + 1e-5::DOUBLE), 4) + 0.0 AS v FROM xl WINDOW p AS (PARTITION BY dim)",
    "graph_pool": cte("graphs") + " SELECT graph_id, count(DISTINCT src)::DOUBLE AS nodes, count(*)::DOUBLE AS ends FROM ge GROUP BY 1",
    "gin_forward": f"{_GIN} " + _log_softmax("z", "graph_id"),
    "readout_gradient": cte("nodes", "xl") + f", {_w('w', 'readout', WIDTH, CLASSES)}, t AS (SELECT * FROM nodes WHERE split = 'train'), z AS (SELECT node_id, j, sum(v * w) AS z FROM xl JOIN w ON i = dim GROUP BY ALL), e AS (SELECT t.client_id, t.node_id, j, exp(z) / sum(exp(z)) OVER (PARTITION BY t.node_id) - (j = label)::INT AS e FROM z JOIN t USING (node_id)), n AS (SELECT client_id, count(*) AS n FROM t GROUP BY 1) SELECT client_id, 'readout.weight' AS name, j * {WIDTH} + dim AS pos, round(sum(e * v) / any_value(n), 6) + 0.0 AS v FROM e JOIN xl USING (node_id) JOIN n USING (client_id) GROUP BY client_id, j, dim UNION ALL SELECT client_id, 'readout.bias', j, round(sum(e) / any_value(n), 6) + 0.0 FROM e JOIN n USING (client_id) GROUP BY client_id, j",
    "sgd_step": _P + _CH + " SELECT client_id, name, pos, round(v - 0.5::DOUBLE * (g + 5e-4::DOUBLE * v), 6) + 0.0 AS v FROM ch",
    "adam_step": _P + _CH + ", a AS (SELECT *, 0.1::DOUBLE * g AS m1, 0.001::DOUBLE * g * g AS s1 FROM ch), b AS (SELECT *, 0.9::DOUBLE * m1 + 0.1::DOUBLE * g AS m2, 0.999::DOUBLE * s1 + 0.001::DOUBLE * g * g AS s2, v - 0.01::DOUBLE * (m1 / 0.1::DOUBLE / (sqrt(s1 / 0.001::DOUBLE) + 1e-8::DOUBLE)) AS v1 FROM a) SELECT client_id, name, pos, round(v1 - 0.01::DOUBLE * (m2 / 0.19::DOUBLE / (sqrt(s2 / 0.001999::DOUBLE) + 1e-8::DOUBLE)), 6) + 0.0 AS v, round(m2, 6) + 0.0 AS m FROM b",
    "proximal_gradient": _P + _CH + ", r AS (SELECT name, pos, sum(v) / 5 AS r FROM params GROUP BY ALL) SELECT client_id, name, pos, round(g + 0.1::DOUBLE * (v - r), 6) + 0.0 AS v FROM ch JOIN r USING (name, pos)",
    "link_gradient": _PAIRS + f", uv AS (SELECT DISTINCT user_id, k, {_vec('user_id')} AS u FROM lab, range({LINK_WIDTH}) t(k)), iv AS (SELECT DISTINCT item_id, k, {_vec('item_id')} AS v FROM lab, range({LINK_WIDTH}) t(k)), lb AS (SELECT *, row_number() OVER () AS r FROM lab), e AS (SELECT r, any_value(user_id) AS user_id, any_value(item_id) AS item_id, 1 / (1 + exp(-sum(u * v))) - any_value(y) AS e FROM lb JOIN uv USING (user_id) JOIN iv USING (item_id, k) GROUP BY r) SELECT user_id AS id, k::INT AS dim, round(1000 * sum(e * v) / (SELECT count(*) FROM lab), 4) + 0.0 AS g FROM e JOIN iv USING (item_id) GROUP BY ALL",
    "update_sequences": _SEQ + ", c AS (SELECT client_id, least(max(rounds), 10) AS len FROM r GROUP BY 1) SELECT client_id, rounds, (len - k)::INT AS i, round(norm, 4) AS norm FROM r JOIN c USING (client_id) WHERE k <= 10",
    "warp_distances": _warp(_SEQ + ", q AS (SELECT * FROM seq)"),
    "warp_distances_standardised": _warp(_SEQ + ", q AS (SELECT client_id, CASE WHEN list_stddev_pop(s) > 0 THEN list_transform(s, lambda x: x / list_stddev_pop(s)) ELSE s END AS s FROM seq)"),
    "cluster_cut": _P + _CH + ", q AS (SELECT client_id, sqrt(sum(g * g)) AS x FROM ch GROUP BY 1), dt AS (SELECT a.client_id AS a, b.client_id AS b, sum(a.g * b.g) AS dot FROM ch a JOIN ch b USING (name, pos) WHERE a.client_id < b.client_id GROUP BY ALL), s AS (SELECT a, b, 1 + dot / (x.x * y.x) AS s FROM dt JOIN q x ON x.client_id = a JOIN q y ON y.client_id = b), c AS (SELECT m, sum(CASE WHEN ((m * 2) >> a) & 1 <> ((m * 2) >> b) & 1 THEN s ELSE 0 END) AS w FROM s, range(1, 16) t(m) GROUP BY m), best AS (SELECT arg_min(m, w) AS m FROM c) SELECT 0 AS cluster_id, c::INT AS client_id, (((m * 2) >> c) & 1)::INT AS side FROM best, range(5) t(c)",
}
