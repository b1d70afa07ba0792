"""Queries on gradients of whole models, learned batch norm, mini-batches and clusters that split while training."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.functions.scalar import unit
from meshloom.operators import clustered, gradients, graph, layers, minibatch, training
from meshloom.plans.common import WIDTH, long_form, r6, sql_hash
from meshloom.plans.q_links import TEST
from meshloom.plans.q_models import _GIN, _P, _PAIRS, _W0, _W1, CLASSES, GIN_HIDDEN, GIN_SHAPES, HIDDEN, LINK_WIDTH, NODE_SHAPES, _graph_nodes, _pairs, _vec
from meshloom.plans.q_params import _S, CLIENTS, _sizes
from meshloom.session import durable
from meshloom.sources import tables as T
from meshloom.sources.tables import cte

#: Orders' states, as classes.
STATES = ("F", "O", "P")
#: Where the link model's edges begin; they end before TEST.
SINCE = "1999-03-01"
BATCH, FAN_OUT = 16, 3
#: The clusters' rounds: each client steps half of the way to its own means.
ROUNDS, RATE = 7, 0.5
CLUSTERS = clustered.ClusterSpec(eps1=0.05, eps2=0.05, after=2)


def node_gradient(spark, sf_dir):
    """Each client's gradient of the two-layer model over its training nodes."""
    nodes = T.nodes(spark, sf_dir).select("client_id", "node_id", "x", F.col("label").alias("y"), (F.col("split") == "train").alias("is_train"))
    edges = graph.induced(T.edges(spark, sf_dir), T.owners(spark, sf_dir), ("client_id",))
    g = training.node_gradients(nodes, edges, layers.initial_weights(spark, NODE_SHAPES, clients=CLIENTS), (WIDTH, HIDDEN, CLASSES))
    return training.to_params(g).withColumn("v", r6("v"))


def gin_gradient(spark, sf_dir):
    """The gradient of all GIN layers by the orders' states."""
    nodes, edges = _graph_nodes(spark, sf_dir)
    graphs, _ = T.order_graphs(spark, sf_dir)
    y = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("y")) - 1
    g = gradients.gin_gradients(graphs.select("graph_id", y.alias("y")), nodes, edges, layers.initial_weights(spark, GIN_SHAPES), (2, GIN_HIDDEN, len(STATES)), by=())
    return training.to_params(g, ()).withColumn("v", r6("v"))


def _link_inputs(spark, sf_dir):
    """Labelled pairs, nodes of both kinds with hashed vectors, edges both ways, and weights by kind."""
    pairs = durable(_pairs(spark, sf_dir).select("user_id", "item_id", "y"))
    inter = T.interactions(spark, sf_dir).where((F.col("ts") >= F.lit(SINCE).cast("timestamp")) & (F.col("ts") < F.lit(TEST).cast("timestamp")))
    edges = durable(inter.select("user_id", "item_id").distinct())

    def drawn(column):
        ids = pairs.select(column).union(edges.select(column)).distinct()
        return ids.select(F.col(column).alias("id"), F.array(*[2 * unit(F.lit(column), column, F.lit(k)) - 1 for k in range(LINK_WIDTH)]).alias("x"))

    named = [(f"{kind}.conv{k}.{part}", LINK_WIDTH, LINK_WIDTH) for kind in gradients.KINDS for k in (0, 1) for part in ("neighbours", "self")]
    w = layers.initial_weights(spark, named)
    weights = durable(w.select(F.substring_index("layer", ".", 1).alias("kind"), F.substring("layer", 6, 99).alias("layer"), "w", "b"))
    return pairs, durable(gradients.two_kinds(drawn("user_id"), drawn("item_id"))), durable(gradients.both_ways(edges)), weights


def link_model_forward(spark, sf_dir):
    """The score of each labelled pair under two layers over users and items."""
    pairs, nodes, both, weights = _link_inputs(spark, sf_dir)
    _, output = gradients.link_forward(nodes, both, weights, LINK_WIDTH)
    return gradients.pair_scores(pairs, output).select("user_id", "item_id", "y", r6("score").alias("score"))


def link_model_gradient(spark, sf_dir):
    """The gradient of each kind's matrices."""
    g, _ = gradients.link_model_gradients(*_link_inputs(spark, sf_dir), LINK_WIDTH)
    return training.to_params(g, ("kind",)).where("name NOT LIKE '%neighbours.bias'").withColumn("v", r6("v"))


def link_vector_gradient(spark, sf_dir):
    """The gradient of the vectors of users and items, which reaches them over two edges."""
    _, v = gradients.link_model_gradients(*_link_inputs(spark, sf_dir), LINK_WIDTH)
    return v.select("kind", "node_id", F.posexplode("x").alias("dim", "v")).withColumn("v", F.round(1000 * F.col("v"), 4) + F.lit(0.0))


def _affine(spark):
    """A scale and a shift for each place, which differ."""
    place = lambda step, least: F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda i: least + step * i)
    return spark.range(1).select(place(1 / 64, F.lit(1.0)).alias("scale"), place(0.01, F.lit(0.1)).alias("shift"))


def batch_norm_learned(spark, sf_dir):
    """Evaluation with running statistics that each client has moved by its own batch and all have then averaged."""
    nodes = T.nodes(spark, sf_dir).select("client_id", "node_id", "x")
    start = spark.range(CLIENTS).select(F.col("id").cast("int").alias("client_id"), F.array_repeat(F.lit(0.0), WIDTH).alias("mean"), F.array_repeat(F.lit(1.0), WIDTH).alias("var"))
    running = gradients.running_statistics(start, gradients.moments(nodes, WIDTH, ("client_id",)), ("client_id",))
    merged = durable(gradients.merged_statistics(running, WIDTH))
    affine = merged.select("client_id").crossJoin(F.broadcast(_affine(spark)))
    return long_form(gradients.batch_norm_forward(nodes, affine, merged, ("client_id",)), "client_id", "node_id")


def batch_norm_gradient(spark, sf_dir):
    """The inputs' errors for outputs' errors that are hashed numbers."""
    nodes = T.nodes(spark, sf_dir).select("node_id", "x")
    errors = nodes.select("node_id", F.transform("x", lambda v, i: unit("node_id", i) - 0.5).alias("x"))
    _, back = gradients.batch_norm_back(nodes, errors, _affine(spark), WIDTH)
    return long_form(back, "node_id")


def neighbour_batches(spark, sf_dir):
    """A batch for each client: hashed seeds, and at most three hashed neighbours a node in each of two layers."""
    seeds = T.nodes(spark, sf_dir).where("split = 'train'").select("client_id", "node_id")
    return minibatch.neighbour_batch(seeds, T.edges(spark, sf_dir), BATCH, 2, FAN_OUT, step=1).edges


def neighbour_batch_nodes(spark, sf_dir):
    """The nodes of the same batches: seeds first, then by how far they are."""
    seeds = T.nodes(spark, sf_dir).where("split = 'train'").select("client_id", "node_id")
    return minibatch.neighbour_batch(seeds, T.edges(spark, sf_dir), BATCH, 2, FAN_OUT, step=1).nodes


def _cluster_rounds(spark, sf_dir):
    p = durable(T.params(spark, sf_dir))
    targets, sizes = durable(p.select("client_id", "name", "pos", F.col("v").alias("t"))), durable(_sizes(p))
    keys = ["client_id", "name", "pos"]

    def local(params, r):
        return params.join(targets, keys).select(*keys, (F.col("v") + RATE * (F.col("t") - F.col("v"))).alias("v"))

    def score(params):
        """How near a client's model is to its own means."""
        gap = params.join(targets, keys).groupBy("client_id").agg(F.sqrt(F.avg((F.col("t") - F.col("v")) * (F.col("t") - F.col("v")))).alias("gap"))
        return gap.select("client_id", (1 / (1 + 100 * F.col("gap"))).alias("value"))

    start = targets.select(*keys, F.lit(0.0).alias("v"))
    return list(clustered.clustered_rounds(start, local, sizes, ROUNDS, CLUSTERS, score)), score


def gcfl_rounds(spark, sf_dir):
    """Clients that learn their own means, in clusters that split: after each round, each client's cluster and what decided."""
    rounds, _ = _cluster_rounds(spark, sf_dir)
    frames = []
    for k, r in enumerate(rounds):
        before = rounds[k - 1].members if k else r.members.withColumn("cluster_id", F.min("cluster_id").over(_everyone()))
        joined = r.members.join(before.select("client_id", F.col("cluster_id").alias("was")), "client_id").join(r.decided.withColumnRenamed("cluster_id", "was"), "was")
        frames.append(joined.select(F.lit(r.number).alias("round"), "client_id", "cluster_id", "size", r6("mean_norm").alias("mean_norm"), r6("max_norm").alias("max_norm"), "split"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _everyone():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # clients of a run, a row each


def gcfl_best(spark, sf_dir):
    """Each client's best score over the models it entered the cache with."""
    rounds, score = _cluster_rounds(spark, sf_dir)
    return clustered.best_of_cache(rounds, score).withColumn("value", r6("value"))


QUERIES = {f.__name__: f for f in (node_gradient, gin_gradient, link_model_forward, link_model_gradient, link_vector_gradient, batch_norm_learned, batch_norm_gradient, neighbour_batches, neighbour_batch_nodes, gcfl_rounds, gcfl_best)}


def _named(layer: str, part: str, source: str, inputs: int, keys: str = "") -> str:
    """A gradient in source(j, i, v) or source(j, v), as parameters."""
    pos = f"j * {inputs} + i" if part == "weight" else "j"
    return f"SELECT {keys}'{layer}.{part}' AS name, {pos} AS pos, round(sum(v), 6) + 0.0 AS v FROM ({source}) GROUP BY ALL"


_NODE = cte("nodes", "xl", "edges") + f""", ce AS (SELECT a.client_id, src, dst FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.client_id = b.client_id UNION ALL SELECT client_id, node_id, node_id FROM nodes),
 d AS (SELECT src AS node_id, count(*)::DOUBLE AS d FROM ce GROUP BY 1), {_W0}, {_W1},
 h AS (SELECT node_id, j AS dim, greatest(sum(v * w), 0) AS v FROM xl JOIN w0 ON i = dim GROUP BY ALL),
 m AS (SELECT node_id, j AS dim, sum(v * w) AS v FROM h JOIN w1 ON i = dim GROUP BY ALL),
 z AS (SELECT src AS node_id, dim, sum(v / sqrt(a.d * b.d)) AS v FROM ce JOIN m ON m.node_id = dst JOIN d a ON a.node_id = src JOIN d b ON b.node_id = dst GROUP BY ALL),
 tn AS (SELECT client_id, count(*) AS n FROM nodes WHERE split = 'train' GROUP BY 1),
 e AS (SELECT client_id, node_id, dim, (exp(v) / sum(exp(v)) OVER (PARTITION BY node_id) - (dim = label)::INT) / n AS v FROM z JOIN nodes USING (node_id) JOIN tn USING (client_id) WHERE split = 'train'),
 t AS (SELECT ce.client_id, src AS node_id, dim, sum(v / sqrt(a.d * b.d)) AS v FROM ce JOIN e ON e.node_id = dst JOIN d a ON a.node_id = src JOIN d b ON b.node_id = dst GROUP BY ALL),
 g AS (SELECT client_id, node_id, i AS dim, sum(t.v * w) AS v FROM t JOIN w1 ON j = t.dim GROUP BY ALL),
 k AS (SELECT client_id, node_id, dim, CASE WHEN h.v > 0 THEN g.v ELSE 0 END AS v FROM g JOIN h USING (node_id, dim)) """
_C = "client_id, "

_GIN_BACK = _GIN + f""", y AS (SELECT graph_id, list_position({list(STATES)!r}, y) - 1 AS y FROM graphs), cn AS (SELECT count(DISTINCT graph_id) AS n FROM z),
 ez AS (SELECT graph_id, dim, (exp(v) / sum(exp(v)) OVER (PARTITION BY graph_id) - (dim = y)::INT) / (SELECT n FROM cn) AS v FROM z JOIN y USING (graph_id)),
 eo AS (SELECT ez.graph_id, i AS dim, CASE WHEN any_value(o.v) > 0 THEN sum(ez.v * w) ELSE 0 END AS v FROM ez JOIN wr ON j = ez.dim JOIN o ON o.graph_id = ez.graph_id AND o.dim = i GROUP BY ez.graph_id, i),
 ep AS (SELECT graph_id, i AS dim, sum(v * w) AS v FROM eo JOIN wo ON j = dim GROUP BY ALL),
 eb AS (SELECT b.graph_id, node_id, dim, CASE WHEN b.v > 0 THEN ep.v ELSE 0 END AS v FROM b JOIN ep USING (graph_id, dim)),
 ea AS (SELECT graph_id, node_id, i AS dim, CASE WHEN any_value(a.v) > 0 THEN sum(eb.v * w) ELSE 0 END AS v FROM eb JOIN wb ON j = eb.dim JOIN a USING (graph_id, node_id) WHERE a.dim = i GROUP BY graph_id, node_id, i),
 es AS (SELECT graph_id, node_id, i AS dim, sum(v * w) AS v FROM ea JOIN wa ON j = dim GROUP BY ALL),
 ex AS (SELECT gh.graph_id, gh.src AS node_id, dim, sum(v) AS v FROM gh JOIN es ON es.graph_id = gh.graph_id AND es.node_id = gh.dst GROUP BY ALL) """


def _gin_parts() -> str:
    """(layer, its outputs' errors, its inputs, what they meet on)."""
    rows = [("readout", "ez", "o", "graph_id"), ("post", "eo", "pool", "graph_id"), ("conv0.1", "eb", "a", "graph_id, node_id"), ("conv0.0", "ea", "s", "graph_id, node_id"), ("pre", "ex", "gn", "graph_id, node_id")]
    out = []
    for layer, e, x, on in rows:
        out.append(_named(layer, "weight", f"SELECT {e}.dim AS j, {x}.dim AS i, {e}.v * {x}.v AS v FROM {e} JOIN {x} USING ({on})", 2 if layer == "pre" else GIN_HIDDEN))
        out.append(_named(layer, "bias", f"SELECT dim AS j, v FROM {e}", 1))
    return " UNION ALL ".join(out)


def _link_weights() -> str:
    rows = []
    for kind in gradients.KINDS:
        for k in (0, 1):
            for part in ("neighbours", "self"):
                u = f"(({sql_hash(repr(f'{kind}.conv{k}.{part}'), 'i', 'j')} + 0.5::DOUBLE) / 4294967296::DOUBLE)"
                rows.append(f"SELECT {k} AS layer, '{part}' AS part, '{kind}' AS kind, i, j, (2 * {u} - 1) * sqrt({6.0 / (2 * LINK_WIDTH)!r}::DOUBLE) AS w FROM range({LINK_WIDTH}) a(i), range({LINK_WIDTH}) b(j)")
    return " UNION ALL ".join(rows)


_KIND, _OTHER = (f"CASE WHEN id >= 0 THEN '{a}' ELSE '{b}' END" for a, b in (("user", "item"), ("item", "user")))


def _kind_layer(name: str, x: str, layer: int) -> str:
    return f"""{name}_y AS (SELECT id, j AS dim, sum(v * w) AS v FROM {x} JOIN w ON i = dim AND layer = {layer} AND part = 'neighbours' AND w.kind = {_OTHER} GROUP BY ALL),
 {name}_m AS (SELECT src AS id, dim, sum(v) / any_value(d) AS v FROM e2 JOIN {name}_y y ON y.id = dst JOIN dg ON dg.id = src GROUP BY src, dim),
 {name} AS (SELECT id, dim, sum(v) AS v FROM (SELECT id, j AS dim, v * w AS v FROM {x} JOIN w ON i = dim AND layer = {layer} AND part = 'self' AND w.kind = {_KIND} UNION ALL SELECT id, dim, v FROM {name}_m) GROUP BY ALL)"""


def _kind_back(name: str, e: str, layer: int) -> str:
    return f"""{name}_t AS (SELECT src AS id, dim, sum(v / d) AS v FROM e2 JOIN {e} e ON e.id = dst JOIN dg ON dg.id = dst GROUP BY ALL),
 {name} AS (SELECT id, dim, sum(v) AS v FROM (SELECT id, i AS dim, v * w AS v FROM {e} JOIN w ON j = dim AND layer = {layer} AND part = 'self' AND w.kind = {_KIND} UNION ALL SELECT id, i, v * w FROM {name}_t JOIN w ON j = dim AND layer = {layer} AND part = 'neighbours' AND w.kind = {_OTHER}) GROUP BY ALL)"""


_LINK = _PAIRS + f""", ed AS (SELECT DISTINCT user_id, item_id FROM inter WHERE ts >= '{SINCE}' AND ts < '{TEST}'),
 us AS (SELECT user_id FROM lab UNION SELECT user_id FROM ed), it AS (SELECT item_id FROM lab UNION SELECT item_id FROM ed),
 x AS (SELECT user_id AS id, k AS dim, {_vec('user_id')} AS v FROM us, range({LINK_WIDTH}) t(k) UNION ALL SELECT -item_id - 1, k, {_vec('item_id')} FROM it, range({LINK_WIDTH}) t(k)),
 e2 AS (SELECT user_id AS src, -item_id - 1 AS dst FROM ed UNION ALL SELECT -item_id - 1, user_id FROM ed), dg AS (SELECT src AS id, count(*)::DOUBLE AS d FROM e2 GROUP BY 1),
 w AS ({_link_weights()}), {_kind_layer('c', 'x', 0)}, h AS (SELECT id, dim, greatest(v, 0) AS v FROM c), {_kind_layer('z', 'h', 1)},
 lb AS (SELECT *, row_number() OVER () AS r FROM lab), sc AS (SELECT r, any_value(user_id) AS user_id, any_value(item_id) AS item_id, any_value(y) AS y, sum(a.v * b.v) AS s FROM lb JOIN z a ON a.id = user_id JOIN z b ON b.id = -item_id - 1 AND b.dim = a.dim GROUP BY r)"""
_LINK_BACK = _LINK + f""", er AS (SELECT user_id, item_id, (1 / (1 + exp(-s)) - y) / (SELECT count(*) FROM lab) AS e FROM sc),
 e1 AS (SELECT user_id AS id, dim, sum(e * v) AS v FROM er JOIN z ON z.id = -item_id - 1 GROUP BY ALL UNION ALL SELECT -item_id - 1, dim, sum(e * v) FROM er JOIN z ON z.id = user_id GROUP BY ALL),
 {_kind_back('b1', 'e1', 1)}, e0 AS (SELECT id, dim, CASE WHEN h.v > 0 THEN b1.v ELSE 0 END AS v FROM b1 JOIN h USING (id, dim)), {_kind_back('b0', 'e0', 0)} """


def _link_parts() -> str:
    out = []
    for k, (x, e) in enumerate((("x", "e0"), ("h", "e1"))):
        own = f"SELECT {_KIND} AS kind, e.dim AS j, x.dim AS i, e.v * x.v AS v FROM {e} e JOIN {x} x USING (id)"
        sent = f"SELECT {_OTHER} AS kind, t.dim AS j, x.dim AS i, t.v * x.v AS v FROM b{k}_t t JOIN {x} x USING (id)"
        out += [_named(f"conv{k}.self", "weight", own, LINK_WIDTH, "kind, "), _named(f"conv{k}.neighbours", "weight", sent, LINK_WIDTH, "kind, ")]
        out.append(_named(f"conv{k}.self", "bias", f"SELECT {_KIND} AS kind, dim AS j, v FROM {e}", 1, "kind, "))
    return " UNION ALL ".join(out)


_AFFINE = "(1 + dim / 64.0::DOUBLE)"
_BATCH = cte("nodes", "edges") + f""", s AS (SELECT client_id, node_id FROM (SELECT client_id, node_id, row_number() OVER (PARTITION BY client_id ORDER BY {sql_hash('node_id', '1')}, node_id) AS k FROM nodes WHERE split = 'train') WHERE k <= {BATCH}),
 l1 AS (SELECT client_id, src, dst FROM (SELECT s.client_id, src, dst, row_number() OVER (PARTITION BY s.client_id, dst ORDER BY {sql_hash('src', 'dst', '0', '1')}, src) AS k FROM s JOIN edges ON dst = node_id) WHERE k <= {FAN_OUT}),
 f1 AS (SELECT client_id, src AS node_id FROM l1 EXCEPT SELECT client_id, node_id FROM s),
 l2 AS (SELECT client_id, src, dst FROM (SELECT f1.client_id, src, dst, row_number() OVER (PARTITION BY f1.client_id, dst ORDER BY {sql_hash('src', 'dst', '1', '1')}, src) AS k FROM f1 JOIN edges ON dst = node_id) WHERE k <= {FAN_OUT}),
 f2 AS (SELECT client_id, src AS node_id FROM l2 EXCEPT SELECT * FROM (SELECT client_id, node_id FROM s UNION ALL SELECT * FROM f1)) """


def _cluster_twin(last: str) -> str:
    """All rounds, each as a chain of tables; a cluster is cut as the lightest of all cuts of its members says."""
    parts = [_P + _S + ", w0 AS (SELECT client_id, name, pos, 0.0::DOUBLE AS v FROM params), m0 AS (SELECT client_id, (SELECT min(client_id) FROM params) AS cl FROM s)"]
    for r in range(1, ROUNDS + 1):
        b = r - 1
        parts.append(f"""ch{r} AS (SELECT client_id, name, pos, {RATE}::DOUBLE * (t.v - w.v) AS v FROM w{b} w JOIN params t USING (client_id, name, pos)),
 q{r} AS (SELECT client_id, sqrt(sum(v * v)) AS x FROM ch{r} GROUP BY 1),
 k{r} AS (SELECT cl, sum(size) AS total, count(*) AS k, max(x) AS max_norm FROM m{b} JOIN s USING (client_id) JOIN q{r} USING (client_id) GROUP BY cl),
 u{r} AS (SELECT cl, sum(v * size) AS u FROM ch{r} JOIN m{b} USING (client_id) JOIN s USING (client_id) GROUP BY cl, name, pos),
 p{r} AS MATERIALIZED (SELECT *, mean_norm < {CLUSTERS.eps1} AND max_norm > {CLUSTERS.eps2} AND k > 2 AND {r} > {CLUSTERS.after} AS split FROM (SELECT cl, any_value(k) AS k, sqrt(sum(u * u)) / any_value(total) / any_value(k) AS mean_norm, any_value(max_norm) AS max_norm FROM u{r} JOIN k{r} USING (cl) GROUP BY cl)),
 c{r} AS (SELECT client_id, cl FROM m{b} JOIN p{r} USING (cl) WHERE split),
 o{r} AS (SELECT a.client_id AS a, b.client_id AS b, sum(a.v * b.v) AS dot FROM ch{r} a JOIN ch{r} b USING (name, pos) WHERE a.client_id < b.client_id AND EXISTS (FROM c{r}) GROUP BY ALL),
 i{r} AS (SELECT x.cl, a, b, 1 + dot / (xa.x * xb.x) AS v FROM o{r} JOIN c{r} x ON x.client_id = a JOIN c{r} y ON y.client_id = b AND y.cl = x.cl JOIN q{r} xa ON xa.client_id = a JOIN q{r} xb ON xb.client_id = b),
 z{r} AS (SELECT cl, arg_min(mask, v) AS mask FROM (SELECT cl, mask, sum(CASE WHEN (mask >> a) & 1 <> (mask >> b) & 1 THEN v ELSE 0 END) AS v, bool_or((mask >> a) & 1 <> (mask >> b) & 1) AS two FROM i{r}, range(1, {1 << CLIENTS}) t(mask) GROUP BY ALL) WHERE two GROUP BY cl),
 m{r} AS MATERIALIZED (SELECT client_id, min(client_id) OVER (PARTITION BY cl, CASE WHEN mask IS NULL THEN 0 ELSE (mask >> client_id) & 1 END) AS cl FROM m{b} LEFT JOIN z{r} USING (cl)),
 t{r} AS (SELECT cl, sum(size) AS total FROM m{r} JOIN s USING (client_id) GROUP BY cl),
 d{r} AS (SELECT cl, name, pos, sum(v * size) / any_value(total) AS d FROM ch{r} JOIN m{r} USING (client_id) JOIN s USING (client_id) JOIN t{r} USING (cl) GROUP BY cl, name, pos),
 w{r} AS MATERIALIZED (SELECT w.client_id, w.name, w.pos, w.v + coalesce(d, 0) AS v FROM w{b} w JOIN m{r} USING (client_id) LEFT JOIN d{r} d ON d.cl = m{r}.cl AND d.name = w.name AND d.pos = w.pos),
 a{r} AS (SELECT client_id, 1 / (1 + 100 * sqrt(avg((t.v - w.v) * (t.v - w.v)))) AS value FROM w{r} w JOIN params t USING (client_id, name, pos) GROUP BY 1)""")
    return ", ".join(parts) + " " + last


_ROUND_ROWS = " UNION ALL ".join(f"SELECT {r} AS round, n.client_id, n.cl AS cluster_id, k AS size, round(mean_norm, 6) + 0.0 AS mean_norm, round(max_norm, 6) + 0.0 AS max_norm, split FROM m{r} n JOIN m{r - 1} o USING (client_id) JOIN p{r} ON p{r}.cl = o.cl" for r in range(1, ROUNDS + 1))
_BEST_ROWS = "SELECT client_id, round(max(value), 6) AS value FROM (" + " UNION ALL ".join([f"SELECT client_id, value FROM a{r - 1} JOIN c{r} USING (client_id)" for r in range(2, ROUNDS + 1)] + [f"SELECT client_id, value FROM a{ROUNDS}"]) + ") GROUP BY 1"

ORACLE = {
    "node_gradient": _NODE + " UNION ALL ".join([
        _named("conv1", "weight", "SELECT client_id, t.dim AS j, h.dim AS i, t.v * h.v AS v FROM t JOIN h USING (node_id)", HIDDEN, _C), _named("conv1", "bias", "SELECT client_id, dim AS j, v FROM e", 1, _C),
        _named("conv0", "weight", "SELECT client_id, k.dim AS j, x.dim AS i, k.v * x.v AS v FROM k JOIN xl x USING (node_id)", WIDTH, _C), _named("conv0", "bias", "SELECT client_id, dim AS j, v FROM k", 1, _C),
    ]),
    "gin_gradient": _GIN_BACK + _gin_parts(),
    "link_model_forward": _LINK + " SELECT user_id, item_id, y, round(s, 6) + 0.0 AS score FROM sc",
    "link_model_gradient": _LINK_BACK + _link_parts(),
    "link_vector_gradient": _LINK_BACK + f"SELECT {_KIND} AS kind, x.id AS node_id, x.dim::INT AS dim, round(1000 * coalesce(b0.v, 0), 4) + 0.0 AS v FROM x LEFT JOIN b0 ON b0.id = x.id AND b0.dim = x.dim".replace("CASE WHEN id", "CASE WHEN x.id"),
    "batch_norm_learned": cte("nodes", "xl") + f", st AS (SELECT client_id, dim, 0.1::DOUBLE * avg(v) AS m, 0.9::DOUBLE + 0.1::DOUBLE * var_samp(v) AS s FROM xl JOIN nodes USING (node_id) GROUP BY ALL), av AS (SELECT dim, avg(m) AS m, avg(s) AS s FROM st GROUP BY 1) SELECT client_id, node_id, dim::INT AS dim, round((v - m) / sqrt(s + 1e-5::DOUBLE) * {_AFFINE} + 0.1::DOUBLE + 0.01::DOUBLE * dim, 4) + 0.0 AS v FROM xl JOIN nodes USING (node_id) JOIN av USING (dim)",
    "batch_norm_gradient": cte("xl") + f", a AS (SELECT node_id, dim, (({sql_hash('node_id', 'dim')} + 0.5::DOUBLE) / 4294967296::DOUBLE) - 0.5::DOUBLE AS e, (v - avg(v) OVER p) / sqrt(var_pop(v) OVER p + 1e-5::DOUBLE) AS h, var_pop(v) OVER p AS s FROM xl WINDOW p AS (PARTITION BY dim)) SELECT node_id, dim::INT AS dim, round({_AFFINE} / sqrt(s + 1e-5::DOUBLE) * (e - avg(e) OVER p - h * avg(e * h) OVER p), 4) + 0.0 AS v FROM a WINDOW p AS (PARTITION BY dim)",
    "neighbour_batches": _BATCH + "SELECT client_id, 1 AS layer, src, dst FROM l1 UNION ALL SELECT client_id, 2, src, dst FROM l2",
    "neighbour_batch_nodes": _BATCH + "SELECT client_id, node_id, 0 AS hop FROM s UNION ALL SELECT client_id, node_id, 1 FROM f1 UNION ALL SELECT client_id, node_id, 2 FROM f2",
    "gcfl_rounds": _cluster_twin(_ROUND_ROWS),
    "gcfl_best": _cluster_twin(_BEST_ROWS),
}
