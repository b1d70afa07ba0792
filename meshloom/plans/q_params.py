"""Queries on client parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.functions.scalar import unit
from meshloom.operators import federate
from meshloom.plans.common import r4, r6, sql_hash
from meshloom.sources import tables as T
from meshloom.sources.tables import cte

CLIENTS = 5


def _sizes(params):
    return params.groupBy("client_id").agg(F.sum("n").alias("size"))


def _change(params):
    """A deterministic update of each parameter, of hashed size."""
    return params.withColumn("v", F.col("v") * (unit("client_id", "pos") - 0.5))


def _clusters(spark):
    return spark.createDataFrame([(c, c % 2) for c in range(CLIENTS)], "client_id int, cluster_id int")


def fedavg_unweighted(spark, sf_dir):
    return federate.mean(T.params(spark, sf_dir), CLIENTS).withColumn("v", r6("v"))


def fedavg_weighted(spark, sf_dir):
    p = T.params(spark, sf_dir)
    return federate.weighted_mean(p, _sizes(p)).withColumn("v", r4("v"))


def fedavg_subset(spark, sf_dir):
    return federate.mean(T.params(spark, sf_dir), CLIENTS, "layer1").withColumn("v", r6("v"))


def clusterwise_update(spark, sf_dir):
    p = T.params(spark, sf_dir)
    return federate.clusterwise(p, _change(p), _clusters(spark), _sizes(p)).withColumn("v", r4("v"))


def param_delta(spark, sf_dir):
    p = T.params(spark, sf_dir)
    return federate.deltas(p, _change(p)).withColumn("v", r4("v"))


def update_norm_max(spark, sf_dir):
    return federate.max_update_norm(_change(T.params(spark, sf_dir))).withColumn("max_norm", r4("max_norm"))


def update_norm_mean(spark, sf_dir):
    p = T.params(spark, sf_dir)
    return federate.mean_update_norm(_change(p), _sizes(p)).withColumn("mean_norm", r4("mean_norm"))


def layer_norms(spark, sf_dir):
    return federate.norms(T.params(spark, sf_dir), "client_id", "name").withColumn("norm", r4("norm"))


def pairwise_cosine(spark, sf_dir):
    return federate.pairwise_cosine(_change(T.params(spark, sf_dir))).withColumn("similarity", r4("similarity"))


def prox_term(spark, sf_dir):
    p = T.params(spark, sf_dir)
    return federate.proximal(p, federate.mean(p, CLIENTS), 0.01).withColumn("prox", r4("prox"))


def param_stats(spark, sf_dir):
    s = federate.param_stats(T.params(spark, sf_dir))
    return s.select("client_id", "name", *[r4(c).alias(c) for c in ("v_min", "v_max", "v_mean", "v_std")], "non_zero")


def _clients_and_rounds(spark, sf_dir):
    """Each client that owns nodes with each round; years of orders are the rounds, numbered from 0. Both lists are short."""
    clients = T.owners(spark, sf_dir).select("client_id").distinct()
    years = T.load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    rounds = years.select((F.col("year") - 1992).alias("epoch"))
    return clients.join(rounds)


def uniform_client_sampling(spark, sf_dir):
    """Two clients a round, in turn, out of those that own nodes."""
    return federate.uniform_sample(_clients_and_rounds(spark, sf_dir), CLIENTS, 2, F.col("epoch"))


def random_client_sampling(spark, sf_dir):
    """The two clients of each round with the least hashes, out of those that own nodes."""
    both = _clients_and_rounds(spark, sf_dir)
    drawn = both.groupBy("epoch").agg(F.slice(F.sort_array(F.collect_list(F.struct(unit("client_id", "epoch").alias("u"), "client_id"))), 1, 2).alias("c"))
    return drawn.select("epoch", F.explode("c.client_id").alias("client_id"))


def gcfl_split_predicate(spark, sf_dir):
    """Per order year: whether the clients' updates call for a split."""
    orders = T.load(spark, sf_dir, "orders").join(T.load(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = orders.groupBy(F.year("o_orderdate").alias("yr"), "c_nationkey").agg(F.avg(F.col("o_totalprice") / 1e6).alias("u"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy("yr").agg(F.abs(F.avg(F.col("u") - 0.25)).alias("mean_norm"), F.max(F.abs(F.col("u") - 0.25)).alias("max_norm"), F.count(F.lit(1)).alias("size"))
    return out.select("yr", "size", federate.split_predicate(F.col("mean_norm"), F.col("max_norm"), F.col("size"), F.col("yr") - 1974, 0.05, 0.1).alias("split"))


def scale_aligned_mean(spark, sf_dir):
    p = T.params(spark, sf_dir)
    scaled = p.withColumn("scale", F.when(F.col("client_id") % 2 == 0, 100.0).otherwise(1000.0)).withColumn("payload", F.col("v") * F.col("scale"))
    return federate.scale_aligned_mean(scaled).select("name", "pos", r6("value").alias("value"), "scale")


def param_scale(spark, sf_dir):
    p = T.params(spark, sf_dir).groupBy("client_id", "name").agg(F.max(F.abs("v")).alias("m"))
    return p.select("client_id", "name", federate.param_scale(F.col("m")).alias("scale"))


def row_mask(spark, sf_dir):
    """Parameters of the positions that a list keeps; the others become 0."""
    keep = T.load(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("pos"), F.lit(True).alias("k"))
    p = T.params(spark, sf_dir).join(keep, "pos", "left")
    return p.select("client_id", "name", "pos", r6(F.when(F.col("k"), F.col("v")).otherwise(0.0)).alias("v"))


def last_updates(spark, sf_dir):
    """The norms of each client's last three months, as input to sequence clustering."""
    x = T.interactions(spark, sf_dir).groupBy("client_id", F.date_trunc("month", "ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    last = x.groupBy("client_id").agg(F.reverse(F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("month", "n")))), 1, 3)).alias("s"), F.count(F.lit(1)).alias("rounds"))
    return last.select("client_id", "rounds", F.posexplode("s.n").alias("i", "n"))


def best_over_clusters(spark, sf_dir):
    p = T.params(spark, sf_dir).groupBy("client_id", "name").agg(F.avg("v").alias("acc"))
    return p.groupBy("client_id").agg(r4(F.max("acc")).alias("best"))


QUERIES = {f.__name__: f for f in (fedavg_unweighted, fedavg_weighted, fedavg_subset, clusterwise_update, param_delta, update_norm_max, update_norm_mean, layer_norms, pairwise_cosine, prox_term, param_stats, uniform_client_sampling, random_client_sampling, gcfl_split_predicate, scale_aligned_mean, param_scale, row_mask, last_updates, best_over_clusters)}

_P = cte("params")
_U = f"(({sql_hash('client_id', 'pos')} + 0.5::DOUBLE) / 4294967296::DOUBLE)"
_S = ", s AS (SELECT client_id, sum(n) AS size FROM params GROUP BY 1)"
_C = f", ch AS (SELECT client_id, name, pos, v * ({_U} - 0.5::DOUBLE) AS v, n FROM params)"

ORACLE = {
    "fedavg_unweighted": _P + " SELECT name, pos, round(sum(v) / 5, 6) + 0.0 AS v FROM params GROUP BY ALL",
    "fedavg_weighted": _P + _S + " SELECT name, pos, round(sum(v * size) / (SELECT sum(size) FROM s), 4) + 0.0 AS v FROM params JOIN s USING (client_id) GROUP BY ALL",
    "fedavg_subset": _P + " SELECT name, pos, round(sum(v) / 5, 6) + 0.0 AS v FROM params WHERE name = 'layer1' GROUP BY ALL",
    "clusterwise_update": _P + _S + _C + ", m AS (SELECT client_id % 2 AS cl, name, pos, sum(v * size) AS d FROM ch JOIN s USING (client_id) GROUP BY ALL), t AS (SELECT client_id % 2 AS cl, sum(size) AS total FROM s GROUP BY 1) SELECT p.client_id, p.name, p.pos, round(v + d / total, 4) + 0.0 AS v FROM params p JOIN m ON m.cl = p.client_id % 2 AND m.name = p.name AND m.pos = p.pos JOIN t ON t.cl = m.cl",
    "param_delta": _P + _C + " SELECT client_id, name, pos, round(params.v - ch.v, 4) + 0.0 AS v FROM params JOIN ch USING (client_id, name, pos)",
    "update_norm_max": _P + _C + ", q AS (SELECT sqrt(sum(v * v)) AS x FROM ch GROUP BY client_id) SELECT round(max(x), 4) AS max_norm FROM q",
    "update_norm_mean": _P + _S + _C + ", q AS (SELECT sum(v * size) / (SELECT sum(size) FROM s) / (SELECT count(*) FROM s) AS m FROM ch JOIN s USING (client_id) GROUP BY name, pos) SELECT round(sqrt(sum(m * m)), 4) AS mean_norm FROM q",
    "layer_norms": _P + " SELECT client_id, name, round(sqrt(sum(v * v)), 4) AS norm FROM params GROUP BY ALL",
    "pairwise_cosine": _P + _C + ", q AS (SELECT client_id, sqrt(sum(v * v)) AS x FROM ch GROUP BY 1), d AS (SELECT a.client_id AS a, b.client_id AS b, sum(a.v * b.v) AS dot FROM ch a JOIN ch b USING (name, pos) GROUP BY ALL) SELECT a, b, round(1 + dot / greatest(x.x * y.x, 1e-12), 4) + 0.0 AS similarity FROM d JOIN q x ON x.client_id = a JOIN q y ON y.client_id = b",
    "prox_term": _P + ", g AS (SELECT name, pos, sum(v) / 5 AS r FROM params GROUP BY ALL), l AS (SELECT client_id, name, sqrt(sum((v - r) * (v - r))) AS x FROM params JOIN g USING (name, pos) GROUP BY ALL) SELECT client_id, round(sum(x) * 0.005::DOUBLE, 4) AS prox FROM l GROUP BY 1",
    "param_stats": _P + " SELECT client_id, name, round(min(v), 4) AS v_min, round(max(v), 4) AS v_max, round(avg(v), 4) AS v_mean, round(stddev_samp(v), 4) AS v_std, count(*) FILTER (v <> 0) AS non_zero FROM params GROUP BY ALL",
    "uniform_client_sampling": "WITH c AS (SELECT DISTINCT (vec_id % 5)::INT AS client_id FROM embeddings), e AS (SELECT DISTINCT (year(o_orderdate) - 1992)::INT AS epoch FROM orders) SELECT client_id, epoch FROM c, e WHERE ((client_id - 2 * epoch) % 5 + 5) % 5 < 2",
    "random_client_sampling": f"WITH c AS (SELECT DISTINCT (vec_id % 5)::INT AS client_id FROM embeddings), e AS (SELECT DISTINCT (year(o_orderdate) - 1992)::INT AS epoch FROM orders) SELECT epoch, client_id FROM (SELECT client_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {sql_hash('client_id', 'epoch')}, client_id) AS r FROM c, e) WHERE r <= 2",
    "gcfl_split_predicate": "WITH p AS (SELECT year(o_orderdate) AS yr, c_nationkey, avg(o_totalprice / 1e6) AS u FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), o AS (SELECT yr, abs(avg(u - 0.25)) AS mean_norm, max(abs(u - 0.25)) AS max_norm, count(*) AS size FROM p GROUP BY 1) SELECT yr::INT AS yr, size, mean_norm < 0.05 AND max_norm > 0.1 AND size > 2 AND yr - 1974 > 20 AS split FROM o",
    "scale_aligned_mean": _P + ", q AS (SELECT *, CASE WHEN client_id % 2 = 0 THEN 100.0 ELSE 1000.0 END::DOUBLE AS scale FROM params), t AS (SELECT name, max(scale) AS big FROM q GROUP BY 1) SELECT name, pos, round(avg(v * scale * big / scale) / any_value(big), 6) + 0.0 AS value, any_value(big) AS scale FROM q JOIN t USING (name) GROUP BY ALL",
    "param_scale": _P + " SELECT client_id, name, CASE WHEN max(abs(v)) < 1e-3 THEN 1000.0 ELSE 100.0 END::DOUBLE AS scale FROM params GROUP BY ALL",
    "row_mask": _P + " SELECT client_id, name, pos, CASE WHEN p_size <= 10 THEN round(v, 6) ELSE 0.0 END + 0.0 AS v FROM params JOIN part ON pos = p_partkey",
    "last_updates": cte("inter") + ", m AS (SELECT client_id, date_trunc('month', ts) AS month, count(*) AS n FROM inter GROUP BY ALL), r AS (SELECT client_id, n, row_number() OVER (PARTITION BY client_id ORDER BY month DESC) AS k, count(*) OVER (PARTITION BY client_id) AS rounds FROM m) SELECT client_id, rounds, (3 - k)::INT AS i, n FROM r WHERE k <= 3",
    "best_over_clusters": _P + ", a AS (SELECT client_id, name, avg(v) AS acc FROM params GROUP BY ALL) SELECT client_id, round(max(acc), 4) AS best FROM a GROUP BY 1",
}
