"""Queries on private and compressed aggregation, cost accounting and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import cost, logs, lowrank, privacy
from meshloom.plans.common import WIDTH, r4, r6, sql_hash
from meshloom.plans.q_graph import khop1_nodes
from meshloom.sources import tables as T
from meshloom.sources.tables import cte

CLIENTS = 5
CLIP = 0.5


def _sums(spark, sf_dir):
    return T.params(spark, sf_dir).select("client_id", "name", "pos", "v")


def _private(mechanism):
    def run(spark, sf_dir):
        spec = privacy.PrivacySpec(epsilon=2.0, delta=1e-5, clip_norm=CLIP, mechanism=mechanism)
        return privacy.private_sum(_sums(spark, sf_dir), spec, "name", "pos").withColumn("v", r4("v"))

    return run


def clip_stats(spark, sf_dir):
    s = privacy.clip_stats(_sums(spark, sf_dir), CLIP)
    return s.select("client_id", r4("norm").alias("norm"), r6("factor").alias("factor"))


def clipped_sum(spark, sf_dir):
    return privacy.clipped_sum(_sums(spark, sf_dir), CLIP, "name", "pos").withColumn("v", r4("v"))


def masked_sum(spark, sf_dir):
    return privacy.masked_sum(_sums(spark, sf_dir), CLIENTS, "name", "pos").withColumn("v", r6("v"))


def privacy_accountant(spark, sf_dir):
    """A year of orders is a round that spends by its size."""
    rounds = T.load(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("round")).agg((F.count(F.lit(1)) / 1000.0).alias("epsilon"))
    spent = privacy.accountant(rounds.withColumn("delta", F.lit(0.001)))
    return spent.select("round", *[r4(c).alias(c) for c in ("epsilon", "delta", "epsilon_spent", "delta_spent")])


def chunk_plan(spark, sf_dir):
    return privacy.chunk_plan(T.params(spark, sf_dir).groupBy("client_id").agg(F.count(F.lit(1)).alias("n")), 100)


def _matrices(spark, sf_dir):
    p = T.params(spark, sf_dir)
    return p.groupBy("client_id", "name", F.pmod("pos", F.lit(6)).cast("int").alias("i"), F.pmod("pos", F.lit(7)).cast("int").alias("j")).agg(F.sum("n").cast("double").alias("v"))


def svd_round_trip(spark, sf_dir):
    """Matrices rebuilt from all of their singular triplets: their own entries."""
    f = lowrank.svd_factors(_matrices(spark, sf_dir), 6)
    by = ("client_id", "name")
    u = f.select(*by, "k", F.posexplode("u").alias("i", "u"))
    v = f.select(*by, "k", F.posexplode("v").alias("j", "v"))
    back = lowrank.reconstruct(u, f.select(*by, "k", "s"), v, by)
    return back.select(*by, "i", "j", r4("v").alias("v")).where("v > 0")


def matrix_mean(spark, sf_dir):
    return lowrank.matrix_mean(_matrices(spark, sf_dir), CLIENTS).withColumn("v", r4("v"))


def factor_mean(spark, sf_dir):
    """The plain mean of entries, taken here as the columns of the clients' matrices."""
    entries = _matrices(spark, sf_dir).select("client_id", "name", F.lit("u").alias("side"), F.col("j").alias("k"), F.col("i").alias("pos"), "v")
    return lowrank.factor_mean(entries).withColumn("v", r4("v"))


def rank_by_energy(spark, sf_dir):
    singular = T.params(spark, sf_dir).groupBy("name", F.col("pos").alias("k")).agg(F.sum("n").cast("double").alias("s"))
    return lowrank.rank_by_energy(singular, 0.9, "name")


def model_size(spark, sf_dir):
    return cost.model_size(T.params(spark, sf_dir))


def _rounds(spark, sf_dir):
    o = T.load(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("round")).agg(F.count_distinct("o_orderpriority").alias("sampled"), (F.count_if(F.col("o_orderstatus") == "F") > 0).alias("split"))


def round_bytes(spark, sf_dir):
    return cost.round_bytes(_rounds(spark, sf_dir), 4000, CLIENTS)


def cluster_round_bytes(spark, sf_dir):
    return cost.cluster_round_bytes(_rounds(spark, sf_dir), 4000, CLIENTS)


def pretrain_bytes(spark, sf_dir):
    nodes = T.nodes(spark, sf_dir)
    return cost.pretrain_bytes(nodes.select("client_id", "node_id"), khop1_nodes(spark, sf_dir), nodes.count(), WIDTH)


def cumulative_bytes(spark, sf_dir):
    log = T.load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase"), F.date_format("ts", "yyyy-MM-dd").alias("round")).agg((F.count(F.lit(1)) * 1000).alias("bytes"))
    return cost.cumulative(log).withColumn("mb", r4("mb"))


def counter_deltas(spark, sf_dir):
    e = T.load(spark, sf_dir, "events").select(F.col("user_id").alias("pod"), F.col("event_id").alias("at"), "value")
    return cost.counter_deltas(e).withColumn("delta", r4("delta"))


def _lines(spark, sf_dir):
    """A log per user: events as experiment and phase marks and as metrics."""
    line = """CASE event_id % 5 WHEN 0 THEN concat('Experiment e', user_id % 10) WHEN 1 THEN 'train start' WHEN 2 THEN 'pretrain start'
        WHEN 3 THEN concat('auc: 0.', event_id % 100) ELSE concat('time: ', event_id % 7) END"""
    return T.load(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("line_no"), F.expr(line).alias("line"))


def log_phases(spark, sf_dir):
    filled = logs.filled_phase(_lines(spark, sf_dir))
    return filled.groupBy("experiment", "phase").agg(F.count(F.lit(1)).alias("lines"))


def log_metrics(spark, sf_dir):
    return logs.pivoted(logs.metric_pairs(logs.filled_phase(_lines(spark, sf_dir))), ["auc", "time"])


def _texts(spark, sf_dir):
    text = "concat('=== run\\nRound 1: Global Test Accuracy = 0.', event_id % 90 + 10, '\\nRound 2: Global Test Accuracy = 0.5\\n=== end ', user_id, '\\n')"
    return T.load(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.expr(text).alias("text"))


def log_rounds(spark, sf_dir):
    return logs.round_pairs(_texts(spark, sf_dir))


def log_sections(spark, sf_dir):
    return logs.sections(_texts(spark, sf_dir), r"=== (\w+)")


def log_numbers(spark, sf_dir):
    """A number by the second pattern where the first finds none."""
    return _texts(spark, sf_dir).select("log_id", logs.number_after("text", r"Accuracy: ([0-9.]+)", r"=== end ([0-9]+)").alias("value"))


def csv_lines(spark, sf_dir):
    line = F.concat_ws(", ", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "more"))
    return logs.csv_fields(T.load(spark, sf_dir, "orders").select(line.alias("line")), 2)


QUERIES = {
    **{f"private_sum_{m}": _private(m) for m in ("gaussian", "laplace", "local")},
    **{f.__name__: f for f in (clip_stats, clipped_sum, masked_sum, privacy_accountant, chunk_plan, svd_round_trip, matrix_mean, factor_mean, rank_by_energy, model_size, round_bytes, cluster_round_bytes, pretrain_bytes, cumulative_bytes, counter_deltas, log_phases, log_metrics, log_rounds, log_sections, log_numbers, csv_lines)},
}

_P = cte("params")
_F = _P + ", f AS (SELECT client_id, sqrt(sum(v * v)) AS norm, least(1.0, 0.5 / sqrt(sum(v * v))) AS factor FROM params GROUP BY 1), c AS (SELECT name, pos, sum(v * factor) AS v FROM params JOIN f USING (client_id) GROUP BY ALL)"
_M = _P + ", m AS (SELECT client_id, name, (pos % 6)::INT AS i, (pos % 7)::INT AS j, sum(n)::DOUBLE AS v FROM params GROUP BY ALL)"
_R = "WITH r AS (SELECT year(o_orderdate)::INT AS round, count(DISTINCT o_orderpriority) AS sampled, count(*) FILTER (o_orderstatus = 'F') > 0 AS split FROM orders GROUP BY 1)"
_L = """WITH l AS (SELECT user_id AS log_id, event_id AS line_no, CASE event_id % 5 WHEN 0 THEN 'Experiment e' || (user_id % 10) WHEN 1 THEN 'train start' WHEN 2 THEN 'pretrain start'
 WHEN 3 THEN 'auc: 0.' || (event_id % 100) ELSE 'time: ' || (event_id % 7) END AS line FROM events),
 f AS (SELECT *, last_value(CASE WHEN line LIKE 'Experiment %' THEN line[12:] END IGNORE NULLS) OVER w AS experiment,
  last_value(CASE WHEN line = 'pretrain start' THEN 'pretrain' WHEN line = 'train start' THEN 'train' END IGNORE NULLS) OVER w AS phase FROM l
  WINDOW w AS (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _u(seed: int) -> str:
    return f"(({sql_hash('name', 'pos', seed=seed)} + 0.5::DOUBLE) / 4294967296::DOUBLE)"


ORACLE = {
    "private_sum_gaussian": _F + f" SELECT name, pos, round(v + sqrt(2 * ln(1.25 / 1e-5)) * 0.5 / 2.0 * sqrt(-2 * ln({_u(11)})) * cos(2 * pi() * {_u(12)}), 4) + 0.0 AS v FROM c",
    "private_sum_laplace": _F + f" SELECT name, pos, round(v - sign({_u(13)} - 0.5) * (0.5 / 2.0) * ln(1 - 2 * abs({_u(13)} - 0.5)), 4) + 0.0 AS v FROM c",
    "private_sum_local": _F + f" SELECT name, pos, round(CASE WHEN {_u(14)} < exp(2.0) / (exp(2.0) + 1) THEN v ELSE -v END, 4) + 0.0 AS v FROM c",
    "clip_stats": _F + " SELECT client_id, round(norm, 4) AS norm, round(factor, 6) AS factor FROM f",
    "clipped_sum": _F + " SELECT name, pos, round(v, 4) + 0.0 AS v FROM c",
    "masked_sum": _P + " SELECT name, pos, round(sum(round(v * 1e6)) / 1e6, 6) + 0.0 AS v FROM params GROUP BY ALL",
    "privacy_accountant": "WITH r AS (SELECT year(o_orderdate)::INT AS round, count(*) / 1000.0 AS epsilon, 0.001::DOUBLE AS delta FROM orders GROUP BY 1) SELECT round, round(epsilon, 4)::DOUBLE AS epsilon, delta, round(sum(epsilon) OVER w, 4)::DOUBLE AS epsilon_spent, round(sum(delta) OVER w, 4) AS delta_spent FROM r WINDOW w AS (ORDER BY round)",
    "chunk_plan": _P + ", s AS (SELECT client_id, count(*) AS n FROM params GROUP BY 1), k AS (SELECT client_id, n, unnest(range((n + 99) // 100)) AS chunk FROM s) SELECT client_id, chunk, chunk * 100 AS first, least(100, n - chunk * 100) AS length FROM k",
    "svd_round_trip": _M + " SELECT client_id, name, i, j, v FROM m",
    "matrix_mean": _M + " SELECT name, i, j, round(sum(v) / 5, 4) AS v FROM m GROUP BY ALL",
    "factor_mean": _M + " SELECT name, 'u' AS side, j AS k, i AS pos, round(avg(v), 4) AS v FROM m GROUP BY ALL",
    "rank_by_energy": _P + ", s AS (SELECT name, pos, sum(n)::DOUBLE AS s FROM params GROUP BY ALL), e AS (SELECT name, sum(s * s) OVER (PARTITION BY name ORDER BY pos) / sum(s * s) OVER (PARTITION BY name) AS e FROM s) SELECT name, count(*) FILTER (e < 0.9) + 1 AS rank FROM e GROUP BY 1",
    "model_size": _P + " SELECT name, count(DISTINCT pos) * 4 AS bytes FROM params GROUP BY 1",
    "round_bytes": _R + " SELECT round, sampled * 4000 AS upload, 20000::BIGINT AS download FROM r",
    "cluster_round_bytes": _R + " SELECT round, (20080 + CASE WHEN split THEN 4200 ELSE 0 END)::BIGINT AS upload, 20000::BIGINT AS download FROM r",
    "pretrain_bytes": cte("nodes", "edges") + ", view AS (SELECT client_id, node_id FROM nodes UNION SELECT client_id, src FROM edges JOIN nodes ON dst = node_id) SELECT client_id, (SELECT count(*) FROM nodes) * 256 AS upload, count(*) * 256 AS download FROM view GROUP BY 1",
    "cumulative_bytes": "WITH l AS (SELECT event_type AS phase, strftime(ts, '%Y-%m-%d') AS round, count(*) * 1000 AS bytes FROM events GROUP BY ALL) SELECT *, round(sum(bytes) OVER (PARTITION BY phase ORDER BY round) / 1048576, 4)::DOUBLE AS mb FROM l",
    "counter_deltas": "SELECT user_id AS pod, round(max_by(value, event_id) - min_by(value, event_id), 4) + 0.0 AS delta FROM events GROUP BY 1",
    "log_phases": _L + " SELECT experiment, phase, count(*) AS lines FROM f GROUP BY ALL",
    "log_metrics": _L + ", g AS (SELECT experiment, phase, line_no, split_part(line, ': ', 1) AS metric, split_part(line, ': ', 2)::DOUBLE AS value FROM f WHERE line LIKE '%: %') SELECT experiment, phase, max_by(value, line_no) FILTER (metric = 'auc') AS auc, max_by(value, line_no) FILTER (metric = 'time') AS time FROM g GROUP BY ALL",
    "log_rounds": "SELECT event_id AS log_id, 1::INT AS round, ('0.' || (event_id % 90 + 10))::DOUBLE AS accuracy FROM events UNION ALL SELECT event_id, 2, 0.5 FROM events",
    "log_sections": "SELECT event_id AS log_id, p::INT AS pos, CASE p WHEN 0 THEN 'run' ELSE 'end' END AS section FROM events, range(2) t(p)",
    "log_numbers": "SELECT event_id AS log_id, user_id::DOUBLE AS value FROM events",
    "csv_lines": "SELECT o_orderkey::VARCHAR AS f0, o_orderstatus AS f1 FROM orders WHERE o_orderkey % 3 <> 0",
}
