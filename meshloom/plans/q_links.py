"""Queries on interactions in time, link scores and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.functions.scalar import bce_with_logits, dot, epoch_of, hash32, log_softmax
from meshloom.operators import metrics, temporal
from meshloom.plans.common import WIDTH, r4, sql_hash
from meshloom.session import durable
from meshloom.sources import tables as T
from meshloom.sources.tables import cte

#: Slices by month: test month, and the history before it.
TEST, AFTER, START = "1999-06-01", "1999-07-01", "1998-06-01"


def _ts(day: str):
    return F.lit(day).cast("timestamp")


def _events(spark, sf_dir):
    e = T.load(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def id_mapping_first_seen(spark, sf_dir):
    return temporal.first_seen_index(T.load(spark, sf_dir, "events"), "user_id", "event_id")


def edge_mapping(spark, sf_dir):
    e = T.load(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("item_id"), "ts")
    users, items = temporal.first_seen_index(e, "user_id", "event_id"), temporal.first_seen_index(e, "item_id", "event_id")
    out = temporal.mapped_edges(e, users, items)
    return out.select("event_id", "user_idx", "item_idx", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))


def time_strings(spark, sf_dir):
    """Order dates written as log times and read back."""
    o = T.load(spark, sf_dir, "orders")
    text = F.concat(F.lit("Tue "), F.date_format(F.col("o_orderdate").cast("timestamp"), "MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("o_orderdate", "yyyy"))
    return o.select("o_orderkey", epoch_of(text).alias("epoch"))


def time_slice(spark, sf_dir):
    return temporal.time_slice(T.interactions(spark, sf_dir), _ts(START), _ts(TEST)).groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


def sliding_window_counts(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def expanding_window_counts(spark, sf_dir):
    from pyspark.sql import Window

    daily = _events(spark, sf_dir).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("event_type").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("day", "event_type", F.sum("c").over(upto).alias("n"))


def train_test_slices(spark, sf_dir):
    x = T.interactions(spark, sf_dir)
    train = temporal.time_slice(x, _ts(START), _ts(TEST)).withColumn("part", F.lit("train"))
    test = temporal.time_slice(x, _ts(TEST), _ts(AFTER)).withColumn("part", F.lit("test"))
    return train.unionByName(test).groupBy("client_id", "part").agg(F.count(F.lit(1)).alias("n"))


def next_day_counts(spark, sf_dir):
    """Per day: edges of the day before that come back on the day."""
    day = _events(spark, sf_dir).select(F.to_date("ts").alias("d"), "user_id", "event_type").distinct()
    before = day.select(F.date_add("d", 1).alias("d"), "user_id", "event_type")
    return day.join(before, ["d", "user_id", "event_type"], "left_semi").groupBy(F.date_format("d", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def last_n_edges(spark, sf_dir):
    return temporal.last_edges(T.load(spark, sf_dir, "events").select("event_type", "event_id", "user_id"), 50, "event_type", "event_id", 4096)


def edge_buffers(spark, sf_dir):
    return temporal.buffers(T.load(spark, sf_dir, "events").select("event_type", "event_id"), 100, "event_type", "event_id", 4096)


def buffer_choice(spark, sf_dir):
    """The buffer that each event type trains on at each of ten steps."""
    n = T.load(spark, sf_dir, "events").groupBy("event_type").agg(F.ceil(F.count(F.lit(1)) / 100).alias("buffers"))
    steps = n.select("event_type", "buffers", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("step"))
    return steps.select("event_type", "step", F.pmod(hash32("event_type", "step"), F.col("buffers")).alias("buffer"))


def _positives(spark, sf_dir):
    return temporal.time_slice(T.interactions(spark, sf_dir), _ts(TEST), _ts(AFTER)).select("client_id", "user_id", "item_id").distinct()


def _negatives(spark, sf_dir):
    x = T.interactions(spark, sf_dir)
    items = T.load(spark, sf_dir, "part").count()  # a count from the file's footer
    return temporal.negatives(_positives(spark, sf_dir), x, items)


def negative_samples(spark, sf_dir):
    return _negatives(spark, sf_dir)


def label_edges(spark, sf_dir):
    out = temporal.labelled(_positives(spark, sf_dir), _negatives(spark, sf_dir))
    return out.groupBy("client_id", "y").agg(F.count(F.lit(1)).alias("n"))


def _scores(spark, sf_dir):
    """Labelled pairs with the dot product of a user's and an item's vector."""
    e = T.load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    n = e.agg(F.count(F.lit(1))).scalar()
    pairs = temporal.labelled(_positives(spark, sf_dir), _negatives(spark, sf_dir))
    pairs = pairs.withColumn("u", F.col("user_id") % n).withColumn("i", F.col("item_id") % n)
    scored = pairs.join(e.select(F.col("vec_id").alias("u"), F.col("x").alias("xu")), "u").join(e.select(F.col("vec_id").alias("i"), F.col("x").alias("xi")), "i")
    return scored.select("client_id", "user_id", "item_id", "y", F.round(dot(F.col("xu"), F.col("xi")), 6).alias("score"))


def link_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


def auroc(spark, sf_dir):
    return metrics.auroc(_scores(spark, sf_dir), "client_id").withColumn("auroc", r4("auroc"))


def hit_rate_at_2(spark, sf_dir):
    return metrics.hit_rate(_scores(spark, sf_dir), 2, "client_id").withColumn("hit_rate", r4("hit_rate"))


def hit_rate_subset(spark, sf_dir):
    far = T.load(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return metrics.hit_rate(_scores(spark, sf_dir).join(far, "user_id", "left_semi"), 2, "client_id").withColumn("hit_rate", r4("hit_rate"))


def mean_over_clients(spark, sf_dir):
    scores = durable(_scores(spark, sf_dir))  # read by both
    a, h = metrics.auroc(scores, "client_id"), metrics.hit_rate(scores, 2, "client_id")
    return a.join(h, "client_id").agg(r4(F.avg("auroc")).alias("auroc"), r4(F.avg("hit_rate")).alias("hit_rate"))


def bce_loss(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("client_id").agg(r4(F.avg(bce_with_logits(F.col("score") / 10, F.col("y").cast("double")))).alias("loss"))


def _class_scores(spark, sf_dir):
    """Ten class scores of a node: its first ten features."""
    n = T.nodes(spark, sf_dir)
    return n.select("client_id", "node_id", "split", F.slice("x", 1, 10).alias("p"), F.col("label").alias("y"))


def accuracy_by_client(spark, sf_dir):
    return metrics.accuracy(_class_scores(spark, sf_dir), "client_id", "split").withColumn("accuracy", r4("accuracy"))


def accuracy_weighted(spark, sf_dir):
    per = metrics.accuracy(_class_scores(spark, sf_dir), "client_id")
    return metrics.weighted_metric(per, "accuracy", "n").withColumn("accuracy", r4("accuracy"))


def nll_loss(spark, sf_dir):
    s = _class_scores(spark, sf_dir)
    loss = -F.element_at(log_softmax(F.col("p")), F.col("y") + 1)
    return s.groupBy("client_id").agg(r4(F.avg(loss)).alias("loss"))


def confusion_by_client(spark, sf_dir):
    from meshloom.functions.scalar import argmax

    s = _class_scores(spark, sf_dir).withColumn("y_hat", argmax(F.col("p")))
    return metrics.confusion(s, "client_id")


def incomplete_runs(spark, sf_dir):
    """A run per user: the value of its last event as the last loss."""
    e = T.load(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("round"), (F.col("value") / 10000).alias("loss"))
    return metrics.incomplete(e).withColumn("loss", r4("loss"))


QUERIES = {f.__name__: f for f in (id_mapping_first_seen, edge_mapping, time_strings, time_slice, sliding_window_counts, expanding_window_counts, train_test_slices, next_day_counts, last_n_edges, edge_buffers, buffer_choice, negative_samples, label_edges, link_scores, auroc, hit_rate_at_2, hit_rate_subset, mean_over_clients, bce_loss, accuracy_by_client, accuracy_weighted, nll_loss, confusion_by_client, incomplete_runs)}

_MAP = "m AS (SELECT user_id, row_number() OVER (ORDER BY min(event_id)) - 1 AS idx FROM events GROUP BY 1)"
_IMAP = "i AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) - 1 AS idx FROM events GROUP BY 1)"
_POS = cte("inter") + f", pos AS (SELECT DISTINCT client_id, user_id, item_id FROM inter WHERE ts >= '{TEST}' AND ts < '{AFTER}')"
_NEG = _POS + f""", sl AS (SELECT client_id, user_id, item_id AS of, unnest(range(16)) AS kt FROM pos),
 cand AS (SELECT client_id, user_id, of, kt // 8 AS k, kt % 8 AS t, {sql_hash('user_id', 'of', 'kt')} % (SELECT count(*) FROM part) AS item_id FROM sl),
 fr AS (SELECT * FROM cand ANTI JOIN inter ON cand.user_id = inter.user_id AND cand.item_id = inter.item_id),
 neg AS (SELECT client_id, user_id, of, k::INT AS k, arg_min(item_id, t) AS item_id FROM fr GROUP BY ALL),
 lab AS (SELECT client_id, user_id, item_id, 1 AS y FROM pos UNION ALL SELECT client_id, user_id, item_id, 0 FROM neg)"""
_SC = _NEG + f""", en AS (SELECT count(*) AS n FROM embeddings),
 sc AS (SELECT client_id, user_id, item_id, y, round(list_sum(list_transform(range(1, {WIDTH} + 1), lambda j: a.embedding[j]::DOUBLE * b.embedding[j]::DOUBLE)), 6) AS score
   FROM lab, en JOIN embeddings a ON a.vec_id = user_id % n JOIN embeddings b ON b.vec_id = item_id % n)"""
_AU = ", au0 AS (SELECT client_id, y, rank() OVER (PARTITION BY client_id ORDER BY score) + (count(*) OVER (PARTITION BY client_id, score) - 1) / 2.0::DOUBLE AS r FROM sc), au AS (SELECT client_id, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(sum(y) * sum(1 - y), 0) AS auroc FROM au0 GROUP BY 1)"


def _hit(source: str) -> str:
    return f", hr0 AS (SELECT client_id, user_id, y, row_number() OVER (PARTITION BY client_id, user_id ORDER BY score DESC, item_id, y) AS r FROM {source}), hr1 AS (SELECT client_id, user_id, max(CASE WHEN r <= 2 THEN y ELSE 0 END)::DOUBLE AS h FROM hr0 GROUP BY ALL), hr AS (SELECT client_id, avg(h) AS hit_rate FROM hr1 GROUP BY 1)"


_CS = cte("nodes") + ", cs AS (SELECT client_id, node_id, split, label AS y, list_transform(x[1:10], lambda v: v::DOUBLE) AS p FROM nodes), pr AS (SELECT *, list_position(p, list_max(p)) - 1 AS y_hat FROM cs)"

ORACLE = {
    "id_mapping_first_seen": f"WITH {_MAP} SELECT user_id, idx FROM m",
    "edge_mapping": f"WITH {_MAP}, {_IMAP} SELECT event_id, m.idx AS user_idx, i.idx AS item_idx, floor(epoch(ts))::BIGINT AS epoch FROM events e JOIN m USING (user_id) JOIN i USING (event_type)",
    "time_strings": "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS epoch FROM orders",
    "time_slice": cte("inter") + f" SELECT client_id, count(*) AS n, count(DISTINCT user_id) AS users FROM inter WHERE ts >= '{START}' AND ts < '{TEST}' GROUP BY 1",
    "sliding_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "expanding_window_counts": "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS c FROM events GROUP BY ALL) SELECT day, event_type, (sum(c) OVER (PARTITION BY event_type ORDER BY day))::BIGINT AS n FROM d",
    "train_test_slices": cte("inter") + f" SELECT client_id, CASE WHEN ts < '{TEST}' THEN 'train' ELSE 'test' END AS part, count(*) AS n FROM inter WHERE ts >= '{START}' AND ts < '{AFTER}' GROUP BY ALL",
    "next_day_counts": "WITH d AS (SELECT DISTINCT ts::DATE AS d, user_id, event_type FROM events) SELECT strftime(a.d, '%Y-%m-%d') AS day, count(*) AS n FROM d a JOIN d b ON b.d + 1 = a.d AND a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY 1",
    "last_n_edges": "SELECT event_type, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events) WHERE r <= 50",
    "edge_buffers": "SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS buffer FROM events",
    "buffer_choice": f"WITH b AS (SELECT event_type, ceil(count(*) / 100)::BIGINT AS buffers FROM events GROUP BY 1) SELECT event_type, s::INT AS step, {sql_hash('event_type', 's')} % buffers AS buffer FROM b, range(10) t(s)",
    "negative_samples": _NEG + " SELECT client_id, user_id, of, k, item_id FROM neg",
    "label_edges": _NEG + " SELECT client_id, y, count(*) AS n FROM lab GROUP BY ALL",
    "link_scores": _SC + " SELECT client_id, user_id, item_id, y, score FROM sc",
    "auroc": _SC + _AU + " SELECT client_id, round(auroc, 4) AS auroc FROM au",
    "hit_rate_at_2": _SC + _hit("sc") + " SELECT client_id, round(hit_rate, 4) AS hit_rate FROM hr",
    "hit_rate_subset": _SC + ", sub AS (SELECT sc.* FROM sc JOIN customer ON user_id = c_custkey WHERE c_acctbal < 0)" + _hit("sub") + " SELECT client_id, round(hit_rate, 4) AS hit_rate FROM hr",
    "mean_over_clients": _SC + _AU + _hit("sc") + " SELECT round(avg(auroc), 4) AS auroc, round(avg(hit_rate), 4) AS hit_rate FROM au JOIN hr USING (client_id)",
    "bce_loss": _SC + " SELECT client_id, round(avg(greatest(score / 10, 0.0) - score / 10 * y + ln(1 + exp(-abs(score / 10)))), 4) AS loss FROM sc GROUP BY 1",
    "accuracy_by_client": _CS + " SELECT client_id, split, round(avg((y_hat = y)::INT), 4) AS accuracy, count(*) AS n FROM pr GROUP BY ALL",
    "accuracy_weighted": _CS + " SELECT round(avg((y_hat = y)::INT), 4) AS accuracy FROM pr",
    "nll_loss": _CS + " SELECT client_id, round(avg(ln(list_sum(list_transform(p, lambda v: exp(v)))) - p[y + 1]), 4) AS loss FROM cs GROUP BY 1",
    "confusion_by_client": _CS + " SELECT client_id, y, y_hat::BIGINT AS y_hat, count(*) AS n FROM pr GROUP BY ALL",
    "incomplete_runs": "SELECT user_id AS run_id, round(arg_max(value / 10000, event_id), 4) AS loss, arg_max(value / 10000, event_id) >= 0.01 AS incomplete FROM events GROUP BY 1",
}
