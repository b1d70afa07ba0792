"""Queries on result tables, logs with their real patterns, metadata, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.functions import text
from meshloom.functions.scalar import compression_ratio, hash32, relu, softmax
from meshloom.operators import cost, graph, lowrank, reports, run_logs, temporal
from meshloom.plans.common import WIDTH, r4, r6, sql_hash
from meshloom.plans.q_private import _matrices
from meshloom.sources import datasets
from meshloom.sources import tables as T
from meshloom.sources.tables import cte
from meshloom.streaming import online


def _results(spark, sf_dir):
    """A result frame: suppliers as runs, with a data set, a batch size, ten network columns and missing values."""
    k = F.col("s_suppkey")
    columns = {
        "run_id": k, "dataset": F.element_at(F.array(*[F.lit(x) for x in ("cora", "citeseer", "pubmed")]), (k % 3 + 1).cast("int")),
        "batch": (k % 4 * 16).cast("int"), "seconds": (k % 11).cast("double"), "mb": F.when(k % 5 > 0, k * 1.5), "ms": F.when(k % 7 > 0, k * 2.0),
        **{f"net{i}": F.when((k + i) % 6 > 0, (k % 10 + i).cast("double")) for i in range(1, 11)},
    }
    return T.load(spark, sf_dir, "supplier").select(*[c.alias(n) for n, c in columns.items()])


def result_group_means(spark, sf_dir):
    m = reports.group_means(_results(spark, sf_dir), ["dataset", "batch"], ["seconds", "mb"])
    return m.select("dataset", "batch", r4("seconds").alias("seconds"), r4("mb").alias("mb"))


def result_numeric_means(spark, sf_dir):
    """Means of all numeric columns by data set."""
    m = reports.group_means(_results(spark, sf_dir).select("dataset", "batch", "seconds", "ms"), ["dataset"])
    return m.select("dataset", *[r4(c).alias(c) for c in ("batch", "seconds", "ms")])


def result_row_sums(spark, sf_dir):
    return reports.row_sum_means(_results(spark, sf_dir), [f"net{i}" for i in range(1, 11)], "batch", "network").withColumn("network", r4("network"))


def result_summary(spark, sf_dir):
    """Memory of runs by data set: total, mean, extremes and whose they are."""
    s = reports.summary(_results(spark, sf_dir).select("dataset", "run_id", F.col("seconds").alias("mb")), "mb", "run_id", "dataset")
    return s.select("dataset", "total", r4("mean").alias("mean"), "least", "least_of", "largest", "largest_of", r4("ratio").alias("ratio"))


def result_filters(spark, sf_dir):
    return reports.matching(_results(spark, sf_dir), {"batch": [16, 32]}, {"dataset": "cora"}, {"run_id": 3}).select("run_id", "batch")


def result_without_missing(spark, sf_dir):
    some = reports.without_missing(_results(spark, sf_dir), ["mb", "ms"]).select("run_id", F.lit("any").alias("how"))
    return some.unionByName(reports.without_missing(_results(spark, sf_dir), ["mb", "ms"], "all").select("run_id", F.lit("all").alias("how")))


def result_order(spark, sf_dir):
    """Places of runs in a report sorted by data set in a given order, then by run."""
    from pyspark.sql import Window

    ranked = _results(spark, sf_dir).groupBy("dataset").agg(F.count(F.lit(1)).alias("runs"))
    place = F.row_number().over(Window.orderBy(reports.category_rank("dataset", ["pubmed", "cora"]), "dataset"))
    return ranked.select("dataset", "runs", place.alias("place"))


def result_columns(spark, sf_dir):
    """Column names after the wanted ones were put first."""
    frame = reports.reordered(_results(spark, sf_dir), ["mb", "no_such", "dataset"])
    return spark.createDataFrame(list(enumerate(frame.columns[:5])), "place int, name string")


def result_concatenated(spark, sf_dir):
    a = _results(spark, sf_dir).where("run_id % 2 = 0").select("run_id", "mb")
    b = _results(spark, sf_dir).where("run_id % 3 = 0").select("run_id", "ms")
    return reports.concatenated([a, b])


def result_units(spark, sf_dir):
    return reports.in_units(_results(spark, sf_dir).select("run_id", "mb", "ms"), ["mb"], ["ms"]).select("run_id", r6("mb_gb").alias("mb_gb"), r6("ms_s").alias("ms_s"))


def split_statistics(spark, sf_dir):
    nodes = T.nodes(spark, sf_dir).select("client_id", "split", F.col("label").cast("double").alias("label"), F.col("x")[0].alias("x0"))
    wide = reports.split_statistics(nodes, ["client_id"], ["label", "x0"])
    return wide.select("client_id", *[f"{s}_n" for s in ("train", "val", "test")], *[r4(f"{s}_{c}").alias(f"{s}_{c}") for s in ("train", "val", "test") for c in ("label", "x0")])


def node_count(spark, sf_dir):
    """From owned nodes where no client states a count, and from the stated one."""
    own = T.nodes(spark, sf_dir).groupBy("client_id").agg(F.count(F.lit(1)).alias("owned"))
    a = reports.node_count(own.withColumn("stated", F.lit(None).cast("long"))).withColumn("source", F.lit("owned"))
    return a.unionByName(reports.node_count(own.withColumn("stated", F.when(F.col("client_id") > 1, F.lit(77).cast("long")))).withColumn("source", F.lit("stated")))


def class_count(spark, sf_dir):
    own = T.nodes(spark, sf_dir).groupBy("client_id").agg(F.max("label").cast("long").alias("largest"))
    a = reports.class_count(own.withColumn("stated", F.lit(None).cast("long"))).withColumn("source", F.lit("labels"))
    return a.unionByName(reports.class_count(own.withColumn("stated", F.lit(40).cast("long"))).withColumn("source", F.lit("stated")))


def guarded_metrics(spark, sf_dir):
    """A metric of every client, 0 for those without rows."""
    few = T.nodes(spark, sf_dir).where("client_id < 3 and label < 5").groupBy("client_id").agg(F.avg("label").alias("value"))
    return reports.guarded(few, T.owners(spark, sf_dir).select("client_id").distinct(), "value").withColumn("value", r4("value"))


def pod_memory(spark, sf_dir):
    """The most memory per kind of pod, of events as samples of pods with names."""
    name = F.concat(F.element_at(F.array(F.lit("ray-large-"), F.lit("ray-head-"), F.lit("other-")), (F.col("user_id") % 3 + 1).cast("int")), (F.col("user_id") % 4).cast("string"))
    return T.load(spark, sf_dir, "events").select(text.pod_kind(name).alias("pod"), "value").groupBy("pod").agg(F.max("value").alias("most"))


def chunk_metadata(spark, sf_dir):
    """Metadata of chunks written as JSON and read back."""
    k = F.col("s_suppkey")
    line = text.to_metadata((k % 5).cast("int").alias("client_id"), k.alias("chunk"), F.array(k, k + 1).alias("shape"), (k / 4.0).alias("scale"))
    got = T.load(spark, sf_dir, "supplier").select(text.from_metadata(line).alias("m"))
    return got.select("m.client_id", "m.chunk", F.col("m.shape")[1].alias("width"), "m.scale")


def run_names(spark, sf_dir):
    k = F.col("s_suppkey")
    return T.load(spark, sf_dir, "supplier").select(k.alias("run_id"), text.run_name(F.lit("cora"), (k % 7).cast("int"), F.lit(2), F.lit(0.5), k).alias("name"))


def summary_lines(spark, sf_dir):
    return _results(spark, sf_dir).select("run_id", text.summary_line(F.col("dataset"), F.col("batch"), F.col("seconds").cast("int")).alias("line"))


def compression_ratios(spark, sf_dir):
    k = F.col("s_suppkey")
    return T.load(spark, sf_dir, "supplier").select(k.alias("rows"), r4(compression_ratio(k, k % 9 + 2, k % 3 + 1)).alias("ratio"), lowrank.rank_by_ratio(k, k % 9 + 20, 2.0).cast("long").alias("rank"))


def embedding_bytes(spark, sf_dir):
    users, items = T.load(spark, sf_dir, "customer").count(), T.load(spark, sf_dir, "part").count()
    return spark.range(1).select(F.lit(cost.embedding_bytes(users, items, 64)).cast("long").alias("bytes"))


def softmax_relu(spark, sf_dir):
    n = T.nodes(spark, sf_dir).select("node_id", F.slice("x", 1, 5).alias("x"))
    return n.select("node_id", F.posexplode(F.zip_with(softmax(F.col("x")), relu(F.col("x")), lambda a, b: F.struct(a.alias("p"), b.alias("r")))).alias("dim", "z")).select("node_id", "dim", r4("z.p").alias("p"), r4("z.r").alias("r"))


def mask_splits(spark, sf_dir):
    e = T.load(spark, sf_dir, "embeddings")
    r = F.col("vec_id") % 10
    return datasets.splits_of_masks(e.select(F.col("vec_id").alias("node_id"), (r < 6).alias("train_mask"), (r == 6).alias("val_mask"), (r > 7).alias("test_mask")))


def test_row_order(spark, sf_dir):
    """Nodes whose last hundred rows were stored in another order, put where they belong."""
    e = T.load(spark, sf_dir, "embeddings").where("vec_id < 500").select(F.col("vec_id").alias("node_id"), "label")
    listed = spark.range(100).select(F.col("id").alias("pos"), (400 + (F.col("id") * 37 + 11) % 100).alias("node_id"))
    return datasets.reordered_test_rows(e, listed)


def grouped_sets(spark, sf_dir):
    """Two sets of graphs as one table, the first 150 of each in shuffled order."""
    g = T.order_graphs(spark, sf_dir)[0]
    sets = {"open": g.where("y = 'O'"), "filled": g.where("y = 'F'")}
    return datasets.grouped_sets(sets, tiny=True).select("dataset", "client_id", "graph_id")


def step_graph(spark, sf_dir):
    """Edges of a step both ways, the last twenty of each client."""
    e = T.load(spark, sf_dir, "events").select((F.col("user_id") % 3).cast("int").alias("client_id"), "user_id", hash32("event_type").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("pos"))
    day = lambda d: F.lit(d).cast("timestamp")
    return temporal.step_graph(e, day("2024-01-02"), day("2024-01-20"), 20).select("client_id", "src_kind", "src", "dst")


def max_degree(spark, sf_dir):
    """The largest degree over all graphs, and over each label's."""
    graphs, edges = T.order_graphs(spark, sf_dir)
    d = graph.degrees(edges, ("graph_id",)).join(graphs, "graph_id")
    return d.rollup("y").agg(F.max("degree").alias("most"))


def feature_sum_stats(spark, sf_dir):
    """Range, mean, deviation and non-zero numbers of each client's feature sums."""
    parts = graph.client_feature_sum(T.nodes(spark, sf_dir), T.edges(spark, sf_dir), T.owners(spark, sf_dir), WIDTH)
    v = parts.select("client_id", F.explode("x").alias("v"))
    s = v.groupBy("client_id").agg(F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), F.stddev_samp("v").alias("v_std"), F.count_if(F.col("v") != 0).alias("non_zero"))
    return s.select("client_id", *[r4(c).alias(c) for c in ("v_min", "v_max", "v_mean", "v_std")], "non_zero")


def compression_report(spark, sf_dir):
    return lowrank.compression_report(lowrank.compressed(_matrices(spark, sf_dir), "fixed", 2)).withColumn("ratio", r4("ratio"))


def singular_energy(spark, sf_dir):
    """The squared sum of a matrix's singular values is that of its entries."""
    s = lowrank.svd_factors(_matrices(spark, sf_dir), None)
    return s.groupBy("client_id", "name").agg(F.round(F.sum(F.col("s") * F.col("s")), 3).alias("energy"))


def truncation_loss(spark, sf_dir):
    """What a truncated matrix lacks is the energy of the values that were cut: no matrix loses more than the rest."""
    m = _matrices(spark, sf_dir)
    back = lowrank.decompressed(lowrank.compressed(m, "fixed", 2)).withColumnRenamed("v", "w")
    lost = m.join(back, ["client_id", "name", "i", "j"], "right").groupBy("client_id", "name").agg(F.sum(F.pow(F.coalesce("v", F.lit(0.0)) - F.col("w"), 2.0)).alias("lost"))
    rest = lowrank.svd_factors(m, None).where("k >= 2").groupBy("client_id", "name").agg(F.sum(F.col("s") * F.col("s")).alias("rest"))
    return lost.join(rest, ["client_id", "name"]).select("client_id", "name", r4(F.col("lost") - F.col("rest")).alias("gap"))


def adaptive_ranks(spark, sf_dir):
    """Ranks by size ratio and energy: no more than by the ratio alone, which here is 1."""
    return lowrank.chosen_ranks(lowrank.svd_factors(_matrices(spark, sf_dir), None), "adaptive").select("client_id", "name", F.col("rank").cast("long").alias("rank"))


def lowrank_factor_mean(spark, sf_dir):
    """The plain mean of the factors of all clients: how many numbers each side has."""
    from meshloom.runs import factor_round

    return factor_round(_matrices(spark, sf_dir), 2).groupBy("name", "side").agg(F.count(F.lit(1)).alias("n"))


def _logs(spark, sf_dir):
    """A log per supplier with runs of all kinds, in the words that runs print."""
    k = F.col("s_suppkey")
    s = lambda c: c.cast("string")
    names = F.array(*[F.lit(x) for x in ("cora", "citeseer", "pubmed", "ogbn-arxiv", "reddit")])
    node = F.concat(
        F.lit("Running experiment 1/2:\nDataset: "), F.element_at(names, (k % 5 + 1).cast("int")), F.lit(", Trainers: "), s(k % 7 + 3), F.lit(", Distribution: average, IID Beta: 0."), s(k % 9 + 1),
        F.lit("\nconfig {'method': 'FedGCN'}\nRound 1: Global Test Accuracy = 0.25\nRound 2: Global Test Accuracy = 0."), s(k % 90 + 10), F.lit("\n//train_time: "), s(k * 10), F.lit(".5 ms//end\n//Log Theoretical Pretrain Comm Cost: "), s(k),
        F.lit(".25 MB //end\n//Log Theoretical Train Comm Cost: 2.5 MB //end\n//Log Total Actual Pretrain Comm Cost: "), s(k), F.lit(".5 MB //end\n//Log Total Actual Train Comm Cost: 1.5 MB //end\n"),
        F.lit("Running experiment 2/2:\nDataset: cora, IID Beta: 1.0\nChanging method to FedAvg\nAverage test accuracy, 0."), s(k % 80 + 10), F.lit("\n"),
    )
    rule = F.lit("-" * 80 + "\nRunning experiment 1/1:\n")
    graphs = F.concat(rule, F.lit("Algorithm: GCFL+\nDataset: MUTAG\nTrainers: "), s(k % 7 + 3), F.lit("\nAverage test accuracy: 0."), s(k % 80 + 10), F.lit("\n//train_time: 7.5 ms//end\n"), F.lit("Running FedAvg ... \ndataset_trainer_name: 0-BZR\nAverage test accuracy: 0.5\n"))
    links = F.concat(rule, F.lit("Method: STFL\nCountries: 'US', 'BR'\ntrain time 1.5\ntrain time 2.5\nTest AUC: 0.11\nTest AUC: 0."), s(k % 80 + 10), F.lit("\nhit rate: 0.4\n//Log Theoretical Train Comm Cost: 3.5 MB //end\n"))
    lines = F.concat(F.lit("CSV FORMAT RESULT:\nDS,IID,BS,TotalTime[s],PureTrainingTime[s],CommTime[s],FinalAcc[%],CommCost[MB],PeakMem[MB],AvgRoundTime[s],ModelSize[MB],TotalParams\ncora,0.5,-1,"), s(k), F.lit(".5,1.5,2.5,80.25,"), s(k), F.lit(".0,4.0,5.0,6.0,"), s(k * 100), F.lit("\nTrainers: "), s(k % 7 + 3), F.lit("\n"))
    frame = F.concat(F.lit("DS,IID,BS,Time[s],FinalAcc[%],CompTime[s],CommCost[MB],PeakMem[MB],AvgRoundTime[s],ModelSize[MB],TotalParams\ncora,0.5,16,"), s(k), F.lit(".5,80.25,1.5,"), F.when(k % 4 == 0, "n/a").otherwise("3.5"), F.lit(",4.0,5.0,6.0,"), s(k * 100), F.lit("\n"))
    return T.load(spark, sf_dir, "supplier").select(k.alias("log_id"), *[c.alias(n) for n, c in {"node": node, "graphs": graphs, "links": links, "lines": lines, "frame": frame}.items()])


def _log(spark, sf_dir, kind):
    return _logs(spark, sf_dir).select("log_id", F.col(kind).alias("text"))


def log_node_experiments(spark, sf_dir):
    return run_logs.node_experiments(_log(spark, sf_dir, "node"))


def log_graph_experiments(spark, sf_dir):
    return run_logs.graph_experiments(_log(spark, sf_dir, "graphs")).select("log_id", "kind", "algorithm", "dataset", "trainers", "accuracy", "train_ms", "theoretical_total_mb")


def log_link_experiments(spark, sf_dir):
    return run_logs.link_experiments(_log(spark, sf_dir, "links")).select("log_id", "algorithm", "dataset", "auc", "hit_rate", "train_ms", "theoretical_total_mb", "actual_total_mb")


def log_round_accuracies(spark, sf_dir):
    return run_logs.round_accuracies(_log(spark, sf_dir, "node"))


def log_scalability(spark, sf_dir):
    return run_logs.scalability_rows(_log(spark, sf_dir, "lines")).select("log_id", "dataset", "iid_beta", "batch_size", "total_time", "communication_cost", "total_params", "trainers")


def log_frameworks(spark, sf_dir):
    logs = {"one": _log(spark, sf_dir, "frame"), "two": _log(spark, sf_dir, "frame").where("log_id % 2 = 0")}
    return run_logs.framework_rows(logs).select("framework", "log_id", "dataset", "batch_size", "total_time", "communication_cost", "total_params")


def log_line_states(spark, sf_dir):
    """Lines of a log per user with the marks that runs print, as a row per experiment."""
    line = """CASE event_id % 6 WHEN 0 THEN concat('Running experiment with: Dataset=cora, Number of Trainers=', event_id % 9 + 1, ', Distribution Type=average, IID Beta=0.5, Number of Hops=1, Batch Size=16')
        WHEN 1 THEN concat('//pretrain_time: ', event_id, '.5 ms//end') WHEN 2 THEN 'Pretrain end time recorded and duration set to gauge.' WHEN 3 THEN concat('Log Max memory for Server: ', event_id, '.25')
        WHEN 4 THEN concat('Log Large1 network: ', event_id, '.0') ELSE concat('//train_time: ', event_id, '.5 ms//end') END"""
    lines = T.load(spark, sf_dir, "events").select(F.col("user_id").alias("log_id"), F.col("event_id").alias("line_no"), F.expr(line).alias("line"))
    names = {"Number of Trainers": "trainers", "Pretrain Time": "pretrain", "Train Time": "train", "Train Max Server Memory": "memory", "Pretrain Network Large1": "network"}
    return run_logs.experiments_wide(run_logs.line_metrics(lines), list(names)).withColumnsRenamed(names)


def online_daily_counts(spark, sf_dir):
    """The stream's table once all files were read."""
    stream = online.events_stream(spark, f"{sf_dir}/events.parquet")
    return online.finished(online.daily_counts(stream, "event_type"), "daily")


def online_running_totals(spark, sf_dir):
    """Bytes by phase as results arrive, the event type being the phase."""
    stream = online.events_stream(spark, f"{sf_dir}/events.parquet").select(F.col("event_type").alias("phase"), (F.col("event_id") % 1000).alias("bytes"))
    return online.finished(online.running_totals(stream, "bytes", "phase"), "totals")


def online_vector_sums(spark, sf_dir):
    """The sum of clients' vectors as they arrive."""
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    stream = spark.readStream.schema(schema).parquet(online.files_at(f"{sf_dir}/embeddings.parquet")).select("label", F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("x"))
    out = online.finished(online.running_vector(stream, 4, "label"), "vectors")
    return out.select("label", F.posexplode("x").alias("dim", "v")).withColumn("v", r4("v"))


def two_day_windows(spark, sf_dir):
    """Events of two days, a window that slides by one."""
    events = T.load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return online.daily_counts(events, "event_type", width="2 days", slide="1 day")


QUERIES = {f.__name__: f for f in (result_group_means, result_numeric_means, result_row_sums, result_summary, result_filters, result_without_missing, result_order, result_columns, result_concatenated, result_units, split_statistics, node_count, class_count, guarded_metrics, pod_memory, chunk_metadata, run_names, summary_lines, compression_ratios, embedding_bytes, softmax_relu, mask_splits, test_row_order, grouped_sets, step_graph, max_degree, feature_sum_stats, compression_report, singular_energy, truncation_loss, adaptive_ranks, lowrank_factor_mean, log_node_experiments, log_graph_experiments, log_link_experiments, log_round_accuracies, log_scalability, log_frameworks, log_line_states, online_daily_counts, online_running_totals, online_vector_sums, two_day_windows)}

_R = "WITH r AS (SELECT s_suppkey AS run_id, ['cora', 'citeseer', 'pubmed'][s_suppkey % 3 + 1] AS dataset, (s_suppkey % 4 * 16)::INT AS batch, (s_suppkey % 11)::DOUBLE AS seconds, CASE WHEN s_suppkey % 5 > 0 THEN s_suppkey * 1.5::DOUBLE END AS mb, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey * 2.0::DOUBLE END AS ms FROM supplier)"
_MATRIX = cte("params") + ", m AS (SELECT client_id, name, (pos % 6)::INT AS i, (pos % 7)::INT AS j, sum(n)::DOUBLE AS v FROM params GROUP BY ALL), sz AS (SELECT client_id, name, max(i) + 1 AS a, max(j) + 1 AS b FROM m GROUP BY ALL)"
_K = "WITH k AS (SELECT s_suppkey AS k FROM supplier)"
_DATASET = "['cora', 'citeseer', 'pubmed', 'ogbn-arxiv', 'reddit'][k % 5 + 1]"
_STEP = f"WITH e AS (SELECT (user_id % 3)::INT AS client_id, user_id, {sql_hash('event_type')} AS item_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id DESC) AS r FROM events WHERE ts >= '2024-01-02' AND ts < '2024-01-20')"
_LINES = """WITH l AS (SELECT user_id AS log_id, event_id, event_id % 6 AS kind, sum((event_id % 6 = 0)::INT) OVER w AS experiment,
 last_value(CASE event_id % 6 WHEN 0 THEN 'Pretrain' WHEN 1 THEN 'Pretrain' WHEN 2 THEN 'Train' END IGNORE NULLS) OVER w AS phase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT log_id, experiment::BIGINT AS experiment, max_by((event_id % 9 + 1)::DOUBLE, event_id) FILTER (kind = 0) AS trainers, max_by(event_id + 0.5::DOUBLE, event_id) FILTER (kind = 1) AS pretrain, max_by(event_id + 0.5::DOUBLE, event_id) FILTER (kind = 5) AS train,
  max_by(event_id + 0.25::DOUBLE, event_id) FILTER (kind = 3 AND phase = 'Train') AS memory, max_by(event_id::DOUBLE, event_id) FILTER (kind = 4 AND phase = 'Pretrain') AS network FROM l WHERE experiment > 0 GROUP BY ALL"""

ORACLE = {
    "result_group_means": _R + " SELECT dataset, batch, round(avg(seconds), 4) AS seconds, round(avg(mb), 4) AS mb FROM r GROUP BY ALL",
    "result_numeric_means": _R + " SELECT dataset, round(avg(batch), 4) AS batch, round(avg(seconds), 4) AS seconds, round(avg(ms), 4) AS ms FROM r GROUP BY ALL",
    "result_row_sums": "WITH n AS (SELECT (s_suppkey % 4 * 16)::INT AS batch, s_suppkey, sum(CASE WHEN (s_suppkey + i) % 6 > 0 THEN s_suppkey % 10 + i ELSE 0 END)::DOUBLE AS t FROM supplier, range(1, 11) x(i) GROUP BY ALL) SELECT batch, round(avg(t), 4) AS network FROM n GROUP BY 1",
    "result_summary": _R + " SELECT dataset, sum(seconds) AS total, round(avg(seconds), 4) AS mean, min(seconds) AS least, min(run_id) FILTER (seconds = lo) AS least_of, max(seconds) AS largest, min(run_id) FILTER (seconds = hi) AS largest_of, round(CASE WHEN avg(seconds) <> 0 THEN max(seconds) / avg(seconds) ELSE 0 END, 4) AS ratio FROM (SELECT *, min(seconds) OVER (PARTITION BY dataset) AS lo, max(seconds) OVER (PARTITION BY dataset) AS hi FROM r) GROUP BY 1",
    "result_filters": _R + " SELECT run_id, batch FROM r WHERE batch IN (16, 32) AND dataset = 'cora' AND run_id <> 3",
    "result_without_missing": _R + " SELECT run_id, 'any' AS how FROM r WHERE mb IS NOT NULL AND ms IS NOT NULL UNION ALL SELECT run_id, 'all' FROM r WHERE mb IS NOT NULL OR ms IS NOT NULL",
    "result_order": _R + " SELECT dataset, count(*) AS runs, row_number() OVER (ORDER BY CASE dataset WHEN 'pubmed' THEN 1 WHEN 'cora' THEN 2 ELSE 3 END, dataset)::INT AS place FROM r GROUP BY 1",
    "result_columns": "SELECT * FROM (VALUES (0, 'mb'), (1, 'dataset'), (2, 'run_id'), (3, 'batch'), (4, 'seconds')) t(place, name)",
    "result_concatenated": _R + " SELECT run_id, mb, NULL::DOUBLE AS ms FROM r WHERE run_id % 2 = 0 UNION ALL SELECT run_id, NULL, ms FROM r WHERE run_id % 3 = 0",
    "result_units": _R + " SELECT run_id, round(mb / 1024, 6) AS mb_gb, round(ms / 1000, 6) AS ms_s FROM r",
    "split_statistics": cte("nodes") + " SELECT client_id, " + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_n, round(avg(label) FILTER (split = '{s}'), 4) AS {s}_label, round(avg(x[1]::DOUBLE) FILTER (split = '{s}'), 4) + 0.0 AS {s}_x0" for s in ("train", "val", "test")) + " FROM nodes GROUP BY 1",
    "node_count": "SELECT count(*) AS n, 'owned' AS source FROM embeddings UNION ALL SELECT 77, 'stated'",
    "class_count": "SELECT max(label)::BIGINT + 1 AS n, 'labels' AS source FROM embeddings UNION ALL SELECT 40, 'stated'",
    "guarded_metrics": cte("nodes") + " SELECT c.client_id, round(coalesce(avg(label), 0), 4)::DOUBLE AS value FROM (SELECT DISTINCT client_id FROM nodes) c LEFT JOIN (SELECT * FROM nodes WHERE client_id < 3 AND label < 5) n ON n.client_id = c.client_id GROUP BY 1",
    "pod_memory": "SELECT CASE user_id % 3 WHEN 0 THEN 'trainer' WHEN 1 THEN 'server' ELSE 'other-' || (user_id % 4) END AS pod, max(value) AS most FROM events GROUP BY 1",
    "chunk_metadata": _K + " SELECT (k % 5)::INT AS client_id, k AS chunk, k + 1 AS width, k / 4.0::DOUBLE AS scale FROM k",
    "run_names": _K + " SELECT k AS run_id, 'cora_' || (k % 7) || 'trainer_2hop_iid_beta_0.5_trainer_id_' || k AS name FROM k",
    "summary_lines": _R + " SELECT run_id, dataset || ',' || batch || ',' || seconds::INT AS line FROM r",
    "compression_ratios": _K + " SELECT k AS rows, round(k * (k % 9 + 2) / ((k % 3 + 1) * (k + k % 9 + 3))::DOUBLE, 4) AS ratio, greatest(1, least(trunc((k * (k % 9 + 20) / 2.0::DOUBLE - k - (k % 9 + 20)) / (k + k % 9 + 21))::BIGINT, k, k % 9 + 20)) AS rank FROM k",
    "embedding_bytes": "SELECT ((SELECT count(*) FROM customer) + (SELECT count(*) FROM part)) * 256 AS bytes",
    "softmax_relu": cte("xl") + " SELECT node_id, dim::INT AS dim, round(exp(v) / sum(exp(v)) OVER (PARTITION BY node_id), 4) AS p, round(greatest(v, 0), 4) + 0.0 AS r FROM xl WHERE dim < 5",
    "mask_splits": "SELECT vec_id AS node_id, CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 = 6 THEN 'val' ELSE 'test' END AS split FROM embeddings WHERE vec_id % 10 <> 7",
    "test_row_order": "SELECT CASE WHEN vec_id >= 400 THEN 400 + ((vec_id - 400) * 37 + 11) % 100 ELSE vec_id END AS node_id, label FROM embeddings WHERE vec_id < 500",
    "grouped_sets": f"WITH g AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' ELSE 'open' END AS dataset, o_orderkey AS graph_id FROM orders WHERE o_orderstatus IN ('F', 'O')), p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {sql_hash('graph_id')}, graph_id) AS r FROM g) SELECT dataset, (dataset = 'open')::INT AS client_id, graph_id FROM p WHERE r <= 150",
    "step_graph": _STEP + " SELECT client_id, 'user' AS src_kind, user_id AS src, item_id AS dst FROM e WHERE r <= 20 UNION ALL SELECT client_id, 'item', item_id, user_id FROM e WHERE r <= 20",
    "max_degree": cte("graphs") + ", d AS (SELECT graph_id, y, count(*) AS d FROM ge JOIN graphs USING (graph_id) GROUP BY graph_id, y, src) SELECT y, max(d) AS most FROM d GROUP BY ROLLUP (y)",
    "feature_sum_stats": cte("nodes", "xl", "edges") + ", held AS (SELECT client_id, src, dst FROM edges JOIN nodes ON dst = node_id), s AS (SELECT client_id, src AS node_id, dim, v FROM held JOIN xl ON held.dst = xl.node_id UNION ALL SELECT client_id, nodes.node_id, dim, v FROM nodes JOIN xl ON nodes.node_id = xl.node_id), f AS (SELECT client_id, node_id, dim, sum(v) AS v FROM s GROUP BY ALL) SELECT client_id, round(min(v), 4) AS v_min, round(max(v), 4) AS v_max, round(avg(v), 4) + 0.0 AS v_mean, round(stddev_samp(v), 4) AS v_std, count(*) FILTER (v <> 0) AS non_zero FROM f GROUP BY 1",
    "compression_report": _MATRIX + " SELECT client_id, name, least(2, a, b)::BIGINT AS rank, (a * b)::BIGINT AS original, (least(2, a, b) * (a + b + 1))::BIGINT AS compressed, round(a * b / (least(2, a, b) * (a + b + 1))::DOUBLE, 4) AS ratio FROM sz WHERE least(a, b) > 1",
    "singular_energy": _MATRIX + " SELECT client_id, name, round(sum(v * v), 3) AS energy FROM m GROUP BY ALL",
    "truncation_loss": _MATRIX + " SELECT client_id, name, 0.0::DOUBLE AS gap FROM sz WHERE least(a, b) > 2",
    "adaptive_ranks": _MATRIX + " SELECT client_id, name, 1::BIGINT AS rank FROM sz WHERE least(a, b) > 1",
    "lowrank_factor_mean": _MATRIX + ", s AS (SELECT name, max(a) AS a, max(b) AS b FROM sz GROUP BY 1) SELECT name, 'u' AS side, (2 * a)::BIGINT AS n FROM s UNION ALL SELECT name, 'v', 2 * b FROM s UNION ALL SELECT name, 's', 2 FROM s",
    "log_node_experiments": _K + f" SELECT k AS log_id, 0::INT AS pos, 'FedGCN' AS algorithm, {_DATASET} AS dataset, (k % 7 + 3)::INT AS trainers, ('0.' || (k % 9 + 1))::DOUBLE AS iid_beta, ('0.' || (k % 90 + 10))::DOUBLE AS accuracy, k * 10 + 0.5::DOUBLE AS train_ms, k + 0.25::DOUBLE AS theoretical_pretrain_mb, 2.5::DOUBLE AS theoretical_train_mb, k + 2.75::DOUBLE AS theoretical_total_mb, k + 0.5::DOUBLE AS actual_pretrain_mb, 1.5::DOUBLE AS actual_train_mb, k + 2.0::DOUBLE AS actual_total_mb FROM k WHERE {_DATASET} <> 'reddit' UNION ALL SELECT k, 1, 'FedAvg', 'cora', 10, 1.0, ('0.' || (k % 80 + 10))::DOUBLE, NULL, 0, 0, 0, NULL, NULL, NULL FROM k",
    "log_graph_experiments": _K + " SELECT k AS log_id, 'formal' AS kind, 'GCFL+' AS algorithm, 'MUTAG' AS dataset, (k % 7 + 3)::INT AS trainers, ('0.' || (k % 80 + 10))::DOUBLE AS accuracy, 7.5::DOUBLE AS train_ms, 0.0::DOUBLE AS theoretical_total_mb FROM k UNION ALL SELECT k, 'informal', 'FedAvg', 'BZR', 10, 0.5, NULL, 0.0 FROM k",
    "log_link_experiments": _K + " SELECT k AS log_id, 'STFL' AS algorithm, 'US, BR' AS dataset, ('0.' || (k % 80 + 10))::DOUBLE AS auc, 0.4::DOUBLE AS hit_rate, 2000.0::DOUBLE AS train_ms, 3.5::DOUBLE AS theoretical_total_mb, 0.0::DOUBLE AS actual_total_mb FROM k",
    "log_round_accuracies": _K + f" SELECT k AS log_id, {_DATASET} AS dataset, 'FedGCN' AS algorithm, r::INT AS round, CASE r WHEN 1 THEN 0.25::DOUBLE ELSE ('0.' || (k % 90 + 10))::DOUBLE END AS accuracy FROM k, range(1, 3) t(r)",
    "log_scalability": _K + " SELECT k AS log_id, 'cora' AS dataset, 0.5::DOUBLE AS iid_beta, -1::INT AS batch_size, k + 0.5::DOUBLE AS total_time, k::DOUBLE AS communication_cost, k * 100 AS total_params, (k % 7 + 3)::INT AS trainers FROM k",
    "log_frameworks": _K + ", f AS (SELECT 'one' AS framework, k FROM k UNION ALL SELECT 'two', k FROM k WHERE k % 2 = 0) SELECT framework, k AS log_id, 'cora' AS dataset, 16::INT AS batch_size, k + 0.5::DOUBLE AS total_time, 3.5::DOUBLE AS communication_cost, k * 100 AS total_params FROM f WHERE k % 4 <> 0",
    "log_line_states": _LINES,
    "online_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "online_running_totals": "SELECT event_type AS phase, sum(event_id % 1000)::BIGINT AS total, count(*) AS n FROM events GROUP BY 1",
    "online_vector_sums": "SELECT label, d::INT AS dim, round(sum(embedding[d + 1]::DOUBLE), 4) + 0.0 AS v FROM embeddings, range(4) t(d) GROUP BY ALL",
    "two_day_windows": "WITH d AS (SELECT ts::DATE AS d, event_type FROM events) SELECT strftime(d - s::INT, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM d, range(2) t(s) GROUP BY ALL",
}
