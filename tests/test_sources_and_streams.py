"""Readers, writers and streams on small files."""

import pytest
from pyspark.sql import functions as F

from meshloom.operators import logs, lowrank, privacy, reports, run_logs, temporal
from meshloom.sources import datasets
from meshloom.sources import tables as T
from meshloom.streaming import online


def test_country_files_become_edges_and_unknown_ids_fail(spark, tmp_path):
    (tmp_path / "data_US.txt").write_text("7\tcafe\tTue Apr 03 18:00:06 +0000 2012\n9\tbar\tTue Apr 03 19:00:06 +0100 2012\n")
    (path,) = datasets.checked_countries(["US"], str(tmp_path))
    users = spark.createDataFrame([("9", 0), ("7", 1)], "user_id string, idx long")
    items = spark.createDataFrame([("cafe", 0), ("bar", 1)], "item_id string, idx long")
    edges = datasets.country_edges(spark, path, users, items)
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 1333476006), (1, 0, 1333476006)]
    assert sorted(map(tuple, datasets.country_graph(edges).collect())) == [(-2, 0), (-1, 1), (0, -2), (1, -1)]
    with pytest.raises(Exception, match="no index for item_id bar"):
        datasets.country_edges(spark, path, users, items.where("idx = 0")).collect()
    with pytest.raises(ValueError):
        datasets.checked_countries(["US", "XX"], str(tmp_path))
    with pytest.raises(FileNotFoundError):
        datasets.checked_countries(["US", "JP"], str(tmp_path))


def test_runs_get_the_next_free_folder(tmp_path):
    assert datasets.next_free(f"{tmp_path}/run").endswith("run0")
    for name in ("run0", "run3_old", "other9"):
        (tmp_path / name).mkdir()
    assert datasets.next_free(f"{tmp_path}/run", "note").endswith("run4_note")


def test_metrics_are_appended(spark, tmp_path):
    for r in range(2):
        T.write_metrics(spark.createDataFrame([(r, 0.5)], "round int, accuracy double"), f"{tmp_path}/m")
    assert spark.read.csv(f"{tmp_path}/m", header=True).count() == 2


def test_stream_follows_its_folder_and_late_windows_close(spark, tmp_path):
    def put(name, *days):
        rows = spark.createDataFrame([(f"2024-01-{d:02d} 12:00:00", "a") for d in days], "t string, kind string")
        rows.select(F.to_timestamp("t").alias("ts"), "kind").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    for name, days in (("1", (1, 1, 2)), ("2", (2, 5)), ("3", (5, 9))):
        put(name, *days)
    stream = online.events_stream(spark, f"{tmp_path}/in/1", files_per_batch=1)
    assert {r["day"]: r["n"] for r in online.finished(online.daily_counts(stream, "kind"), "one").collect()} == {"2024-01-01": 2, "2024-01-02": 1}
    schema = spark.read.parquet(f"{tmp_path}/in/1").schema
    every = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    assert {r["day"]: r["n"] for r in online.finished(online.daily_counts(every, "kind"), "all", "append").collect()}.items() <= {"2024-01-01": 2, "2024-01-02": 2, "2024-01-05": 2, "2024-01-09": 1}.items()
    seen = []
    tested = online.prequential(every, "p", lambda b: b.groupBy("kind").count(), lambda b: seen.append(b.count()))
    assert tested.agg(F.sum("count")).first()[0] == sum(seen) == 7


def test_releases_have_noise_of_their_own(spark):
    s = spark.createDataFrame([(c, k, 1.0) for c in range(3) for k in range(4)], "client_id int, k int, v double")
    spec = privacy.PrivacySpec(clip_norm=10.0, seed=5)
    one, same, other = ({r["k"]: r["v"] for r in privacy.private_sum(s, spec, "k", release=n).collect()} for n in (0, 0, 1))
    assert one == same and all(one[k] != other[k] for k in one)
    with pytest.raises(ValueError):
        privacy.PrivacySpec(mechanism="none")
    with pytest.raises(ValueError):
        privacy.PrivacySpec(epsilon=0.0)


def test_masks_hide_values_of_any_size_and_cancel(spark):
    s = spark.createDataFrame([(c, k, (-1) ** c * 1e6 * (c + 1) + k / 7) for c in range(4) for k in range(3)], "client_id int, k int, v double")
    plain = {r["k"]: r["v"] for r in s.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    assert {r["k"]: r["v"] for r in privacy.masked_sum(s, 4, "k").collect()} == pytest.approx(plain, abs=1e-5)
    masked = [r["m"] for r in privacy.masked(s, 4, "k").collect()]
    assert max(map(abs, masked)) > 1 << 60 and min(masked) < 0 < max(masked)


def test_inconsistent_node_counts_fail(spark):
    info = spark.createDataFrame([(0, 40, 100), (1, 60, 101)], "client_id int, owned long, stated long")
    with pytest.raises(Exception, match="different numbers of nodes"):
        reports.node_count(info).collect()
    with pytest.raises(Exception, match="no client states classes"):
        reports.class_count(info.select(F.lit(None).cast("long").alias("stated"), F.lit(None).cast("long").alias("largest"))).collect()


def test_sections_in_fallback_order(spark):
    bare = "Dataset: cora, Trainers: 5, Distribution: average, IID Beta: 0.5\nAverage test accuracy, 0.7\nDataset: pubmed, Trainers: 5, Distribution: average, IID Beta: 10\nAverage test accuracy, 0.8\n"
    got = run_logs.node_experiments(spark.createDataFrame([(1, bare), (2, "nothing")], "log_id int, text string")).collect()
    assert [(r["dataset"], r["iid_beta"], r["accuracy"]) for r in got] == [("cora", 0.5, 0.7), ("pubmed", 10.0, 0.8)]
    ended = "Running method: STFL\ndata_BR.txt\ntrain time 2\nTest AUC: 0.6\nThe whole process has ended\n"
    (r,) = run_logs.link_experiments(spark.createDataFrame([(1, ended)], "log_id int, text string")).collect()
    assert (r["algorithm"], r["dataset"], r["auc"], r["train_ms"]) == ("STFL", "BR", 0.6, 2000.0)
    assert logs.csv_fields(spark.createDataFrame([("a, b",), ("c",)], "line string"), 2).count() == 1


def test_offline_windows_differ_by_method():
    a, b = (temporal.window_bounds(False, m) for m in ("STFL", "4D-FED-GNN+"))
    assert (a[1] - a[0]).days == 19 and (b[1] - b[0]).days == 1 and a[2] == b[2] == 1


def test_partitions_grow_with_line_items(spark, sf_dir, monkeypatch):
    """Line items are dealt to partitions of a bounded size, so that a task's memory does not grow with them."""
    from meshloom.sources import tables

    assert tables.parts_for(spark, sf_dir, "lineitem") == 1
    expected = {(r.client_id, r.name, r.pos): (r.v, r.n) for r in tables.params(spark, sf_dir).collect()}
    monkeypatch.setattr(tables, "PART_ROWS", 300)
    few = tables.parts_for(spark, sf_dir, "lineitem")
    assert few == -(-tables.load(spark, sf_dir, "lineitem").count() // 300) > 4
    for df in (tables.order_graphs(spark, sf_dir)[1], tables.interactions(spark, sf_dir)):
        assert "REPARTITION_BY_NUM" in (plan := df._jdf.queryExecution().executedPlan().toString()) and f", {few})" in plan
    got = {(r.client_id, r.name, r.pos): (r.v, r.n) for r in tables.params(spark, sf_dir).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k][0] - v) < 1e-12 and got[k][1] == n for k, (v, n) in expected.items())


def test_parameters_sort_no_line_items_and_orders_go_to_bounded_partitions(spark, sf_dir, tmp_path, monkeypatch):
    """Sorts of line items took a task's memory; a part or order twice, or unknown, counts as in a plain join."""
    monkeypatch.setattr(T, "SORT_ROWS", 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where customers, orders and parts are large
    try:
        plan = T.params(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("ShuffledHashJoin") == 2
        rows = sum(T.load(spark, sf_dir, t).count() for t in ("orders", "customer"))
        assert "hashpartitioning(o_custkey#" in plan and f", {-(-rows // 100)})" in plan
        for t in ("region", "nation", "customer", "orders", "lineitem", "part"):
            df = T.load(spark, sf_dir, t)
            if t in ("orders", "part"):
                df = df.union(df.limit(20))
            if t == "part":
                df = df.withColumn("p_size", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size"))).where("p_partkey % 7 <> 0")
            if t == "lineitem":
                df = df.withColumn("l_discount", F.when(F.col("l_partkey") % 11 != 0, F.col("l_discount")))
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            spark.read.parquet(f"{tmp_path}/{t}.parquet").createOrReplaceTempView(f"odd_{t}")
        want = spark.sql(
            "SELECT n_regionkey, 'layer' || (p_size % 3), l_partkey, avg(l_discount), count(*) FROM odd_lineitem JOIN odd_orders ON l_orderkey = o_orderkey JOIN odd_customer ON o_custkey = c_custkey"
            " JOIN odd_nation ON c_nationkey = n_nationkey JOIN odd_part ON l_partkey = p_partkey GROUP BY 1, 2, 3"
        )
        key = lambda df: {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
        got, expected = key(T.params(spark, str(tmp_path))), key(want)
        assert got.keys() == expected.keys() and any(k[1] is None for k in got)
        assert all(got[k][1] == n and (got[k][0] is v is None or abs(got[k][0] - v) < 1e-12) for k, (v, n) in expected.items())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ranks_by_energy_go_through_blocks_and_move_values_once(spark, monkeypatch):
    """A window over a whole layer's parts held them all in one task; a matrix of a null name or of zeros' tail counts too."""
    monkeypatch.setattr(lowrank, "RANK_BLOCK", 10, raising=False)
    sizes = {"a": 95, "b": 1, "c": 10, None: 31}
    rows = [(name, k, 0.0 if name == "c" and k > 4 else float(1 + k * k % 7)) for name, n in sizes.items() for k in range(3, 3 + n)]
    values = spark.createDataFrame(rows, "name string, k long, s double").repartition(3)
    for share in (0.0, 0.05, 0.5, 0.9, 1.0, 2.0):
        got = lowrank.rank_by_energy(values, share, "name")
        expected = {}
        for name in sizes:
            squares = [s * s for n, _, s in rows if n == name]
            shares = [sum(squares[: i + 1]) / sum(squares) for i in range(len(squares))]
            expected[name] = min(sum(e < share for e in shares) + 1, len(shares))
        assert {r.name: r["rank"] for r in got.collect()} == expected
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line and "[k#" in line]
    assert windows and all("block#" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in windows)
    values.createOrReplaceTempView("singular_values")
    plain = spark.sql("SELECT name, sum(s * s) OVER (PARTITION BY name ORDER BY k) / sum(s * s) OVER (PARTITION BY name) AS e FROM singular_values").where("e < 0.9")
    assert {r.name: r["rank"] - 1 for r in lowrank.rank_by_energy(values, 0.9, "name").collect()} == {n: 0 for n in sizes} | {r.name: r["count"] for r in plain.groupBy("name").count().collect()}
