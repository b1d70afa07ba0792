"""Exact values on small graphs and parameters, and invariants of what is random."""

import math

import pytest
from pyspark.sql import functions as F

from meshloom.operators import federate, graph, metrics, partition, privacy, temporal
from meshloom.sources import tables as T


@pytest.fixture(scope="module")
def line(spark):
    nodes = spark.createDataFrame([(i, [1.0 if j == i else 0.0 for j in range(4)]) for i in range(4)], "node_id long, x array<double>")
    edges = spark.createDataFrame([(a, b) for i in range(3) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long")
    return nodes, edges


def row0(df):
    return df.where("node_id = 0").first()["x"]


def test_hop_sums_on_a_line(line):
    nodes, edges = line
    assert row0(graph.hop_sum(nodes, edges, 4)) == [1, 1, 0, 0]
    assert row0(graph.hop_sum(nodes, edges, 4, "sym")) == pytest.approx([0.5, 1 / math.sqrt(6), 0, 0])
    assert all(sum(r["x"]) == pytest.approx(1) for r in graph.hop_sum(nodes, edges, 4, "row").collect())
    with pytest.raises(ValueError):
        graph.hop_sum(nodes, edges, 4, "bogus")


def test_views_need_0_or_2_hops(line):
    with pytest.raises(ValueError):
        graph.client_views(line[1], line[0].select("node_id", F.lit(0).alias("client_id")), 1)


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(i,) for i in r], "id int") for r in ((1, 2, 3, 4), (3, 4, 5, 6)))
    assert sorted(r[0] for r in graph.set_intersect(a, b).collect()) == [3, 4]
    assert sorted(r[0] for r in graph.set_symdiff(a, b).collect()) == [1, 2, 5, 6]


def test_row_normalise_keeps_a_zero_row(spark):
    w = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 0.0), (1, 1, 0.0)], "src int, dst int, w double")
    got = {r["src"]: r["s"] for r in graph.row_normalised(w).groupBy("src").agg(F.sum("w").alias("s")).collect()}
    assert got == {0: pytest.approx(1), 1: 0}


def test_means(spark):
    p = spark.createDataFrame([(0, "w", 0, 1.0), (2, "w", 0, 5.0)], "client_id int, name string, pos long, v double")
    assert federate.mean(p, 2).first()["v"] == 3
    scaled = spark.createDataFrame([(0, "w", 0, 200.0, 100.0), (1, "w", 0, 4000.0, 1000.0)], "client_id int, name string, pos long, payload double, scale double")
    assert tuple(federate.scale_aligned_mean(scaled).first())[2:] == (3000, 1000, 3)


def test_weighted_metric(spark):
    m = spark.createDataFrame([(0.5, 1), (0.75, 3)], "acc double, n int")
    assert metrics.weighted_metric(m, "acc", "n").first()[0] == 0.6875
    assert metrics.weighted_metric(m.withColumn("n", F.lit(0)), "acc", "n").first()[0] == 0


def test_masked_sum_is_the_plain_sum(spark):
    s = spark.createDataFrame([(c, k, c + k / 7) for c in range(4) for k in range(5) if (c, k) != (2, 3)], "client_id int, k int, v double")
    plain = {r["k"]: r["v"] for r in s.groupBy("k").agg(F.sum("v").alias("v")).collect()}
    assert {r["k"]: r["v"] for r in privacy.masked_sum(s, 4, "k").collect()} == pytest.approx(plain, abs=1e-5)


def test_partition_covers_all_once(spark, sf_dir):
    nodes = T.nodes(spark, sf_dir).select("node_id", "label")
    counts = {r["label"]: r["count"] for r in nodes.groupBy("label").count().collect()}
    shares = spark.createDataFrame(partition.dirichlet_shares(counts, 5, 0.5), "label int, client_id int, share double")
    out = partition.by_label_cuts(nodes, shares)
    assert out.count() == nodes.count() == out.select("node_id").distinct().count() and out.where("client_id is null").isEmpty()


def test_negatives_are_no_edges(spark, sf_dir):
    x = T.interactions(spark, sf_dir)
    pos = x.where("ts >= '1999-06-01' and ts < '1999-07-01'").select("client_id", "user_id", "item_id").distinct()
    neg = temporal.negatives(pos, x, 200)
    assert neg.count() > 0 and neg.join(x, ["user_id", "item_id"], "left_semi").isEmpty()


def test_every_positive_has_its_negatives_unless_the_user_has_all_items(spark):
    has = {0: set(range(10)), 1: set(range(9)), 2: set(range(0, 10, 2)) | {1, 3, 5}, 3: {4}}
    x = spark.createDataFrame([(u % 2, u, i) for u, own in has.items() for i in own] + [(1, 1, 77)], "client_id int, user_id long, item_id long")
    pos = x.where("item_id < 10")
    neg = temporal.negatives(pos, x, 10).collect()
    assert all(r["item_id"] in set(range(10)) - has[r["user_id"]] for r in neg)
    assert sorted((r["user_id"], r["of"], r["k"]) for r in neg) == sorted((u, i, k) for u in (1, 2, 3) for i in has[u] for k in (0, 1))


def test_windows_by_method():
    start, end, days = temporal.window_bounds(True, "STFL")
    assert ((end - start).days, days) == (1, 19) and temporal.next_window(start, end, "STFL")[0] == start
    with pytest.raises(ValueError):
        temporal.next_window(start, end, "none")


def test_sources_round_trip(spark, tmp_path):
    path = str(tmp_path / "clients")
    T.write_by_client(spark.createDataFrame([(0, 1), (1, 2)], "client_id int, v int"), path)
    assert [r["v"] for r in T.read_client(spark, path, 1).collect()] == [2]
    (tmp_path / "index").write_text("3\n x\n7\n")
    assert [r["id"] for r in T.read_index(spark, str(tmp_path / "index")).collect()] == [3, None, 7]
