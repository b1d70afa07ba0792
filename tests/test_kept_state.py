"""What is kept between runs: id maps over batches, windows by what changes, factors of matrices in pieces."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import types as T

from meshloom.operators import range_finder, slices
from meshloom.sources.id_map import IdMap
from meshloom.streaming import keyed


def _entries(spark, matrices):
    rows = [(c, "w", int(i), int(j), float(m[i, j])) for c, m in matrices.items() for i, j in zip(*np.nonzero(m))]
    return spark.createDataFrame(rows, "client_id int, name string, i long, j long, v double")


def test_range_factors_are_those_of_the_whole_matrix(spark):
    rng = np.random.default_rng(5)
    u, v = np.linalg.qr(rng.normal(size=(60, 20)))[0], np.linalg.qr(rng.normal(size=(25, 20)))[0]
    whole = {0: u * 0.6 ** np.arange(20) @ v.T, 1: np.outer(np.arange(1.0, 9), [1.0, -2, 3])}
    rows = range_finder.range_factors(_entries(spark, whole), 4).collect()
    got = {(r["client_id"], r["side"], r["k"], r["pos"]): r["v"] for r in rows}
    assert len(got) == len(rows)
    for client, rank in ((0, 4), (1, 1)):
        a, s, b = np.linalg.svd(whole[client])
        assert sum(1 for c, side, *_ in got if c == client and side == "s") == rank
        for k in range(rank):
            assert got[client, "s", k, 0] == pytest.approx(s[k], rel=1e-6)
            x = np.array([got[client, "u", k, i] for i in range(len(a))])
            y = np.array([got[client, "v", k, j] for j in range(len(b))])
            assert x[np.abs(x).argmax()] > 0
            assert np.abs(np.outer(x, y) - np.outer(a[:, k], b[k])).max() < 1e-6


def test_range_factors_of_nothing_of_nulls_and_of_repeated_places(spark):
    ddl = "client_id int, name string, i int, j int, v double, x string"
    assert range_finder.range_factors(spark.createDataFrame([], ddl), 2).count() == 0
    rows = [(0, "w", 0, 0, 1.0, "a"), (0, "w", 0, 0, 2.0, "b"), (0, "w", 1, 1, None, "c"), (1, "w", 0, 0, 0.0, "d")]
    got = {(r["client_id"], r["side"], r["pos"]): round(r["v"], 9) for r in range_finder.range_factors(spark.createDataFrame(rows, ddl), 2).collect()}
    assert got == {(0, "s", 0): 3.0, (0, "u", 0): 1.0, (0, "u", 1): 0.0, (0, "v", 0): 1.0, (0, "v", 1): 0.0}
    with pytest.raises(ValueError):
        range_finder.range_factors(spark.createDataFrame([], ddl), 0)


def test_two_batches_number_values_as_one_does_and_a_batch_can_run_again(spark, tmp_path):
    rows = [("b", 0), ("a", 1), ("b", 2), (None, 3), ("d", 4), ("c", 4), ("a", 5), ("e", 6)]
    df = spark.createDataFrame(rows, "value string, at long")
    whole = IdMap(spark, str(tmp_path / "one"), T.StringType())
    want = {r["value"]: r["idx"] for r in whole.extend(df, "value", "at", 0).collect()}
    assert want == {"b": 0, "a": 1, "c": 2, "d": 3, "e": 4}
    known = IdMap(spark, str(tmp_path / "many"), T.StringType(), buckets=3)
    parts = [df.where("at < 3"), df.where("at < 0"), df.where("at >= 3")]
    for batch in (0, 0, 1, 2, 1, 2):
        known.extend(parts[batch], "value", "at", batch)
    assert {r["value"]: r["idx"] for r in known.rows(3).collect()} == want and known.rows(3).count() == len(want)
    assert {(r["at"], r["idx"]) for r in known.mapped(df, "value", 1).collect()} == {(0, 0), (1, 1), (2, 0), (3, None), (4, None), (5, 1), (6, None)}
    with pytest.raises(Exception, match="batch=3"):
        known.extend(df, "value", "at", 4)


@pytest.mark.parametrize("sliding", [True, False])
def test_windows_by_changes_equal_full_rebuilds(spark, tmp_path, sliding):
    start = date(2024, 1, 30)
    rng = np.random.default_rng(3)
    edges = [(int(n), int(o), start + timedelta(days=int(d))) for n, o, d in zip(rng.integers(0, 6, 80), rng.integers(0, 5, 80), rng.integers(0, 14, 80))]
    edges += [(1, 1, None), (2, 9, start), (2, 9, start)]
    features = {o: [float(o), 1.0] for o in range(5)}
    slices.store_by_day(spark.createDataFrame(edges, "node long, other long, ts date"), str(tmp_path / "edges"))
    x = spark.createDataFrame([*features.items(), (9, None)], "other long, x array<double>")
    views = slices.day_by_day(spark, str(tmp_path / "edges"), x, 2, start, start + timedelta(days=3), 6, sliding)
    got = {(r["day"], r["node"]): (r["degree"], r["x"]) for r in views.collect()}
    want = {}
    for k in range(6):
        first, last = start + timedelta(days=k if sliding else 0), start + timedelta(days=k + 2)
        for node, other, day in edges:
            if day and first <= day <= last:
                degree, sums = want.get((last, node), (0, [0.0, 0.0]))
                want[last, node] = (degree + 1, [a + b for a, b in zip(sums, features.get(other, [0.0, 0.0]))])
    assert got == want


def test_a_window_opens_only_the_months_that_it_needs(spark, tmp_path):
    rows = [(1, 1, date(2024, m, d)) for m in range(1, 7) for d in (1, 15)]
    slices.store_by_day(spark.createDataFrame(rows, "node long, other long, ts date"), str(tmp_path / "e"))
    some = slices.days_of(spark, str(tmp_path / "e"), date(2024, 2, 10), date(2024, 3, 2))
    assert some.count() == 2 and {f.split("month=")[1][:7] for f in some.inputFiles()} >= {"2024-02", "2024-03"}
    assert "PartitionFilters: [isnotnull(month" in some._jdf.queryExecution().explainString(some.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_keyed_stream_taken_up_again_gives_what_a_batch_run_gives(spark, tmp_path):
    rng = np.random.default_rng(8)
    parts = [[(None if k == 3 else int(k), [1.0, float(v)] if v else None) for k, v in zip(rng.integers(0, 4, 30), rng.integers(0, 5, 30))] for _ in range(3)]
    run, ddl = keyed.KeyedRun(spark, f"test-{tmp_path.name}"), "k long, x array<double>"
    want, vectors, counts = [], {}, {}
    for rows in parts:
        spark.createDataFrame(rows, ddl).write.mode("append").parquet(str(tmp_path / "in"))
        run.upto_now(keyed.keyed_tests(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")), "k", 2, rate=0.5))
        for key in {k for k, x in rows if x}:
            some = np.array([x for k, x in rows if k == key and x])
            want.append((key, len(some), float((some @ vectors.get(key, np.zeros(2))).sum()), counts.get(key, 0)))
            vectors[key], counts[key] = vectors.get(key, np.zeros(2)) + 0.5 * some.sum(0), counts.get(key, 0) + len(some)
    got = [(None if r["k"] is None else int(r["k"]), r["n"], r["score"], r["seen"]) for r in run.tests().collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
