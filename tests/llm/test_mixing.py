"""Mixing: targets against water-filling, the mix against its own parts, and sameness however rows are dealt out."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import mixing

SCHEMA = "doc_id long, source string, size long"


def targets(sizes):
    """source -> target, by pouring until no source is above its ceiling."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(8)
    names = ["a", "B", "é", "中", "hot", "tiny", None, "x y", "z", "none"]
    rows = [(int(i), names[int(k)], int(n)) for i, (k, n) in enumerate(zip(rng.choice(9, 1500, p=[0.1, 0.1, 0.1, 0.1, 0.4, 0.02, 0.08, 0.05, 0.05]), rng.integers(0, 400, 1500)))]
    rows += [(None, "hot", 77)] * 700 + [(5000, "a", 3)] * 40 + [(6000, "none", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_are_those_of_pouring(docs):
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += r["size"]
    want = targets(sizes)
    for r in mixing.taken_words(docs).collect():
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])


def test_the_mix_is_the_same_however_rows_are_dealt_out(docs, monkeypatch):
    monkeypatch.setattr(mixing, "STRETCH", 64)
    some = [sorted(map(tuple, mixing.taken_words(d).collect()), key=repr) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("size")))]
    assert some[0] == some[1] == some[2]


def test_blocks_cover_every_word_once_and_slots_meet_the_targets(docs):
    placed, slots, pieces = (df.collect() for df in mixing.mix(docs, block_words=16))
    assert len(placed) == docs.count()
    size, target, words, passes = {}, {}, defaultdict(list), defaultdict(list)
    for r in placed:
        size[r["source_id"]], target[r["source_id"]] = r["source_size"], r["target"]
    of = {r["row"]: r for r in placed}
    inside = Counter()
    for p in pieces:
        words[p["source_id"]] += range(p["block"] * 16 + p["start"], p["block"] * 16 + p["start"] + p["words"])
        inside[p["row"]] += p["words"]
    assert all(sorted(w) == list(range(size[s])) for s, w in words.items())
    assert all(inside[r] == of[r]["size"] for r in of)
    for s in slots:
        passes[s["source_id"]].append((s["number"], s["block"], s["words"]))
    for s, got in passes.items():
        got.sort()
        blocks = -(-size[s] // 16)
        assert [n for n, _, _ in got] == list(range(len(got)))
        for first in range(0, len(got), blocks):
            one = [b for _, b, _ in got[first : first + blocks]]
            assert len(set(one)) == len(one) and set(one) <= set(range(blocks))
        assert sum(w for _, _, w in got) == pytest.approx(target[s], abs=0.5)


def test_permutation_and_its_inverse(spark):
    df = spark.createDataFrame([(n, i, k) for n in (1, 2, 3, 10, 97) for i in range(n) for k in (1, 2)], "n long, i long, k long")
    there = df.withColumn("p", mixing.permuted(F.col("i"), F.col("n"), F.col("k")))
    got = there.withColumn("q", mixing.permuted(F.col("p"), F.col("n"), F.col("k"), inverse=True)).collect()
    assert all(r["i"] == r["q"] for r in got)
    seen = defaultdict(list)
    for r in sorted(got, key=lambda r: r["i"]):
        seen[r["n"], r["k"]].append(r["p"])
    assert all(sorted(p) == list(range(n)) for (n, _), p in seen.items()) and seen[97, 1] != seen[97, 2] != list(range(97))


def broadcast_rows(plan):
    """Rows of each table that a plan that has run sent to all tasks."""
    out = [plan.metrics().apply("numOutputRows").value()] if plan.nodeName().startswith("BroadcastExchange") else []
    below = [getattr(plan, name)() for name, kind in (("executedPlan", "AdaptiveSparkPlanExec"), ("plan", "QueryStageExec")) if plan.getClass().getSimpleName().endswith(kind)]
    return out + [n for p in below or [plan.children().apply(i) for i in range(plan.children().size())] for n in broadcast_rows(p)]


def test_slots_are_not_sent_to_every_task(docs):
    _, slots, _ = mixing.mix(docs, block_words=4)
    n = len(slots.collect())
    sent = broadcast_rows(slots._jdf.queryExecution().executedPlan())
    assert n > 8 * mixing.CELLS and all(r < mixing.CELLS for r in sent)
