"""Clusters of clients: distances of update sequences, and cuts of similarity graphs. Clients are tens, rounds few."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sequences(norms: DataFrame, last: int) -> DataFrame:
    """norms(client_id, round, norm) -> (client_id, s, rounds): the last `last` norms in order, and how many rounds there were.

    A top-k by round on the map side would gain nothing: a client has one norm a round.
    """
    ordered = F.sort_array(F.collect_list(F.struct("round", "norm")))
    out = norms.groupBy("client_id").agg(ordered.alias("o"), F.count(F.lit(1)).alias("rounds"))
    return out.select("client_id", F.slice(F.col("o.norm"), F.greatest(F.size("o") - last + 1, F.lit(1)), last).alias("s"), "rounds")


def warp_distance(a: Column, b: Column) -> Column:
    """Dynamic time warping of two arrays: the root of the least sum of squared differences over monotone alignments.

    A fold over a, whose state is a row of the cost table; each row is a fold over b, whose state is the row so far.
    """
    far = F.lit(float("inf"))
    start = F.concat(F.array(F.lit(0.0)), F.array_repeat(far, F.size(b)))

    def row(before: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            least = F.least(F.element_at(before, j), F.element_at(before, j + 1), F.element_at(done, -1))
            gap = x - F.element_at(b, j)
            return F.concat(done, F.array(least + gap * gap))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(far), cell)

    return F.sqrt(F.element_at(F.aggregate(a, start, row), -1))


def standardised(s: Column) -> Column:
    """An array over its deviation; a constant one stays as it is."""
    n = F.size(s)
    mean = F.aggregate(s, F.lit(0.0), lambda t, v: t + v) / n
    deviation = F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, v: t + (v - mean) * (v - mean)) / n)
    return F.when(deviation > 0, F.transform(s, lambda v: v / deviation)).otherwise(s)


def pairwise_warp(seqs: DataFrame, standardise: bool = False) -> DataFrame:
    """seqs(client_id, s) -> (a, b, distance) of every two clients, each pair once with a < b."""
    s = standardised(F.col("s")) if standardise else F.col("s")
    one = seqs.select(F.col("client_id").alias("a"), s.alias("sa"))
    two = seqs.select(F.col("client_id").alias("b"), s.alias("sb"))
    return one.join(two, F.col("a") < F.col("b")).select("a", "b", warp_distance(F.col("sa"), F.col("sb")).alias("distance"))


def two_sides(weights: np.ndarray) -> np.ndarray:
    """Which nodes of a weighted graph lie on one side of its lightest cut (Stoer and Wagner, 1997)."""
    n = len(weights)
    w = np.array(weights, float)
    np.fill_diagonal(w, 0.0)
    groups, left, best = [[i] for i in range(n)], list(range(n)), (np.inf, [0])
    while len(left) > 1:
        order, reach = [left[0]], w[left[0]].copy()
        while len(order) < len(left):
            nxt = max((v for v in left if v not in order), key=lambda v: (reach[v], -v))
            order.append(nxt)
            reach += w[nxt]
        s, t = order[-2:]
        cut = sum(w[t][v] for v in left if v != t)
        if cut < best[0]:
            best = (cut, list(groups[t]))
        groups[s] += groups[t]
        w[s] += w[t]
        w[:, s] += w[:, t]
        w[s, s] = 0.0
        left.remove(t)
    return np.isin(np.arange(n), best[1])


def split_clusters(similarity: DataFrame) -> DataFrame:
    """similarity(cluster_id, a, b, similarity) -> (cluster_id, client_id, side): each cluster cut in two where it is weakest.

    A group is the pairs of one cluster's clients. A cluster of one client stays on side 0, which is the side of its
    smallest client.
    """

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pairs["a"]) | set(pairs["b"]))
        at = {c: i for i, c in enumerate(ids)}
        w = np.zeros((len(ids), len(ids)))
        for a, b, s in zip(pairs["a"], pairs["b"], pairs["similarity"]):
            w[at[a], at[b]] = w[at[b], at[a]] = s
        side = two_sides(w)
        side = (side != side[0]).astype(np.int32)
        return pd.DataFrame({"cluster_id": pairs["cluster_id"].iloc[0], "client_id": ids, "side": side})

    return similarity.groupBy("cluster_id").applyInPandas(run, "cluster_id int, client_id int, side int")
