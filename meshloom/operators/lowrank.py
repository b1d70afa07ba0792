"""Low-rank factors of parameter matrices: factors(client_id, name, k, side, pos, v) with side u or v, and s."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.scalar import compression_ratio

#: How many places k of singular values are summed as one, before those of one block are told apart.
RANK_BLOCK = 1 << 16
SVD_DDL = "client_id int, name string, k int, s double, u array<double>, v array<double>"


def svd_factors(matrices: DataFrame, rank: int | None) -> DataFrame:
    """matrices(client_id, name, i, j, v) -> a row per singular triplet: (client_id, name, k, s, u, v).

    Each client's layer is one matrix of bounded size, factorised in its own task; layers with a side of 1 are left
    out. The rank is at most the smaller side, and that if it is None. A triplet's sign is such that the first of the
    largest entries of u is positive, so equal matrices have equal factors.
    """

    def run(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
        m = np.zeros((int(frames["i"].max()) + 1, int(frames["j"].max()) + 1))
        m[frames["i"], frames["j"]] = frames["v"]
        if min(m.shape) < 2:
            return pd.DataFrame({c.split()[0]: [] for c in SVD_DDL.split(", ")})
        u, s, v = np.linalg.svd(m, full_matrices=False)
        r = len(s) if rank is None else min(rank, len(s))
        sign = np.sign(u[np.abs(u).argmax(0), np.arange(len(s))])
        u, v = u * sign, v * sign[:, None]
        rows = [(frames["client_id"].iloc[0], frames["name"].iloc[0], k, float(s[k]), u[:, k], v[k]) for k in range(r)]
        return pd.DataFrame(rows, columns=["client_id", "name", "k", "s", "u", "v"])

    return matrices.groupBy("client_id", "name").applyInPandas(run, SVD_DDL)


def reconstruct(u: DataFrame, s: DataFrame, v: DataFrame, by: tuple[str, ...] = ("name",)) -> DataFrame:
    """u(*by, i, k, u), s(*by, k, s), v(*by, j, k, v) -> (*by, i, j, v): sum over k of u s v."""
    joined = u.join(s, [*by, "k"]).join(v, [*by, "k"])
    return joined.groupBy(*by, "i", "j").agg(F.sum(F.col("u") * F.col("s") * F.col("v")).alias("v"))


def rank_by_energy(singular: DataFrame, share: float, *by: str) -> DataFrame:
    """singular(*by, k, s), k whole numbers -> (*by, rank): the fewest values with at least `share` of the squared sum.

    Squares are summed by blocks of RANK_BLOCK numbers k, and only the block that reaches the share is gone through value
    by value: a window is a row per block of a matrix, or the values of one block.
    """
    squares = singular.select(*by, "k", F.floor(F.col("k") / RANK_BLOCK).alias("block"), (F.col("s") * F.col("s")).alias("e")).repartition(*by, "block")
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    earlier = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # of k, so that the join below reads the same columns and rows move once; null-safe, as a filter of one side would also part them
    sums = squares.groupBy(*by, "block").agg(F.sum("e").alias("e"), F.count("k").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(
        *by, "block", F.sum("e").over(upto).alias("until"), F.sum("e").over(whole).alias("total"), F.sum("n").over(upto).alias("n_until"), F.sum("n").over(whole).alias("n"),
        zero(F.sum("e").over(earlier)).alias("before"), zero(F.sum("n").over(earlier)).alias("n_before"),
    )
    starts = (F.col("n_before") == 0) | (F.col("before") / F.col("total") < share)
    ends = (F.col("n_until") == F.col("n")) | (F.col("until") / F.col("total") >= share)
    reached = sums.where(starts & ends).select(*[F.col(c).alias(f"_{c}") for c in (*by, "block")], "before", "total", "n_before", "n")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*by, "block")])
    values = Window.partitionBy(*by, "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    inside = squares.join(F.broadcast(reached), same)  # a row per matrix
    part = inside.withColumn("e", (F.col("before") + F.sum("e").over(values)) / F.col("total"))
    return part.groupBy(*by).agg(F.least(F.max("n_before") + F.count_if(F.col("e") < share) + 1, F.max("n")).alias("rank"))


def rank_by_ratio(rows: Column, cols: Column, ratio: float) -> Column:
    """(rows cols / ratio - rows - cols) / (rows + cols + 1) as a whole number, between 1 and the smaller side."""
    rank = ((rows * cols / F.lit(float(ratio)) - rows - cols) / (rows + cols + 1)).cast("int")
    return F.greatest(F.lit(1), F.least(rank, rows, cols))


#: How a matrix's rank is chosen: (size ratio, share of energy) by method; fixed ranks are given instead.
RANK_RULES = {"adaptive": (2.0, 0.95), "energy": (10.0, 0.95)}


def chosen_ranks(triplets: DataFrame, method: str, rank: int = 10, ratio: float | None = None, share: float | None = None) -> DataFrame:
    """triplets(client_id, name, k, s, u, v) -> (client_id, name, rows, cols, rank).

    fixed: `rank`, at most the smaller side. adaptive, energy: the smaller of the ranks by size ratio and by energy.
    """
    by = ["client_id", "name"]
    sides = triplets.groupBy(*by).agg(F.max(F.size("u")).alias("rows"), F.max(F.size("v")).alias("cols"))
    if method == "fixed":
        return sides.select(*by, "rows", "cols", F.least(F.lit(rank), "rows", "cols").alias("rank"))
    if method not in RANK_RULES:
        raise ValueError(f"unknown method {method!r}")
    r, e = RANK_RULES[method]
    energy = rank_by_energy(triplets, share or e, *by).withColumnRenamed("rank", "by_energy")
    return sides.join(energy, by).select(*by, "rows", "cols", F.least(rank_by_ratio(F.col("rows"), F.col("cols"), ratio or r), "by_energy").cast("int").alias("rank"))


def compressed(matrices: DataFrame, method: str = "fixed", rank: int = 10, ratio: float | None = None, share: float | None = None) -> DataFrame:
    """matrices(client_id, name, i, j, v) -> triplets of the chosen rank; matrices with a side of 1 are not factorised."""
    triplets = svd_factors(matrices, None)
    ranks = chosen_ranks(triplets, method, rank, ratio, share).select("client_id", "name", "rank")
    return triplets.join(ranks, ["client_id", "name"]).where("k < rank")


def decompressed(triplets: DataFrame) -> DataFrame:
    """(client_id, name, i, j, v) of triplets(client_id, name, k, s, u, v)."""
    by = ("client_id", "name")
    u = triplets.select(*by, "k", F.posexplode("u").alias("i", "u"))
    v = triplets.select(*by, "k", F.posexplode("v").alias("j", "v"))
    return reconstruct(u, triplets.select(*by, "k", "s"), v, by)


def compression_report(triplets: DataFrame) -> DataFrame:
    """(client_id, name, rank, original, compressed, ratio): numbers in a matrix and in its triplets."""
    per = triplets.groupBy("client_id", "name").agg(F.count(F.lit(1)).alias("rank"), F.max(F.size("u")).cast("long").alias("rows"), F.max(F.size("v")).cast("long").alias("cols"))
    original, small = F.col("rows") * F.col("cols"), F.col("rank") * (F.col("rows") + F.col("cols") + 1)
    return per.select("client_id", "name", "rank", original.alias("original"), small.alias("compressed"), compression_ratio(F.col("rows"), F.col("cols"), F.col("rank")).alias("ratio"))


def factor_entries(triplets: DataFrame) -> DataFrame:
    """Triplets as entries(client_id, name, side, k, pos, v): sides u and v by place, s at place 0."""
    by = ["client_id", "name"]
    u = triplets.select(*by, F.lit("u").alias("side"), "k", F.posexplode("u").alias("pos", "v"))
    v = triplets.select(*by, F.lit("v").alias("side"), "k", F.posexplode("v").alias("pos", "v"))
    return u.unionByName(v).unionByName(triplets.select(*by, F.lit("s").alias("side"), "k", F.lit(0).alias("pos"), F.col("s").alias("v")))


def singular_bytes(triplets: DataFrame, item: int = 4) -> DataFrame:
    """Bytes that each client sends instead of its matrices."""
    return compression_report(triplets).groupBy("client_id").agg((F.sum("compressed") * item).alias("bytes"), (F.sum("original") * item).alias("plain_bytes"))


def factor_mean(entries: DataFrame) -> DataFrame:
    """Plain mean of factor entries over clients: entries(client_id, name, side, k, pos, v).

    Factors of different clients need not match in sign or order, so this is not the mean matrix; see matrix_mean.
    """
    return entries.groupBy("name", "side", "k", "pos").agg(F.avg("v").alias("v"))


def matrix_mean(matrices: DataFrame, clients: int) -> DataFrame:
    return matrices.groupBy("name", "i", "j").agg((F.sum("v") / float(clients)).alias("v"))
