"""Aggregation of client parameters: params(client_id, name, pos, v[, n]) in long form.

Everything is a group-by over (name, pos) or over clients; parameters of all clients are never in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("name", "pos")


def mean(params: DataFrame, clients: int, prefix: str | None = None) -> DataFrame:
    """Unweighted mean over clients; a position that a client lacks is 0 there. prefix keeps names that begin so."""
    if prefix is not None:
        params = params.where(F.col("name").startswith(prefix))
    return params.groupBy(*KEY).agg((F.sum("v") / F.lit(float(clients))).alias("v"))


def weighted_mean(params: DataFrame, sizes: DataFrame) -> DataFrame:
    """Mean weighted by sizes(client_id, size) over all clients of sizes."""
    total = sizes.agg(F.sum("size").alias("total"))
    weighed = params.join(F.broadcast(sizes), "client_id").groupBy(*KEY).agg(F.sum(F.col("v") * F.col("size")).alias("s"))
    return weighed.crossJoin(F.broadcast(total)).select(*KEY, (F.col("s") / F.col("total")).alias("v"))


def deltas(new: DataFrame, old: DataFrame) -> DataFrame:
    """Each client's change: v minus the client's old v, 0 where either lacks the position."""
    n, o = new.select("client_id", *KEY, F.col("v").alias("a")), old.select("client_id", *KEY, F.col("v").alias("b"))
    return n.join(o, ["client_id", *KEY], "full").select("client_id", *KEY, (F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("v"))


def clusterwise(old: DataFrame, change: DataFrame, clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every client's parameters plus its cluster's weighted mean change: (client_id, name, pos, v)."""
    # a row per client or cluster: dealt by client, parameters would go to as few tasks as there are clients
    member = F.broadcast(clusters.join(F.broadcast(sizes), "client_id"))
    total = F.broadcast(member.groupBy("cluster_id").agg(F.sum("size").alias("total")))
    moved = change.join(member, "client_id").groupBy("cluster_id", *KEY).agg(F.sum(F.col("v") * F.col("size")).alias("s"))
    moved = moved.join(total, "cluster_id").select("cluster_id", *KEY, (F.col("s") / F.col("total")).alias("d"))
    held = old.select("client_id", *KEY, "v").join(F.broadcast(clusters), "client_id")
    out = held.join(moved, ["cluster_id", *KEY], "left")
    return out.select("client_id", *KEY, (F.col("v") + F.coalesce("d", F.lit(0.0))).alias("v"))


def norms(params: DataFrame, *by: str) -> DataFrame:
    return params.groupBy(*by).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def max_update_norm(change: DataFrame) -> DataFrame:
    return norms(change, "client_id").agg(F.max("norm").alias("max_norm"))


def mean_update_norm(change: DataFrame, sizes: DataFrame) -> DataFrame:
    """Norm of the mean over clients of changes scaled by size / total size."""
    one = sizes.agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("k"))
    scaled = change.join(F.broadcast(sizes), "client_id").groupBy(*KEY).agg(F.sum(F.col("v") * F.col("size")).alias("s"))
    per = scaled.crossJoin(F.broadcast(one)).select((F.col("s") / F.col("total") / F.col("k")).alias("m"))
    return per.agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("mean_norm"))


def pairwise_cosine(change: DataFrame) -> DataFrame:
    """(a, b, similarity): 1 + cosine of each pair of clients, the product of norms floored at 1e-12.

    Pairs are of clients, which are tens; they meet by position, so what is shuffled is one row per parameter.
    """
    entries = change.groupBy(*KEY).agg(F.collect_list(F.struct("client_id", "v")).alias("e"))
    pairs = entries.select(F.explode("e").alias("p"), "e").select("p", F.explode("e").alias("q"))
    dots = pairs.groupBy(F.col("p.client_id").alias("a"), F.col("q.client_id").alias("b")).agg(F.sum(F.col("p.v") * F.col("q.v")).alias("dot"))
    size = norms(change, "client_id")
    out = dots.join(size.select(F.col("client_id").alias("a"), F.col("norm").alias("na")), "a")
    out = out.join(size.select(F.col("client_id").alias("b"), F.col("norm").alias("nb")), "b")
    return out.select("a", "b", (1 + F.col("dot") / F.greatest(F.col("na") * F.col("nb"), F.lit(1e-12))).alias("similarity"))


def proximal(params: DataFrame, reference: DataFrame, mu: float) -> DataFrame:
    """mu / 2 times the sum over layers of the norm of the distance to reference(name, pos, v), per client."""
    ref = reference.select(*KEY, F.col("v").alias("r"))
    gap = params.join(ref, list(KEY)).select("client_id", "name", (F.col("v") - F.col("r")).alias("v"))
    return norms(gap, "client_id", "name").groupBy("client_id").agg((F.sum("norm") * (mu / 2)).alias("prox"))


def param_stats(params: DataFrame) -> DataFrame:
    return params.groupBy("client_id", "name").agg(
        F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.avg("v").alias("v_mean"), F.stddev_samp("v").alias("v_std"),
        F.count_if(F.col("v") != 0).alias("non_zero"),
    )


def uniform_sample(clients: DataFrame, total: int, take: int, epoch: Column) -> DataFrame:
    """Round robin: client (i + take * epoch) mod total for i < take."""
    place = F.pmod(F.col("client_id") - take * epoch, F.lit(total))
    return clients.where(place < take)


def split_predicate(mean_norm: Column, max_norm: Column, size: Column, rounds: Column, eps1: float, eps2: float, after: int = 20) -> Column:
    """Whether a cluster of clients is split: its mean update is small while some client's is large."""
    return (mean_norm < eps1) & (max_norm > eps2) & (size > 2) & (rounds > after)


def scale_aligned_mean(scaled: DataFrame) -> DataFrame:
    """scaled(client_id, name, pos, payload, scale): mean payload at each layer's largest scale, and its value."""
    common = scaled.groupBy("name").agg(F.max("scale").alias("to"))
    aligned = scaled.join(common, "name").select(*KEY, (F.col("payload") * F.col("to") / F.col("scale")).alias("p"), "to")
    out = aligned.groupBy(*KEY, "to").agg(F.avg("p").alias("payload"))
    return out.select(*KEY, "payload", F.col("to").alias("scale"), (F.col("payload") / F.col("to")).alias("value"))


def param_scale(largest: Column) -> Column:
    """1000 for a layer of tiny values, else 100."""
    return F.when(largest < 1e-3, 1000.0).otherwise(100.0)
