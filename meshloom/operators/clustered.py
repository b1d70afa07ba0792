"""Training by clusters of clients that split when their updates part.

All clients begin in one cluster. After each round's local steps a cluster whose mean change is small while a member's is
large is cut in two where its members are least alike: by the angles of their changes, or by how the sequences of their
change norms run. Every client then moves by its own cluster's weighted mean change. A cluster is named by its smallest
client, so a name stays with the part that holds it.

Models, changes, memberships and norms are tables; what comes to the driver is whether any cluster is to be cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.operators import clusters, federate
from meshloom.session import durable

METHODS = ("gcfl", "gcfl_plus", "gcfl_plus_dws")


@dataclass(frozen=True)
class ClusterSpec:
    """When and how clusters are cut.

    method gcfl goes by the angles of changes; gcfl_plus by the sequences of gradient norms, gcfl_plus_dws by those of
    change norms, once every client has `last` of them, each over its deviation if `standardise`.
    """

    method: str = "gcfl"
    eps1: float = 0.05
    eps2: float = 0.1
    after: int = 20
    last: int = 5
    standardise: bool = True

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}")
        if self.last < 1 or self.after < 0:
            raise ValueError("last must be at least 1 and after at least 0")


@dataclass(frozen=True)
class Round:
    """What a round leaves: params(client_id, name, pos, v), members(client_id, cluster_id), and what decided.

    decided(cluster_id, size, mean_norm, max_norm, split) is of the clusters before the cut; cached(client_id, value) has
    the scores with which members of a cluster that was cut enter the cache, or is None.
    """

    number: int
    params: DataFrame
    members: DataFrame
    decided: DataFrame
    cached: DataFrame | None


def update_norms(change: DataFrame, members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster_id, size, mean_norm, max_norm): the norms of each cluster's changes, in one pass over the parameters.

    The mean is over members, each scaled by its share of the cluster's rows.
    """
    member = F.broadcast(members.join(F.broadcast(sizes), "client_id"))  # a row per client
    total = member.groupBy("cluster_id").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("members"))
    largest = federate.norms(change, "client_id").join(members, "client_id").groupBy("cluster_id").agg(F.max("norm").alias("max_norm"))
    sums = change.join(member, "client_id").groupBy("cluster_id", *federate.KEY).agg(F.sum(F.col("v") * F.col("size")).alias("s"))
    square = sums.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    joined = total.join(square, "cluster_id", "left").join(largest, "cluster_id", "left")
    mean = F.coalesce(F.col("norm"), F.lit(0.0)) / F.col("total") / F.col("members")
    return joined.select("cluster_id", F.col("members").alias("size"), mean.alias("mean_norm"), F.coalesce("max_norm", F.lit(0.0)).alias("max_norm"))


def alike_by_angle(change: DataFrame, members: DataFrame) -> DataFrame:
    """similarity(cluster_id, a, b, similarity) of members of one cluster: 1 + cosine of their changes."""
    return _within(federate.pairwise_cosine(change.join(F.broadcast(members), "client_id", "left_semi")).where("a < b"), members)


def alike_by_sequence(norms: DataFrame, members: DataFrame, last: int, standardise: bool) -> DataFrame:
    """similarity(cluster_id, a, b, similarity): the cluster's largest warping distance less the pair's."""
    seqs = clusters.sequences(norms.join(members, "client_id", "left_semi"), last)
    pairs = _within(clusters.pairwise_warp(seqs, standardise).withColumnRenamed("distance", "similarity"), members)
    most = pairs.groupBy("cluster_id").agg(F.max("similarity").alias("most"))
    return pairs.join(most, "cluster_id").select("cluster_id", "a", "b", (F.col("most") - F.col("similarity")).alias("similarity"))


def _within(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of clients of one cluster, with the cluster."""
    a, b = (members.select(F.col("client_id").alias(x), F.col("cluster_id").alias(f"c{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where("ca = cb").select(F.col("ca").cast("int").alias("cluster_id"), "a", "b", "similarity")


def cut_members(members: DataFrame, sides: DataFrame) -> DataFrame:
    """members after a cut: side(cluster_id, client_id, side) of the clusters that are cut; the others stay."""
    joined = members.join(sides.select("client_id", "side"), "client_id", "left")
    named = joined.groupBy("cluster_id", F.coalesce("side", F.lit(0)).alias("side")).agg(F.min("client_id").alias("name"))
    on = [joined["cluster_id"] == named["cluster_id"], F.coalesce(joined["side"], F.lit(0)) == named["side"]]
    return joined.join(named, on).select(joined["client_id"], named["name"].alias("cluster_id"))


def clustered_rounds(
    params: DataFrame, local: Callable[[DataFrame, int], DataFrame], sizes: DataFrame, count: int, spec: ClusterSpec,
    score: Callable[[DataFrame], DataFrame] | None = None, gradient_norms: Callable[[DataFrame, int], DataFrame] | None = None,
) -> Iterator[Round]:
    """Rounds of local steps, cuts and merging within clusters, numbered from 1.

    local(params, round) gives the clients' parameters after their steps; only their change is used. score(params) gives
    (client_id, value), say the accuracy of each client with its model: when a cluster is cut, its members' values of the
    round before enter the cache, and only then are they made. gradient_norms(params, round) gives (client_id, norm) for gcfl_plus. Each round's tables
    are kept in shared storage.
    """
    if spec.method == "gcfl_plus" and gradient_norms is None:
        raise ValueError("gcfl_plus needs the clients' gradient norms")
    least = sizes.agg(F.min("client_id").alias("cluster_id"))
    members = durable(sizes.select("client_id").crossJoin(F.broadcast(least)))
    norms, since = None, 0
    for r in range(1, count + 1):
        change = durable(federate.deltas(local(params, r), params))
        if spec.method != "gcfl":
            found = gradient_norms(params, r) if spec.method == "gcfl_plus" else federate.norms(change, "client_id")
            new = found.select("client_id", F.lit(r).alias("round"), "norm")
            norms, since = durable(new if norms is None else norms.unionByName(new)), since + 1
        split = federate.split_predicate(F.col("mean_norm"), F.col("max_norm"), F.col("size"), F.lit(r), spec.eps1, spec.eps2, spec.after)
        ready = spec.method == "gcfl" or since >= spec.last
        decided = durable(update_norms(change, members, sizes).withColumn("split", split & F.lit(ready)))
        cached = None
        if not decided.where("split").isEmpty():
            cut = members.join(decided.where("split"), "cluster_id", "left_semi").select("client_id", "cluster_id")
            alike = alike_by_angle(change, cut) if spec.method == "gcfl" else alike_by_sequence(norms, cut, spec.last, spec.standardise)
            cached = None if score is None or r == 1 else durable(score(params).join(F.broadcast(cut), "client_id", "left_semi"))
            members = durable(cut_members(members, clusters.split_clusters(alike)))
            norms, since = None, 0
        params = durable(federate.clusterwise(params, change, members, sizes))
        yield Round(r, params, members, decided, cached)


def best_of_cache(rounds: list[Round], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(client_id, value): each client's best value over the models it entered the cache with, the last one among them."""
    out = score(rounds[-1].params).select("client_id", "value")
    for r in rounds:
        if r.cached is not None:
            out = out.unionByName(r.cached.select("client_id", "value"))
    return out.groupBy("client_id").agg(F.max("value").alias("value"))
