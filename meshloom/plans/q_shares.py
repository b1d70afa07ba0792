"""Queries on masked sums of which some clients are missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshloom.operators import shares
from meshloom.plans.common import WIDTH
from meshloom.session import durable
from meshloom.sources import tables as T
from meshloom.sources.tables import cte

#: The client that shares its seeds out and then sends nothing; how many others must be left; what seeds are drawn from.
MISSING, THRESHOLD, SECRET = 3, 3, 20_011
SCALE = 1000


def _inputs(spark, sf_dir):
    """Each client's feature sums as whole numbers, all clients, and the seeds' shares."""
    nodes = T.nodes(spark, sf_dir).select("client_id", F.posexplode("x").alias("dim", "v"))
    values = nodes.groupBy("client_id", "dim").agg(F.sum(F.round(F.col("v") * SCALE).cast("long")).alias("q"))
    clients = durable(T.owners(spark, sf_dir).select("client_id").distinct())
    seeds = durable(shares.pair_seeds(clients, SECRET))
    return values, clients, seeds


def sum_without_a_client(spark, sf_dir):
    """Sums over the clients that are left, from masked values and shares."""
    values, clients, seeds = _inputs(spark, sf_dir)
    sent = durable(shares.masked(values, seeds, "dim").where(F.col("client_id") != MISSING))
    return shares.sum_of_present(sent, clients, shares.shared_out(seeds, clients, THRESHOLD, SECRET + 1), THRESHOLD, "dim")


def seeds_from_shares(spark, sf_dir):
    """For each pair of clients, whether the shares of the clients with the largest ids give its seed back."""
    _, clients, seeds = _inputs(spark, sf_dir)
    held = shares.shared_out(seeds, clients, THRESHOLD, SECRET + 1).where(F.col("holder") >= T.CLIENTS - THRESHOLD)
    back = shares.put_together(held, THRESHOLD).withColumnRenamed("v", "w")
    return seeds.join(back, ["a", "b", "part"]).select("a", "b", "part", (F.col("v") == F.col("w")).alias("same"))


QUERIES = {f.__name__: f for f in (sum_without_a_client, seeds_from_shares)}

_V = cte("nodes", "xl")
ORACLE = {
    "sum_without_a_client": _V + f" SELECT dim::INT AS dim, sum(round(v * {SCALE})::BIGINT)::BIGINT AS q FROM xl JOIN nodes USING (node_id) WHERE client_id <> {MISSING} AND dim < {WIDTH} GROUP BY ALL",
    "seeds_from_shares": _V + f" SELECT x.c AS a, y.c AS b, p::INT AS part, true AS same FROM (SELECT DISTINCT client_id AS c FROM nodes) x JOIN (SELECT DISTINCT client_id AS c FROM nodes) y ON x.c < y.c, range({shares.PARTS}) t(p)",
}
