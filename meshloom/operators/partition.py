"""Dealing nodes and graphs out to clients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.functions.scalar import hash32
from meshloom.operators.ranking import shuffled_positions


#: Exponent of the powerlaw sizes (fixed value).
POWER = 0.31653612251668856


def least_held(table: list[tuple[int, int, float]], counts: dict[int, int], clients: int) -> int:
    """The fewest rows that a client gets: whole ones, as cut_points deals them out."""
    held, upto = [0] * clients, dict.fromkeys(counts, 0.0)
    taken = dict.fromkeys(counts, 0)
    for label, c, share in table:
        upto[label] += share
        cut = counts[label] if c == clients - 1 else int(round(upto[label], 9) * counts[label])
        held[c] += cut - taken[label]
        taken[label] = cut
    return min(held)


def dirichlet_shares(counts: dict[int, int], clients: int, beta: float, seed: int = 42, sizes: str = "average", tries: int = 1000) -> list[tuple[int, int, float]]:
    """(label, client, share) by a Dirichlet draw per label; counts are rows per label.

    sizes is average (a client at its fair size takes no more), equal (no such limit), or lognormal, powerlaw, exponential,
    which weigh clients; other names are an error. Draws are repeated until every client has max(1, min(10, rows // (clients * labels)))
    rows; if none of `tries` does, the one with the largest smallest client is used.
    """
    rng = np.random.default_rng(seed)
    total, labels = sum(counts.values()), sorted(counts)
    if sizes in ("average", "equal"):
        weights = np.ones(clients)
    elif sizes == "lognormal":
        weights = rng.lognormal(0, 2, clients)
    elif sizes == "powerlaw":
        weights = rng.power(POWER, clients)
    elif sizes == "exponential":
        weights = rng.exponential(1, clients)
    else:
        raise ValueError(f"unknown size distribution {sizes!r}")
    least, best, best_low = max(1, min(10, total // (clients * max(1, len(labels))))), None, -1
    for _ in range(tries):
        held, table = np.zeros(clients), []
        for label in labels:
            p = rng.dirichlet(np.full(clients, beta)) * weights
            if sizes == "average":
                p = p * (held < total / clients)
            p = p / p.sum() if p.sum() > 0 else np.full(clients, 1 / clients)
            held += p * counts[label]
            table += [(label, c, float(x)) for c, x in enumerate(p)]
        low = least_held(table, counts, clients)
        if low > best_low:
            best, best_low = table, low
        if best_low >= least:
            break
    return best or []


def cut_points(shares: DataFrame, counts: DataFrame) -> DataFrame:
    """shares(label, client_id, share), counts(label, n) -> (label, client_id, lo, hi): positions lo..hi-1 are the client's.

    Cuts are floors of cumulative shares; the last client of a label takes the rest. A row per label and client.
    """
    upto = Window.partitionBy("label").orderBy("client_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("client_id") == F.max("client_id").over(Window.partitionBy("label"))
    hi = F.when(last, F.col("n")).otherwise(F.floor(F.round(F.sum("share").over(upto), 9) * F.col("n")))
    cut = shares.join(counts, "label").withColumn("hi", hi.cast("long"))
    order = Window.partitionBy("label").orderBy("client_id")
    return cut.select("label", "client_id", F.coalesce(F.lag("hi").over(order), F.lit(0).cast("long")).alias("lo"), "hi")


def by_label_cuts(nodes: DataFrame, shares: DataFrame, seed: int = 42) -> DataFrame:
    """nodes(node_id, label) -> (node_id, label, client_id): each label's nodes in shuffled order, cut by shares."""
    counts = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    cuts = cut_points(shares, counts)
    placed = shuffled_positions(nodes.select("node_id", "label"), ["label"], "node_id", seed)
    # an array of a label's cuts instead of a range join: clients are few, and every node finds its client in it
    lists = cuts.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("client_id", "lo", "hi"))).alias("cuts"))
    found = placed.join(lists, "label")
    mine = F.filter("cuts", lambda c: (F.col("pos") >= c["lo"]) & (F.col("pos") < c["hi"]))
    return found.select("node_id", "label", mine[0]["client_id"].alias("client_id"))


def by_label_block(nodes: DataFrame, clients: int, classes: int, share: float, seed: int = 42) -> DataFrame:
    """nodes(node_id, label) -> (node_id, label, client_id, block).

    Client c prefers labels c, c + clients, ...: the first `share` of each label's shuffled nodes go to the label's
    client; the rest are dealt out by hash. block tells the two apart.
    """
    counts = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    placed = shuffled_positions(nodes.select("node_id", "label"), ["label"], "node_id", seed).join(counts, "label")
    block = F.col("pos") < F.floor(F.col("n") * F.lit(share))
    home = F.pmod(F.pmod(F.col("label"), F.lit(classes)), F.lit(clients))
    away = F.pmod(hash32("node_id", seed=seed + 1), F.lit(clients))
    return placed.select("node_id", "label", F.when(block, home).otherwise(away).cast("int").alias("client_id"), block.alias("block"))


def graph_chunks(graphs: DataFrame, clients: int, seed: int = 42, most: int = 50) -> DataFrame:
    """graphs(graph_id) -> (graph_id, client_id): equal first chunks of min(most, n // clients), the rest by hash."""
    n = graphs.count()
    size = max(1, min(most, n // clients))
    placed = shuffled_positions(graphs.select("graph_id", F.lit(0).alias("_g")), ["_g"], "graph_id", seed)
    chunk = F.floor(F.col("pos") / size)
    client = F.when(chunk < clients, chunk).otherwise(F.pmod(hash32("graph_id", seed=seed + 1), F.lit(clients)))
    return placed.select("graph_id", client.cast("int").alias("client_id"))


def overlapping_chunks(graphs: DataFrame, clients: int, seed: int = 42, low: int = 50, high: int = 150) -> DataFrame:
    """(client_id, graph_id, draw): each client draws between low and high - 1 graphs with replacement, by hash."""
    spark: SparkSession = graphs.sparkSession
    n = graphs.count()
    placed = shuffled_positions(graphs.select("graph_id", F.lit(0).alias("_g")), ["_g"], "graph_id", seed)
    draws = spark.range(clients).select(F.col("id").cast("int").alias("client_id"), (low + F.pmod(hash32("id", seed=seed + 2), F.lit(high - low))).alias("size"))
    draws = draws.select("client_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size"))).alias("draw"))
    draws = draws.withColumn("pos", F.pmod(hash32("client_id", "draw", seed=seed + 3), F.lit(max(n, 1))))
    return draws.join(placed, "pos").select("client_id", "graph_id", "draw")


def stratified_split(rows: DataFrame, key: str, label: str, train: float, seed: int = 42) -> DataFrame:
    """rows with is_train: the first floor(train * n) of each label in shuffled order; over all rows if a label has one."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    if counts.where("_n < 2").isEmpty():
        placed = shuffled_positions(rows, [label], key, seed).join(counts, label)
    else:
        placed = shuffled_positions(rows.withColumn("_all", F.lit(0)), ["_all"], key, seed).withColumn("_n", F.lit(rows.count())).drop("_all")
    return placed.withColumn("is_train", F.col("pos") < F.floor(F.col("_n") * F.lit(train))).drop("pos", "_n")
