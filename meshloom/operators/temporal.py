"""Time slices of interactions and what link prediction needs of them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions.scalar import hash32
from meshloom.operators.ranking import positions, spaced_positions
from meshloom.session import durable

SLIDING, EXPANDING = ("4D-FED-GNN+",), ("STFL", "StaticGNN", "FedLink")
FIRST_DAY = date(2012, 4, 3)
#: Items in a cell when a user's free items are ranked.
RANK_WIDTH = 4096


def window_bounds(online: bool, method: str, first: date = FIRST_DAY, days: int = 20) -> tuple[date, date, int]:
    """(start, end, predictions): online begins with one day of history, offline has all but the last."""
    if method not in SLIDING + EXPANDING:
        raise ValueError(f"unknown method {method!r}")
    if online:
        return first, first + timedelta(days=1), days - 1
    end = first + timedelta(days=days - 1)
    return (end - timedelta(days=1) if method in SLIDING else first), end, 1


def next_window(start: date, end: date, method: str) -> tuple[date, date]:
    """The window a day later: it slides or expands by method."""
    if method not in SLIDING + EXPANDING:
        raise ValueError(f"unknown method {method!r}")
    return (start + timedelta(days=1) if method in SLIDING else start), end + timedelta(days=1)


def time_slice(df: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """start <= ts < end, as a range that reaches the scan."""
    return df.where((F.col(ts) >= start) & (F.col(ts) < end))


def step_graph(df: DataFrame, start: Column, end: Column, most: int | None = None) -> DataFrame:
    """Edges of one time step both ways: (client_id, src_kind, src, dst).

    df(client_id, user_id, item_id, ts, pos): those with start <= ts < end, or of each client's the last `most` by pos, a
    whole number without ties. Nodes are those of the whole graph, whatever the step holds.
    """
    some = time_slice(df, start, end)
    if most is not None:
        some = last_edges(some, most, "client_id", "pos", RANK_WIDTH)
    there = some.select("client_id", F.lit("user").alias("src_kind"), F.col("user_id").alias("src"), F.col("item_id").alias("dst"))
    return there.unionByName(some.select("client_id", F.lit("item").alias("src_kind"), F.col("item_id").alias("src"), F.col("user_id").alias("dst")))


def first_seen_index(df: DataFrame, value: str, order: str, width: int = 1 << 16) -> DataFrame:
    """(value, idx): distinct values numbered from 0 in the order of their first row by `order`, a whole number."""
    first = df.groupBy(value).agg(F.min(order).alias("_first"))
    return spaced_positions(first, "_first", width, "idx").select(value, "idx")


def mapped_edges(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Interactions by dense indices; a user or item that the maps lack makes the query fail when it runs."""
    joined = df.join(users.withColumnRenamed("idx", "user_idx"), "user_id", "left").join(items.withColumnRenamed("idx", "item_idx"), "item_id", "left")

    def known(idx: str, key: str) -> Column:
        unknown = F.raise_error(F.concat(F.lit(f"no index for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        return F.when(F.col(idx).isNotNull(), F.col(idx)).otherwise(unknown.cast("long"))

    return joined.withColumn("user_idx", known("user_idx", "user_id")).withColumn("item_idx", known("item_idx", "item_id"))


def last_edges(df: DataFrame, most: int, by: str, order: str, width: int) -> DataFrame:
    """The last `most` rows of each group by a whole-number order without ties."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    placed = positions(df, [by], F.floor(F.col(order) / F.lit(width)), [order], "_p")
    return placed.join(counts, by).where(F.col("_p") >= F.col("_n") - most).drop("_p", "_n")


def buffers(df: DataFrame, size: int, by: str, order: str, width: int) -> DataFrame:
    """Adds `buffer`: consecutive rows of a group in runs of `size`."""
    placed = positions(df, [by], F.floor(F.col(order) / F.lit(width)), [order], "_p")
    return placed.withColumn("buffer", F.floor(F.col("_p") / size)).drop("_p")


def negatives(positives: DataFrame, edges: DataFrame, items: int, per: int = 2, tries: int = 8, seed: int = 42) -> DataFrame:
    """(client_id, user_id, item_id, k): for the k-th of `per` negatives of each positive pair, an item without an edge.

    Candidates are drawn by hash from the items 0..items-1, `tries` for each negative; the first without an edge is it.
    Later tries are made only where the first one has an edge, which few have, and each step's result is kept.
    A negative whose candidates all have edges takes one of the user's items without an edge by a hashed rank, so only a
    user with edges to all items has none.
    """
    pos = positives.select("client_id", "user_id", F.col("item_id").alias("of")).distinct()
    known = edges.select("user_id", "item_id", F.lit(True).alias("_edge")).distinct()
    key = ["client_id", "user_id", "of", "k"]

    def tried(slots: DataFrame, first: int, last: int) -> DataFrame:
        """slots(*key) with their candidates of tries first..last, t, and whether each has an edge."""
        drawn = slots.select(*key, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("t")).withColumn("kt", tries * F.col("k") + F.col("t"))
        drawn = drawn.withColumn("item_id", F.pmod(hash32("user_id", "of", "kt", seed=seed), F.lit(items)))
        # a pair of slots and edges first: few candidates have one, and the edges need no sorting for that
        met = drawn.join(known, ["user_id", "item_id"]).select(*key, "t", "_edge")
        return drawn.join(met, [*key, "t"], "left").select(*key, "t", "item_id", "_edge")

    begun = durable(tried(pos.select("*", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("k")), 0, 0).select(*key, "item_id", "_edge"))
    taken, found = begun.where("_edge is not null").select(*key), begun.where("_edge is null").select(*key, "item_id")
    if taken.isEmpty():
        return found
    if tries > 1:
        later = tried(taken, 1, tries - 1).groupBy(*key).agg(F.min_by("item_id", F.when(F.col("_edge").isNull(), F.col("t"))).alias("item_id"))
        drawn = durable(later)
    else:
        drawn = taken.withColumn("item_id", F.lit(None).cast(begun.schema["item_id"].dataType))
    found = found.unionByName(drawn.where("item_id is not null"))
    if drawn.where("item_id is null").isEmpty():
        return found

    # the rest: free items are listed for users with open negatives only, who have edges to a large share of the items,
    # as tries hardly ever fail otherwise; the list is about as long as their edges
    left = drawn.where("item_id is null").select(*key)
    listed = left.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(items - 1).cast("long"))).alias("item_id"))
    listed = listed.join(known, ["user_id", "item_id"], "left_anti")
    listed = positions(listed, ["user_id"], F.floor(F.col("item_id") / F.lit(RANK_WIDTH)), ["item_id"], "_rank")
    counts = listed.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    left = left.join(counts, "user_id").withColumn("_kt", F.lit(per * tries) + F.col("k"))
    left = left.withColumn("_rank", F.pmod(hash32("user_id", "of", "_kt", seed=seed), F.col("_n")))
    rest = left.join(listed, ["user_id", "_rank"]).select(*key, F.col("item_id").cast(drawn.schema["item_id"].dataType))
    return found.unionByName(rest)


def labelled(positives: DataFrame, negative: DataFrame) -> DataFrame:
    """Positives with y = 1 and negatives with y = 0."""
    cols = ["client_id", "user_id", "item_id"]
    return positives.select(*cols, F.lit(1).alias("y")).unionByName(negative.select(*cols, F.lit(0).alias("y")))
