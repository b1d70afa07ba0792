"""Data sets as one table: groups of graph sets, tab-separated interactions by country, masks, reordered test rows."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.functions.scalar import epoch_of
from meshloom.operators.graph import undirected
from meshloom.operators.ranking import shuffled_positions
from meshloom.operators.reports import concatenated
from meshloom.operators.temporal import mapped_edges
from meshloom.sources.tables import read_interactions

#: Graphs that a tiny group keeps of each set.
TINY = 150
#: Countries of the link prediction task (fixed values).
COUNTRIES = ("US", "BR", "ID", "TR", "JP")


def grouped_sets(sets: dict[str, DataFrame], tiny: bool = False, key: str = "graph_id", seed: int = 42) -> DataFrame:
    """All sets in one table with a `dataset` column, a client of its own each (client_id by the order of names).

    tiny keeps TINY graphs of each, the first in shuffled order.
    """
    if not sets:
        raise ValueError("a group needs a data set")
    names = sorted(sets)
    out = concatenated([sets[n].withColumns({"dataset": F.lit(n), "client_id": F.lit(i)}) for i, n in enumerate(names)])
    return shuffled_positions(out, ["dataset"], key, seed).where(F.col("pos") < TINY).drop("pos") if tiny else out


def checked_countries(codes: Iterable[str], folder: str) -> list[str]:
    """The paths of the countries' files; an unknown code or a missing file is an error, as nothing is downloaded here."""
    codes = list(codes)
    if unknown := sorted(set(codes) - set(COUNTRIES)):
        raise ValueError(f"unknown countries {unknown}")
    paths = [f"{folder}/data_{c}.txt" for c in codes]
    if missing := [p for p in paths if not os.path.exists(p)]:
        raise FileNotFoundError(f"no such files: {missing}")
    return paths


def country_edges(spark: SparkSession, path: str, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_idx, item_idx, epoch) of a tab-separated file, by users(user_id, idx) and items(item_id, idx).

    A user or item that the maps lack makes the query fail.
    """
    rows = read_interactions(spark, path).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), epoch_of(F.col("time")).alias("epoch"))
    return mapped_edges(rows, users, items).select("user_idx", "item_idx", "epoch")


def country_graph(edges: DataFrame) -> DataFrame:
    """edges(user_idx, item_idx) both ways and distinct: src, dst, where items are -1 - idx so that they differ from users."""
    return undirected(edges.select(F.col("user_idx").alias("src"), (-1 - F.col("item_idx")).alias("dst")))


def splits_of_masks(nodes: DataFrame) -> DataFrame:
    """nodes(node_id, train_mask, val_mask, test_mask) -> (node_id, split), a row per mask that holds."""
    marks = F.array(*[F.when(F.col(f"{s}_mask"), F.lit(s)) for s in ("train", "val", "test")])
    return nodes.select("node_id", F.explode(F.array_compact(marks)).alias("split"))


def reordered_test_rows(nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """nodes(node_id, ...) whose test rows were stored in the order of listed(pos, node_id), put where they belong.

    The rows that stand at the sorted listed ids hold, in order, the data of the listed ids: the k-th stored test row
    becomes node listed[k]. Other rows stay.
    """
    # the list is a short index, not the nodes: one window over it
    stored = listed.select(F.col("node_id").alias("id"), (F.row_number().over(Window.orderBy("node_id")) - 1).alias("k"))
    to = listed.select(F.col("node_id").alias("becomes"), F.col("pos").alias("k"))
    moves = stored.join(to, "k").select(F.col("id").alias("node_id"), "becomes")
    return nodes.join(moves, "node_id", "left").withColumn("node_id", F.coalesce("becomes", "node_id")).drop("becomes")


def next_free(folder: str, comment: str = "") -> str:
    """folder followed by the next number that no sibling has, and the comment: runs are numbered from 0."""
    parent, name = os.path.split(folder.rstrip("/"))
    taken = [e[len(name) :].split("_")[0] for e in (os.listdir(parent or ".") if os.path.isdir(parent or ".") else []) if e.startswith(name)]
    n = max((int(t) for t in taken if t.isdigit()), default=-1) + 1
    return f"{folder.rstrip('/')}{n}" + (f"_{comment}" if comment else "")
