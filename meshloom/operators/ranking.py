"""Exact positions inside groups that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.scalar import hash32

#: Cells of a group's order. Hashes fall evenly, so a cell holds about rows / CELLS of a group's rows.
CELLS = 256


def positions(df: DataFrame, group: list[str], cell: Column, order: list, name: str = "pos") -> DataFrame:
    """df with each row's place (from 0) in its group by (cell, order).

    `cell` must grow with the order. Rows are numbered inside (group, cell) and shifted by the counts of the cells
    before, which are few; no task sorts a whole group.
    """
    keyed = df.withColumn("_cell", cell)
    counts = keyed.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0).cast("long"))).drop("_c")
    inside = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*order))
    return keyed.withColumn("_in", inside).join(offsets, [*group, "_cell"]).withColumn(name, F.col("_before") + F.col("_in") - 1).drop("_cell", "_before", "_in")


def shuffled_positions(df: DataFrame, group: list[str], key: str, seed: int = 42, name: str = "pos", cells: int = CELLS) -> DataFrame:
    """Places in the order of the key's hash (ties by key): a shuffle of each group that any engine can repeat."""
    hashed = df.withColumn("_h", hash32(key, seed=seed))
    return positions(hashed, group, F.floor(F.col("_h") / F.lit((1 << 32) / cells)), ["_h", key], name).drop("_h")


def spaced_positions(df: DataFrame, order: str, width: int, name: str = "pos") -> DataFrame:
    """Places over the whole table by a whole-number column, cut into cells of `width` values."""
    return positions(df.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col(order) / F.lit(width)), [order], name).drop("_all")
