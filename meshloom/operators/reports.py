"""Tables of results: means by group, summaries with the row that holds an extreme, order, units, missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_means(frame: DataFrame, keys: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """Means by keys of the given columns, or of all numeric ones."""
    if values is None:
        numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
        values = [n for n, t in frame.dtypes if n not in keys and (t in numeric or t.startswith("decimal"))]
    return frame.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def row_sum_means(frame: DataFrame, columns: Sequence[str], key: str, name: str) -> DataFrame:
    """The mean by key of the sum over a row's columns, in which a missing value counts 0."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    return frame.groupBy(key).agg(F.avg(total).alias(name))


def summary(frame: DataFrame, value: str, arg: str, *by: str) -> DataFrame:
    """Sum, mean, least and largest value with who holds them (the smaller of equals), and largest over mean."""
    low, high = F.min(F.struct(value, arg)), F.min(F.struct((-F.col(value)).alias("v"), arg))
    out = frame.groupBy(*by).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), low.alias("low"), high.alias("high"))
    ratio = F.when(F.col("mean") != 0, -F.col("high.v") / F.col("mean")).otherwise(0.0)
    return out.select(*by, "total", "mean", F.col(f"low.{value}").alias("least"), F.col(f"low.{arg}").alias("least_of"), (-F.col("high.v")).alias("largest"), F.col(f"high.{arg}").alias("largest_of"), ratio.alias("ratio"))


def reordered(frame: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns first, in that order, then the others; a wanted one that isn't there is left out."""
    first = [c for c in wanted if c in frame.columns]
    return frame.select(*first, *[c for c in frame.columns if c not in first])


def concatenated(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of frames with different columns; what a frame lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def without_missing(frame: DataFrame, columns: Sequence[str], how: str = "any") -> DataFrame:
    """Rows without a null in any (or in all) of the columns."""
    if how not in ("any", "all"):
        raise ValueError(f"unknown rule {how!r}")
    return frame.dropna(how=how, subset=list(columns))


def category_rank(column: str, categories: Sequence[str]) -> Column:
    """The place of a value in a given order; other values come last."""
    place = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(column))
    return F.when(place > 0, place).otherwise(len(categories) + 1).cast("int")


def matching(frame: DataFrame, among: dict[str, Sequence] | None = None, equal: dict | None = None, other: dict | None = None) -> DataFrame:
    """Rows whose columns are among values, equal to a value, and other than a value."""
    for column, values in (among or {}).items():
        frame = frame.where(F.col(column).isin(list(values)))
    for column, value in (equal or {}).items():
        frame = frame.where(F.col(column) == value)
    for column, value in (other or {}).items():
        frame = frame.where(F.col(column) != value)
    return frame


def in_units(frame: DataFrame, mb: Sequence[str] = (), ms: Sequence[str] = ()) -> DataFrame:
    """Megabytes as gigabytes (of 1024) and milliseconds as seconds, under names that end in _gb and _s."""
    return frame.withColumns({**{f"{c}_gb": F.col(c) / 1024.0 for c in mb}, **{f"{c}_s": F.col(c) / 1000.0 for c in ms}})


def node_count(info: DataFrame) -> DataFrame:
    """info(client_id, owned, stated) -> (n): the stated count of all clients that give one, else the sum of the owned.

    Clients that state different counts are an error.
    """
    agg = info.agg(F.count_distinct("stated").alias("kinds"), F.max("stated").alias("stated"), F.sum("owned").alias("owned"))
    wrong = F.raise_error(F.lit("clients state different numbers of nodes")).cast("long")
    return agg.select(F.when(F.col("kinds") > 1, wrong).otherwise(F.coalesce("stated", "owned")).alias("n"))


def class_count(info: DataFrame) -> DataFrame:
    """info(client_id, stated, largest label) -> (n): the largest stated count, else the largest label plus 1; none is an error."""
    agg = info.agg(F.max("stated").alias("stated"), F.max("largest").alias("largest"))
    found = F.coalesce(F.col("stated"), F.col("largest") + 1)
    return agg.select(F.when(found.isNull(), F.raise_error(F.lit("no client states classes or has labels")).cast("long")).otherwise(found).alias("n"))


def split_statistics(splits: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """splits(*keys, split, ...) -> a row per key with count and means of the values for train, val and test."""
    wide = splits.groupBy(*keys).pivot("split", ["train", "val", "test"]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
    return wide.na.fill(0, [f"{s}_n" for s in ("train", "val", "test")])


def guarded(metrics: DataFrame, clients: DataFrame, *values: str) -> DataFrame:
    """Metrics of all clients: 0 for one that has no rows to measure."""
    return clients.join(metrics, "client_id", "left").select("client_id", *[F.coalesce(v, F.lit(0.0)).alias(v) for v in values])
