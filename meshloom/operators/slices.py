"""Time windows of a graph kept up by what changes: degrees and neighbour sums from edges that enter and leave.

Edges lie by month and day in shared storage. When a window moves by a day, only the days that it gains and loses are read; the view
itself has a row per node with an edge. Sums are added to and taken from, so whole numbers stay exact.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions.scalar import scaled, vector_sum
from meshloom.session import durable


def store_by_day(edges: DataFrame, path: str, ts: str = "ts") -> None:
    """Writes edges(node, other, ts, ...) below `path`: a folder per month, in it files in the order of days.

    A month's rows come together in as few files as their size asks for (a large month is split), so there are about as
    many files as the data needs and not one per day and task. A null time has no day and is left out.
    """
    days = edges.where(F.col(ts).isNotNull()).withColumn("day", F.to_date(ts)).withColumn("month", F.trunc("day", "month"))
    days.hint("rebalance", "month").sortWithinPartitions("month", "day").write.mode("overwrite").partitionBy("month").parquet(path)


def days_of(spark: SparkSession, path: str, start: date, end: date) -> DataFrame:
    """Edges of start <= day < end: other months' folders are not opened, other days' row groups are skipped."""
    months = F.col("month").between(F.lit(start.replace(day=1)), F.lit(end - timedelta(days=1)))
    return spark.read.parquet(path).where(months & (F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(end)))


def change(edges: DataFrame, features: DataFrame, width: int, sign: int) -> DataFrame:
    """edges(node, other) and features(other, x) -> (node, degree, x): what they add (1) or take (-1), repeated edges too.

    An edge without a feature row, or with a null one, counts in the degree and adds zeros.
    """
    zeros = F.array_repeat(F.lit(0.0), width)
    joined = edges.join(features, "other", "left").withColumn("x", scaled(F.coalesce(F.col("x"), zeros), F.lit(float(sign))))
    return joined.groupBy("node").agg((F.count(F.lit(1)) * sign).alias("degree"), vector_sum(F.col("x"), width).alias("x"))


def advance(view: DataFrame, changes: DataFrame, width: int) -> DataFrame:
    """view(node, degree, x) after changes of the same columns; nodes without an edge leave it."""
    both = view.unionByName(changes).groupBy("node").agg(F.sum("degree").alias("degree"), vector_sum(F.col("x"), width).alias("x"))
    return both.where("degree > 0")


def day_by_day(spark: SparkSession, path: str, features: DataFrame, width: int, start: date, end: date, days: int, sliding: bool = True) -> DataFrame:
    """(day, node, degree, x) of the window start <= day < end and of those after each of the next `days` - 1 days.

    `day` is a window's last day. Each step reads the day that enters and, if windows slide, the one that leaves.
    """
    view = durable(change(days_of(spark, path, start, end), features, width, 1))
    out = view.withColumn("day", F.lit(end - timedelta(days=1)))
    for _ in range(days - 1):
        moves = change(days_of(spark, path, end, end + timedelta(days=1)), features, width, 1)
        if sliding:
            moves = moves.unionByName(change(days_of(spark, path, start, start + timedelta(days=1)), features, width, -1))
            start += timedelta(days=1)
        end += timedelta(days=1)
        view = durable(advance(view, moves, width))
        out = out.unionByName(view.withColumn("day", F.lit(end - timedelta(days=1))))
    return out.select("day", "node", "degree", "x")
