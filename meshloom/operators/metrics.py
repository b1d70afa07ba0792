"""Evaluation: accuracy, losses, AUROC, hit rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.scalar import argmax
from meshloom.session import durable


#: Cells of a group's scores, about equally full.
CELLS = 64


def accuracy(scores: DataFrame, *by: str) -> DataFrame:
    """scores(*by, p, y) -> (*by, accuracy, n): the share of rows whose largest score is at place y."""
    right = (argmax(F.col("p")) == F.col("y")).cast("double")
    return scores.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def weighted_metric(metrics: DataFrame, value: str, weight: str) -> DataFrame:
    """Weighted mean over all rows; 0 without weight."""
    total = F.sum(weight)
    return metrics.agg(F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.when(total != 0, total), F.lit(0.0)).alias(value))


def auroc(scores: DataFrame, by: str) -> DataFrame:
    """scores(by, score, y) -> (by, auroc): ties count half.

    Rows are first counted per distinct score, and the counts kept in shared storage, as they are read more than once.
    Negatives below a score are those of the cells below its own, and those below it in its cell: a group's scores are cut
    at their quantiles, so a window sees about a CELLS-th of a group's distinct scores, wherever single scores lie. The
    quantiles are approximate, which moves rows between cells and changes no result. Null if a group lacks positives or
    negatives.
    """
    per = durable(scores.groupBy(by, "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q")))
    ends = per.groupBy(by).agg(F.percentile_approx("score", [k / CELLS for k in range(1, CELLS)]).alias("ends"))
    per = per.join(ends, by).withColumn("cell", F.size(F.filter("ends", lambda e: e < F.col("score")))).drop("ends")
    cells = per.groupBy(by, "cell").agg(F.sum("q").alias("c"))
    before = Window.partitionBy(by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per = per.join(cells.select(by, "cell", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("under")), [by, "cell"])
    below = F.col("under") + F.coalesce(F.sum("q").over(Window.partitionBy(by, "cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = per.select(by, "p", "q", (F.col("p") * (below + F.col("q") / 2.0)).alias("w"))
    out = won.groupBy(by).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return out.select(by, (F.col("w") / F.when(F.col("p") * F.col("q") > 0, F.col("p") * F.col("q"))).alias("auroc"))


def hit_rate(scores: DataFrame, k: int, by: str) -> DataFrame:
    """scores(by, user_id, item_id, score, y) -> (by, hit_rate): users with a positive among their k best, of all users.

    Ties go to the smaller item. Spark keeps only k rows of a user before the shuffle, as the filter on the place in the
    window tells it.
    """
    place = F.row_number().over(Window.partitionBy(by, "user_id").orderBy(F.desc("score"), "item_id", "y"))
    best = scores.select(by, "user_id", "y", place.alias("place")).where(F.col("place") <= k)
    hits = best.groupBy(by, "user_id").agg(F.max((F.col("y") == 1).cast("double")).alias("hit"))
    return hits.groupBy(by).agg(F.avg("hit").alias("hit_rate"))


def confusion(pred: DataFrame, *by: str) -> DataFrame:
    return pred.groupBy(*by, "y", "y_hat").agg(F.count(F.lit(1)).alias("n"))


def incomplete(metrics: DataFrame, limit: float = 0.01) -> DataFrame:
    """Runs whose last loss is not below limit: metrics(run_id, round, loss) -> (run_id, loss, incomplete)."""
    last = metrics.groupBy("run_id").agg(F.max_by("loss", "round").alias("loss"))
    return last.withColumn("incomplete", F.col("loss") >= limit)
