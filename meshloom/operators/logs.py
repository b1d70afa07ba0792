"""Training logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(logs: DataFrame, pattern: str) -> DataFrame:
    """logs(log_id, text) -> (log_id, pos, section): what group 1 of the pattern finds, in order."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
    return logs.select("log_id", found.alias("pos", "section"))


def number_after(text: str, *patterns: str):
    """The first number that one of the patterns' group 1 finds, in fallback order; null if none does."""
    return F.coalesce(*[F.expr("try_cast(nullif(x, '') AS DOUBLE)".replace("x", f"regexp_extract({text}, r'{p}', 1)")) for p in patterns])


def filled_phase(lines: DataFrame) -> DataFrame:
    """lines(log_id, line_no, line) with the last experiment and phase seen in the log so far.

    One log is one window; logs are many and each is small.
    """
    upto = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.nullif(F.regexp_extract("line", r"^Experiment (\w+)", 1), F.lit(""))
    phase = F.when(F.col("line").contains("pretrain start"), "pretrain").when(F.col("line").contains("train start"), "train")
    marked = lines.withColumn("_e", start).withColumn("_p", phase)
    return marked.withColumn("experiment", F.last("_e", ignorenulls=True).over(upto)).withColumn("phase", F.last("_p", ignorenulls=True).over(upto)).drop("_e", "_p")


def metric_pairs(lines: DataFrame) -> DataFrame:
    """lines(..., line) -> their `name: number` pairs as metric and value."""
    got = lines.withColumn("metric", F.regexp_extract("line", r"^(\w+): (-?[0-9.]+)$", 1)).withColumn("value", F.expr(r"try_cast(nullif(regexp_extract(line, r'^(\w+): (-?[0-9.]+)$', 2), '') AS DOUBLE)"))
    return got.where("metric <> '' AND value IS NOT NULL")


def pivoted(metrics: DataFrame, names: list[str]) -> DataFrame:
    """A row per experiment and phase with a column per metric (last value by line)."""
    return metrics.groupBy("experiment", "phase").pivot("metric", names).agg(F.max_by("value", "line_no"))


def round_pairs(logs: DataFrame) -> DataFrame:
    """logs(log_id, text) -> (log_id, round, accuracy) of every 'Round r: Global Test Accuracy = a'."""
    r = F.regexp_extract_all("text", F.lit(r"Round (\d+): Global Test Accuracy = ([0-9.]+)"), F.lit(1))
    a = F.regexp_extract_all("text", F.lit(r"Round (\d+): Global Test Accuracy = ([0-9.]+)"), F.lit(2))
    out = logs.select("log_id", F.explode(F.arrays_zip(r.alias("r"), a.alias("a"))).alias("z"))
    return out.select("log_id", F.col("z.r").cast("int").alias("round"), F.col("z.a").cast("double").alias("accuracy"))


def csv_fields(lines: DataFrame, width: int) -> DataFrame:
    """lines(line) -> fields f0.. of those with exactly `width` comma-separated fields; others are left out."""
    parts = F.split("line", ",")
    return lines.where(F.size(parts) == width).select(*[F.trim(parts[i]).alias(f"f{i}") for i in range(width)])
