"""Interactions and traffic as streams: the same aggregates as in batch, kept up as files arrive.

A stream's source is a folder (or pattern) of Parquet files; its state and its sink live below spark.checkpoint.dir, so a
restarted query goes on where it stopped. Watermarks bound the state: a window is final, and its state dropped, once the
newest event is `late` beyond its end.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshloom.session import shared_folder


def files_at(path: str) -> str:
    """path as a pattern that only it matches: a stream's source may then be one file as well as a folder of them."""
    return f"{path[:-1]}[{path[-1]}]"


def events_stream(spark: SparkSession, path: str, ts: str = "ts", files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files at `path`, with ts as a timestamp with zone, which watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(files_at(path)).withColumn(ts, F.col(ts).cast("timestamp"))


def daily_counts(events: DataFrame, *by: str, ts: str = "ts", late: str = "1 day", slide: str | None = None, width: str = "1 day") -> DataFrame:
    """(day, *by, n): events per window, which tumbles by day, or slides where `slide` is shorter than `width`."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    counted = marked.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *by, "n")


def running_totals(log: DataFrame, value: str, *by: str) -> DataFrame:
    """(*by, total, n) over everything so far: the partial sums of results as they arrive."""
    return log.groupBy(*by).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def running_vector(parts: DataFrame, width: int, *by: str) -> DataFrame:
    """(*by, x): the sum so far of array columns x, as clients' results arrive in any order."""
    return parts.groupBy(*by).agg(F.array(*[F.sum(F.col("x")[i]) for i in range(width)]).alias("x"))


def to_table(stream: DataFrame, name: str, mode: str = "complete") -> tuple[StreamingQuery, str]:
    """Starts a query that keeps a Parquet table up to date in shared storage; returns it and the table's path.

    In complete mode each batch replaces the table by a new version (a folder per batch, named by its number, so a batch
    that runs again overwrites itself); in append mode finished windows are added, exactly once.
    """
    top = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{top}/state").trigger(availableNow=True)
    if mode == "append":
        return writer.outputMode("append").format("parquet").option("path", f"{top}/table").start(), f"{top}/table"

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/table/version={number:010d}")

    return writer.outputMode("complete").foreachBatch(replace).start(), f"{top}/table"


def finished(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs the query over what is there now and reads its table: in complete mode the newest version."""
    query, path = to_table(stream, name, mode)
    query.awaitTermination()
    spark = stream.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    if mode == "append":
        return spark.read.schema(schema).parquet(path)
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")


def prequential(stream: DataFrame, name: str, test: Callable[[DataFrame], DataFrame], train: Callable[[DataFrame], None]) -> DataFrame:
    """Each batch is scored by the model as it is, then learned from: test then train, in the order of arrival.

    test(batch) gives metric rows; train(batch) updates the model's tables. Metrics are kept by batch number, so a batch
    that runs again replaces its own.
    """
    top = f"{shared_folder(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def step(batch: DataFrame, number: int) -> None:
        test(batch).write.mode("overwrite").parquet(f"{top}/metrics/batch={number}")
        train(batch)

    stream.writeStream.option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{top}/metrics")


def counter_totals(log: DataFrame, phase: Column) -> DataFrame:
    """Megabytes by phase so far: log(bytes) with a phase expression."""
    return running_totals(log.withColumn("phase", phase), "bytes", "phase").select("phase", (F.col("total") / float(1 << 20)).alias("mb"), "n")
