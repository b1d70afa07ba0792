"""Communication cost: how many bytes go up and down."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a parameter or feature.
ITEM = 4


def model_size(params: DataFrame) -> DataFrame:
    """Bytes by layer of one model: params(name, pos)."""
    return params.select("name", "pos").distinct().groupBy("name").agg((F.count(F.lit(1)) * ITEM).alias("bytes"))


def round_bytes(rounds: DataFrame, size: int, clients: int) -> DataFrame:
    """rounds(round, sampled) -> (round, upload, download): sampled clients send the model, all receive it."""
    return rounds.select("round", (F.col("sampled") * size).alias("upload"), F.lit(size * clients).cast("long").alias("download"))


def pretrain_bytes(owned: DataFrame, views: DataFrame, total_nodes: int, width: int) -> DataFrame:
    """(client_id, upload, download): a full matrix up, the rows of the client's view down."""
    down = views.groupBy("client_id").agg((F.count(F.lit(1)) * width * ITEM).alias("download"))
    return down.select("client_id", F.lit(total_nodes * width * ITEM).cast("long").alias("upload"), "download")


def cluster_round_bytes(rounds: DataFrame, size: int, clients: int) -> DataFrame:
    """rounds(round, split, clusters): models and two norms up, and on a split similarities and the cluster's model too."""
    norms = 2 * 8 * clients
    extra = F.when(F.col("split"), F.lit(clients * clients * 8 + size).cast("long")).otherwise(F.lit(0).cast("long"))
    return rounds.select("round", (F.lit(size * clients + norms) + extra).alias("upload"), F.lit(size * clients).cast("long").alias("download"))


def embedding_bytes(users: int, items: int, width: int) -> int:
    return (users + items) * width * ITEM


def cumulative(log: DataFrame) -> DataFrame:
    """log(phase, round, bytes) with running megabytes of the phase. A row per phase and round."""
    upto = Window.partitionBy("phase").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("mb", F.sum("bytes").over(upto) / float(1 << 20))


def counter_deltas(counters: DataFrame) -> DataFrame:
    """counters(pod, at, value) -> (pod, delta): the last value less the first."""
    return counters.groupBy("pod").agg((F.max_by("value", "at") - F.min_by("value", "at")).alias("delta"))
