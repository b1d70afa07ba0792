"""What the operators share: shared storage, words, and joins that survive hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts, as a character class.
SPACE = r"\x20\x09-\x0D"
#: A key is hot from this share of all rows on, so there are at most HOT_KEYS of them whatever the input's size.
HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; where none is set, a local session gets a temporary one.

    On a cluster a folder of one machine would be none, so there the setting is a must.
    """
    if not (set_to := spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_to = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder: reads of it survive lost executors.

    A checkpoint keeps how rows are dealt out, so a join or grouping by the same key needs no further shuffle.
    """
    shared_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    forget(df.sparkSession)  # many steps leave much in a small driver before it would collect by itself
    return kept


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written once as compressed Parquet below the shared folder and read again: for tables of much data."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables, and shuffle files and checkpoints that nothing refers to any more.

    Spark's cleaner learns what is unreferenced from the driver's garbage collection, which a driver with little to do
    seldom runs by itself.
    """
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def short_plans(spark: SparkSession, characters: int = 8192) -> Iterator[None]:
    """Bounds the plan texts that the driver keeps of each job: a job of a long chain of joins has megabytes of them."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, characters)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(taken: Iterable[str], name: str) -> str:
    """name with as many underscores before it as it takes to differ from all of taken, in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame, but: Iterable[str] = ()) -> list[Column]:
    """The columns of df, by their whole names, without those named in `but`."""
    out = {b.lower() for b in but}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in out]


def words_of(text: Column) -> Column:
    """The words of a text, as an array; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1)), F.array().cast("array<string>"))


def join_on_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left") -> DataFrame:
    """left join right on key, where right has one row per key and `weight` tells how many rows of left have it.

    Keys with at least total / HOT_KEYS rows are at most HOT_KEYS many, as the weights sum to no more than total: those
    rows of right are broadcast, and only left rows of other keys are shuffled. So no task gets a hot key's rows.
    """
    hot = right.where(F.col(weight) * HOT_KEYS >= F.lit(total))
    cold = right.where(F.col(weight) * HOT_KEYS < F.lit(total))
    near = left.join(F.broadcast(hot), key, "inner")
    keys = hot.select(F.col(key), F.lit(True).alias("_hot"))
    far = left.join(F.broadcast(keys), key, "left").where(F.col("_hot").isNull()).drop("_hot").join(cold, key, how)
    return near.unionByName(far)
