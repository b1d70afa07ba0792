"""A dictionary from values to dense indices that later files extend.

It lies in shared storage as one folder per batch, inside it one per bucket of the values' hash. A batch writes its own
folder only and reads those before it, so one that runs again, even after later ones, gives the same; a lost job leaves a
folder that the next run of the same batch replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.operators.ranking import positions

#: Width of the cells of the order in which new values are numbered.
WIDTH = 1 << 16


class IdMap:
    """Values numbered from 0 in the order in which they were first seen, over all batches."""

    def __init__(self, spark: SparkSession, path: str, kind: T.DataType, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = T.StructType([T.StructField("value", kind), T.StructField("idx", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def rows(self, before: int) -> DataFrame:
        """(value, idx, batch, bucket) of the batches 0 to before - 1; a batch that was never written is an error."""
        folders = [f"{self.path}/batch={b}" for b in range(before)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*folders)

    def extend(self, df: DataFrame, value: str, order: str, batch: int) -> DataFrame:
        """Gives the values of df that no earlier batch has the next indices; returns those rows (value, idx).

        `order` is a whole number; values with the same first place are ordered by value. Null values get no index, and
        an empty df adds nothing. Repeated rows count once. Indices of earlier batches never change.
        """
        known = self.rows(batch)
        first = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.min(order).alias("_order"))
        new = first.join(known.select("value"), "value", "left_anti")
        base = known.count()  # from the files' footers
        placed = positions(new.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_order") / WIDTH), ["_order", "value"], "_place")
        placed = placed.select("value", (F.col("_place") + base).cast("long").alias("idx"))
        placed = placed.withColumn("bucket", F.pmod(F.xxhash64("value"), F.lit(self.buckets)).cast("int"))
        folder = f"{self.path}/batch={batch}"
        # a bucket is one file, sorted by value; a batch's new values are hashed evenly over buckets
        placed.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "value").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        return self.rows(batch + 1).where(F.col("batch") == batch).select("value", "idx")

    def mapped(self, df: DataFrame, value: str, batches: int, idx: str = "idx") -> DataFrame:
        """df with the index of its values; null for one that the first `batches` batches do not have."""
        known = self.rows(batches).select(F.col("value").alias(value), F.col("idx").alias(idx))
        return df.join(known, value, "left")
