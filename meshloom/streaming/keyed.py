"""Test then train on a stream with a vector of state per key.

Each key's vector lies in Spark's state store, so it survives lost executors and a restart. A micro-batch's rows are scored
by the vector as it was before the batch, then the batch's features are added to it; rows pass in Arrow batches and are
never held together, however many a key has. State grows by a vector per key and is not aged out: with timeouts in
processing time, a run that ends at what is there now would never end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meshloom.session import shared_folder

STATE = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("seen", T.LongType())])


def keyed_tests(stream: DataFrame, key: str, width: int, rate: float = 1.0) -> DataFrame:
    """stream(key, x) -> (key, n, score, seen) per key and micro-batch: its rows, the sum over them of the key's vector
    times x, and the rows before. The vector is `rate` times the sum of all x of earlier batches.

    Null keys are a key of their own; a row with a null x is left out, and an empty batch gives no rows.
    """

    def step(value: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, seen = state.get if state.exists else ([0.0] * width, 0)
        x, gained, n, score = np.array(kept, float), np.zeros(width), 0, 0.0
        for part in parts:
            if len(part):
                features = np.stack(part["x"].to_numpy())
                gained += features.sum(0)
                score += float((features @ x).sum())
                n += len(part)
        state.update(((x + rate * gained).tolist(), int(seen + n)))
        yield pd.DataFrame({key: [value[0]], "n": [n], "score": [score], "seen": [int(seen)]})

    out = T.StructType([stream.schema[key], T.StructField("n", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("seen", T.LongType())])
    return stream.where("x is not null").select(key, "x").groupBy(key).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)


class KeyedRun:
    """A stream that is run up to what has arrived, stopped, and taken up again: state and results lie below `name`."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.top = spark, f"{shared_folder(spark)}/{name}"

    def upto_now(self, scored: DataFrame) -> None:
        """Processes what is there, once, and ends."""
        writer = scored.writeStream.option("checkpointLocation", f"{self.top}/state").option("path", f"{self.top}/tests")
        writer.format("parquet").outputMode("append").trigger(availableNow=True).start().awaitTermination()

    def tests(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.top}/tests")
