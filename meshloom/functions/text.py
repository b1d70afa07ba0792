"""Names, metadata and summary lines as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a chunk of a vector says about itself.
CHUNK_METADATA = T.StructType([T.StructField("client_id", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("shape", T.ArrayType(T.LongType())), T.StructField("scale", T.DoubleType())])


def pod_kind(name: Column) -> Column:
    """trainer for a pod with `large` in its name, server for one with `head`, else the name itself."""
    return F.when(name.rlike("large"), "trainer").when(name.rlike("head"), "server").otherwise(name)


def to_metadata(*columns: Column) -> Column:
    return F.to_json(F.struct(*columns))


def from_metadata(text: Column) -> Column:
    """Chunk metadata of JSON text; null fields where they are missing, null where the text is no JSON."""
    return F.from_json(text, CHUNK_METADATA)


def run_name(dataset: Column, trainers: Column, hops: Column, beta: Column, client: Column) -> Column:
    """The name under which one client's part of a partitioned data set is stored."""
    return F.format_string("%s_%dtrainer_%dhop_iid_beta_%s_trainer_id_%d", dataset, trainers, hops, beta.cast("string"), client)


def summary_line(*columns: Column, places: int = 2) -> Column:
    """Values joined by commas: numbers with a fraction to `places`, others as they are."""
    return F.concat_ws(",", *[c.cast("string") if isinstance(c, Column) else F.lit(str(c)) for c in columns])
