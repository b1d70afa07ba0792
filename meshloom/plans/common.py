"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the features in `embeddings`.
WIDTH = 64


def r4(c: Column | str) -> Column:
    """Rounded to 4 places, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0)


def r6(c: Column | str) -> Column:
    """Rounded to 6 places: for means of few short decimals, which often lie on a half at 4 places."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def long_form(df: DataFrame, *keys: str) -> DataFrame:
    """(*keys, dim, v) from an array column x, rounded."""
    return df.select(*keys, F.posexplode("x").alias("dim", "v")).withColumn("v", r4("v"))


#: md5 buckets as meshloom.functions.scalar.hash32 makes them.
def sql_hash(*keys: str, seed: int = 42) -> str:
    parts = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"(('0x' || substr(md5({parts}), 1, 8))::BIGINT)"
