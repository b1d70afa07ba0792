"""Singular triplets of matrices that no task can hold, by a random range and power steps.

A matrix is a table of entries. It is multiplied by a block of a few columns as a join of entries with the block's rows,
summed by row where the entries are; a block is made orthonormal by its Gram matrix, which has the block's width whatever
the matrix's size. Only such small squares are taken apart in one place (after Halko, Martinsson and Tropp, 2011).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from meshloom.functions.scalar import dot, scaled, unit, vector_sum
from meshloom.operators.lowrank import reconstruct
from meshloom.operators.training import outer_sums
from meshloom.session import durable

BY = ("client_id", "name")
SQUARE = T.ArrayType(T.ArrayType(T.DoubleType()))
#: Directions of a Gram matrix below this share of its largest count as none: a matrix may have a lower rank than asked for.
NOTHING = 1e-13


@pandas_udf(SQUARE)
def _whitening(grams: pd.Series) -> pd.Series:
    """Per Gram matrix the rows of t, such that a block times t is orthonormal, and zero where the block has no direction."""

    def one(gram):
        values, vectors = np.linalg.eigh(np.stack(gram))
        there = values > NOTHING * max(values[-1], 0.0)
        return list((vectors * np.where(there, 1.0 / np.sqrt(np.where(there, values, 1.0)), 0.0)).T)

    return grams.map(one)


@pandas_udf(T.StructType([T.StructField("s", T.ArrayType(T.DoubleType())), T.StructField("w", SQUARE)]))
def _directions(grams: pd.Series) -> pd.DataFrame:
    """Per Gram matrix its square roots of eigenvalues, falling, and their vectors."""
    pairs = [np.linalg.eigh(np.stack(g)) for g in grams]
    return pd.DataFrame({"s": [np.sqrt(np.maximum(v[::-1], 0.0)) for v, _ in pairs], "w": [list(x.T[::-1]) for _, x in pairs]})


def times(entries: DataFrame, block: DataFrame, over: str, to: str, width: int) -> DataFrame:
    """entries(*BY, i, j, v) and block(*BY, pos, x) -> (*BY, pos, x): the product summed over `over`, a row per `to`."""
    rows = block.withColumnRenamed("pos", over)
    joined = entries.join(rows, [*BY, over])
    return joined.groupBy(*BY, F.col(to).alias("pos")).agg(vector_sum(scaled(F.col("x"), F.col("v")), width).alias("x"))


def orthonormal(block: DataFrame, width: int) -> DataFrame:
    """block(*BY, pos, x) with orthonormal columns of the same span; what it lacks in rank are columns of zeros."""
    t = outer_sums(block.withColumn("y", F.col("x")), "x", "y", width, BY).select(*BY, _whitening("w").alias("t"))
    return block.join(t, list(BY)).select(*BY, "pos", F.transform("t", lambda row: dot(F.col("x"), row)).alias("x"))


def range_factors(entries: DataFrame, rank: int, extra: int = 8, rounds: int = 2, seed: int = 42) -> DataFrame:
    """entries(client_id, name, i, j, v) -> (client_id, name, side, k, pos, v): the `rank` largest singular triplets.

    Sides are u and v by place, and s at place 0, as lowrank.factor_entries gives them; the largest entry of each u (of
    equal ones the first) is positive. Places without an entry in the matrix have none in the factors. Triplets whose
    singular value is 0 are left out, so a matrix of a lower rank has fewer. pos is of the wider of the types of i and j. Entries of one place add up; a null v is 0.
    Without rows there are no factors. `extra` columns and `rounds` power steps buy exactness: the error falls with the
    power 2 * rounds + 1 of the ratio of the (rank + extra + 1)-th singular value to the one wanted. As squares are taken
    apart, values below a millionth of a matrix's largest are not exact.
    """
    if rank < 1 or extra < 0 or rounds < 0:
        raise ValueError(f"no factors of rank {rank} with {extra} extra columns and {rounds} power steps")
    width = rank + extra
    entries = durable(entries.groupBy(*BY, "i", "j").agg(F.sum(F.coalesce(F.col("v"), F.lit(0.0))).cast("double").alias("v")))
    places = entries.select(*BY, F.col("j").alias("pos")).distinct()
    drawn = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: 2 * unit(F.col("pos"), c, seed=seed) - 1)
    block = durable(times(entries, places.withColumn("x", drawn), "j", "i", width))
    for _ in range(rounds):
        back = durable(times(entries, orthonormal(block, width), "i", "j", width))
        block = durable(times(entries, orthonormal(back, width), "j", "i", width))
    left = durable(orthonormal(block, width))
    right = durable(times(entries, left, "i", "j", width))

    small = outer_sums(right.withColumn("y", F.col("x")), "x", "y", width, BY).select(*BY, _directions("w").alias("d"))
    ranked = small.select(*BY, F.posexplode(F.arrays_zip("d.s", "d.w")).alias("k", "p")).where(F.col("k") < rank)
    ranked = ranked.withColumn("top", F.max("p.s").over(Window.partitionBy(*BY)))
    ranked = durable(ranked.where((F.col("p.s") > 1e-9 * F.col("top")) & (F.col("p.s") > 0)).select(*BY, "k", F.col("p.s").alias("s"), F.col("p.w").alias("w")))
    # a model has at most `rank` rows here, so these joins are by model and add `rank` rows to each place
    u = left.join(ranked, list(BY)).select(*BY, "k", "pos", dot(F.col("x"), F.col("w")).alias("v"))
    v = right.join(ranked, list(BY)).select(*BY, "k", "pos", (dot(F.col("x"), F.col("w")) / F.col("s")).alias("v"))
    sign = u.groupBy(*BY, "k").agg(F.signum(F.max_by("v", F.struct(F.round(F.abs("v"), 10), -F.col("pos")))).alias("sign"))
    sides = u.withColumn("side", F.lit("u")).unionByName(v.withColumn("side", F.lit("v")))
    turned = sides.join(sign, [*BY, "k"]).select(*BY, "side", "k", "pos", (F.col("v") * F.col("sign")).alias("v"))
    return turned.unionByName(ranked.select(*BY, F.lit("s").alias("side"), "k", F.lit(0).cast(turned.schema["pos"].dataType).alias("pos"), F.col("s").alias("v")))


def from_factors(factors: DataFrame) -> DataFrame:
    """The matrix (client_id, name, i, j, v) of factors as range_factors gives them: all pairs of its places."""
    u, s, v = (factors.where(F.col("side") == side) for side in "usv")
    return reconstruct(
        u.select(*BY, "k", F.col("pos").alias("i"), F.col("v").alias("u")), s.select(*BY, "k", F.col("v").alias("s")),
        v.select(*BY, "k", F.col("pos").alias("j"), F.col("v")), BY,
    )
