"""Column functions: hashes for reproducible order, vectors, privacy noise, time strings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*keys, seed: int = 42) -> Column:
    """A number in [0, 2^32) from the md5 of seed and keys: the same in any engine."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    joined = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("long")


def unit(*keys, seed: int = 42) -> Column:
    """A number strictly between 0 and 1 that depends on the keys only."""
    return (hash32(*keys, seed=seed).cast("double") + 0.5) / float(1 << 32)


def vector_sum(x: Column, width: int) -> Column:
    """Sums of an array column's places: partial sums on the map side, and no row per place."""
    return F.array(*[F.sum(x[i]) for i in range(width)])


def vector_mean(x: Column, width: int) -> Column:
    return F.array(*[F.avg(x[i]) for i in range(width)])


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda v: v * by)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def norm2(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def one_hot(value: Column, width: int | Column) -> Column:
    last = width - 1 if isinstance(width, Column) else F.lit(width - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: (i == value).cast("int"))


def argmax(x: Column) -> Column:
    """The first place of the largest value, from 0."""
    return F.array_position(x, F.array_max(x)) - 1


def softmax(x: Column) -> Column:
    return F.transform(log_softmax(x), F.exp)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def log_softmax(x: Column) -> Column:
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.transform(x, lambda v: v - top - F.log(total))


def inverse_power(degree: Column, power: float) -> Column:
    """degree ** -power, 0 for degree 0."""
    return F.when(degree > 0, F.pow(degree.cast("double"), F.lit(-power))).otherwise(0.0)


def clip_factor(norm: Column, limit: float) -> Column:
    """What a vector of this norm is multiplied by so that its norm is at most limit."""
    return F.least(F.lit(1.0), F.lit(limit) / F.greatest(norm, F.lit(1e-300)))


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float) -> float:
    return math.sqrt(2 * math.log(1.25 / delta)) * sensitivity / epsilon


def laplace(u: Column, scale: float) -> Column:
    """Laplace noise by the inverse distribution function of u in (0, 1)."""
    d = u - 0.5
    return -F.signum(d) * scale * F.log(1 - 2 * F.abs(d))


def randomized_sign(v: Column, u: Column, epsilon: float) -> Column:
    """v with its sign kept with probability e^epsilon / (1 + e^epsilon)."""
    keep = math.exp(epsilon) / (math.exp(epsilon) + 1)
    return F.when(u < keep, v).otherwise(-v)


def compression_ratio(rows: Column, cols: Column, rank: Column) -> Column:
    return rows * cols / (rank * (rows + cols + 1)).cast("double")


def epoch_of(text: Column) -> Column:
    """Seconds since 1970 of 'Tue Apr 03 18:00:06 +0000 2012'; the offset counts, the weekday does not."""
    return F.unix_timestamp(F.regexp_replace(text, "^[A-Za-z]{3} ", ""), "MMM dd HH:mm:ss Z yyyy")


def bce_with_logits(score: Column, y: Column) -> Column:
    return F.greatest(score, F.lit(0.0)) - score * y + F.log1p(F.exp(-F.abs(score)))
