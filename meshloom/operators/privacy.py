"""Clipped, noised and masked sums.

Masked sums stand in for encrypted ones: each pair of clients shares a mask that one adds and the other subtracts, in
whole numbers, so only the sum over all clients means anything. This is not homomorphic encryption.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.scalar import clip_factor, gaussian_sigma, hash32, laplace, unit


@dataclass(frozen=True)
class PrivacySpec:
    """Noise by mechanism gaussian, laplace or local; sensitivity is the clipping norm unless given."""

    epsilon: float = 1.0
    delta: float = 1e-5
    clip_norm: float = 1.0
    mechanism: str = "gaussian"
    sensitivity: float | None = None
    seed: int = 0

    def __post_init__(self) -> None:
        if self.epsilon <= 0 or not 0 < self.delta < 1 or self.clip_norm <= 0:
            raise ValueError("epsilon and clip_norm must be positive and delta in (0, 1)")
        if self.mechanism not in MECHANISMS:
            raise ValueError(f"unknown mechanism {self.mechanism!r}")


#: name -> (value, spec, keys of the entry) -> noised value; keys include the release, so no two share their noise
MECHANISMS: dict[str, Callable[[Column, PrivacySpec, tuple], Column]] = {}


def register_mechanism(name: str):
    def add(f):
        MECHANISMS[name] = f
        return f

    return add


def _sensitivity(spec: PrivacySpec) -> float:
    return spec.clip_norm if spec.sensitivity is None else spec.sensitivity


@register_mechanism("gaussian")
def _gaussian(v: Column, spec: PrivacySpec, keys: tuple) -> Column:
    """Box and Muller's transform of two hashed uniforms, so a task that is run again adds the same noise."""
    u, w = unit(*keys, seed=11), unit(*keys, seed=12)
    return v + gaussian_sigma(spec.epsilon, spec.delta, _sensitivity(spec)) * F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * w)


@register_mechanism("laplace")
def _laplace(v: Column, spec: PrivacySpec, keys: tuple) -> Column:
    return v + laplace(unit(*keys, seed=13), _sensitivity(spec) / spec.epsilon)


@register_mechanism("local")
def _local(v: Column, spec: PrivacySpec, keys: tuple) -> Column:
    keep = math.exp(spec.epsilon) / (math.exp(spec.epsilon) + 1)
    return F.when(unit(*keys, seed=14) < keep, v).otherwise(-v)


def clip_stats(sums: DataFrame, limit: float) -> DataFrame:
    """sums(client_id, ..., v) -> (client_id, norm, factor): one norm over all of a client's entries."""
    norm = sums.groupBy("client_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return norm.withColumn("factor", clip_factor(F.col("norm"), limit))


def clipped_sum(sums: DataFrame, limit: float, *keys: str) -> DataFrame:
    """Sum over clients of entries (client_id, *keys, v), each client clipped to norm `limit`."""
    factor = clip_stats(sums, limit).select("client_id", "factor")
    return sums.join(factor, "client_id").groupBy(*keys).agg(F.sum(F.col("v") * F.col("factor")).alias("v"))


def private_sum(sums: DataFrame, spec: PrivacySpec, *keys: str, release: int | None = None) -> DataFrame:
    """The clipped sum by keys, noised. Give each round its own `release` and keep spec.seed secret: noise that is drawn
    from the same seed and release is the same, and would cancel between two sums.
    """
    clean = clipped_sum(sums, spec.clip_norm, *keys)
    more = () if release is None and not spec.seed else (F.lit(f"{spec.seed}/{0 if release is None else release}"),)
    return clean.withColumn("v", MECHANISMS[spec.mechanism](F.col("v"), spec, (*keys, *more)))


def accountant(rounds: DataFrame) -> DataFrame:
    """rounds(round, epsilon, delta) with running totals. Rounds are few."""
    upto = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    return rounds.withColumn("epsilon_spent", F.sum("epsilon").over(upto)).withColumn("delta_spent", F.sum("delta").over(upto))


#: Half of a 64-bit number's bits, and their mask.
HALF, LOW = 32, (1 << 32) - 1


def wrapped_sum(column: str) -> Column:
    """The sum of whole numbers modulo 2**64: halves are summed apart, as numbers that don't overflow below 2**31 rows."""
    low = F.sum(F.col(column).bitwiseAND(F.lit(LOW)))
    high = F.sum(F.shiftrightunsigned(F.col(column), HALF)) + F.shiftrightunsigned(low, HALF)
    return F.shiftleft(high, HALF).bitwiseOR(low.bitwiseAND(F.lit(LOW)))


def masked(sums: DataFrame, clients: int, *keys: str, scale: float = 1e6, seed: int = 42) -> DataFrame:
    """(client_id, *keys, m): fixed-point values under masks that cancel over all clients 0..clients-1.

    Every client must have every key, or its masks stay in the sum; see masked_sum. All masks follow from `seed`: they hide
    nothing from who knows it, so outside tests give one that is secret. operators.shares has secrets by pair, and sums
    that survive a missing client.
    """
    value = F.round(F.col("v") * scale).cast("long")
    low, high = value.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(value, HALF)
    for other in range(clients):
        ends = F.least(F.col("client_id"), F.lit(other)), F.greatest(F.col("client_id"), F.lit(other))
        # 64 bits that wrap around, so a masked value is as likely to be any number as any other; -p is ~p + 1
        pair = F.shiftleft(hash32(*ends, *keys, seed=seed), HALF).bitwiseXOR(hash32(*ends, *keys, seed=seed + 1))
        larger = F.col("client_id") > other
        term = F.when(F.col("client_id") < other, pair).when(larger, F.bitwise_not(pair)).otherwise(F.lit(0).cast("long"))
        low, high = low + term.bitwiseAND(F.lit(LOW)) + larger.cast("long"), high + F.shiftrightunsigned(term, HALF)
    total = F.shiftleft(high + F.shiftrightunsigned(low, HALF), HALF).bitwiseOR(low.bitwiseAND(F.lit(LOW)))
    return sums.select("client_id", *keys, total.alias("m"))


def masked_sum(sums: DataFrame, clients: int, *keys: str, scale: float = 1e6, seed: int = 42) -> DataFrame:
    """The sum by key of masked values: equal to the plain sum in fixed point. Keys that a client lacks count 0 there."""
    every = sums.select(*keys).distinct().withColumn("client_id", F.explode(F.sequence(F.lit(0), F.lit(clients - 1))))
    filled = every.join(sums, ["client_id", *keys], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return masked(filled, clients, *keys, scale=scale, seed=seed).groupBy(*keys).agg((wrapped_sum("m") / scale).alias("v"))


def chunk_plan(sizes: DataFrame, slots: int) -> DataFrame:
    """sizes(client_id, n) -> (client_id, chunk, first, length): vectors cut into chunks of at most `slots` numbers."""
    chunks = F.ceil(F.col("n") / F.lit(slots))
    out = sizes.where("n > 0").select("client_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    return out.select("client_id", "chunk", (F.col("chunk") * slots).alias("first"), F.least(F.lit(slots).cast("long"), F.col("n") - F.col("chunk") * slots).alias("length"))
