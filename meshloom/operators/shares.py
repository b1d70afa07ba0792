"""Masked sums that survive missing clients: the seeds of pairwise masks are shared out by polynomials (Shamir, 1979).

Every two clients have a secret seed, from which both make the same mask: the one with the smaller id adds it, the other
takes it away, so masks cancel in the sum over all. Each client splits its seeds into shares, one for every client, of
which any `threshold` give the seed back and fewer tell nothing. If a client sends shares but no masked values, the masks
that the others share with it stay in the sum; enough of the others give back what they hold of those seeds, and the
masks are taken out.

Numbers lie in the field of 2**31 - 1 elements, so that products fit in 64 bits; a seed is two of them. Shares are made
and put together by aggregates and joins, a row per seed and holder, whatever the number of masked values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshloom.functions.scalar import hash32

#: The field's size, a prime.
PRIME = (1 << 31) - 1
#: Field elements of a seed.
PARTS = 2


def times(a: Column, b: Column) -> Column:
    return F.pmod(F.pmod(a, F.lit(PRIME)) * F.pmod(b, F.lit(PRIME)), F.lit(PRIME))


def inverse(a: Column) -> Column:
    """1 / a in the field, by a ** (PRIME - 2): 31 squarings, as the exponent is fixed."""
    out, base, left = F.lit(1).cast("long"), F.pmod(a, F.lit(PRIME)), PRIME - 2
    bits = [int(b) for b in bin(left)[:1:-1]]
    squares = F.aggregate(F.array([F.lit(b) for b in bits]), F.struct(out.alias("r"), base.alias("b")), lambda s, bit: F.struct(F.when(bit == 1, times(s["r"], s["b"])).otherwise(s["r"]).alias("r"), times(s["b"], s["b"]).alias("b")))
    return squares["r"]


def shared_out(seeds: DataFrame, holders: DataFrame, threshold: int, secret: int) -> DataFrame:
    """seeds(a, b, part, v) -> shares(a, b, part, holder, share), a row for each of holders(client_id).

    A share is the value at client_id + 1 of a polynomial of degree threshold - 1 whose value at 0 is the seed; its other
    coefficients are drawn from the owner's secret, which has no default: whoever knows it knows the seeds.
    """
    if threshold < 1:
        raise ValueError("threshold must be at least 1")
    draws = [F.pmod(hash32("a", "b", "part", F.lit(k), seed=secret), F.lit(PRIME)) for k in range(1, threshold)]
    drawn = seeds.select("a", "b", "part", F.array(F.pmod("v", F.lit(PRIME)), *draws).alias("c"))
    x = F.col("client_id").cast("long") + 1
    value = F.aggregate(F.reverse("c"), F.lit(0).cast("long"), lambda s, c: F.pmod(times(s, x) + c, F.lit(PRIME)))
    # holders are clients, a row each
    return drawn.crossJoin(F.broadcast(holders.select("client_id"))).select("a", "b", "part", F.col("client_id").alias("holder"), value.alias("share"))


def put_together(shares: DataFrame, threshold: int) -> DataFrame:
    """seeds(a, b, part, v) from shares of at least `threshold` holders each; fewer are an error when rows are computed.

    Lagrange's weights at 0 are made from the `threshold` holders with the smallest ids by a join of holders with holders.
    """
    keys = ["a", "b", "part"]
    held = shares.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("holder", "share"))).alias("s"))
    enough = F.when(F.size("s") >= threshold, F.slice("s", 1, threshold)).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {threshold} shares of the seed of clients "), F.col("a").cast("string"), F.lit(" and "), F.col("b").cast("string"))))
    few = held.select(*keys, enough.alias("s"))
    mine = few.select(*keys, F.explode("s").alias("m"), F.transform("s", lambda h: h["holder"].cast("long") + 1).alias("xs"))
    x = F.col("m.holder").cast("long") + 1
    others = F.filter("xs", lambda o: o != x)
    over = F.aggregate(others, F.lit(1).cast("long"), lambda s, o: times(s, o))
    under = F.aggregate(others, F.lit(1).cast("long"), lambda s, o: times(s, o - x))
    weighed = mine.withColumn("over", over).withColumn("under", under)
    part = times(F.col("m.share"), times(F.col("over"), inverse(F.col("under"))))
    return weighed.select(*keys, part.alias("p")).groupBy(*keys).agg(F.pmod(F.sum("p"), F.lit(PRIME)).alias("v"))


def pair_seeds(clients: DataFrame, secret: int) -> DataFrame:
    """seeds(a, b, part, v) of every two clients a < b, drawn from a secret; a row per pair and part: clients are tens."""
    a, b = clients.select(F.col("client_id").alias("a")), clients.select(F.col("client_id").alias("b"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    parts = pairs.select("a", "b", F.explode(F.array(*[F.lit(k) for k in range(PARTS)])).alias("part"))
    return parts.withColumn("v", F.pmod(hash32("a", "b", "part", seed=secret), F.lit(PRIME)))


def whole_seeds(seeds: DataFrame) -> DataFrame:
    """(a, b, seed): a pair's parts as one text, by which its masks are hashed."""
    ordered = F.sort_array(F.collect_list(F.struct("part", F.col("v").cast("string").alias("v"))))
    return seeds.groupBy("a", "b").agg(ordered.alias("p")).select("a", "b", F.concat_ws(".", F.col("p.v")).alias("seed"))


def mask(*keys: str) -> Column:
    """A field element for each key of values, from a pair's seed."""
    return F.pmod(hash32("seed", *keys, seed=0), F.lit(PRIME))


def _signed(seeds: DataFrame) -> DataFrame:
    """(client_id, other, seed, sign): each pair from both its clients' sides."""
    one = seeds.select(F.col("a").alias("client_id"), F.col("b").alias("other"), "seed", F.lit(1).alias("sign"))
    return one.unionByName(seeds.select(F.col("b").alias("client_id"), F.col("a").alias("other"), "seed", F.lit(-1).alias("sign")))


def masked(values: DataFrame, seeds: DataFrame, *keys: str) -> DataFrame:
    """values(client_id, *keys, q), whole numbers, with all of a client's masks: (client_id, *keys, m) in the field.

    A client masks each key that any client may have, so values must hold the same keys for every client.
    """
    sides = _signed(whole_seeds(seeds))
    moved = values.join(sides, "client_id").groupBy("client_id", *keys).agg(F.first("q").alias("q"), F.sum(F.col("sign") * mask(*keys)).alias("s"))
    return moved.select("client_id", *keys, F.pmod(F.col("q") + F.col("s"), F.lit(PRIME)).alias("m"))


def sum_of_present(sent: DataFrame, clients: DataFrame, shares: DataFrame, threshold: int, *keys: str) -> DataFrame:
    """(*keys, q): the exact sum over the clients that sent masked(client_id, *keys, m), whoever of `clients` is missing.

    shares(a, b, part, holder, share) are those of the clients that are there. Seeds of pairs of which one client is
    missing are put together from them, and those pairs' masks taken out; seeds of two clients that are both there are
    never put together. Sums must lie within half of the field's size; with fewer than `threshold` clients left it's an
    error.
    """
    there = sent.select("client_id").distinct()
    gone = clients.select("client_id").join(there, "client_id", "left_anti")
    half = lambda x, y: shares.join(there.withColumnRenamed("client_id", x), x, "left_semi").join(gone.withColumnRenamed("client_id", y), y, "left_semi")
    given = half("a", "b").unionByName(half("b", "a")).join(there.withColumnRenamed("client_id", "holder"), "holder", "left_semi")
    open_ = _signed(whole_seeds(put_together(given, threshold))).join(there, "client_id", "left_semi").select("seed", "sign")
    total = sent.groupBy(*keys).agg(F.sum("m").alias("m"))
    # a row per pair that a missing client is part of
    left = total.select(*keys).crossJoin(F.broadcast(open_)).groupBy(*keys).agg(F.sum(F.col("sign") * mask(*keys)).alias("s"))
    q = F.pmod(F.col("m") - F.coalesce("s", F.lit(0)), F.lit(PRIME))
    return total.join(left, list(keys), "left").select(*keys, F.when(q > PRIME // 2, q - PRIME).otherwise(q).alias("q"))
