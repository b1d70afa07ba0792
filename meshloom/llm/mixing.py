"""Mixing sources to target weights, by blocks.

The words of each source are laid end to end and cut into blocks of fixed length. The mix is a list of slots, a block
each. For every output shard a multinomial draw over the sources, with the targets as probabilities, says how many of
its slots each source gets; the few slots that a source's draws leave over its target go to sources under theirs. A
source's slots are numbered, and number k takes block perm(k mod blocks), where perm is a pseudorandom permutation of
the source's block indices that differs from pass to pass: a block is taken once before any is taken twice. Targets are
counted in words: a source has as many slots as its target needs, and only the first words of the last one's block are
taken if the whole would be too much. Blocks are then joined by source and index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.llm.common import SPACE, durable

#: Words of a block; slots of an output shard; rounds of the permutation; documents of a stretch of a source.
BLOCK_WORDS, SHARD_SLOTS, ROUNDS, STRETCH = 64, 8192, 24, 4096
#: Slots that a task makes rows of.
TASK_SLOTS = 1 << 20
#: No document is taken more often than this.
MOST = 3
#: Cells of [0, 1) in which a draw finds its source.
CELLS = 4096
SEED = 20240229


def word_count(text: Column) -> Column:
    """Words of a whole text, however long; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"([^{SPACE}]+)"), F.lit(1))).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """sizes(source, source_size, ...) -> the same with weight and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the total by weight, but none is above
    MOST times its source's size; what is cut off is shared again by weight. In the order of size per weight, the
    sources that are cut form a prefix: source i is cut if, were it the first that isn't, its share would still be
    above its ceiling. One row per source, so these windows see the list of sources and never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    w = w.withColumn("cap", MOST * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    whole = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    w = w.withColumn("cut", F.col("level") > F.col("ratio"))
    level = F.min(F.when(~F.col("cut"), F.struct("ratio", "level"))).over(whole).getField("level")
    return w.withColumn("target", F.when(F.col("cut"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))).drop("cap", "ratio", "level", "cut", "total")


def permuted(index: Column, n: Column, key: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0..n-1 under key: the swap-or-not shuffle (Hoang, Morris and Rogaway, 2012).

    A round is its own inverse, so the inverse permutation takes the rounds from the last to the first.

    Each round pairs i with (K - i) mod n and swaps the two or not by a hash of the pair, so it is a bijection for any n.
    The rounds are a fold over a sequence: written out as nested expressions they double the plan with each round.
    """

    def step(i: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) + n - i, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(i, partner), F.lit(1)), F.lit(2)) == 0, partner).otherwise(i)

    return F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS)), index, step)


def unit_draw(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mixes docs(doc_id, source, size): (documents, slots, pieces).

    documents: row (unique), doc_id, source, source_id, size, source_size, target, at.
    slots: shard, source_id, number, block, words - the mix, in output shards; words are taken from the block's start.
    pieces: row, source_id, block, start, words - which words of a document lie in a block, by place and count.

    Documents of size 0, and so sources of size 0, are in no block. Null sources are one source, the last. Ids may be null
    or repeated. A document's place in its source follows from a hash of its columns, and rows that are equal in all of
    them lie side by side, so the mix is the same however the rows are dealt out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), F.col("size").cast("long").alias("size"))
    groups = durable(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")))
    sizes = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("source_rows"))
    targets = source_targets(sizes)
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    targets = targets.withColumn("source_id", F.row_number().over(order) - 1)
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    targets = targets.withColumn("blocks", blocks)
    # words in whole passes and in one more; that pass has the source's short last block at a place which decides how
    # many blocks the words take, and how many words of the last of them
    words = F.least(F.round("target").cast("long"), MOST * F.col("source_size"))
    one_pass, n_blocks = F.greatest("source_size", F.lit(1).cast("long")), F.greatest("blocks", F.lit(1).cast("long"))
    targets = targets.withColumn("rest", words % one_pass).withColumn("passes", ((words - F.col("rest")) / one_pass).cast("long"))
    targets = targets.withColumn("place", permuted(n_blocks - 1, n_blocks, F.xxhash64(F.lit(seed), F.col("source_id"), F.col("passes")), True))
    lost = F.col("blocks") * block_words - F.col("source_size")
    even = F.ceil(F.col("rest") / F.lit(block_words))
    more = F.when((F.col("place") < even) & (even * block_words - lost < F.col("rest")), even + 1).otherwise(even)
    targets = targets.withColumn("more", more).withColumn("wanted", F.col("passes") * F.col("blocks") + F.col("more"))
    before = (F.col("more") - 1) * block_words - F.when(F.col("place") < F.col("more") - 1, lost).otherwise(F.lit(0).cast("long"))
    targets = targets.withColumn("last_words", F.when(F.col("more") > 0, F.col("rest") - before)).drop("passes", "rest", "place", "more")
    targets = durable(targets.coalesce(1))

    # each group's place: stretches of a source by hash, then a running sum inside and over the stretches' sums;
    # sources go by id from here on, with one row per source, which is joined without moving the documents when small
    named = groups.join(targets.select(F.col("source").alias("_s"), "source_id", "source_rows", "source_size", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    named = named.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source", "size")).withColumn("words", F.col("size") * F.col("copies"))
    named = named.withColumn("stretch", F.pmod("h", F.ceil(F.col("source_rows") / F.lit(STRETCH)).cast("long")))
    sums = named.groupBy("source_id", "stretch").agg(F.sum("words").alias("s"))
    upto = Window.partitionBy("source_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("from", F.coalesce(F.sum("s").over(upto), F.lit(0).cast("long"))).drop("s")
    inside = Window.partitionBy("source_id", "stretch").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = named.withColumn("in", F.coalesce(F.sum("words").over(inside), F.lit(0).cast("long")))
    placed = placed.join(sums, ["source_id", "stretch"]).withColumn("at", F.col("from") + F.col("in"))
    placed = durable(members(placed).select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "source_id", "size", "source_size", "target", "at"))

    # draws: a slot's number in [0, 1) falls into a cell, which knows the few sources that reach into it
    n = targets.agg(F.sum("wanted").alias("n")).first()["n"] or 0
    reach = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = targets.withColumn("hi", F.sum("wanted").over(reach) / F.lit(float(max(n, 1)))).withColumn("lo", F.col("hi") - F.col("wanted") / F.lit(float(max(n, 1))))
    cut = cut.withColumn("hi", F.when(F.sum("wanted").over(reach) == n, F.lit(1.0)).otherwise(F.col("hi"))).where(F.col("wanted") > 0)
    cells = cut.select("source_id", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    shards = max(1, -(-n // SHARD_SLOTS))
    drawn = spark.range(0, n).select((F.col("id") % shards).alias("shard"), unit_draw(F.lit(seed), F.lit("draw"), F.col("id")).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    counts = drawn.groupBy("shard", "source_id").agg(F.count(F.lit(1)).alias("slots"))

    # numbers of a source's slots over the shards; what is over its target is handed on
    running = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = durable(counts.withColumn("from", F.coalesce(F.sum("slots").over(running), F.lit(0).cast("long"))))
    got = counts.groupBy("source_id").agg(F.sum("slots").alias("got"))
    about = ("source_id", "source_size", "blocks", "wanted", "last_words")
    balance = targets.select(*about).join(got, "source_id", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long")))
    balance = balance.withColumn("over", F.greatest(F.col("got") - F.col("wanted"), F.lit(0))).withColumn("under", F.greatest(F.col("wanted") - F.col("got"), F.lit(0)))
    prior = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    balance = balance.withColumn("over_from", F.coalesce(F.sum("over").over(prior), F.lit(0).cast("long"))).withColumn("under_from", F.coalesce(F.sum("under").over(prior), F.lit(0).cast("long")))
    # a shard's share of a source is a bounded number of slots; it learns all about its source, and shares are dealt out
    # anew, before they become rows: Spark takes slots for as small as their shares and would send them to every task
    spread = counts.where(F.col("slots") > 0).join(balance.select(*about, "over_from"), "source_id").withColumn("end", F.col("from") + F.col("slots"))
    spread = spread.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_SLOTS)), "shard", "source_id")
    fits = spread.where(F.col("from") < F.col("wanted")).select("shard", *about, F.explode(F.sequence("from", F.least("end", "wanted") - 1)).alias("number"))
    handed_on = F.sequence(F.greatest("from", "wanted"), F.col("end") - 1)
    spare = spread.where(F.col("end") > F.col("wanted")).select("shard", (F.col("over_from") - F.col("wanted")).alias("shift"), F.explode(handed_on).alias("number"))
    spare = spare.select("shard", (F.col("shift") + F.col("number")).alias("spare"))
    lacks = balance.where(F.col("under") > 0).select(*about, F.col("got").alias("first"), "under_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("j"))
    lacks = lacks.select(*about, (F.col("first") + F.col("j")).alias("number"), (F.col("under_from") + F.col("j")).alias("spare"))
    slots = fits.unionByName(spare.join(lacks.hint("merge"), "spare").drop("spare"))
    turn = F.floor(F.col("number") / F.col("blocks"))
    block = permuted(F.col("number") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("source_id"), turn))
    slots = slots.withColumn("block", block)
    whole = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    cut_short = F.when(F.col("number") == F.col("wanted") - 1, F.col("last_words"))
    slots = slots.select("shard", "source_id", "number", "block", F.coalesce(cut_short, whole).alias("words"))

    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    pieces = placed.where(F.col("size") > 0).select("row", "source_id", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    ends = F.least((F.col("block") + 1) * block_words, F.col("at") + F.col("size"))
    starts = F.greatest(F.col("block") * block_words, F.col("at"))
    pieces = pieces.select("row", "source_id", "block", (starts - F.col("block") * block_words).alias("start"), (ends - starts).alias("words"))
    return placed, slots, pieces


def members(groups: DataFrame) -> DataFrame:
    """A row for each of a group's `copies` rows, at the place where it begins; groups of many are spread over tasks."""
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / STRETCH)))
    parts = groups.select("*", part.alias("j")).repartition("h", "j")
    each = parts.select("*", F.explode(F.sequence(F.col("j") * STRETCH, F.least(F.col("copies"), (F.col("j") + 1) * STRETCH) - 1)).alias("k"))
    return each.withColumn("at", F.col("at") + F.col("k") * F.col("size"))


def taken_words(docs: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Per document of docs(doc_id, source, size): size, source_size, target and taken, the words that the mix takes.

    A row per input row: an empty table gives none, a document of size 0 has taken 0, and rows that are equal in all three
    columns get the shares of neighbours. Other columns are not read. Reruns over the same rows agree, however they are
    dealt out.
    """
    placed, slots, pieces = mix(docs, block_words, seed)
    # a block is in at most MOST slots; all its slots but perhaps one take the whole of it
    taken = slots.groupBy("source_id", "block").agg(F.collect_list("words").alias("upto"))
    inside = F.aggregate("upto", F.lit(0).cast("long"), lambda n, upto: n + F.greatest(F.least(upto - F.col("start"), F.col("words")), F.lit(0).cast("long")))
    # both sides grow with the words, so neither is for every task, whatever its compressed size
    sums = pieces.join(taken.hint("merge"), ["source_id", "block"]).groupBy("row").agg(F.sum(inside).alias("taken"))
    out = placed.join(sums.hint("merge"), "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`, mixed to the weights 1, 2, 3, repeating over the sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return taken_words(sized).select("doc_id", "size", "source_size", "target", "taken")
