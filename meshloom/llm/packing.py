"""Best-fit packing by a grouping genetic algorithm, on islands with migrating elites.

Documents longer than a sequence are cut into full pieces, which fill sequences of their own, and one shorter first
piece. The rest is bin packing. Pieces are dealt into shards of bounded size by a hash of their place, so every shard
sees the same mix of lengths. Each shard is evolved by several islands: a chromosome is a partition of the shard's
pieces into bins; crossover injects whole well-filled bins of one parent into another and removes the bins that hold a
piece twice. Displaced pieces are first exchanged for smaller ones of a bin where that fills it better (the dominance
step of Falkenauer's hybrid, 1996), then put back by best fit. Between epochs the best chromosome of an island moves to
the next one. Epochs are Spark stages: what moves is (shard, island, genes), never texts or ids. A shard at its lower
bound ceil(tokens / capacity) is left alone, and so is an island that has not improved for PATIENCE children.

One island begins with best fit by falling length among its chromosomes, so no shard needs more bins than that; the others
begin with first fit in random order.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.common import durable
from meshloom.llm.tokens import default_path, id_encoder

#: Pieces of a shard, islands of a shard, chromosomes of an island.
SHARD_PIECES, ISLANDS, POPULATION = 4096, 3, 8
#: Epochs at most, children of an island in an epoch at most, and children without improvement after which it stops.
EPOCHS, CHILDREN, PATIENCE = 3, 80, 30
#: Islands that a task evolves.
TASK_ISLANDS = 16
#: Bins of a child that the exchange step looks at, at most: others are left to later children.
EXCHANGED = 256
END = np.zeros(1, "<u4").tobytes()


def pieces_of(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> row_id, doc_id, piece, start, length, ids_crc32.

    Each text is encoded and ends with id 0. Only a document of more than `capacity` ids is cut: into full pieces, after
    a shorter first piece where its length is no multiple. row_id tells repeated documents apart. Null and empty texts
    have the end id only; a text of any length is encoded whole; an empty table gives no pieces.
    """
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = id_encoder(path)
        for batch in batches:
            rows = []
            for row, doc, text in zip(batch["row_id"].tolist(), batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = encode(text if isinstance(text, str) else "") + END
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    length = n % capacity or capacity if piece == 0 else capacity
                    rows.append((row, doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, piece = start + length, piece + 1
            yield pd.DataFrame(rows, columns=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text"))
    out = source.mapInPandas(run, "row_id long, doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, room: list, capacity: int) -> None:
    """Puts the pieces of `order` into open bins where they leave least room, or new ones. bins and room are updated."""
    by_room: dict[int, list[int]] = {}
    for b, r in enumerate(room):
        by_room.setdefault(r, []).append(b)
    # a bit per room value that some bin has: the tightest fitting bin is the lowest set bit from the length on
    mask = 0
    for r in by_room:
        mask |= 1 << r
    for i in order.tolist():
        n = int(lengths[i])
        fitting = mask >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            same = by_room[r]
            b = same.pop()
            if not same:
                mask &= ~(1 << r)
                del by_room[r]
        else:
            b, r = len(room), capacity
            room.append(capacity)
        bins[i] = b
        room[b] = left = r - n
        by_room.setdefault(left, []).append(b)
        mask |= 1 << left


def fill_of(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first; among equals, the mean squared fill, which rewards full bins beside empty ones."""
    fill = fill_of(lengths, bins)
    return -len(fill), float(np.mean((fill / capacity) ** 2))


def exchange(lengths: np.ndarray, bins: np.ndarray, room: list, loose: list[int], capacity: int, rng: np.random.Generator) -> list[int]:
    """Swaps one or two pieces of a bin for one or two loose ones that fill it better; returns what is loose then.

    bins and room are updated. Loose pieces get smaller by it, so best fit can place them more easily.
    """
    free = sorted((int(lengths[i]), i) for i in loose)
    chosen = set(rng.permutation(len(room))[:EXCHANGED].tolist())
    held: dict[int, list[int]] = {}
    for i in np.flatnonzero(np.isin(bins, list(chosen))).tolist():
        held.setdefault(int(bins[i]), []).append(i)
    for b, pieces in held.items():
        if not room[b] or len(free) < 2:
            continue
        outs = [(int(lengths[i]), (i,)) for i in pieces] + [(int(lengths[i] + lengths[j]), (i, j)) for k, i in enumerate(pieces[:12]) for j in pieces[k + 1 : 12]]
        best = None
        for size, out in outs:
            space = size + room[b]
            at = bisect_right(free, (space, len(lengths))) - 1
            if at >= 0 and free[at][0] > size and (best is None or free[at][0] - size > best[0]):
                best = (free[at][0] - size, out, (free[at],))
            # two loose pieces: a few choices of the larger one, each with the best smaller one beside it
            for k in range(max(0, at - 3), at + 1):
                other = min(bisect_right(free, (space - free[k][0], len(lengths))) - 1, k - 1)
                if other >= 0 and (gain := free[k][0] + free[other][0] - size) > 0 and (best is None or gain > best[0]):
                    best = (gain, out, (free[k], free[other]))
            if best and best[0] == room[b]:
                break
        if best:
            gain, out, come = best
            for piece in come:
                free.remove(piece)
                bins[piece[1]] = b
            for i in out:
                bins[i] = -1
                insort(free, (int(lengths[i]), i))
            room[b] -= gain
    return [i for _, i in free]


def put_back(lengths: np.ndarray, child: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Places the pieces of child that are in no bin (-1): exchange, then best fit by falling length."""
    placed = child >= 0
    count = int(child.max()) + 1
    room = (capacity - np.bincount(child[placed], weights=lengths[placed], minlength=count).astype(np.int64)).tolist()
    loose = np.array(exchange(lengths, child, room, np.flatnonzero(~placed).tolist(), capacity, rng), np.int64)
    best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], child, room, capacity)
    return child


def crossover(lengths: np.ndarray, one: np.ndarray, other: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """one with some of other's well-filled bins injected whole; what that displaces is put back."""
    fill = fill_of(lengths, other)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    injected = rng.choice(good, size=int(rng.integers(1, max(2, len(good) // 2 + 1))), replace=False)
    moved = np.isin(other, injected)
    broken = np.unique(one[moved])  # bins of one that would hold a piece twice
    stay = ~moved & ~np.isin(one, broken)
    placed = stay | moved
    child = np.full(len(one), -1, np.int64)
    child[placed] = np.unique(np.where(stay, one, other + len(one) + 1)[placed], return_inverse=True)[1]
    return put_back(lengths, child, capacity, rng)


def mutate(lengths: np.ndarray, bins: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empties a few of the least filled bins and a few random ones and puts their pieces back."""
    fill = fill_of(lengths, bins)
    few = int(rng.integers(1, 5))
    drop = np.union1d(np.argsort(fill)[:few], rng.integers(0, len(fill), few))
    if len(drop) == len(fill):
        return bins
    loose = np.isin(bins, drop)
    child = np.full(len(bins), -1, np.int64)
    child[~loose] = np.unique(bins[~loose], return_inverse=True)[1]
    return put_back(lengths, child, capacity, rng)


def by_best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Best fit of the pieces by falling length."""
    bins, room = np.full(len(lengths), -1, np.int64), []
    best_fit(lengths, np.argsort(-lengths, kind="stable"), bins, room, capacity)
    return bins


def by_chance(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Best fit of the pieces in random order."""
    bins, room = np.full(len(lengths), -1, np.int64), []
    best_fit(lengths, rng.permutation(len(lengths)), bins, room, capacity)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return -(-int(lengths.sum()) // capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, children: int, patience: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Replaces the worst chromosome by a better child of two others, again and again; the best one comes first.

    Parents are the better ones of random pairs. Stops at the lower bound, after `children`, or after `patience` of them
    in a row that did not improve on the best.
    """
    bound = lower_bound(lengths, capacity)
    score = [fitness(lengths, c, capacity) for c in population]
    best, since = max(score), 0
    for _ in range(children):
        if -best[0] <= bound or since >= patience:
            break
        pairs = rng.integers(0, len(population), (2, 2))
        a, b = (int(x) if score[x] >= score[y] else int(y) for x, y in pairs)
        child = crossover(lengths, population[a], population[b], capacity, rng) if a != b else mutate(lengths, population[a], capacity, rng)
        if rng.random() < 0.3:
            child = mutate(lengths, child, capacity, rng)
        worst = min(range(len(population)), key=score.__getitem__)
        if (s := fitness(lengths, child, capacity)) > score[worst]:
            population[worst], score[worst] = child, s
        since = 0 if s > best else since + 1
        best = max(best, s)
    return [population[i] for i in sorted(range(len(population)), key=score.__getitem__, reverse=True)]


def settled(lengths: np.ndarray, island: int, epoch: int, shard: int, elites: list[np.ndarray], capacity: int, children: int, patience: int) -> np.ndarray:
    """The best chromosome of an island after an epoch that begins with `elites` (its own and a guest, if any)."""
    rng = np.random.default_rng([shard & 0x7FFFFFFF, island, epoch])
    population = list(elites)
    if not epoch:
        falling = by_best_fit(lengths, capacity)
        if int(falling.max()) + 1 <= lower_bound(lengths, capacity):
            return falling
        if island == 0:
            population.append(falling)
    while len(population) < POPULATION:
        population.append(by_chance(lengths, capacity, rng))
    return evolve(lengths, population, capacity, children, patience, rng)[0]


def pack_sequences(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, children: int = CHILDREN, patience: int = PATIENCE) -> DataFrame:
    """pieces with a `length` column (1 to capacity), row_id and piece -> the same with sequence_id and offset.

    Full pieces are sequences of their own. Ties do not matter: pieces of one length are interchangeable. An empty
    input gives an empty result. Reruns over the same pieces give the same sequences: all randomness is seeded by
    shard, island and epoch. pieces is read several times, so give a durable one.
    """
    full = pieces.where(F.col("length") >= capacity)
    rest = pieces.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard_pieces))
    place = F.xxhash64(F.col("row_id"), F.col("piece"))
    rest = rest.withColumn("_place", place).withColumn("_shard", F.pmod(F.shiftright(place, 7), F.lit(shards)).cast("int"))
    genes = rest.groupBy("_shard").agg(F.sort_array(F.collect_list(F.struct("_place", "row_id", "piece", "length"))).alias("g"))
    shard_rows = genes.select("_shard", F.col("g.length").alias("lengths"))
    state = shard_rows.select("_shard", "lengths", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"), F.lit(None).cast("binary").alias("guest"), F.lit(None).cast("binary").alias("home"))
    ddl = "_shard int, lengths array<long>, island int, guest binary, home binary, done boolean"

    def epoch_of(epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    lengths = np.asarray(row.lengths, np.int64)
                    elites = [np.frombuffer(x, "<i4").astype(np.int64) for x in (row.home, row.guest) if x is not None]
                    elite = settled(lengths, row.island, epoch, row[0], elites, capacity, children, patience)
                    done = int(elite.max()) + 1 <= lower_bound(lengths, capacity)
                    yield pd.DataFrame({"_shard": [row[0]], "lengths": [row.lengths], "island": [row.island], "guest": [None], "home": [elite.astype("<i4").tobytes()], "done": [done]})

        return run

    tasks = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards * islands // TASK_ISLANDS)
    over = None  # shards at their bound, an island of each
    for epoch in range(epochs):
        if epoch:
            done = state.where("done").select("_shard").distinct()
            reached = state.join(done, "_shard", "left_semi")
            over = reached if over is None else over.unionByName(reached)
            state = state.join(done, "_shard", "left_anti").drop("done")
            # the elite of the island before comes as a guest
            sent = state.select("_shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("home").alias("guest"))
            state = state.drop("guest").join(sent, ["_shard", "island"]).select("_shard", "lengths", "island", "guest", "home")
        # little to read but much to compute: a fixed number of tasks, which adaptive execution doesn't join by their bytes
        state = durable(state.repartition(tasks, "_shard", "island").mapInPandas(epoch_of(epoch), ddl))
        if state.where("not done").isEmpty():
            break
    if over is not None:
        state = state.unionByName(over)

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                best = max((np.frombuffer(x, "<i4").astype(np.int64) for x in row.elites), key=lambda c: fitness(lengths, c, capacity))
                order = np.argsort(best, kind="stable")
                sums = np.cumsum(lengths[order]) - lengths[order]
                first = np.concatenate([[True], best[order][1:] != best[order][:-1]])
                offset = np.empty(len(best), np.int64)
                offset[order] = sums - np.maximum.accumulate(np.where(first, sums, 0))
                yield pd.DataFrame({"_shard": [row[0]], "bins": [best], "offsets": [offset]})

    ended = state.groupBy("_shard").agg(F.first("lengths").alias("lengths"), F.collect_list("home").alias("elites"))
    ended = ended.select("_shard", "lengths", "elites").mapInPandas(settle, "_shard int, bins array<long>, offsets array<long>")
    placed = genes.join(ended, "_shard").select("_shard", F.explode(F.arrays_zip("g", "bins", "offsets")).alias("z"))
    placed = placed.select(
        F.col("z.g.row_id").alias("row_id"), F.col("z.g.piece").alias("piece"),
        (F.col("_shard").cast("long") * F.lit(2 * shard_pieces * 8) + F.col("z.bins")).alias("sequence_id"), F.col("z.offsets").alias("offset"),
    )
    shared = pieces.where(F.col("length") < capacity).join(placed, ["row_id", "piece"])
    alone = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return alone.unionByName(shared)


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None) -> DataFrame:
    """A row per piece of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty and still have their end id, so each document has a piece. Ids may be null or repeated.
    """
    pieces = durable(pieces_of(docs, capacity, tokenizer_path))
    return pack_sequences(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
