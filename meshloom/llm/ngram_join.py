"""Set-similarity self-join of documents on word shingles, by universe partition and the pigeonhole principle.

1. A shingle that a single text has is in no intersection. Chunks of documents ask for their distinct shingles (see
   chunked.py) and learn which ones others have too. A text with fewer than 75 % of such shingles links with nothing.
2. Texts with equal sets form a class, which goes on as one.
3. Sizes are cut into bands; two sets that link lie in one band or in neighbouring ones. In a band the universe of
   shingles is hashed into m segments. Two linked sets differ in at most D elements there, so if segment i is indexed
   so as to find pairs that differ in at most e_i of its elements, and the sum of (e_i + 1) exceeds D, some segment
   finds the pair. e_i is 0 (index the segment's subset), 1 (also its one-deletion neighbourhood) or -1 (skip the
   segment). Allocation is by cost: where a segment's subset is so common that its candidate pairs cost more than the
   extra rows of a one-deletion neighbourhood elsewhere, it is skipped and the cheapest segment of the band gets 1.
4. Empty subsets say nothing and aren't indexed. A set with so many thin segments that the sum may fail is odd; if a
   linked pair fails to meet in a segment, both of its sets are odd, so odd sets are also indexed by their prefixes.
5. Sets under one index key are candidates. A key's hub is the set there with most company. First each set meets a
   single hub, the one of all its keys' with most company; found links are contracted. Under keys that still hold several
   components each set then meets the hub, if it is in another component. Sets of keys that are open even then go on to
   their other partners there: a key may be a passage that thousands of texts share which have little else in common, so
   of those pairs only the ones are tested that also share one of their rarest elements (see rare_pairs). Every candidate
   pair is verified exactly; pairs within a component tell nothing new and aren't tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.llm.chunked import CHUNK_BYTES, Chunk, answers, meet, pack, pack_ids, pack_sorted, pack_texts, scan_chunks, sizes_for, unpack, unpack_ids, unpack_sorted, unpack_texts
from meshloom.llm.common import durable, forget, fresh_path, join_on_hot, short_plans, stored
from meshloom.llm.components import components
from meshloom.llm.hashing import mix64, word_hashes

WORDS = 5
#: Similarity as a ratio of whole numbers.
NUM, DEN = 75, 100
#: Bits of a shingle that are enough to ask who else has it; more sharing than there is only costs time.
ASK_BITS = 48
#: Segments of a band per element of its largest set, and besides: enough for the pigeonhole despite empty segments.
SEGMENTS, MORE_SEGMENTS = 0.33, 4
#: What an index row costs, in candidate pairs.
ROW_COST = 0.5
#: Cells of the table of rough frequencies: 2 MB, whatever the input's size.
RARITY_CELLS = 1 << 18

_M = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of a text's word hashes; a text of fewer words is one shingle, an empty one none."""
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(n, len(words))
    rows = len(words) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(rows, np.uint64(width))
        for j in range(width):
            total = total * _M + words[j : j + rows]
    total = np.sort(mix64(total))
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def text_sets(texts: list) -> list[np.ndarray]:
    """Sets of texts (str or UTF-8 bytes); only A-Z are lower-cased."""
    return [shingle_set(word_hashes(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass"))) for t in texts]


def _asked(sets: list[np.ndarray]) -> np.ndarray:
    """Keys under which a chunk asks for the elements of its distinct sets, one set after the other."""
    return np.concatenate([s >> np.uint64(64 - ASK_BITS) for s in sets] or [np.empty(0, np.uint64)])


def _once(sets: list[np.ndarray]) -> dict[bytes, np.ndarray]:
    """The distinct sets of a chunk by digest; not the empty one."""
    return {xxhash.xxh3_128_digest(s.tobytes()): s for s in sets if len(s)}


def _distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Asked keys of a chunk, sorted, and in how many of its distinct sets each is (2 for more)."""
    keys = np.sort(_asked(sets))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    return keys[first], np.minimum(counts, 2).astype(np.uint8)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys pass from bucket to bucket: bucket b has keys[cuts[b]:cuts[b + 1]]."""
    edges = np.array([-(-(b << ASK_BITS) // buckets) for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def shared_shingles(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, digest (of the set; null if empty), elements.

    elements holds the shingles that other texts have too, as 64-bit integers, of the first document of a chunk with
    that set; it is null if they are less than 75 % of the set, so that the document can link with nothing.
    """
    sizes = sizes_for(docs, chunk_bytes)
    chunk_bytes, buckets = sizes.chunk_bytes, sizes.buckets

    def keep(chunk: Chunk) -> Iterator[tuple]:
        yield chunk.key, pack_ids(chunk.ids), pack_texts(chunk.raw)

    def ask(chunk: Chunk) -> Iterator[tuple]:
        keys, counts = _distinct(list(_once(text_sets(chunk.raw)).values()))
        cuts = _cuts(keys, buckets)
        for b in range(buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if lo < hi:
                yield b, chunk.key, pack_sorted(keys[lo:hi]), pack(counts[lo:hi])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_sorted(blob) for blob in rows["keys"]]
        counts = np.concatenate([unpack(blob) for blob in rows["counts"]])
        every = np.concatenate(asked)
        order = np.argsort(every, kind="stable")
        first = np.concatenate([[True], every[order][1:] != every[order][:-1]])
        group = np.cumsum(first) - 1
        shared = np.empty(len(every), np.uint8)
        shared[order] = (np.add.reduceat(counts[order].astype(np.int64), np.flatnonzero(first)) > 1)[group]
        ends = np.cumsum([len(a) for a in asked])
        blobs = [pack(np.packbits(part)) for part in np.split(shared, ends[:-1])]
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "shared": blobs})

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sets = text_sets(unpack_texts(left["texts"].iloc[0]))
        once = _once(sets)
        asked = _asked(list(once.values()))
        order = np.argsort(asked)
        keys = asked[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        cuts = _cuts(keys[first], buckets)
        shared = np.zeros(len(first), bool)
        for b, blob in zip(right["bucket"], right["shared"]):
            lo, hi = cuts[b], cuts[b + 1]
            shared[lo:hi] = np.unpackbits(unpack(blob), count=hi - lo)
        told = np.empty(len(asked), bool)
        told[order] = np.repeat(shared, np.diff(np.append(first, len(keys))))
        held: dict[bytes, bytes] = {}
        at = 0
        for digest, s in once.items():
            some = s[told[at : at + len(s)]]
            at += len(s)
            if DEN * len(some) >= NUM * len(s):
                held[digest] = some.tobytes()
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        # one document of the chunk carries a set's elements for all that have it
        elements = [held.pop(d, None) if d is not None else None for d in digests]
        return pd.DataFrame({"doc_id": unpack_ids(left["ids"].iloc[0]), "n_shingles": [len(s) for s in sets], "digest": digests, "elements": elements})

    kept = scan_chunks(docs, keep, "chunk string, ids binary, texts binary", chunk_bytes)
    asked = scan_chunks(docs, ask, "bucket int, chunk string, keys binary, counts binary", chunk_bytes)
    answered = answers(asked, answer, "chunk string, bucket int, shared binary")
    out = meet(kept, answered, choose, "doc_id string, n_shingles long, digest binary, elements binary")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def bands(largest: int) -> list[tuple[int, int]]:
    """(lowest, highest) size of each band up to the largest size; linked sizes lie in one band or in neighbours."""
    out, low = [], 1
    while low <= largest:
        high = low * DEN // NUM
        out.append((low, high))
        low = high + 1
    return out


def band_of(n: int, table: list[tuple[int, int]]) -> int:
    low, high = 0, len(table) - 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if n <= table[mid][1] else (mid + 1, high)
    return low


def segments(high: int) -> int:
    return int(SEGMENTS * high) + MORE_SEGMENTS


def most_difference(n: int, in_band: bool, high: int) -> int:
    """The most elements in which a set of size n and a linked partner differ, when the larger one lies in the band."""
    partner = min(high, n * DEN // NUM) if in_band else n * DEN // NUM
    return (n + partner) * (DEN - NUM) // (DEN + NUM)


def index_keys(elements: np.ndarray, n: int, table: list[tuple[int, int]], plan: dict[int, tuple], stats: bool = False) -> Iterator[tuple]:
    """Index rows of one set: arrays (band, segment, key, full) per band; full is False for one-deletion neighbours.

    With stats, only whole subsets of every segment. plan holds, per band, the segments whose e_i isn't 0. Odd sets also give prefix keys,
    under band -1.
    """
    own = band_of(n, table)
    odd = False
    for band in (own, own + 1):
        if band >= len(table):
            continue  # no set is that large
        high = table[band][1]
        m = segments(high)
        segment = (mix64(elements ^ np.uint64(band + 1)) % np.uint64(m)).astype(np.int64)
        value = mix64(elements + _M)
        order = np.argsort(segment, kind="stable")
        segment, value = segment[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else np.empty(0, np.int64)
        here = segment[starts]
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(value, starts) if len(starts) else np.empty(0, np.uint64)
            salt = mix64((np.uint64(band + 1) << np.uint64(40)) + here.astype(np.uint64) + np.uint64(1))
            keys = mix64(sums + salt)
        if stats:
            yield band, here, keys, np.ones(len(keys), bool)
            continue
        e = np.zeros(m, np.int64)
        changed = plan.get(band)
        if changed is not None:
            e[changed[0]] = changed[1]
        sizes = np.diff(np.append(starts, len(segment)))
        held = np.zeros(m, np.int64)
        held[here] = sizes
        thin = (held == 0) | ((e == 1) & (held <= 1))
        reach = int((e + 1)[~thin].sum())
        odd |= reach <= most_difference(n, band == own, high) - (n - len(elements))
        used = e[here] >= 0
        yield band, here[used], keys[used], np.ones(int(used.sum()), bool)
        deep = np.flatnonzero((e[here] == 1) & (sizes > 1))
        if len(deep):
            at = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in deep])
            of = np.repeat(deep, sizes[deep])
            with np.errstate(over="ignore"):
                yield band, here[of], mix64(sums[of] - value[at] + salt[of]), np.zeros(len(at), bool)
    if odd and not stats:
        length = len(elements) - -(-NUM * n // DEN) + 1
        prefix = elements[: max(length, 0)]  # elements are sorted by hash, the same order for all sets
        yield -1, np.zeros(len(prefix), np.int64), mix64(prefix), np.ones(len(prefix), bool)


def index_rows(classes: DataFrame, table: list[tuple[int, int]], plan: dict | None) -> DataFrame:
    """classes(node, n, elements) -> (band, segment,) key, node, full; with plan None, rows for the statistics."""
    stats = plan is None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, rows = [], 0
            for node, n, blob in zip(batch["node"].tolist(), batch["n"].tolist(), batch["elements"].tolist()):
                for band, segment, key, full in index_keys(np.frombuffer(blob, np.uint64), n, table, plan or {}, stats):
                    out.append((np.full(len(key), band), segment, key.view(np.int64), np.full(len(key), node), full))
                    rows += len(key)
                if rows > 200_000:
                    yield frame(out)
                    out, rows = [], 0
            if out:
                yield frame(out)

    def frame(parts: list[tuple]) -> pd.DataFrame:
        band, segment, key, node, full = (np.concatenate(c) for c in zip(*parts))
        return pd.DataFrame({"band": band, "segment": segment, "key": key, "node": node, "full": full})

    return classes.select("node", "n", "elements").mapInPandas(run, "band int, segment int, key long, node long, full boolean")


def allocate(classes: DataFrame, table: list[tuple[int, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Which segments of which band are skipped (-1) or get one-deletion neighbourhoods (1), by cost.

    Statistics cover all sets. Cost of a segment: pairs under equal subsets. The costliest segment of a band is paired
    with its cheapest one, the next with the next, and so on; a pair is swapped if the saving outweighs the cheap one's
    neighbourhoods, whose pairs and rows are estimated from its mean subset. The plan's size depends on the longest
    text, not on how many there are.
    """
    rows = index_rows(classes, table, None)
    under = rows.groupBy("band", "segment", "key").agg(F.count(F.lit(1)).alias("c"))
    per = under.groupBy("band", "segment").agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs"), F.sum("c").alias("sets"))
    costly = Window.partitionBy("band").orderBy(F.desc("pairs"), "segment")
    cheap = Window.partitionBy("band").orderBy("pairs", "segment")
    ranked = durable(per.withColumn("d", F.row_number().over(costly)).withColumn("u", F.row_number().over(cheap)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("band"))))
    hot = ranked.where(F.col("d") * 2 <= F.col("of")).select("band", F.col("d").alias("r"), F.col("segment").alias("skip"), F.col("pairs").alias("saved"))
    cold = ranked.where(F.col("u") * 2 <= F.col("of")).select("band", F.col("u").alias("r"), F.col("segment").alias("deep"), F.col("pairs").alias("p"), "sets")
    mean = 1 / SEGMENTS
    swaps = hot.join(cold, ["band", "r"]).where(F.col("saved") > F.col("p") * (1 + mean) + F.col("sets") * F.lit(mean * ROW_COST))
    told = swaps.select("band", "skip", "deep").toArrow()
    band, skip, deep = (told[c].to_numpy() for c in told.column_names)
    return {int(b): (np.concatenate([skip[band == b], deep[band == b]]), np.repeat([-1, 1], int((band == b).sum()))) for b in np.unique(band)}


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of pairs(a, b), whose sizes allow a link, whose classes link: 100 |A and B| >= 75 |A or B|, counted exactly."""
    left = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea"))
    right = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for na, ea, nb, eb in zip(batch["na"], batch["ea"], batch["nb"], batch["eb"]):
                both = len(np.intersect1d(np.frombuffer(ea, np.uint64), np.frombuffer(eb, np.uint64), assume_unique=True))
                keep.append(DEN * both >= NUM * (na + nb - both))
            yield batch.loc[keep, ["a", "b"]]

    return pairs.join(right, "b").join(left, "a").mapInPandas(run, "a long, b long")


def link_classes(classes: DataFrame) -> DataFrame:
    """classes(node, n, elements) -> (node, label): components of the links between classes."""
    largest = classes.agg(F.max("n")).first()[0] or 0
    table = bands(largest)
    spark = classes.sparkSession
    every = fresh_path(spark, "index")
    plan = allocate(classes, table)
    forget(spark)
    rows = stored(index_rows(classes, table, plan).select("key", "node", "full"), every)
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("full").alias("some")).where("c > 1 and some")
    met, ranked, again, unsettled = (fresh_path(spark, name) for name in ("met", "ranked", "again", "unsettled"))
    rows = stored(rows.join(groups.select("key", "c"), "key"), met)
    forget(spark, every)
    company = rows.groupBy("node").agg(F.sum("c").alias("company")).join(classes.select("node", "n"), "node")
    rows = stored(rows.join(company, "node").select("key", "node", "full", "company", "n"), ranked)
    forget(spark, met)
    labels = durable(classes.select("node", F.col("node").alias("label")))
    # each set first meets one hub: the one with most company of all its keys' hubs
    best = hub_pairs(rows.withColumn("label", F.col("node"))).groupBy("node").agg(F.max(F.struct("company", "hub")).alias("h"))
    first = durable(unordered(best.select("node", F.col("h.hub").alias("hub"))))
    labels = components(durable(verified(first, classes)), labels)
    forget(spark)
    # keys that still hold several components: their sets may link elsewhere, with the hubs of these keys above all
    rows = stored(open_rows(rows, labels), again)
    forget(spark, ranked)
    second = durable(unordered(hub_pairs(rows)).join(first, ["a", "b"], "left_anti"))
    labels = components(durable(verified(second, classes)), labels)
    forget(spark)
    left = stored(classes.join(open_rows(rows.drop("label"), labels).select("node").distinct(), "node", "left_semi"), unsettled)
    forget(spark, again)
    more = durable(rare_pairs(left, labels).join(first.union(second), ["a", "b"], "left_anti"))
    forget(spark)
    links = durable(verified(more, left))
    forget(spark, unsettled)
    return components(links, labels)


def hub_pairs(rows: DataFrame) -> DataFrame:
    """(node, hub, company) for rows(key, node, full, company, n, label) whose label and key's hub's label differ.

    Hubs are sets with the most company of those whose row is full; sizes of a pair allow a link.
    """
    hub = rows.where("full").groupBy("key").agg(F.max(F.struct("company", "node", "n", "label")).alias("h"))
    met = rows.select("key", "node", "n", "label").join(hub, "key")
    fit = (F.col("n") * DEN >= F.col("h.n") * NUM) & (F.col("h.n") * DEN >= F.col("n") * NUM)
    return met.where((F.col("label") != F.col("h.label")) & fit).select("node", F.col("h.node").alias("hub"), F.col("h.company").alias("company"))


def unordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def open_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their labels, of the keys under which several labels meet."""
    named = rows.join(labels, "node")
    open_ = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return named.join(open_, "key")


def rarity(classes: DataFrame) -> np.ndarray:
    """How many elements of all sets fall in each of RARITY_CELLS cells of a hash: a rough frequency, of bounded size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(RARITY_CELLS, np.int64)
        for batch in batches:
            for blob in batch["elements"]:
                np.add.at(sums, _cell(np.frombuffer(blob, np.uint64)), 1)
        seen = np.flatnonzero(sums)
        yield pd.DataFrame({"cell": seen, "c": sums[seen]})

    sums = classes.select("elements").mapInPandas(run, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(RARITY_CELLS, np.int64)
    out[sums["cell"].to_numpy()] = sums["c"].to_numpy()
    return out


def _cell(elements: np.ndarray) -> np.ndarray:
    return (mix64(elements) % np.uint64(RARITY_CELLS)).astype(np.int64)


def rare_pairs(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes(node, n, elements) that may link and have different labels.

    Put the elements of every set in one order, the rare ones first. Linked sets share at least 75 % of either, so the
    first element that they share is among the first n - ceil(0.75 n) + 1 of both; elements that one text alone has come
    before all and are not indexed. Two sets are paired at that first shared element only if what either has from there on
    (`onward`) is enough for a link, and if their sizes are: sets with little in common but a passage meet at the passage,
    with too little onward.
    """
    frequency = rarity(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, nodes, sizes, onward = [], [], [], []
            for node, n, blob in zip(batch["node"].tolist(), batch["n"].tolist(), batch["elements"].tolist()):
                elements = np.frombuffer(blob, np.uint64)
                first = len(elements) - -(-NUM * n // DEN) + 1
                if first > 0:
                    keys.append(elements[np.lexsort((elements, frequency[_cell(elements)]))[:first]].view(np.int64))
                    nodes.append(np.full(first, node))
                    sizes.append(np.full(first, n))
                    onward.append(len(elements) - np.arange(first))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "node": np.concatenate(nodes), "n": np.concatenate(sizes), "onward": np.concatenate(onward)})

    spark = classes.sparkSession
    rows = durable(classes.mapInPandas(run, "key long, node long, n long, onward long").join(labels, "node"))
    open_ = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    left = durable(rows.join(open_, "key"))
    forget(spark)
    other = left.select("key", *[F.col(c).alias(f"o_{c}") for c in ("node", "n", "onward", "label")])
    close = F.least("onward", "o_onward") * (NUM + DEN) >= (F.col("n") + F.col("o_n")) * NUM
    fit = (F.col("n") * DEN >= F.col("o_n") * NUM) & (F.col("o_n") * DEN >= F.col("n") * NUM)
    met = left.join(other, (left["key"] == other["key"]) & (F.col("node") < F.col("o_node")) & (F.col("label") != F.col("o_label")) & close & fit)
    return met.select(F.col("node").alias("a"), F.col("o_node").alias("b")).distinct()


def near_duplicate_components(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document of docs(doc_id, text): n_shingles and component_id, the least doc_id reachable by links.

    Ids are of any type that has an order and a form as text. Null and empty texts, and those of white space, have no
    shingles and link with nothing. Equal texts link, however short. Texts of any length are compared whole. Rows with a
    null id take part; a component of such rows only has a null id. A repeated row is a copy of itself. An empty table
    gives an empty result. Other columns are not read.
    """
    with short_plans(docs.sparkSession):
        return _components(docs.select("doc_id", "text"), chunk_bytes)


def _components(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    spark = docs.sparkSession
    forget(spark)  # what earlier steps of the session left in the driver
    wide, classes = fresh_path(spark, "shingles"), fresh_path(spark, "classes")
    found = stored(shared_shingles(docs, chunk_bytes), wide)
    forget(spark)
    same = found.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.max("elements").alias("elements"), F.count(F.lit(1)).alias("copies"))
    same = stored(same.withColumn("node", F.monotonically_increasing_id()), classes)
    found = durable(found.select("doc_id", "n_shingles", "digest"))
    forget(spark, wide)
    labels = link_classes(same.where(F.col("elements").isNotNull()).select("node", "n", "elements"))
    named = durable(same.select("digest", "node", "least", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", F.col("node"))))
    forget(spark, classes)
    smallest = durable(named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets")))
    final = join_on_hot(named.select("digest", "label", "copies"), smallest, "label", "sets", named.count(), "inner").select("digest", "component_id", "copies")
    alone = found.where(F.col("digest").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = found.where(F.col("digest").isNotNull()).select("doc_id", "n_shingles", "digest")
    out = join_on_hot(rest, durable(final), "digest", "copies", rest.count(), "inner")
    return out.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates over all `documents`."""
    return near_duplicate_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
