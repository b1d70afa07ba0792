"""Alignment of two tokenizers over the same bytes, and how often their ids meet.

Tokens of the two are the nodes of a bipartite graph; two are linked if their byte ranges overlap. A union-find over the
links gives components, which are exactly the groups between places where tokens of both end: the smallest stretches
that both tokenizers cover with whole tokens. Components never cross a space that follows something else than white
space, since both tokenizers begin a token there, so the graph of a text is the sum of those of its units (a text cut
before such spaces), and each distinct unit of a chunk of documents is encoded and aligned once, all of a chunk's units
in one graph.

Pairs of linked ids are counted over the corpus by asking and answering (see chunked): a chunk sends each of its distinct
pairs once with its count to the bucket of the pair's second id, which adds up all chunks' counts and knows the best
pairs of each of its second ids. A pair that every text has is sent once per chunk, and an id has at most as many
partners as the other vocabulary has ids, so no bucket grows with how often a pair occurs.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.chunked import CHUNK_BYTES, Chunk, answers, meet, pack, pack_ids, pack_sorted, pack_texts, scan_chunks, sizes_for, unpack, unpack_ids, unpack_sorted, unpack_texts
from meshloom.llm.common import fresh_path, stored
from meshloom.llm.tokens import default_path, piece_bytes, plain_encoder, spaced_piece_ids, token_bytes

DDL = "doc_id string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Units that are encoded and written down at once.
BLOCK = 20_000
#: Where a text is cut: before a space that follows something else than white space.
CUT = re.compile(r"(?<=\S)(?= )")
#: Ids of the second tokenizer are below this: a pair is one number, its first id times this plus its second.
IDS = 1 << 31


@cache
def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def components(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of n nodes, by union-find over the links (left, right) as arrays.

    Each round hooks the roots of all links that still hold two of them, the larger below the smaller, and then halves
    paths until every node points to its root. Rounds grow with the logarithm of a component's size.
    """
    parent = np.arange(n)
    while len(left):
        a, b = parent[left], parent[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (number of a token, number of a token of the other) whose ranges overlap, in order of bytes.

    Both cover the same bytes, no token is empty: each place where a token of either ends closes one overlap.
    """
    places = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, places), np.searchsorted(b_ends, places)


class Alignment:
    """Tokens, groups and links of a list of units, as flat arrays in the order of units.

    Of unit u, the first tokens are a[a_at[u]:a_at[u + 1]], and so on; pairs are numbers (see IDS); groups is its text.
    A unit whose tokens don't spell it is not `good` and has nothing.
    """

    def __init__(self, units: list[str], a_path: str, b_path: str) -> None:
        a_of, a_bytes, b_bytes = plain_encoder(a_path), token_bytes(a_path), piece_bytes(b_path)
        self.good: list[bool] = []
        a_ids, b_ids, a_many, b_many = array("q"), array("q"), [0], [0]
        for start in range(0, len(units), BLOCK):
            block = units[start : start + BLOCK]
            for unit, b in zip(block, spaced_piece_ids(block, b_path)):
                raw, a = unit.encode("utf-8", "surrogatepass"), a_of(unit)
                good = b"".join([a_bytes[i] for i in a]) == raw == b"".join([b_bytes[i] for i in b])
                self.good.append(good)
                a_many.append(len(a) if good else 0)
                b_many.append(len(b) if good else 0)
                if good:
                    a_ids.extend(a)
                    b_ids.extend(b)
        self.a_at, self.b_at = np.cumsum(a_many), np.cumsum(b_many)
        a, b = np.frombuffer(a_ids, np.int64), np.frombuffer(b_ids, np.int64)
        lengths_a, lengths_b = (np.array([len(x) for x in table], np.int64) for table in (a_bytes, b_bytes))
        of_a, of_b = overlaps(np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b]))
        self.link_at = np.searchsorted(of_a, self.a_at)
        self.pairs = a[of_a] * IDS + b[of_b]
        root = components(of_a, of_b + len(a), len(a) + len(b))
        self.groups, self.n_groups = self._texts(a, b, root)

    def _texts(self, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Per unit its groups as text, and how many there are. A component's least node is its first token of a."""
        head_a, head_b = root[: len(a)], root[len(a) :]
        heads = np.flatnonzero(head_a == np.arange(len(a)))  # of a's tokens, those that begin a group
        at, b_heads, out = np.searchsorted(heads, self.a_at), np.searchsorted(head_b, heads), []
        for start in range(0, len(at) - 1, BLOCK):
            ends = at[start : start + BLOCK + 1]
            # the block's groups, and behind them where the next block's first one begins
            a_from, b_from = (np.append(x, n)[ends[0] : ends[-1] + 1] for x, n in ((heads, len(a)), (b_heads, len(b))))
            a_text, b_text = (list(map(str, ids[f[0] : f[-1]].tolist())) for ids, f in ((a, a_from), (b, b_from)))
            i, j = (a_from - a_from[0]).tolist(), (b_from - b_from[0]).tolist()
            texts = [",".join(a_text[p:q]) + "|" + ",".join(b_text[r:t]) for p, q, r, t in zip(i, i[1:], j, j[1:])]
            cuts = (ends - ends[0]).tolist()
            out += [";".join(texts[p:q]) for p, q in zip(cuts, cuts[1:])]
        return out, np.diff(at)


def units_of(text: str) -> list[str]:
    return CUT.split(f" {text}")


class Corpus:
    """A chunk's documents as bags of distinct units, with those units' alignment."""

    def __init__(self, chunk: Chunk, a_path: str, b_path: str) -> None:
        self.places: dict[str, int] = {}
        put = self.places.setdefault
        # a document as places of its units: the units' strings are kept once only
        cut = [np.fromiter((put(u, len(self.places)) for u in (units_of(t) if t else ())), np.uint32) for t in chunk.texts]
        self.units = Alignment(list(self.places), a_path, b_path)
        good, groups = np.array(self.units.good, bool), self.units.groups
        self.digests, units, times = [], [], []
        for at in cut:
            at = at if good[at].all() else at[:0]
            self.digests.append(hashlib.sha256(";".join([groups[i] for i in at.tolist()]).encode()).hexdigest() if len(at) else "")
            distinct, often = np.unique(at, return_counts=True)
            units.append(distinct)
            times.append(often)
        #: Distinct units of each document; and (document, unit, times) of all of them.
        self.bags = np.array([len(u) for u in units], np.int64)
        self.doc = np.repeat(np.arange(len(units)), self.bags)
        self.unit, self.times = np.concatenate(units).astype(np.int64), np.concatenate(times)

    def sums(self, per_unit: np.ndarray) -> np.ndarray:
        """Per document the sum over its units of a number that each unit has."""
        return _sums(self.doc, per_unit[self.unit] * self.times, len(self.bags))

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunk's distinct pairs, sorted, how often each occurs, and the place of each link's pair among them."""
        often = _sums(self.unit, self.times, len(self.places))
        pairs, place = np.unique(self.units.pairs, return_inverse=True)
        return pairs, _sums(place, np.repeat(often, np.diff(self.units.link_at)), len(pairs)), place


def _sums(key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of integers by key 0..n-1."""
    out = np.zeros(n, np.int64)
    np.add.at(out, key, value)
    return out


def _bucket(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return (pairs % IDS) * 0x9E3779B1 % (1 << 32) * buckets >> 32


def best_pairs(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the highest count of all with their second id; ties all are."""
    _, second = np.unique(pairs % IDS, return_inverse=True)
    top = np.zeros(second.max(initial=-1) + 1, np.int64)
    np.maximum.at(top, second, counts)
    return counts == top[second]


def align_tokens(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document of docs(doc_id, text): the sizes of its alignment under two tokenizers, its links' counts, a digest.

    a_path is a byte-level BPE file of the tokenizers library, b_path a sentencepiece model with byte fallback and no
    normalisation that puts a space before a text; both must exist on the executors. A text is encoded with a space
    before it, special strings as plain text. Null and empty texts, and those that either tokenizer doesn't spell byte for
    byte (such as one that holds U+2581), have no tokens: zeros and an empty digest. n_best counts the links whose pair is
    the most frequent of its b id over the corpus, ties included; count_sum adds the pairs' counts over the links.

    Every input row gives one row and counts once more, a repeated one as well; ids may be null. An empty table gives an
    empty result. Texts of any length are aligned whole, one that is longer than a chunk in a chunk of its own. Other
    columns are not read. A chunk's units are kept in a table below the shared folder, so texts are encoded once.
    """
    a_path, b_path = a_path or default_path(), b_path or default_pieces()
    docs = docs.select("doc_id", "text")
    sizes = sizes_for(docs, chunk_bytes)
    chunk_bytes, buckets = sizes.chunk_bytes, sizes.buckets

    def scan(chunk: Chunk) -> Iterator[tuple]:
        c = Corpus(chunk, a_path, b_path)
        u = c.units
        pairs, counts, place = c.pair_counts()
        where = _bucket(pairs, buckets)
        fixed = [c.sums(x) for x in (np.diff(u.a_at), np.diff(u.b_at), u.n_groups, np.diff(u.link_at))]
        # a row of documents has no bucket; a row for a bucket has pairs and their counts
        yield (None, chunk.key, pack_ids(chunk.ids), *map(pack, fixed), pack_texts(c.digests), pack(c.bags.astype(np.uint32)), pack(c.unit.astype(np.uint32)), pack(c.times.astype(np.uint32)),
               pack(np.diff(u.link_at).astype(np.uint32)), pack(place.astype(np.uint32)), pack(where.astype(np.uint32)), None, None)
        order = np.argsort(where, kind="stable")
        cuts = np.flatnonzero(np.diff(where[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            yield (int(where[part[0]]), chunk.key, *[None] * 12, pack_sorted(pairs[part].astype(np.uint64)), pack(counts[part]))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_sorted(blob).astype(np.int64) for blob in rows["pairs"]]
        pairs, place = np.unique(np.concatenate(asked), return_inverse=True)
        counts = _sums(place, np.concatenate([unpack(blob) for blob in rows["counts"]]), len(pairs))
        # one number for both: twice the count, and one more if it is the best
        told = 2 * counts + best_pairs(pairs, counts)
        parts = np.split(told[place], np.cumsum([len(a) for a in asked])[:-1])
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "told": [pack(p) for p in parts]})

    def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        bags, unit, times, links, place, where = (unpack(row[c]).astype(np.int64) for c in ("bags", "unit", "times", "links", "place", "places"))
        told = np.zeros(len(where), np.int64)
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], np.arange(buckets + 1))
        for b, blob in zip(right["bucket"], right["told"]):
            told[order[ends[b] : ends[b + 1]]] = unpack(blob)
        of = np.repeat(np.arange(len(links)), links)
        doc = np.repeat(np.arange(len(bags)), bags)
        best, count = (_sums(doc, _sums(of, x[place], len(links))[unit] * times, len(bags)) for x in (told & 1, told >> 1))
        fixed = {c: unpack(row[c]) for c in ("n_a", "n_b", "n_groups", "n_links")}
        digests = [d.decode() for d in unpack_texts(row["digests"])]
        return pd.DataFrame({"doc_id": unpack_ids(row["ids"]), **fixed, "n_best": best, "count_sum": count, "groups_sha256": digests})

    blobs = "ids binary, n_a binary, n_b binary, n_groups binary, n_links binary, digests binary, bags binary, unit binary, times binary, links binary, place binary, places binary"
    kept = stored(scan_chunks(docs, scan, f"bucket int, chunk string, {blobs}, pairs binary, counts binary", chunk_bytes), fresh_path(docs.sparkSession, "token-alignment"))
    asked = kept.where("bucket IS NOT NULL").select("bucket", "chunk", "pairs", "counts")
    held = kept.where("bucket IS NULL").drop("bucket", "pairs", "counts")
    out = meet(held, answers(asked, answer, "chunk string, bucket int, told binary"), total, DDL)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of all whole texts of `documents` under the byte-level and the piece tokenizer."""
    return align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
