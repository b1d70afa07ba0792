"""Scores of documents under a trigram model with deleted interpolation.

The probability of a token is a mixture of maximum-likelihood estimates by two, one and no words of context and a uniform
share for what is unknown. How much each is trusted depends on how often the context was seen: contexts are tied into
buckets by frequency, and each bucket has mixture weights of its own, learned by expectation-maximisation. For that a
fold of the training documents is held out: the estimates come from the other folds' counts, and the held-out tokens say
which mixture predicts them best. The final model uses the counts of all training documents.

Counting and looking up go through packed chunks (see chunked.py): each chunk sends its distinct n-grams with counts,
buckets of the n-gram space add them up over all chunks and answer with the totals. No model is collected or broadcast.
What is collected is the held-out tokens' histogram over cells of bucket and estimates, whose size has a fixed bound.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.chunked import Chunk, answers, meet, pack, pack_ids, pack_sorted, pack_texts, scan_chunks, sizes_for, unpack, unpack_ids, unpack_sorted, unpack_texts
from meshloom.llm.common import durable
from meshloom.llm.hashing import mix64, word_hashes

CHUNK_BYTES = 16 << 20
#: Key bits by order: single words decide exact columns, longer n-grams only the model's estimates.
BITS = (64, 48, 48)
#: Documents are dealt by crc32(id) mod FOLDS: TEST is never learned from, DELETED only learns the weights.
FOLDS, TEST, DELETED = 5, 1, 0
#: Context buckets: 0 is an unseen context, then powers of two of the pair's count, then of the last word's.
LEVELS = 16
BUCKETS = 1 + 2 * LEVELS
#: Estimates are binned by powers of two down to this one; with 0 there are STEPS + 2 values.
STEPS = 24
EM_ROUNDS = 60
#: Tokens that a task works on at once; of a whole chunk it keeps narrow arrays only.
BLOCK_TOKENS = 1 << 18
BOS, EOS = np.uint64(0x5DEECE66D), np.uint64(0xB5026F5AA9661)
_A = np.uint64(0x9E3779B97F4A7C15)


def fold_of(doc_id: str | None) -> int:
    """crc32 of the id as text, mod FOLDS; a null id counts as training text that weights are not learned from."""
    return 2 if doc_id is None else zlib.crc32(doc_id.encode()) % FOLDS


class Tokens:
    """The tokens of a chunk's texts: keys of each order, aligned, and where the documents begin and end."""

    def __init__(self, texts: list) -> None:
        parts, sizes = [], []
        for t in texts:
            words = word_hashes(t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass"))
            parts += [np.array([BOS, BOS]), words, np.array([EOS])]
            sizes.append(len(words) + 1)
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        del parts
        self.sizes = np.array(sizes, np.int64)
        ends = np.cumsum(self.sizes)
        n = int(ends[-1]) if sizes else 0
        starts = ends - self.sizes
        self.place = np.arange(n, dtype=np.int32) - np.repeat(starts.astype(np.int32), self.sizes)
        begins = starts + 2 * np.arange(len(sizes))
        real = np.ones(len(flat), bool)  # what is no mark of a beginning
        real[begins] = real[begins + 1] = False
        self.keys = [np.empty(n, np.uint64) for _ in BITS]
        done = 0
        for lo, hi in blocks(len(flat)):
            at = lo + np.flatnonzero(real[lo:hi])
            w, v, u = flat[at], flat[at - 1], flat[at - 2]
            with np.errstate(over="ignore"):
                one = mix64(w)
                two = mix64(v * _A + one)
                three = mix64((u * _A + v) * _A + two)
            for out, k, bits in zip(self.keys, (one, two, three), BITS):
                out[done : done + len(at)] = k >> np.uint64(64 - bits)
            done += len(at)

    def taken(self, order: int) -> np.ndarray:
        """The keys of an order, which are given up: a task doesn't hold all three longer than it must."""
        keys, self.keys[order - 1] = self.keys[order - 1], None
        return keys


def blocks(n: int) -> Iterator[tuple[int, int]]:
    return ((lo, min(lo + BLOCK_TOKENS, n)) for lo in range(0, n, BLOCK_TOKENS))


def ranks(keys: np.ndarray) -> np.ndarray:
    """Each key's place among the sorted distinct keys, as np.unique's inverse, in a third of its memory."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    del ordered
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return out


def counted(keys: np.ndarray, bits: int, train: np.ndarray, deleted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, how often each is in training text, and in the fold that weights are learned from)."""
    if bits > 62:
        distinct, at = np.unique(keys, return_inverse=True)
        return distinct, np.bincount(at[train], minlength=len(distinct)).astype(np.uint32), np.bincount(at[deleted], minlength=len(distinct)).astype(np.uint32)
    # two flags ride on the key's free bits, so plain sorting does it, without a permutation
    flagged = np.sort((keys << np.uint64(2)) | (train.astype(np.uint64) << np.uint64(1)) | deleted.astype(np.uint64))
    sorted_keys = flagged >> np.uint64(2)
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    if not len(first):
        return sorted_keys, np.empty(0, np.uint32), np.empty(0, np.uint32)
    t = np.add.reduceat((flagged >> np.uint64(1)).astype(np.uint32) & np.uint32(1), first)
    return sorted_keys[first], t.astype(np.uint32), np.add.reduceat(flagged.astype(np.uint32) & np.uint32(1), first).astype(np.uint32)


def cuts_of(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    edges = np.array([-(-(b << bits) // buckets) for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def estimates(counts: list[np.ndarray], place: np.ndarray, docs: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(context bucket, estimates by 0, 1 and 2 words of context) of each token, from the counts of its n-grams."""
    one, two, three = (c.astype(np.float64) for c in counts)
    last = np.where(place == 0, docs, np.concatenate([[0.0], one[:-1]]))
    pair = np.where(place == 0, docs, np.concatenate([[0.0], two[:-1]]))
    f1 = one / max(total, 1)
    f2 = np.divide(two, last, out=np.zeros_like(two), where=last > 0)
    f3 = np.divide(three, pair, out=np.zeros_like(three), where=pair > 0)
    with np.errstate(divide="ignore"):
        by_pair = 1 + np.minimum(np.log2(pair, out=np.zeros_like(pair), where=pair > 0), LEVELS - 1).astype(np.int64)
        by_last = 1 + LEVELS + np.minimum(np.log2(last, out=np.zeros_like(last), where=last > 0), LEVELS - 1).astype(np.int64)
    bucket = np.where(pair > 0, by_pair, np.where(last > 0, by_last, 0))
    return bucket, np.stack([f1, np.minimum(f2, 1.0), np.minimum(f3, 1.0)])


def estimates_of(counts: list[np.ndarray], place: np.ndarray, docs: int, total: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """estimates, block by block of tokens: (from, to, context buckets, estimates). A block needs the token before it."""
    for lo, hi in blocks(len(place)):
        before = max(lo - 1, 0)
        bucket, f = estimates([c[before:hi] for c in counts], place[before:hi], docs, total)
        yield lo, hi, bucket[lo - before :], f[:, lo - before :]


def learn_weights(cells: pd.DataFrame, uniform: float) -> np.ndarray:
    """EM over cells(bucket, n, s1, s2, s3: sums of the estimates): weights per bucket for uniform, f1, f2 and f3.

    Every bucket has some virtual tokens spread as all tokens are, so one with few or no held-out tokens has weights too.
    """
    n = cells["n"].to_numpy(np.float64)
    f = np.stack([np.full(len(n), uniform)] + [cells[c].to_numpy(np.float64) / np.maximum(n, 1) for c in ("s1", "s2", "s3")], 1)
    bucket = cells["bucket"].to_numpy(np.int64)

    def em(weights: np.ndarray, group: np.ndarray, prior: np.ndarray) -> np.ndarray:
        for _ in range(EM_ROUNDS):
            share = weights[group] * f
            share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
            fresh = np.zeros_like(weights) + prior
            np.add.at(fresh, group, share)
            weights = fresh / fresh.sum(1, keepdims=True)
        return weights

    start = np.full((1, 4), 0.25)
    overall = em(start, np.zeros(len(n), np.int64), np.full((1, 4), 0.01)) if len(n) else start
    return em(np.repeat(overall, BUCKETS, 0), bucket, 10 * overall) if len(n) else np.repeat(start, BUCKETS, 0)


def score_documents(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document of docs(doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words, with A-Z in lower case, and one end; a null or empty text has the end only. Documents with
    crc32(id) mod 5 = 1 are held out; a null id is trained on. Repeated rows count as often as they are there. With no
    training text at all every token is unknown: scores come from the uniform share. Texts of any length are scored whole;
    one that is longer than a chunk is a chunk by itself. Documents with equal texts on the same side of the split get
    equal scores. Other columns are not read. Pairs and triples of words are told apart by 48 bits: two that fall on one
    key share their counts.
    """
    docs = docs.select("doc_id", "text")
    sizes = sizes_for(docs, chunk_bytes)
    chunk_bytes, buckets = sizes.chunk_bytes, sizes.buckets

    def keep(chunk: Chunk) -> Iterator[tuple]:
        yield chunk.key, pack_ids(chunk.ids), pack_texts(chunk.raw)

    def ask(chunk: Chunk) -> Iterator[tuple]:
        tokens = Tokens(chunk.raw)
        fold = np.array([fold_of(i) for i in chunk.ids], np.int64)
        train, deleted = np.repeat(fold != TEST, tokens.sizes), np.repeat(fold == DELETED, tokens.sizes)
        sent: list[list] = [[b, chunk.key] for b in range(buckets)]
        for order, bits in enumerate(BITS, 1):
            distinct, n_train, n_deleted = counted(tokens.taken(order), bits, train, deleted)
            cuts = cuts_of(distinct, bits, buckets)
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                sent[b] += [pack_sorted(distinct[lo:hi]), pack(n_train[lo:hi]), pack(n_deleted[lo:hi])]
        yield from map(tuple, sent)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        """Totals t of all keys that a chunk asked for, and o, without the fold that weights are learned from, of that fold's keys."""
        out = {"chunk": [*rows["chunk"], None], "bucket": [*rows["bucket"], rows["bucket"].iloc[0]]}
        for order in (1, 2, 3):
            asked = [unpack_sorted(blob) for blob in rows[f"k{order}"]]
            every = np.concatenate(asked)
            distinct, at = np.unique(every, return_inverse=True)
            ends = np.cumsum([len(a) for a in asked])[:-1]
            theirs = {what: [unpack(blob) for blob in rows[f"{what}{order}"]] for what in "th"}
            totals = {what: np.bincount(at, weights=np.concatenate(found), minlength=len(distinct)).astype(np.int64) for what, found in theirs.items()}
            parts = np.split(totals["t"][at], ends)
            others = [part[own > 0] for part, own in zip(np.split((totals["t"] - totals["h"])[at], ends), theirs["h"])]
            for what, found in (("t", parts), ("o", others)):
                out[f"{what}{order}"] = [pack(part.astype(np.uint32) if part.max(initial=0) < 1 << 32 else part) for part in found] + [None]
            if order == 1:
                for what, sums in totals.items():
                    end = distinct == (mix64(np.array([EOS]))[0] >> np.uint64(64 - BITS[0]))
                    seen = (int((sums > 0).sum()), int(sums.sum()), int(sums[end].sum()))
                    out[f"types_{what}"], out[f"total_{what}"], out[f"docs_{what}"] = ([None] * len(rows) + [x] for x in seen)
        return pd.DataFrame(out)

    def lookup(tokens: Tokens, right: pd.DataFrame, what: str) -> list[np.ndarray]:
        """The totals by order of the tokens, whose keys are given up; right has those of their distinct keys."""
        found = []
        for order in (1, 2, 3):
            at = ranks(tokens.taken(order))
            parts = {b: unpack(blob) for b, blob in zip(right["bucket"], right[f"{what}{order}"])}
            found.append(np.concatenate([parts[b] for b in sorted(parts)])[at] if len(at) else np.empty(0, np.int64))
        return found

    def only_fold(chunk: Chunk) -> Iterator[tuple]:
        yield chunk.key, pack_texts([t for i, t in zip(chunk.ids, chunk.raw) if fold_of(i) == DELETED])

    ask_ddl = "bucket int, chunk string, " + ", ".join(f"k{o} binary, t{o} binary, h{o} binary" for o in (1, 2, 3))
    answer_ddl = "chunk string, bucket int, " + ", ".join(f"t{o} binary, o{o} binary" for o in (1, 2, 3)) + ", types_t long, total_t long, docs_t long, types_h long, total_h long, docs_h long"
    answered = durable(answers(scan_chunks(docs, ask, ask_ddl, chunk_bytes), answer, answer_ddl))
    known = answered.where(F.col("chunk").isNull()).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types_t", "total_t", "docs_t", "total_h", "docs_h")]).first()
    types, total, n_docs = known["types_t"], known["total_t"], known["docs_t"]
    kept_total, kept_docs = total - known["total_h"], n_docs - known["docs_h"]
    uniform = 1.0 / (types + 1)
    answered = answered.where(F.col("chunk").isNotNull())
    # the histogram needs a fifth of the counts and the texts, the scores the rest: each meets what it needs
    asked_of = {what: answered.select("chunk", "bucket", *[f"{what}{o}" for o in (1, 2, 3)]) for what in "to"}

    def cells(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(unpack_texts(left["texts"].iloc[0]))
        bucket, f = estimates(lookup(tokens, right, "o"), tokens.place, kept_docs, kept_total)
        step = np.where(f > 0, np.minimum(-np.log2(f, out=np.zeros_like(f), where=f > 0), STEPS).astype(np.int64), STEPS + 1)
        code = bucket
        for s in step:
            code = code * (STEPS + 2) + s
        distinct, at = np.unique(code, return_inverse=True)
        sums = [np.bincount(at, weights=w, minlength=len(distinct)) for w in (np.ones(len(code)), *f)]
        return pd.DataFrame({"code": distinct, "bucket": distinct // (STEPS + 2) ** 3, "n": sums[0], "s1": sums[1], "s2": sums[2], "s3": sums[3]})

    histogram = meet(scan_chunks(docs, only_fold, "chunk string, texts binary", chunk_bytes), asked_of["o"], cells, "code long, bucket long, n double, s1 double, s2 double, s3 double")
    sums = histogram.groupBy("code", "bucket").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2", "s3")])
    weights = learn_weights(pd.DataFrame([r.asDict() for r in sums.orderBy("code").toLocalIterator()], columns=["code", "bucket", "n", "s1", "s2", "s3"]), uniform)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tokens = Tokens(unpack_texts(left["texts"].iloc[0]))
        counts = lookup(tokens, right, "t")
        log_p, base = np.empty(len(tokens.place)), np.empty(len(tokens.place))
        for lo, hi, bucket, f in estimates_of(counts, tokens.place, n_docs, total):
            w = weights[bucket]
            log_p[lo:hi] = np.log10(w[:, 0] * uniform + w[:, 1] * f[0] + w[:, 2] * f[1] + w[:, 3] * f[2])
            base[lo:hi] = np.log10((counts[0][lo:hi] + 0.5) / (total + 0.5 * (types + 1)))
        starts = np.cumsum(tokens.sizes) - tokens.sizes
        ids = unpack_ids(left["ids"].iloc[0])
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x
        return pd.DataFrame(
            {
                "doc_id": ids,
                "held_out": [fold_of(i) == TEST for i in ids],
                "n_tokens": tokens.sizes,
                "n_known": add((counts[0] > 0).astype(np.int64)),
                "train_tokens": total,
                "base_score": add(base),
                "score": add(log_p),
            }
        )

    ddl = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = meet(scan_chunks(docs, keep, "chunk string, ids binary, texts binary", chunk_bytes), asked_of["t"], score, ddl)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents`."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
