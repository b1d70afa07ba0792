"""The operators' methods against slower ways to the same result, and columns with unlucky names."""

import itertools
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshloom.llm import chunked, line_dedup, lm_scoring, packing, pii, quality_rules, token_counts, tokens


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_evolution_beats_best_fit_by_falling_length_on_triplets():
    rng = np.random.default_rng(0)
    lengths = []
    for _ in range(40):
        a = int(rng.integers(778, 1003))
        b = int(rng.integers(513, (2048 - a) // 2))
        lengths += [a, b, 2048 - a - b]
    lengths = np.array(lengths)[rng.permutation(120)]
    falling = int(packing.by_best_fit(lengths, 2048).max()) + 1
    alone = packing.settled(lengths, 1, 0, 0, [], 2048, packing.CHILDREN, packing.PATIENCE)  # no island with falling best fit
    assert np.bincount(alone, weights=lengths).max() <= 2048 and (alone >= 0).all()
    assert falling >= 45 and int(alone.max()) + 1 <= 42


def test_shards_migrate_and_stop(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, int(n)) for i, n in enumerate(rng.integers(300, 1100, 900))] + [(900, i, 2048) for i in range(3)]
    pieces = spark.createDataFrame(rows, "row_id long, piece int, length long")
    got = packing.pack_sequences(pieces, shard_pieces=300).collect()
    assert len(got) == len(rows)
    fill = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    plain = int(packing.by_best_fit(np.array([n for _, _, n in rows]), 2048).max()) + 1
    assert max(fill.values()) <= 2048 and len(fill) < plain


def test_scores_are_those_of_plain_counting(docs):
    split = {}
    for r in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        split[r["doc_id"]] = ["<s>", "<s>", *words, "</s>"]
    fold = {d: zlib.crc32(str(d).encode()) % 5 for d in split}

    def grams(folds):
        counts = [Counter(), Counter(), Counter()]
        for d, w in split.items():
            if fold[d] in folds:
                for n in (1, 2, 3):
                    counts[n - 1].update(tuple(w[i - n + 1 : i + 1]) for i in range(2, len(w)))
        return counts, sum(counts[0].values()), sum(f in folds for f in fold.values())

    def model(w, counts, total, n_docs):
        found = [np.array([c[tuple(w[i - n + 1 : i + 1])] for i in range(2, len(w))], float) for n, c in zip((1, 2, 3), counts)]
        return lm_scoring.estimates(found, np.arange(len(w) - 2), n_docs, total)

    train, whole = grams({0, 2, 3, 4}), grams({2, 3, 4})
    uniform = 1.0 / (len(train[0][0]) + 1)
    cells = []
    for d, w in split.items():
        if fold[d] == 0:
            bucket, f = model(w, *whole)
            for b, *e in zip(bucket, *f):
                cells.append((b, tuple(min(int(-math.log2(x)), lm_scoring.STEPS) if x > 0 else lm_scoring.STEPS + 1 for x in e), *e))
    table = pd.DataFrame(cells, columns=["bucket", "step", "s1", "s2", "s3"]).assign(n=1.0)
    weights = lm_scoring.learn_weights(table.groupby(["bucket", "step"], as_index=False).sum(), uniform)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(docs, chunk_bytes=50_000).collect()}
    for d, w in split.items():
        bucket, f = model(w, *train)
        p = weights[bucket] * np.stack([np.full(len(bucket), uniform), *f], 1)
        assert got[d] == pytest.approx(np.log10(p.sum(1)).sum(), rel=1e-6), d


def test_lm_histogram_gets_its_fold_only_and_scores_no_counts_without_it(docs, monkeypatch):
    met, real = [], lm_scoring.meet
    monkeypatch.setattr(lm_scoring, "meet", lambda packed, answered, *rest: met.append((packed, answered)) or real(packed, answered, *rest))
    lm_scoring.score_documents(docs)
    (packed, others), (_, totals) = met
    fold = [r["text"] or "" for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == lm_scoring.DELETED]
    assert sorted(t.decode() for r in packed.collect() for t in chunked.unpack_texts(r["texts"])) == sorted(fold)
    assert totals.columns == ["chunk", "bucket", "t1", "t2", "t3"] and others.columns == ["chunk", "bucket", "o1", "o2", "o3"]
    sent = {what: sum(len(chunked.unpack(r[f"{what}{n}"])) for r in df.collect() for n in (1, 2, 3)) for what, df in (("t", totals), ("o", others))}
    assert 0 < 2 * sent["o"] < sent["t"]


def test_lm_tokens_and_estimates_take_little_memory_a_token(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % x for x in rng.integers(0, 5000, n)) for n in (0, 1, 150_000, 3, 250_000)]
    lm_scoring.Tokens(texts)  # what word hashes keep for later texts is there
    whole = lm_scoring.Tokens(texts)
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 1000)
    tracemalloc.start()
    small = lm_scoring.Tokens(texts)
    taken, n = tracemalloc.get_traced_memory()[1], sum(small.sizes)
    tracemalloc.stop()
    assert taken < 64 * n
    counts = [rng.integers(0, 40, n).astype(np.uint32) for _ in range(3)]
    bucket, f = lm_scoring.estimates(counts, whole.place, 5, 1000)
    found = list(lm_scoring.estimates_of(counts, small.place, 5, 1000))
    assert (np.concatenate([b for _, _, b, _ in found]) == bucket).all() and (np.concatenate([e for *_, e in found], 1) == f).all()
    for order in (1, 2, 3):
        keys = whole.taken(order)
        assert (small.taken(order) == keys).all() and (lm_scoring.ranks(keys) == np.unique(keys, return_inverse=True)[1]).all()
    assert len(lm_scoring.ranks(np.empty(0, np.uint64))) == 0 and len(lm_scoring.Tokens([]).place) == 0


def exact_marginals(crf, graph):
    n, y = len(graph.doc), crf.chain.shape[0]
    own = crf.node[np.array(graph.features)].sum(1)
    out = np.zeros((n, y))
    for labels in itertools.product(range(y), repeat=n):
        if any(b and b != x for b, x in zip(graph.base, labels)):
            continue
        s = sum(own[i, x] for i, x in enumerate(labels)) + sum(crf.chain[labels[a], labels[b]] for a, b in graph.chain) + sum(crf.skip[labels[a], labels[b]] for a, b in graph.skip)
        for i, x in enumerate(labels):
            out[i, x] += math.exp(s)
    return out / out.sum(1, keepdims=True)


def test_messages_give_exact_marginals_on_trees_and_close_ones_on_loops():
    rng = np.random.default_rng(4)
    for text, tolerance in (("call 5551234567 12 and later 5551234567 or 77", 1e-3), ("a1 b2 c3 d4", 1e-3), ("x1 y2 x1 y2", 0.1)):
        graph, crf = pii.Graph(), pii.SkipChainCRF()
        graph.add(0, text, [])
        crf.node[np.unique(graph.features)] = rng.normal(0, 0.5, (len(np.unique(graph.features)), 5))
        crf.chain[:] = rng.normal(0, 0.5, (5, 5))
        skip = rng.normal(0, 0.5, (5, 5))
        crf.skip[:] = (skip + skip.T) / 2
        assert np.abs(crf.marginals(graph) - exact_marginals(crf, graph)).max() < tolerance, text


def test_evidence_reaches_mentions_however_far(spark):
    crf = pii.SkipChainCRF()
    crf.node[:, 0] = 0.01
    crf.skip[:] = -6.0
    np.fill_diagonal(crf.skip, 6.0)
    text = "+15551234567, first, and then " + "and then ".join(["15551234567 "] * 60)
    graph = pii.Graph()
    graph.add(0, text, pii.base_spans(text))
    best = crf.marginals(graph).argmax(1)
    assert (best == 1 + pii.KINDS.index("phone")).all() and len(best) == 61


def test_model_is_the_same_from_joined_documents():
    texts = ["mail a@b.de or 10.0.0.1 twice 10.0.0.1", "call +1 555 123 4567 or 15551234567"]
    whole, joined = pii.Graph(), pii.Graph()
    for i, t in enumerate(texts):
        whole.add(i, t, pii.base_spans(t))
        one = pii.Graph()
        one.add(0, t, pii.base_spans(t))
        joined.join(i, one.base, [f for fs in one.features for f in fs], [x for e in one.chain for x in e], [x for e in one.skip for x in e])
    assert all(getattr(whole, n) == getattr(joined, n) for n in ("doc", "base", "features", "chain", "skip"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_kinds_of_files(docs, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    some = docs.limit(40)
    library = tokens.sentence_pieces(path).encode if name.endswith(".model") else lambda t: tokens.tokenizer(path).encode(t, add_special_tokens=False).ids
    want = {r["doc_id"]: len(library(r["text"] or "")) for r in some.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(some, tokenizer_path=path).collect()} == want


def test_pre_tokens_are_the_librarys():
    path = tokens.default_path()
    cut, library = tokens.cutter(path), tokens.tokenizer(path).pre_tokenizer
    rng = np.random.default_rng(6)
    for _ in range(500):
        unit = "".join(rng.choice(list("ab\n\t'sS1é中!<|>"), rng.integers(1, 20)))
        assert "".join(cut(" " + unit)) == " " + unit and len(cut(" " + unit)) == len(library.pre_tokenize_str(" " + unit))


def test_a_chunks_name_depends_on_its_texts(monkeypatch):
    class Context:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(chunked.TaskContext, "get", staticmethod(lambda: Context))
    names = [[c.key for c in chunked.chunks_of(iter([pd.DataFrame({"doc_id": [None, None], "text": list(t)})]), 1 << 20)] for t in ("ab", "ba", "ab")]
    assert names[0] == names[2] != names[1]


def test_buckets_follow_from_bytes(spark):
    df = spark.range(200).select(F.lit("x" * 1000).alias("text"))
    assert chunked.sizes_for(df, 1000, 1000) == chunked.Sizes(6324, 32) and chunked.sizes_for(df.limit(0)).buckets == 4


def test_line_dedup_leaves_columns_with_unlucky_names_alone(spark):
    names = ["_z", "_h", "_gone", "_row", "row", "doc", "pos", "line", "site", "z", "i", "h", "gone", "n_removed", "N_Lines"]
    rows = [(i, f"own {i}\nspread", f"s{i}", *[f"{n}{i}" for n in names]) for i in range(8)]
    out = line_dedup.remove_spread_lines(spark.createDataFrame(rows, ["doc_id", "text", "source", *names]))
    assert out.columns == ["doc_id", "text", "source", *names[:-2], "n_lines", "n_removed"]
    for r in out.collect():
        i = r["doc_id"]
        assert all(r[n] == f"{n}{i}" for n in names[:-2]) and r["text"] == (f"own {i}\nspread" if i == 0 else f"own {i}") and r["n_removed"] == (i > 0)


def test_quality_fields_win_over_columns_of_their_name(spark):
    df = spark.createDataFrame([(1, "a b", "x", 3.5, ["y"])], "doc_id long, text string, kept string, ratio double, more array<string>")
    out = quality_rules.add_quality(df, keep=("doc_id", "text", "kept", "ratio", "more"))
    assert out.columns[:3] == ["doc_id", "text", "more"] and [f for f in out.columns if f == "kept"] == ["kept"]
    assert out.first()["kept"] is False and out.first()["more"] == ["y"]
