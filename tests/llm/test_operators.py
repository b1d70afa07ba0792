"""Each operator against a plain computation of its contract, on real rows and on odd ones."""

import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import common, exact_dedup, hashing, html_text, line_dedup, lm_scoring, mixing, ngram_join, packing, pii, quality_rules, token_counts, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_words string, kept string, group_size int, line int, node int"
LONG = " ".join(f"w{i} x{i % 7} y{i * i % 101}." for i in range(4000))
ODD = [(1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, "Same text", "a"), (5, "Same  text", "b"), (5, "Same text", "b"), (None, "Same text", "c"), (6, LONG, "d"), (7, "<|endoftext|> é 中文 \x00", "e")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 1, 2, 3) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id < 0")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_html_keeps_the_article_only(spark):
    page = """<html><head><title>no</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><div class="sidebar"><p>Side text here</p></div>
    <div id="content"><h1>Title &amp; more</h1><p>First   paragraph with quite a lot of text, <b>bold</b> too.</p><p>Second paragraph, which is also long enough to count.<p>Third, unclosed but long enough to be an article's paragraph.</div>
    <div class="comments"><p>A reader's comment that is not wanted.</p></div><script>var x = "<p>no</p>";</script><footer>Copyright</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page, 9), (2, "v", None, 9), (3, None, "", 9), (4, "w", "plain text", 9), (5, "x", "<div><p>never closed " * 500, 9)], "page_id long, url string, html string, n_chars int")
    got = {r["page_id"]: r for r in html_text.add_main_text(df).collect()}
    assert got[1]["text"] == "Title & more\n\nFirst paragraph with quite a lot of text, bold too.\n\nSecond paragraph, which is also long enough to count.\n\nThird, unclosed but long enough to be an article's paragraph."
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["text"] == "plain text" and len(got) == 5
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.add_main_text(df.where("page_id < 0")).count() == 0


def test_html_looks_for_attribute_names_outside_values():
    page = """<body title="a hidden lake"><article><p data-x='hidden'>First paragraph with a <a href="/hidden-gems">hidden gem</a> and a <a href=/p?id=comments>link</a>.</p>
    <p title="id=comments">Second <img alt="a hidden lake"> paragraph.</p><p hidden>Gone.</p><p CLASS = promo>Gone too.</p><p data-hidden=1>Third paragraph.</p></article></body>"""
    assert html_text.extract_text(page) == "First paragraph with a hidden gem and a link.\n\nSecond paragraph.\n\nThird paragraph."


@pytest.mark.parametrize("second", [100, 25])
def test_html_keeps_all_parts_of_an_article(second):
    first = [f"Paragraph {i} of the first part, " + "with words of prose " * 5 for i in range(10)]
    more = [f"Paragraph {i} of the second part, " + ("with words of prose " * 5)[:second] for i in range(8)]
    parts = [" ".join(p.split()) for p in ["A title", *first, *more]]
    one, two = ("".join(f"<p>{p}</p>" for p in ps) for ps in (first, more))
    links = "<ul>" + "".join(f"<li><a href=/{i}>Some other page {i}</a></li>" for i in range(12)) + "</ul>"
    for page in (
        f"<html><body><h1>A title</h1><div>{one}</div><div>{two}</div></body></html>",
        f"<html><body>{links}<h1>A title</h1><div>{one}</div>{links}<div>{two}</div><div>{links}</div></body></html>",
        f"<body><div id=content><section><h1>A title</h1></section><section>{one}</section><section>{two}</section></div><div>{links}</div></body>",
    ):
        assert html_text.extract_text(page).split("\n\n") == parts


def test_exact_dedup_of_odd_rows_and_a_second_batch(spark, odd, empty):
    index = exact_dedup.DigestIndex(spark, common.fresh_path(spark, "index"))
    assert index.ingest(empty).count() == 0
    got = [r for r in index.ingest(odd).collect()]
    assert len(got) == len(ODD)
    same = [r for r in got if r["group_size"] == 4]
    assert len(same) == 4 and {r["keep_id"] for r in same} == {5} and sum(r["kept"] for r in same) == 1
    assert {r["keep_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {3}
    again = index.ingest(odd.where("doc_id = 4").withColumn("doc_id", F.lit(0).cast("long"))).collect()
    assert again[0]["keep_id"] == 5 and not again[0]["kept"]
    assert index.rows().count() == 4


def test_quality_base_fields(docs, odd, empty):
    for r in quality_rules.add_quality(docs.limit(120), keep=("doc_id", "text")).collect():
        text = r["text"] or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        inside = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert r["n_repeat_words"] == len(inside)
        assert r["base_failed"] == (len(words) < 50 or 100 * len(inside) > 50 * len(words)) and not (r["kept"] and r["base_failed"])
    assert quality_rules.add_quality(odd).count() == len(ODD) and quality_rules.add_quality(empty).count() == 0


def test_quality_bands_tell_noise_and_repetition_from_prose(docs):
    c = __import__("zstandard").ZstdCompressor(level=3)
    rng = np.random.default_rng(1)
    noise = "".join(map(chr, rng.integers(33, 127, 6000)))
    assert not quality_rules.bands_ok(noise.encode(), c)[0] and not quality_rules.bands_ok(b"the same words again " * 400, c)[0]
    prose = [t for t in texts_of(docs).values() if 3000 < len(t) < 20000]
    assert np.mean([quality_rules.bands_ok(t.encode(), c)[0] for t in prose]) > 0.8


def test_quality_finds_a_bad_stretch_wherever_it_is(docs):
    import base64

    c = __import__("zstandard").ZstdCompressor(level=3)
    prose = "\n".join(t for t in texts_of(docs).values() if quality_rules.measure(t, c)[6] and len(t) > 1000).encode()
    noise = base64.b64encode(np.random.default_rng(2).bytes(60_000))
    assert quality_rules.bands_ok(prose[:8096], c)[0] and quality_rules.bands_ok(prose[:100_000], c)[0]
    for good, bad in ((4096, 4000), (51_000, 49_000), (90_000, 10_000)):
        for text in (prose[:good] + noise[:bad], noise[:bad] + prose[:good]):
            assert not quality_rules.bands_ok(text, c)[0], (good, bad)
    one = prose[:8192] + noise[:4096]
    assert quality_rules.bands_ok(one + prose[8192 : 4096 * 19], c)[0] and quality_rules.bands_ok(prose[: 4096 * 19 + 1] + noise[:4096], c)[0]
    assert quality_rules.bands_ok(one, c)[2:] == (1, 3) and quality_rules.bands_ok(prose[:4097], c)[3] == 2


def test_line_dedup_near_and_beyond_the_threshold(spark, odd, empty):
    many = [(i, f"own {i}\n  spread line \nfour sites" if i < 4 else f"own {i}\nspread line", f"s{i}") for i in range(12)]
    one_site = [(100 + i, f"x{i}\nlocal", "s0") for i in range(20)]
    df = spark.createDataFrame([(*r, 7) for r in many + one_site], "doc_id long, text string, source string, n_lines int")
    got = {r["doc_id"]: r for r in line_dedup.remove_spread_lines(df).collect()}
    assert got[0]["text"] == "own 0\n  spread line \nfour sites" and got[0]["n_removed"] == 0
    assert got[1]["text"] == "own 1\nfour sites" and got[11]["text"] == "own 11" and got[105]["text"] == "x5\nlocal"
    assert got[1]["n_lines"] == 3 and got[1]["n_removed"] == 1
    left = line_dedup.remove_spread_lines(odd).collect()
    assert len(left) == len(ODD) and {r["doc_id"]: r["text"] for r in left}[1] is None
    assert line_dedup.remove_spread_lines(empty).count() == 0


def test_ids_are_the_librarys(docs):
    encode, library = tokens.id_encoder(tokens.default_path()), tokens.tokenizer(tokens.default_path())
    rng = np.random.default_rng(3)
    signs = list("ab \n\t'sS1é中!<|>endoftext  ") + ["<|endoftext|>", "  ", "　", "\x85"]
    made = ["".join(rng.choice(signs, rng.integers(1, 40))) for _ in range(2000)]
    for text in [*texts_of(docs).values(), *made, "", "x" * 3000, " " * 3000]:
        assert encode(text) == np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_is_a_partition_into_full_sequences(spark, docs, odd, empty):
    encode = tokens.id_encoder(tokens.default_path())
    got = packing.pack_documents(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in texts_of(docs).items():
        ids = encode(text) + bytes(4)
        pieces = sorted(by_doc[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert b"".join(ids[4 * r["start"] : 4 * (r["start"] + r["length"])] for r in pieces) == ids
        assert all(r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in pieces)
        assert all(r["length"] == 2048 for r in pieces[1:])
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    bound = -(-sum(r["length"] for r in got) // 2048)
    assert len(by_sequence) <= bound * 1.03 + 1
    assert len({r["doc_id"] for r in packing.pack_documents(odd).collect()}) == 8 and packing.pack_documents(empty).count() == 0


def test_mixing_meets_targets_and_reruns_agree(docs, odd, empty):
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.taken_words(sized).collect()
    assert len(got) == docs.count()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 0.02 * t + 200 for s, t in target.items())
    assert sorted(map(tuple, got), key=repr) == sorted(rows(mixing.taken_words(sized)), key=repr)
    sizes = odd.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    assert mixing.taken_words(sizes).count() == len(ODD) and mixing.taken_words(sizes.where("doc_id < 0")).count() == 0


def test_mixing_meets_the_targets_of_small_sources(spark):
    sizes = {"big": [700] * 30, "capped": [50], "more": [9, 1, 55], "tiny": [21], None: [5, 3], "none": [0], "some": [130] * 40, "word": [1]}
    df = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)], "doc_id long, source string, size long")
    for seed in range(3):
        taken, target = Counter(), {}
        for r in mixing.taken_words(df, seed=seed).collect():
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
        assert set(target) == set(sizes) and all(abs(taken[s] - t) <= 0.5 for s, t in target.items()), (taken, target)
        assert taken["capped"] == 150 and taken["tiny"] == 63 and taken[None] == 24 and taken["word"] == 3


def test_lm_base_score_and_held_out_gain(docs, odd, empty):
    split = {d: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) + [None] for d, t in texts_of(docs).items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in split}
    counts = Counter(w for d, ws in split.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    gain = 0.0
    for r in lm_scoring.score_documents(docs).collect():
        words = split[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(words), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel=1e-9)
        gain += held[r["doc_id"]] * (r["score"] - r["base_score"])
    assert gain > 0
    assert lm_scoring.score_documents(odd).count() == len(ODD) and lm_scoring.score_documents(empty).count() == 0


def test_token_counts_are_the_librarys(docs, odd, empty):
    library = tokens.tokenizer(tokens.default_path())
    for df in (docs, odd.where("doc_id is not null")):
        want = sorted((r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
        got = token_counts.count_tokens(df, chunk_bytes=5000).collect()
        assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_counts.count_tokens(odd).count() == len(ODD) and token_counts.count_tokens(empty).count() == 0


def test_pii_base_spans_are_the_patterns(docs, odd, empty):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def plain(text):
        out = []
        for k, p in enumerate(patterns):
            for m in re.finditer(p, text):
                d = re.sub("[^0-9]", "", m.group())
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 14 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 10 <= len(d) <= 15:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    made = ["a@b@c.d x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 01.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999. +12", "@.a a.b@-.-", "+49 30 1234567 x@y"]
    for text in [*texts_of(docs).values(), *made]:
        assert pii.base_spans(text) == plain(text), text[:80]
    for r in pii.find_personal_data(docs).collect():
        base = {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(texts_of_cache(docs)[r["doc_id"]])}
        assert base <= set(filter(None, r["spans"].split(",")))
    assert pii.find_personal_data(odd).count() == len(ODD) and pii.find_personal_data(empty).count() == 0


_cache = {}


def texts_of_cache(docs):
    if not _cache:
        _cache.update(texts_of(docs))
    return _cache


def brute_components(texts):
    """doc_id -> (set size, least reachable id), by comparing all sets that share a shingle."""
    sets = {}
    for d, t in texts.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_ngram_join_of_documents(docs, odd, empty):
    want = brute_components(texts_of(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_components(docs, 20_000).collect()}
    assert got == want
    assert ngram_join.near_duplicate_components(odd).count() == len(ODD) and ngram_join.near_duplicate_components(empty).count() == 0


def test_ngram_join_loses_no_link_around_the_threshold(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(12, 120)))]
        for _ in range(8):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 1 + len(words) // 25))):
                words[at] = f"e{rng.integers(0, 40)}"
            texts[len(texts)] = " ".join(words)
    for _ in range(60):  # a passage that most of them consist of, with a little of their own and of each other's
        extra = [f"z{rng.integers(0, 30)}" for _ in range(int(rng.integers(0, 30)))]
        texts[len(texts)] = " ".join(passage + extra)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicate_components(df, 3000).collect()}
    assert got == brute_components(texts)


def test_word_hashes_tell_words_apart(docs, monkeypatch):
    monkeypatch.setattr(hashing, "BLOCK_BYTES", 64)
    seen = {}
    for text in texts_of(docs).values():
        words, found = text.encode().lower().split(), hashing.word_hashes(text.encode())
        assert len(words) == len(found)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, found.tolist()))
    assert len(set(seen.values())) == len(seen)
