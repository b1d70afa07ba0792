"""Periodic runs, license scans and token alignment against plain computations of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshloom.llm import common, exact_dedup, license_rules, license_scan, periodic_runs, token_alignment, tokens

SCHEMA = "doc_id long, text string, n_words string, runs string, collapsed int, detections int, bucket int, chunk string"
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a a a b"), (4, "a a a a a a a a b"), (None, "x y x y x y x y x y"), (5, "Same text"), (6, "<|endoftext|> <s> é 中文字 ﬁ \x00 <0x0A>"), (7, "a▁b c"), (8, "w" * 30000), (9, " ".join(f"w{i % 7}" for i in range(20000))), (10, "  a   b \n \n c\x1cd  "), (20, "Under the MIT License; CC BY-NC 4.0. Apache License, Version 2.0 cc by nc")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 1, 2, 3, "clash") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def same_rows(df, want):
    """Rows of df, as tuples, are those of want, in any order."""
    assert Counter(map(tuple, df.collect())) == Counter(want)


# periodic runs


def plain_runs(words):
    n, out = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(6, 4 * p):
                out.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def plain_run_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, length, p in runs for i in range(s + p, s + length)}
    first = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    digests = (hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
    return doc_id, len(runs), *first, 1000 * first[1] // first[2] if runs else None, *digests


def test_runs_of_random_sequences():
    rnd = random.Random(1)
    for _ in range(1500):
        words = [rnd.randint(0, rnd.randint(1, 3)) for _ in range(rnd.randint(0, 60))]
        if words and rnd.random() < 0.6:
            p, s = rnd.randint(1, 8), rnd.randrange(len(words))
            for i in range(s, len(words)):
                words[i] = words[s + (i - s) % p]
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(words, np.int64)).tolist()] == plain_runs(words)


def test_runs_in_small_blocks_and_with_colliding_hashes(monkeypatch):
    rnd = random.Random(2)
    cases = [[rnd.randint(0, 1) for _ in range(50)] + [0, 1, 1] * 6 + [rnd.randint(0, 1) for _ in range(20)] for _ in range(60)]
    monkeypatch.setattr(periodic_runs, "PAIRS", 7)
    for c in cases:
        assert [tuple(r) for r in periodic_runs.runs_of(np.array(c, np.int64)).tolist()] == plain_runs(c)
    # hashes that say that nearly everything is equal: the words decide
    monkeypatch.setattr(periodic_runs.PrefixHashes, "equal", lambda self, low, high, shift: (low + high + shift) % 5 > 0)
    for c in cases:
        got = {tuple(r) for r in periodic_runs.runs_of(np.array(c, np.int64)).tolist()}
        assert got <= set(plain_runs(c))


def test_thue_morse_words_hold_no_run():
    words = np.array([i.bit_count() % 2 for i in range(1 << 14)], np.int64)  # prefix hashes modulo 2**64 collide on them
    assert len(periodic_runs.runs_of(words)) == 0


def test_runs_of_documents(spark, documents, sf_dir):
    want = [plain_run_row(r["doc_id"], r["text"]) for r in documents.collect()]
    got = periodic_runs.op11_periodic_runs(spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    same_rows(got, want)
    assert sum(r[1] > 0 for r in want) > 5


def test_runs_of_odd_rows(odd):
    same_rows(periodic_runs.run_digests(odd), [plain_run_row(*r) for r in ODD])
    got = {r["doc_id"]: r for r in periodic_runs.add_runs(odd, keep=("doc_id", "runs", "bucket")).collect()}
    assert got[4]["collapsed"] == "a b" and got[4]["n_words"] == 9 and got[4]["bucket"] == 3
    assert [tuple(r) for r in got[9]["runs"]] == [(0, 20000, 7)] and got[1]["runs"] == []
    assert periodic_runs.run_digests(odd.where("doc_id < 0")).count() == 0


# license scans


def plain_license_row(doc_id, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    starts, labels = [i for i, _ in places], sorted({label for _, label in places})
    return doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(labels)


def test_licenses_of_documents_and_odd_rows(spark, documents, odd, sf_dir):
    got = license_scan.op12_license_scan(spark, sf_dir)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    same_rows(got.drop("labels", "score"), [plain_license_row(r["doc_id"], r["text"]) for r in documents.collect()])
    for r in got.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")
    same_rows(license_scan.license_labels(odd).drop("labels", "score"), [plain_license_row(*r) for r in ODD])
    assert license_scan.license_labels(odd.where("doc_id < 0")).count() == 0
    kept = license_scan.scan_licenses(odd.where("doc_id = 20"), keep=("doc_id", "detections", "chunk")).first()
    assert kept["chunk"] == "clash" and [d["label"] for d in kept["detections"]][:2] == ["mit", "cc-by-nc"]


def labels(text):
    return sorted({rule.label for rule, _, _ in license_scan.default_scanner().scan(license_scan.words_of_text(text))})


@pytest.mark.parametrize(
    "text, want",
    [
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", ["lgpl-2.1-or-later"]),
        ("GNU Lesser General Public License as published by the FSF; either version 2.1 of the License, or (at your option) any later version.", ["lgpl-2.1-or-later"]),
        ("see https://www.apache.org/licenses/LICENSE-2.0", ["apache-2"]),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0", ["cc-by-nc-sa"]),
        ("CC BY-NC-SA 4.0", ["cc-by-nc", "cc-by-nc-sa"]),
        ("a new BSD licence", ["bsd-3-clause"]),
        ("Ich fahre mit der Bahn, die Lizenz liegt bei.", []),
        ("The apache helicopter has a license plate.", []),
        ("under the MIT licence", ["mit"]),
        ("", []),
    ],
)
def test_license_rules(text, want):
    assert labels(text) == want


def test_every_rule_has_keywords_that_its_matches_hold():
    rules = license_rules.all_rules()
    assert len(rules) > 200 and all(r.keywords for r in rules)
    for r in rules:  # an example of each rule: the pattern with every group's last alternative once
        text = r.pattern
        while m := re.search(r"\((?:\?:)?([^()]*)\)(?:\{\d+,\d+\}\??|\?)?", text):
            text = text[: m.start()] + m[1].split("|")[-1] + text[m.end() :]
        text = re.sub(r"\[(.)[^]]*\]", r"\1", text).replace(r"\S+", "word").replace("licenc", "licens").replace("?", "")
        found = [d for d in license_scan.Scanner([r]).scan(license_scan.words_of_text(text))]
        assert found, (r.pattern, text)


def test_contained_detections_give_way():
    r = [license_rules.Rule(i, f"l{i}", p, 0.5, b, "", frozenset()) for i, (p, b) in enumerate([(1, False), (2, False), (1, False), (2, True)])]
    found = [(r[0], 5, 4), (r[1], 6, 2), (r[1], 4, 9), (r[2], 5, 4), (r[2], 20, 3), (r[3], 6, 2), (r[1], 19, 3)]
    assert {(d[0].number, d[1], d[2]) for d in license_scan.unsuppressed(found)} == {(0, 5, 4), (1, 4, 9), (2, 20, 3), (3, 6, 2), (1, 19, 3)}


# token alignment


def plain_alignment(texts):
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(tokens.default_path())
    first.encode_special_tokens = True
    second = tokens.sentence_pieces(token_alignment.default_pieces())
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printing)}
    per, counts = [], Counter()
    for text in texts:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        a_raw = [bytes(sign[c] for c in first.id_to_token(i)) for i in a]
        pieces = [second.id_to_piece(i) for i in b]
        b_raw = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        raw = f" {text}".encode()
        if not text or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
            per.append(None)
            continue
        owner_a, owner_b = ([i for i, x in enumerate(raws) for _ in x] for raws in (a_raw, b_raw))
        links = sorted(set(zip(owner_a, owner_b)))
        groups, ga, gb = [], [], []
        for k in range(len(raw)):
            ga += [owner_a[k]] * (owner_a[k] not in ga)
            gb += [owner_b[k]] * (owner_b[k] not in gb)
            if k + 1 == len(raw) or (owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1]):
                groups.append(",".join(str(a[i]) for i in ga) + "|" + ",".join(str(b[j]) for j in gb))
                ga, gb = [], []
        pairs = [(a[i], b[j]) for i, j in links]
        counts.update(pairs)
        per.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(*p[:3], len(p[3]), sum(counts[x] == top[x[1]] for x in p[3]), sum(counts[x] for x in p[3]), p[4]) if p else (0, 0, 0, 0, 0, 0, "") for p in per]


def test_alignment_of_documents_and_odd_rows(spark, documents, odd):
    rows = [tuple(r) for r in documents.where("length(text) < 4000").collect()]
    want = [(i, *w) for (i, _), w in zip(rows, plain_alignment([t for _, t in rows]))]
    for size in (20_000, 16 << 20):
        same_rows(token_alignment.align_tokens(spark.createDataFrame(rows, documents.schema), chunk_bytes=size), want)
    same_rows(token_alignment.align_tokens(odd), [(i, *w) for (i, _), w in zip(ODD, plain_alignment([t for _, t in ODD]))])
    assert token_alignment.align_tokens(odd.where("doc_id < 0")).count() == 0


def test_components_of_random_links():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 40)
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randint(0, 40))]
        least = list(range(n))
        for _ in range(n):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        left, right = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
        assert token_alignment.components(left, right, n).tolist() == least
    chain = np.arange(200_000)
    assert not token_alignment.components(chain, chain + 1, 200_001).any()


def test_long_white_space_is_encoded_as_the_library_does():
    path = tokens.default_path()
    lib = tokens.tokenizer(path)
    for text in (" " * 2_000_000, "\n" * 2_000_000, "x" + " " * 800_000 + "y" + "\n" * 800_000 + " <|endoftext|>z", " " * 150_000 + "<|endoftext|>" + "\t" * 150_000 + "\x1c"):
        assert np.frombuffer(tokens.id_encoder(path)(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
        head, *rest = tokens.units(text)
        assert " ".join([head, *rest]) == text


def test_a_batch_that_is_run_again_gives_the_same(spark, odd):
    index = exact_dedup.DigestIndex(spark, common.fresh_path(spark, "index"))
    first = sorted(map(str, index.ingest(odd, batch_id="monday").collect()))
    n = index.rows().count()
    assert sorted(map(str, index.ingest(odd, batch_id="monday").collect())) == first and index.rows().count() == n
    assert not any(r["kept"] for r in index.ingest(odd, batch_id="tuesday").collect()) and index.rows().count() == n
    index.close()
