"""The pipeline's stages against plain computations, on real rows mixed with odd ones and columns with unlucky names."""

import re
from collections import Counter, defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from meshloom.llm import mixing, quality_rules
from test_operators import brute_components

EXTRA = ("kept", "n_removed", "n_lines", "doc", "row", "key", "_key", "_share", "_copies", "_h", "z", "line", "component_id", "taken", "size")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in some.collect()]
    long = max((r for r in rows if r[1]), key=lambda r: len(r[1]))
    prose = [r for r in rows if r[1] and quality_rules.measure(r[1], zstandard.ZstdCompressor(level=3))[6]]
    again = [(r[0], r[1] + f"\nan odd line {i}", *r[2:]) for i, r in enumerate(prose[:4])]  # a repeated id, nearly the same text
    rows += [(9001, None, "x", "s", None), (9002, "", "x", None, 0), (None, prose[5][1], "x", "s", 1), (None, " \n", "x", "s", 2), (-5, prose[6][1], "x", None, 7), (9003, long[1] * 5, "x", "s", 8)]
    rows += again + prose[7:9] + [(9100 + i, f"{prose[i][1]}\n a notice on many sites \nown {i}", "x", f"site{i}", 3) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in EXTRA])


def stage(docs, name):
    out = getattr(corpus_pipeline, name)(docs.sparkSession, docs, "")
    assert out.columns == docs.columns
    empty = getattr(corpus_pipeline, name)(docs.sparkSession, docs.where("lang = 'no such'"), "")
    assert empty.columns == docs.columns and empty.count() == 0
    rows = out.collect()
    for r in rows:  # what a user carries stays what it was
        assert all(r[c] == f"{c}{'-' if r['doc_id'] is None else r['doc_id']}" for c in EXTRA)
    return rows


def counted(rows):
    return Counter((r["doc_id"], r["text"], r["source"], r["n_chars"]) for r in rows)


def test_quality_keeps_what_passes(docs):
    c = zstandard.ZstdCompressor(level=3)
    want = [r for r in docs.collect() if quality_rules.measure(r["text"], c)[6]]
    assert counted(stage(docs, "quality")) == counted(want) and len(want) > 20


def test_lines_on_many_sites_go(docs):
    rows, sites, first = docs.collect(), defaultdict(set), {}
    for r in rows:
        order = (r["doc_id"] is None, r["doc_id"] or 0)
        for pos, line in enumerate((r["text"] or "").split("\n") if r["text"] is not None else []):
            if line := line.strip(" \t\n\v\f\r"):
                sites[line] |= {r["source"]} - {None}
                first[line] = min(first.get(line, (order, pos)), (order, pos))
    want = Counter()
    for r in rows:
        order = (r["doc_id"] is None, r["doc_id"] or 0)
        lines = (r["text"] or "").split("\n")
        left = [x for p, x in enumerate(lines) if not (t := x.strip(" \t\n\v\f\r")) or len(sites[t]) < 5 or first[t] == (order, p)]
        text = "\n".join(left)
        if WORD.search(text):
            want[r["doc_id"], text, r["source"], len(text) if len(left) < len(lines) else r["n_chars"]] += 1
    got = counted(stage(docs, "lines"))
    odd = {r["doc_id"] for r in rows if Counter(x["doc_id"] for x in rows)[r["doc_id"]] > 1}  # firsts among these depend on a hash
    assert {k: n for k, n in got.items() if k[0] not in odd} == {k: n for k, n in want.items() if k[0] not in odd}
    assert sum(got.values()) == sum(want.values())


def test_one_of_each_near_duplicate_group_stays(docs):
    rows = {(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""): r for r in docs.collect()}
    keys = sorted(rows)
    label = brute_components({i: k[2] for i, k in enumerate(keys)})
    groups = defaultdict(list)
    for i, k in enumerate(keys):
        groups[label[i][1]].append(k)
    got = Counter((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in stage(docs, "near_duplicates"))
    assert max(got.values()) == 1
    for members in groups.values():
        (kept,) = [k for k in members if k in got]
        assert kept[:2] == members[0][:2]
    assert len(got) == len(groups)


def test_the_mix_takes_documents_as_often_as_their_words(docs):
    rows = docs.collect()
    sized = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "source", mixing.word_count(F.col("text")).alias("size"))
    share = defaultdict(list)
    for r in mixing.taken_words(sized).collect():
        share[r["doc_id"]].append(r["taken"] / r["size"] if r["size"] else 0)
    key = {(r["doc_id"], r["text"]): r["k"] for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k")).collect()}
    got = counted(stage(docs, "mix"))
    for k, n in counted(rows).items():
        s = share[key[k[:2]]]
        assert n * int(min(s)) <= got[k] <= n * min(3, int(max(s)) + 1)
        assert s != [0] * len(s) or not got[k]
    assert set(got) <= set(counted(rows)) and counted(stage(docs, "mix")) == got


def test_all_stages_in_a_row(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    fill = Counter()
    for r in out:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.collect()}
