"""License scans by ordered signature rules.

A text's words, with one space between them, are searched by some hundreds of hand-written patterns (license_rules). Most
texts hold the keywords of none, which a set of the text's words tells, so no pattern is tried on them; on the others only
those are whose keywords are all there. Where detections overlap, one that lies inside a detection of a stronger rule, or
inside a longer one of an equally strong rule, gives way; the contract's base phrases never do.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.llm.common import free_name
from meshloom.llm.license_rules import Rule, all_rules

#: Bytes of words as they are, A-Z in lower case, all others as spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))

DETECTIONS = "array<struct<label:string,rule:int,start:long,n_words:long,confidence:double,base:boolean,words:string>>"
_KINDS = {"label": pa.string(), "rule": pa.int32(), "start": pa.int64(), "n_words": pa.int64(), "confidence": pa.float64(), "base": pa.bool_(), "words": pa.string()}


class Scanner:
    """All rules, by the keyword that the fewest rules have."""

    def __init__(self, rules: list[Rule]) -> None:
        often = Counter(w for r in rules for w in r.keywords)
        self.by_word: dict[bytes, list[tuple[Rule, re.Pattern]]] = {}
        self.always = [(r, r.finder) for r in rules if not r.keywords]
        for r in rules:
            if r.keywords:
                self.by_word.setdefault(min(r.keywords, key=lambda w: (often[w], w)), []).append((r, r.finder))
        self.anchors = frozenset(self.by_word)

    def candidates(self, words: set[bytes]) -> list[tuple[Rule, re.Pattern]]:
        """The rules whose keywords are all among a text's words."""
        words = words | {b"license"} if b"licence" in words else words
        found = [rule for anchor in self.anchors & words for rule in self.by_word[anchor] if rule[0].keywords <= words]
        return found + self.always

    def scan(self, words: list[bytes]) -> list[tuple[Rule, int, int]]:
        """(rule, first word, number of words) of all detections that stay, by first word, length and rule."""
        rules = self.candidates(set(words))
        if not rules:
            return []
        text = b" " + b" ".join(words) + b" "
        spans = [(rule, m.start(), m.end()) for rule, pattern in rules for m in pattern.finditer(text)]
        if not spans:
            return []
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        first, after = (np.searchsorted(spaces, [s[k] for s in spans]).tolist() for k in (1, 2))
        found = [(s[0], a, b - a) for s, a, b in zip(spans, first, after)]
        return sorted(unsuppressed(found), key=lambda d: (d[1], d[2], d[0].number))


def unsuppressed(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """Detections without those that lie inside one of a stronger rule or inside a longer one of an equally strong rule.

    Of equally strong detections of the same words the rule that is written first stays. One sweep per priority: a
    detection is inside another if one that starts no later ends no earlier.
    """
    kept: list[tuple[Rule, int, int]] = []
    for priority in sorted({rule.priority for rule, _, _ in found}):
        stronger = sorted((first, first + n) for _, first, n in kept)
        firsts, ends = [s[0] for s in stronger], []
        for _, end in stronger:
            ends.append(max(end, ends[-1] if ends else 0))
        own, reach = [], 0
        for d in sorted((d for d in found if d[0].priority == priority), key=lambda d: (d[1], -d[2], d[0].number)):
            rule, first, n = d
            at = bisect_right(firsts, first)
            inside = reach >= first + n or (at and ends[at - 1] >= first + n)
            if rule.base or not inside:
                own.append(d)
            reach = max(reach, first + n)
        kept += own
    return kept


@cache
def default_scanner() -> Scanner:
    return Scanner(all_rules())


def words_of_text(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def scan_licenses(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with n_words and license detections, by place.

    A detection has its label, its rule's number and confidence, its first word (from 0), how many words it has and
    these, and whether it is one of the base phrases. Every document gets a row, a repeated one as many rows; an empty
    table gives none. Null and empty texts have no word and no detection. Texts of any length are searched whole, in one
    pass per candidate rule. Other columns are not read; one of `keep` that is named like a result gives way to it. There
    is no shuffle.
    """
    names = ("n_words", "detections")
    keep = tuple(c for c in keep if c.lower() not in names)
    kept = docs.select(*[f"`{c}`" for c in keep])
    source = free_name((*keep, *names), "text")
    results = T.StructType.fromDDL(f"n_words long, detections {DETECTIONS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = default_scanner()
        kind = pa.list_(pa.struct(list(_KINDS.items())))
        for batch in batches:
            table = pa.Table.from_batches([batch])
            counts, detections = [], []
            for text in table.column(source):
                words = words_of_text(text.as_py())
                counts.append(len(words))
                detections.append([
                    {"label": r.label, "rule": r.number, "start": s, "n_words": n, "confidence": r.confidence, "base": r.base, "words": b" ".join(words[s : s + n]).decode("utf-8", "surrogatepass")}
                    for r, s, n in scanner.scan(words)
                ])
            table = table.drop_columns([source]).append_column("n_words", pa.array(counts, pa.int64()))
            yield from table.append_column("detections", pa.array(detections, kind)).to_batches()

    return docs.select(*[f"`{c}`" for c in keep], docs[text_col].alias(source)).mapInArrow(run, T.StructType([*kept.schema, *results]))


def license_labels(docs: DataFrame) -> DataFrame:
    """Per document of docs(doc_id, text): places of the base phrases, and the labels of all detections.

    score is the confidence of the strongest detection, 0 if there is none.
    """
    found = scan_licenses(docs).withColumn("_base", F.expr("filter(detections, d -> d.base)"))
    joined = lambda column: F.array_join(F.array_sort(F.array_distinct(F.col(column)["label"])), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.col("_base")["start"]).alias("first_word"),
        F.array_max(F.col("_base")["start"]).alias("last_word"),
        joined("_base").alias("base_labels"),
        joined("detections").alias("labels"),
        F.coalesce(F.array_max(F.col("detections")["confidence"]), F.lit(0.0)).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license detections in all whole texts of `documents`."""
    return license_labels(spark.read.parquet(f"{sf_dir}/documents.parquet"))
