"""Runs of periodic words in a text, by a harmonic grid and prefix hashes.

A run is a stretch of words that repeats with a smallest period q at least MIN_EXPONENT times and that no neighbouring
word extends. Words that equal the word q places on form a stretch of length - q places, so a grid of points as far apart
as the shortest such stretch of period q meets every run of that period: n / (3 * q) points for period q, n log n / 3 over
all periods (a harmonic sum). At every (period, point) pair the longest common extensions to both sides of the point and
of the point q words on are looked for at once, by binary search on differences of prefix hashes in NumPy arrays. What the
hashes find is then compared word for word, so a collision costs time only, and pairs that found the same stretch are
one run, of the smallest period.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshloom.llm.common import free_name
from meshloom.llm.hashing import BASE, mix64

#: A run has at least so many words, and its period at least so many times.
MIN_LENGTH, MIN_EXPONENT = 6, 4
#: (period, point) pairs that are worked on at once, which bounds memory for texts of millions of words.
PAIRS = 1 << 18

RUNS = "array<struct<start:long,length:long,period:long>>"
_ARROW_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class PrefixHashes:
    """Hashes of all prefixes of a sequence of word numbers, as a polynomial modulo 2**64."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.powers = np.full(n + 1, BASE, np.uint64)
        self.powers[0] = 1
        np.multiply.accumulate(self.powers, out=self.powers)
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=self.upto[1:])

    def equal(self, low: np.ndarray, high: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Whether words low..high-1 hash like those `shift` places on."""
        return (self.upto[high] - self.upto[low]) * self.powers[shift] == self.upto[high + shift] - self.upto[low + shift]

    def extend(self, at: np.ndarray, shift: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """How many words from `at` on (way 1) or before `at` (way -1) equal those shift places on; at most `most`.

        One binary search for all pairs: each step tries a power of two, the largest first. A true extension is never
        underrated, as equal words have equal hashes.
        """
        found = np.zeros(len(at), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step := step >> 1:
            tried = found + step
            fits = np.flatnonzero(tried <= most)
            a, s, t = at[fits], shift[fits], tried[fits]
            good = self.equal(a, a + t, s) if way > 0 else self.equal(a - t, a, s)
            found[fits[good]] = t[good]
        return found


def least_match(period: np.ndarray | int, min_length: int, min_exponent: int):
    """How many places of a run of this period equal the place `period` on, at least."""
    return np.maximum(min_length - period, (min_exponent - 1) * period)


def grid_blocks(n: int, min_length: int, min_exponent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (period, point) pairs of the harmonic grid over n words, in blocks of about PAIRS."""
    periods = np.arange(1, n // min_exponent + 1, dtype=np.int64)
    steps = least_match(periods, min_length, min_exponent)
    counts = (n - periods - 1) // steps + 1
    blocks = np.cumsum(counts) // PAIRS
    for part in np.split(np.arange(len(periods)), np.flatnonzero(np.diff(blocks)) + 1):
        many = counts[part]
        first = np.repeat(np.cumsum(many) - many, many)
        yield np.repeat(periods[part], many), (np.arange(many.sum()) - first) * np.repeat(steps[part], many)


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """All runs of a sequence of word numbers: rows (start, length, period), by start, then period."""
    n = len(ids)
    none = np.empty((0, 3), np.int64)
    if n < max(min_length, min_exponent):
        return none
    with np.errstate(over="ignore"):
        hashes = PrefixHashes(ids)
        found = [none]
        for period, point in grid_blocks(n, min_length, min_exponent):
            hit = np.flatnonzero(ids[point] == ids[point + period])
            period, point = period[hit], point[hit]
            ahead = hashes.extend(point, period, n - point - period, 1)
            behind = hashes.extend(point, period, point, -1)
            long = ahead + behind >= least_match(period, min_length, min_exponent)
            found.append(np.stack([point - behind, point + ahead, period], 1)[long])
    stretches = np.unique(np.concatenate(found), axis=0)
    return _verified(ids, stretches, min_length, min_exponent)


def _verified(ids: np.ndarray, stretches: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Runs from stretches (start, end of the equal places, period), compared word for word.

    Stretches that end at the same words are one run if their periods are multiples of the smallest. Where a comparison
    fails, hashes have collided: the equal places are then taken from the words themselves.
    """
    ends: dict[tuple[int, int], list[int]] = {}
    for start, end, period in stretches.tolist():
        ends.setdefault((start, end + period), []).append(period)
    runs: dict[tuple[int, int], int] = {}
    for (start, end), periods in ends.items():
        proven: list[int] = []
        for p in sorted(periods):
            if any(p % q == 0 for q in proven):
                continue
            same = ids[start : end - p] == ids[start + p : end]
            if same.all():
                proven.append(p)
                spans = [(start, end)]
            else:
                edges = np.flatnonzero(np.diff(np.concatenate([[False], ids[:-p] == ids[p:], [False]])))
                spans = [(b, e + p) for b, e in edges.reshape(-1, 2).tolist() if e - b >= least_match(p, min_length, min_exponent)]
            for span in spans:
                runs[span] = min(p, runs.get(span, p))
    return np.array(sorted((s, e - s, p) for (s, e), p in runs.items()), np.int64).reshape(-1, 3)


def outside_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def numbered(words: list) -> np.ndarray:
    """Words as numbers, equal ones alike."""
    places: dict = {}
    return np.fromiter((places.setdefault(w, len(places)) for w in words), np.int64, len(words))


def add_runs(
    docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT, rewrite: Callable[[list[bytes], dict], list[bytes]] | None = None,
) -> DataFrame:
    """The columns `keep` of docs with n_words, runs (start, length, period by start) and collapsed.

    collapsed is the words that no run contains after its first period, joined by one space. Words are separated by the
    white space of ASCII and compared by case. `rewrite`, if given, gets a document's words in UTF-8 and its row of
    `keep` and returns the words to work on.

    Every document gets a row, a repeated one as many rows; an empty table gives none. Null and empty texts have no word,
    no run and an empty collapsed text. Texts of any length are searched whole; pairs are worked on in blocks, so memory
    grows with the text's words, not with its pairs. Of runs that overlap or share a start all are returned. Other
    columns are not read; one of `keep` that is named like a result gives way to it. There is no shuffle.
    """
    names = ("n_words", "runs", "collapsed")
    keep = tuple(c for c in keep if c.lower() not in names)
    kept = docs.select(*[f"`{c}`" for c in keep])
    source = free_name((*keep, *names), "text")
    results = T.StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts, table = table.column(source), table.drop_columns([source])
            rows = table.to_pylist() if rewrite else None
            counts, runs, collapsed = [], [], []
            for i, text in enumerate(texts):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # at exactly the contract's white space
                words = rewrite(words, rows[i]) if rewrite else words
                found = runs_of(numbered(words), min_length, min_exponent)
                if len(found):
                    stay = outside_repeats(len(words), found)
                    words_left = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    words_left = words
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found.tolist()])
                collapsed.append(b" ".join(words_left).decode("utf-8", "surrogatepass"))
            for name, kind, values in (("n_words", pa.int64(), counts), ("runs", _ARROW_RUNS, runs), ("collapsed", pa.string(), collapsed)):
                table = table.append_column(name, pa.array(values, kind))
            yield from table.to_batches()

    return docs.select(*[f"`{c}`" for c in keep], docs[text_col].alias(source)).mapInArrow(run, T.StructType([*kept.schema, *results]))


def planted(words: list[bytes], row: dict) -> list[bytes]:
    """The words of a document with the contract's repeats: every tenth document, by its id's hash, becomes periodic.

    A null id plants nothing.
    """
    h = zlib.crc32(str(row["doc_id"]).encode()) if row["doc_id"] is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    head, tail = words[:a], words[a : a + p]
    return head + (tail * -(-(n - a) // p))[: n - a]


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document of docs(doc_id, text), with planted repeats: its number of runs, its longest run, and digests."""
    found = add_runs(docs, rewrite=planted)
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("_longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_longest.start")).alias("start"),
        F.col("_longest.length").alias("length"),
        (-F.col("_longest.period")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all whole texts of `documents`."""
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
