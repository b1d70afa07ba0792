"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers in their plain forms. A conditional random field
over the document's words that hold a digit or an @ then labels what the patterns miss. Neighbouring words share a chain
potential; distant words that repeat, or repeat each other's digits, share a skip potential, so a number that is plain
in one place is recognised where it is written otherwise in another. Marginals come from loopy message passing; all
documents of a batch are one graph whose parts are the documents. Only labels with a high marginal become spans, and the
patterns' spans always stay.

The weights are learned by pseudo-likelihood on a bounded sample of documents that the patterns have labelled: at most
TRAIN_DOCS of at most TRAIN_BYTES. Features are made where the documents are; numbers come to the driver, never texts.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: At most so many documents, those with the least hash of id and text, are learned from, and none of more bytes.
TRAIN_DOCS, TRAIN_BYTES = 1500, 1 << 15
#: Hashed feature space, passes and step of learning, decay of weights.
DIMENSIONS, PASSES, STEP, DECAY = 1 << 13, 150, 0.5, 1e-4
#: Message passing ends where no message of a document changes by more than SETTLED, or, should it swing for ever, after
#: BP_ROUNDS; its damping; marginal from which a label becomes a span.
SETTLED, BP_ROUNDS, DAMPING, CERTAIN = 1e-4, 1000, 0.3, 0.9

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match of the contract's pattern can begin only where a run of digits does: anchoring it there keeps long runs linear
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]+")
HINT = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the address pattern, found from each @ outwards, so in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that pass, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if HINT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if 14 <= m.end() - m.start() and 14 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


class Graph:
    """The words with a digit or an @ of some documents: nodes with features, chain edges and skip edges."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.word: list[str] = []
        self.base: list[int] = []
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []

    def add(self, number: int, text: str, spans: list[tuple[int, int, int]]) -> None:
        words = [m.span() for m in WORD.finditer(text)]
        last: dict[str, int] = {}
        before = -2
        at = 0
        for i, (s, e) in enumerate(words):
            w = text[s:e]
            if not HINT.search(w):
                continue
            node = len(self.doc)
            while at < len(spans) and spans[at][2] <= s:
                at += 1
            # spans of different kinds may overlap, so all that begin before the word's end are looked at
            label, k = 0, at
            while not label and k < len(spans) and spans[k][0] < e:
                label = spans[k][1] + 1 if spans[k][2] > s else 0
                k += 1
            around = [self._shape(text[slice(*words[j])]) if 0 <= j < len(words) else "" for j in (i - 1, i + 1)]
            self.doc.append(number)
            self.start.append(s)
            self.end.append(e)
            self.word.append(w)
            self.base.append(label)
            self.features.append(self._features(w, *around))
            if before == i - 1:
                self.chain.append((node - 1, node))
            before = i
            keys = self._keys(w)
            self.skip += [(other, node) for other in sorted({last[k] for k in keys if k in last})]  # each pair shares one potential
            last.update(dict.fromkeys(keys, node))

    def join(self, number: int, base: list[int], features: list[int], chain: list[int], skip: list[int]) -> None:
        """Adds a document by its labels, features and edges, without its words."""
        first, width = len(self.doc), len(features) // max(len(base), 1)
        self.doc += [number] * len(base)
        self.base += base
        self.features += [features[i : i + width] for i in range(0, len(features), width)]
        self.chain += [(first + a, first + b) for a, b in zip(chain[::2], chain[1::2])]
        self.skip += [(first + a, first + b) for a, b in zip(skip[::2], skip[1::2])]

    @staticmethod
    def _shape(w: str) -> str:
        return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", w))

    @staticmethod
    def _keys(w: str) -> list[str]:
        """What makes words similar: the bare word, and its digits if they are many."""
        bare = w.strip(".,;:!?\"'()[]<>").lower()
        digits = NOT_DIGIT.sub("", w)
        return [bare] + ([f"#{digits}"] if len(digits) >= 7 else [])

    def _features(self, w: str, left: str, right: str) -> list[int]:
        digits = NOT_DIGIT.sub("", w)
        n = len(digits)
        names = [
            "bias", f"shape {self._shape(w)}", f"left {left}", f"right {right}", f"digits {min(n, 20)}",
            f"at {w.count('@')}", f"dots {min(w.count('.'), 6)}", f"dashes {min(w.count('-'), 4)}",
            f"plus {w[:1] == '+'}", f"open {w[:1] == '('}", f"letters {any(map(str.isalpha, w))}",
            f"luhn {14 <= n <= 19 and luhn(digits)}", f"domain {'@' in w and '.' in w.rpartition('@')[2]}",
        ]
        return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % DIMENSIONS for x in names]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class SkipChainCRF:
    """Weights: node (features x labels), chain (label of the left word x of the right one), skip (symmetric)."""

    def __init__(self) -> None:
        y = len(KINDS) + 1
        self.node, self.chain, self.skip = np.zeros((DIMENSIONS, y)), np.zeros((y, y)), np.zeros((y, y))

    def fit(self, graph: Graph) -> "SkipChainCRF":
        """Maximises the pseudo-likelihood of the base labels by gradient steps with AdaGrad."""
        n, y = len(graph.doc), self.chain.shape[0]
        if not n:
            self.node[:, 0] = 1.0
            return self
        labels = np.array(graph.base)
        x = np.array(graph.features)
        chain = np.array(graph.chain, int).reshape(-1, 2)
        skip = np.array(graph.skip, int).reshape(-1, 2)
        hot = np.eye(y)[labels]
        moments = [np.full_like(w, 1e-2) for w in (self.node, self.chain, self.skip)]
        for _ in range(PASSES):
            s = self.node[x].sum(1)
            np.add.at(s, chain[:, 1], self.chain[labels[chain[:, 0]]])
            np.add.at(s, chain[:, 0], self.chain[:, labels[chain[:, 1]]].T)
            np.add.at(s, skip[:, 1], self.skip[labels[skip[:, 0]]])
            np.add.at(s, skip[:, 0], self.skip[labels[skip[:, 1]]])
            error = (hot - np.exp(s - _log_sum(s, 1)[:, None])) / n
            grads = [np.zeros_like(self.node), np.zeros_like(self.chain), np.zeros_like(self.skip)]
            np.add.at(grads[0], x.ravel(), np.repeat(error, x.shape[1], 0))
            np.add.at(grads[1], labels[chain[:, 0]], error[chain[:, 1]])
            np.add.at(grads[1].T, labels[chain[:, 1]], error[chain[:, 0]])
            np.add.at(grads[2], labels[skip[:, 0]], error[skip[:, 1]])
            np.add.at(grads[2], labels[skip[:, 1]], error[skip[:, 0]])
            grads[2] = (grads[2] + grads[2].T) / 2
            for w, g, m in zip((self.node, self.chain, self.skip), grads, moments):
                g -= DECAY * w
                m += g * g
                w += STEP * g / np.sqrt(m)
        return self

    def marginals(self, graph: Graph) -> np.ndarray:
        """Label marginals by loopy message passing; words that the patterns have labelled are given.

        Documents are parts of one graph that no edge joins. A document whose messages have settled takes no further part,
        so each gets as many rounds as it needs, and evidence reaches every mention however far away.
        """
        y = self.chain.shape[0]
        own = self.node[np.array(graph.features)].sum(1)
        base = np.array(graph.base)
        given = base > 0
        own[given] = -30.0
        own[given, base[given]] = 0.0
        chain = np.array(graph.chain, int).reshape(-1, 2)
        skip = np.array(graph.skip, int).reshape(-1, 2)
        source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        back = np.concatenate([np.arange(len(chain)) + len(chain), np.arange(len(chain)), 2 * len(chain) + len(skip) + np.arange(len(skip)), 2 * len(chain) + np.arange(len(skip))])
        table = np.stack([self.chain, self.chain.T, self.skip])
        kind = np.repeat([0, 1, 2], [len(chain), len(chain), 2 * len(skip)])
        messages = np.zeros((len(source), y))
        belief = own.copy()
        doc = np.array(graph.doc)
        of = doc[source] if len(source) else np.empty(0, int)
        active = np.arange(len(source))
        for _ in range(BP_ROUNDS):
            if not len(active):
                break
            out = belief[source[active]] - messages[back[active]]
            fresh = _log_sum(out[:, :, None] + table[kind[active]], 1)
            fresh -= _log_sum(fresh, 1)[:, None]
            fresh = DAMPING * messages[active] + (1 - DAMPING) * fresh
            change = np.abs(fresh - messages[active]).max(1)
            messages[active] = fresh
            touched = np.unique(target[active])
            belief[touched] = own[touched]
            np.add.at(belief, target[active], fresh)
            moving = np.unique(of[active][change > SETTLED])
            active = active[np.isin(of[active], moving)]
        return np.exp(belief - _log_sum(belief, 1)[:, None])


def added_spans(graph: Graph, marginals: np.ndarray, texts: list[str]) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of confidently labelled words that no pattern covers: (start, kind, end) per document.

    Words of one number that stand beside each other are one span; the punctuation around a span is not part of it.
    """
    out: dict[int, list[tuple[int, int, int]]] = {}
    best = marginals.argmax(1)
    sure = (best > 0) & (marginals.max(1) >= CERTAIN) & (np.array(graph.base) == 0)
    beside = {b for _, b in graph.chain}
    open_: tuple | None = None
    for i in np.flatnonzero(sure).tolist():
        k, d, s, e = int(best[i]) - 1, graph.doc[i], graph.start[i], graph.end[i]
        w = texts[d][s:e]
        e -= len(w) - len(w.rstrip(".,;:!?\"'>]"))
        s += len(w) - len(w.lstrip("\"'<[" if k == 3 else "\"'<[("))
        if s >= e:
            continue
        if k >= 2 and open_ == (i - 1, d, k) and i in beside:
            start = out[d][-1][0]
            out[d][-1] = (start, k, e)
        else:
            out.setdefault(d, []).append((s, k, e))
        open_ = (i, d, k)
    return out


def train(docs: DataFrame, most: int = TRAIN_DOCS) -> SkipChainCRF:
    """A model of the at most `most` documents with least hash among those of bounded size with a digit or an @.

    Ties in the hash are repeated rows, which count once.
    """
    mark = F.xxhash64("doc_id", "text")
    fit = docs.where(F.col("text").rlike("[0-9@]") & (F.octet_length("text") <= TRAIN_BYTES))
    marks = [r["m"] for r in fit.select(mark.alias("m")).distinct().orderBy("m").limit(most).collect()]
    graph = Graph()
    if marks:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for m, text in zip(batch["m"], batch["text"]):
                    one = Graph()
                    one.add(0, text, base_spans(text))
                    rows.append((m, one.base, [f for fs in one.features for f in fs], [i for e in one.chain for i in e], [i for e in one.skip for i in e]))
                yield pd.DataFrame(rows, columns=["m", "base", "features", "chain", "skip"])

        rows = fit.where(mark.isin(marks)).select(mark.alias("m"), "text").mapInPandas(run, "m long, base array<int>, features array<int>, chain array<int>, skip array<int>")
        for number, row in enumerate(sorted(rows.dropDuplicates(["m"]).collect(), key=lambda r: r["m"])):
            graph.join(number, row["base"], row["features"], row["chain"], row["skip"])
    return SkipChainCRF().fit(graph)


def find_personal_data(docs: DataFrame, model: SkipChainCRF | None = None) -> DataFrame:
    """Per document of docs(doc_id, text): n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are those of the patterns; spans lists theirs and the model's, as kind:start:end by start, in
    code points. Null and empty texts have none. A row per input row, none for an empty table; ids may be null or
    repeated; other columns are not read. A document's size is limited by memory only: everything here is linear in it.
    Where two labels are equally likely the first of email, ip, card, phone wins; spans of one start are told apart by
    that order too.
    """
    docs = docs.select("doc_id", "text")
    crf = model or train(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"].tolist()]
            graph, bases = Graph(), []
            for i, t in enumerate(texts):
                bases.append(base_spans(t))
                if HINT.search(t):
                    graph.add(i, t, bases[-1])
            extra = added_spans(graph, crf.marginals(graph), texts) if graph.doc else {}
            counts = [[sum(k == j for _, k, _ in b) for b in bases] for j in range(len(KINDS))]
            # a number that a pattern covers in part is the pattern's
            free = {d: [x for x in more if not any(s < x[2] and e > x[0] for s, _, e in bases[d])] for d, more in extra.items()}
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    **{f"n_{k}": c for k, c in zip(KINDS, counts)},
                    "base_sha256": [hashlib.sha256(render(b).encode()).hexdigest() for b in bases],
                    "spans": [render(sorted(b + free.get(i, []))) for i, b in enumerate(bases)],
                }
            )

    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    ddl = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return source.mapInPandas(run, ddl).withColumn("doc_id", F.col("doc_id").cast("long"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all `documents`."""
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
