"""Token counts by distinct pre-token.

A document is a bag of pre-tokens, so its token count is the sum over them of frequency times pieces. Each chunk of
documents asks once for each of its distinct pre-tokens; a bucket of the pre-token space encodes every distinct one
once, whatever number of chunks asked, and answers with the numbers of pieces; ids are never kept or moved.

Texts are first cut at spaces into units (see tokens.units), which most texts share, and each distinct unit of a chunk is
cut into pre-tokens once. Merges never cross a pre-token's ends, so the sum is exactly what the library gives for the
whole text. For a tokenizer file whose pre-tokens aren't those of byte-level BPE a whole text is one pre-token.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.chunked import Chunk, answers, meet, pack, pack_ids, pack_texts, scan_chunks, sizes_for, unpack, unpack_ids, unpack_texts
from meshloom.llm.tokens import cutter, default_path, piece_counts, units

DDL = "doc_id string, n_bytes long, n_tokens long, over_limit boolean"
#: Larger than elsewhere: a chunk then repeats fewer of its neighbours' pre-tokens.
CHUNK_BYTES = 16 << 20


class Vocabulary:
    """A chunk's distinct units and pre-tokens in order of appearance, and its documents' bags of units."""

    def __init__(self, chunk: Chunk, path: str) -> None:
        cut = cutter(path)
        self.places: dict[str, int] = {}
        self.bags = [self._bag(text, cut is not None) for text in chunk.texts]
        #: Pre-tokens of unit u: parts[ends[u - 1] : ends[u]], as places in `tokens`.
        self.tokens: dict[str, int] = {}
        parts, ends = [], []
        for u in self.places:
            for t in cut(u) if cut else [u]:
                parts.append(self.tokens.setdefault(t, len(self.tokens)))
            ends.append(len(parts))
        self.parts, self.ends = np.array(parts, np.uint32), np.array(ends, np.uint32)

    def _bag(self, text: str, by_space: bool) -> Counter:
        head, *rest = units(text) if by_space else [text]
        bag = Counter([" " + u for u in rest])
        if head:
            bag[head] += 1
        for u in bag:
            self.places.setdefault(u, len(self.places))
        return bag


def _bucket(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % buckets


def count_tokens(docs: DataFrame, limit: int = 512, tokenizer_path: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document of docs(doc_id, text): n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    A null text counts as empty and has no tokens. Every input row gives one row, a repeated one as many; ids may be
    null. Texts of any length are counted whole; one that is longer than a chunk is a chunk by itself. An empty table
    gives an empty result. Other columns are not read. tokenizer_path, a tokenizers (.json) or sentencepiece (.model)
    file, must exist on the executors.
    """
    path = tokenizer_path or default_path()
    docs = docs.select("doc_id", "text")
    sizes = sizes_for(docs, chunk_bytes)
    chunk_bytes, buckets = sizes.chunk_bytes, sizes.buckets

    def keep(chunk: Chunk) -> Iterator[tuple]:
        v = Vocabulary(chunk, path)
        at = np.array([v.places[u] for bag in v.bags for u in bag], np.uint32)
        times = np.array([n for bag in v.bags for n in bag.values()], np.uint32)
        bytes_of = np.array([len(raw) for raw in chunk.raw], np.uint64)
        where = np.array([_bucket(t, buckets) for t in v.tokens], np.uint32)
        yield chunk.key, pack_ids(chunk.ids), pack(bytes_of), pack(np.array([len(b) for b in v.bags], np.uint32)), pack(at), pack(times), pack(v.parts), pack(v.ends), pack(where)

    def ask(chunk: Chunk) -> Iterator[tuple]:
        by: dict[int, list[str]] = {}
        for t in Vocabulary(chunk, path).tokens:
            by.setdefault(_bucket(t, buckets), []).append(t)
        for b, ts in by.items():
            yield b, chunk.key, pack_texts(ts)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [[t.decode("utf-8", "surrogatepass") for t in unpack_texts(blob)] for blob in rows["tokens"]]
        distinct = list({t: None for ts in asked for t in ts})
        pieces: dict[str, int] = {}
        for i in range(0, len(distinct), 20_000):
            part = distinct[i : i + 20_000]
            pieces.update(zip(part, piece_counts(part, path)))
        out = [pack(np.array([pieces[t] for t in ts], np.uint32)) for ts in asked]
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "pieces": out})

    def total(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        where, parts, ends, at, times, n = (unpack(row[c]) for c in ("where", "parts", "ends", "at", "times", "n"))
        pieces = np.zeros(len(where), np.int64)
        for b, blob in zip(right["bucket"], right["pieces"]):
            pieces[where == b] = unpack(blob)
        upto = np.concatenate([[0], np.cumsum(pieces[parts])])[ends]
        of_unit = np.diff(upto, prepend=0)
        last = np.cumsum(n, dtype=np.int64)
        sums = np.concatenate([[0], np.cumsum(of_unit[at] * times.astype(np.int64))])
        tokens = sums[last] - sums[last - n.astype(np.int64)]
        return pd.DataFrame({"doc_id": unpack_ids(row["ids"]), "n_bytes": unpack(row["sizes"]).astype(np.int64), "n_tokens": tokens, "over_limit": tokens > limit})

    kept = scan_chunks(docs, keep, "chunk string, ids binary, sizes binary, n binary, at binary, times binary, parts binary, ends binary, where binary", chunk_bytes)
    asked = scan_chunks(docs, ask, "bucket int, chunk string, tokens binary", chunk_bytes)
    out = meet(kept, answers(asked, answer, "chunk string, bucket int, pieces binary"), total, DDL)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all `documents`."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
