"""Ask-and-answer over packed chunks: look up millions of distinct keys per chunk of documents without a row per key.

Documents stay where they are read. Each scan task groups them into chunks of bounded size and sends, per bucket of the
key space, one packed row with the chunk's distinct keys. A bucket merges what all chunks sent, so every key meets in
one place whatever chunk it came from, and answers each chunk with one packed row in the order of the keys asked. The
answers then meet the chunk's documents again. A key that a third of all documents hold is sent once per chunk, so no
bucket grows with the frequency of a key.

A chunk is named by the scan partition and its place in it, with a hash of its ids and texts: a scan that deals documents
out otherwise than an earlier one is noticed and fails instead of mixing up answers.

There are chunks times buckets packed rows, so the sizes of both grow with the square root of the corpus once that is
large (see Sizes): rows then stay in proportion to the corpus, and so does the number of tasks, but for the square root.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, and behind a bucket, at least.
CHUNK_BYTES = BUCKET_BYTES = 8 << 20
#: A chunk's bytes times a bucket's are this many times the corpus's bytes at least, so that a packed row isn't tiny.
ROW_SHARE = 200


@dataclass(frozen=True)
class Sizes:
    """How a corpus is cut: bytes of text in a chunk, and buckets of the key space.

    A bucket's task holds what all chunks ask of it, so buckets follow from the corpus's bytes, not from the session. 30
    GB are chunks and buckets of 8 MB, 100 TB of 140 MB.
    """

    chunk_bytes: int
    buckets: int


def sizes_for(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> Sizes:
    """Sizes for docs(text): one aggregate over the text's lengths, and at least a bucket for each shuffle partition."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = math.isqrt(ROW_SHARE * total)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // max(bucket_bytes, least)))
    return Sizes(max(chunk_bytes, least), max(1, buckets))


def pack(a: np.ndarray) -> bytes:
    """An integer array, its bytes dealt into planes and compressed; equal high bytes cost almost nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(a.dtype.char.encode() + planes)


def unpack(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    kind = np.dtype(raw[:1].decode())
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind) if planes.size else np.empty(0, kind)


def pack_sorted(a: np.ndarray) -> bytes:
    """A sorted array of unsigned integers, as packed differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def pack_texts(texts: list) -> bytes:
    """Texts, as str or UTF-8 bytes."""
    raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.array([len(r) for r in raw], np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(raw)).tobytes() + lengths.tobytes() + b"".join(raw))


def unpack_texts(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    return [raw[b:e] for b, e in zip(np.concatenate([[4 + 4 * n], ends[:-1]]).tolist() if n else [], ends.tolist())]


class Chunk:
    """Documents of one chunk: ids as text (None where null), texts ('' where null), and the texts' bytes."""

    def __init__(self, key: str, ids: list, texts: list[str], raw: list[bytes]) -> None:
        self.key, self.ids, self.texts, self.raw = key, ids, texts, raw


def chunks_of(batches: Iterator[pd.DataFrame], chunk_bytes: int) -> Iterator[Chunk]:
    """The chunks of one scan partition, in order; a chunk closes with the document that fills it."""
    part, seq, ids, texts, raw, size, seen = TaskContext.get().partitionId(), 0, [], [], [], 0, xxhash.xxh3_64()
    for batch in batches:
        for i, t in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
            t = t if isinstance(t, str) else ""
            i = i if isinstance(i, str) else None
            ids.append(i)
            texts.append(t)
            raw.append(t.encode("utf-8", "surrogatepass"))
            size += len(raw[-1])
            seen.update(f"{i}:{len(raw[-1])};".encode())
            seen.update(raw[-1])
            if size >= chunk_bytes:
                yield Chunk(f"{part}.{seq}.{seen.hexdigest()}", ids, texts, raw)
                seq, ids, texts, raw, size, seen = seq + 1, [], [], [], 0, xxhash.xxh3_64()
    if ids:
        yield Chunk(f"{part}.{seq}.{seen.hexdigest()}", ids, texts, raw)


def scan_chunks(docs: DataFrame, run: Callable[[Chunk], Iterator[tuple]], ddl: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows that run gives for each chunk of docs(doc_id, text); ids of any type go as text."""
    names = [part.strip().split()[0] for part in ddl.split(",")]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks_of(batches, chunk_bytes):
            for row in run(chunk):
                yield pd.DataFrame([row], columns=names)

    # ids as text: pandas would turn a column with nulls into floats and lose digits
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("text")).mapInPandas(over, ddl)


def answers(asked: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    """answer applied to all rows of each bucket; asked has columns bucket and chunk."""
    return asked.groupBy("bucket").applyInPandas(answer, ddl)


def meet(packed: DataFrame, answered: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    """run(documents of a chunk, answers to that chunk) for each chunk; a chunk without documents is an error."""

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) != 1:
            raise RuntimeError(f"{len(left)} rows of documents for a chunk: the scan dealt documents out in another way")
        return run(left, right)

    return packed.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(both, ddl)


def pack_ids(ids: list) -> bytes:
    """Document ids as text, with nulls."""
    return pack_texts(["" if i is None else f"={i}" for i in ids])


def unpack_ids(blob: bytes) -> list:
    return [i[1:].decode("utf-8", "surrogatepass") if i else None for i in unpack_texts(blob)]
