"""Quality rules by compression bands.

A text that zstandard shrinks very much repeats itself; one that it hardly shrinks is noise. How far ordinary prose
shrinks depends on its length, so each band of lengths has limits of its own. Whole texts are measured, and so is every
fixed-size chunk, the last one being the text's last bytes, which finds a bad stretch inside a long document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meshloom.llm.common import free_name

#: Symbols that the base rule counts (fixed values).
SYMBOLS = b"#*$%&|<>"
#: (bytes from, lowest and highest original/compressed ratio of the whole text). Short texts give zstandard nothing to
#: refer to, so their ratio is near 1 whatever they hold; prose shrinks by 1.5 to
#: 2.5 times at a few KB and by 2 to 4 times beyond; base64 stays at 1.3, repeated lines or words go beyond the highest.
BANDS = ((0, 0.0, 3.0), (256, 1.15, 4.0), (1024, 1.35, 4.5), (4096, 1.5, 5.0), (16384, 1.6, 6.0), (65536, 1.65, 7.0))
#: Chunks of this many bytes are measured by themselves when the text has more.
CHUNK_BYTES = 4096
#: Lowest and highest ratio of a chunk. A text fails if more than this share of its bytes lies in chunks outside, or
#: this many bytes on end do.
CHUNK_BAND = (1.35, 5.0)
CHUNK_SHARE = 0.1
CHUNK_RUN = 2 * CHUNK_BYTES

FIELDS = (("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64()))


def repeated_words(words: list) -> int:
    """Word positions that lie in a 3-word window which the text has at least twice, all its occurrences counted."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def bands_ok(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[bool, float, int, int]:
    """The verdict of the compression bands: (passes, ratio of the whole, chunks outside, chunks)."""
    if not raw:
        return False, 0.0, 0, 0
    _, low, high = next(b for b in reversed(BANDS) if len(raw) >= b[0])
    ratio = len(raw) / len(compressor.compress(raw))
    if len(raw) <= CHUNK_BYTES:
        return low <= ratio <= high, ratio, 0, 0
    last = len(raw) - CHUNK_BYTES
    starts = [*range(0, last, CHUNK_BYTES), last]
    bad = [s for s in starts if not CHUNK_BAND[0] <= CHUNK_BYTES / len(compressor.compress(raw[s : s + CHUNK_BYTES])) <= CHUNK_BAND[1]]
    total = longest = run = end = 0
    for s in bad:  # the last chunk may overlap the one before: bytes count once
        run = run + s + CHUNK_BYTES - end if s <= end and run else CHUNK_BYTES
        total += s + CHUNK_BYTES - max(s, end)
        longest, end = max(longest, run), s + CHUNK_BYTES
    good = total <= CHUNK_SHARE * len(raw) and longest < CHUNK_RUN
    return low <= ratio <= high and good, ratio, len(bad), len(starts)


def measure(text: str | None, compressor: zstandard.ZstdCompressor) -> tuple:
    """All of FIELDS for one text; a null or empty text has no words and fails."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes are split at exactly the contract's white space
    spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    lines = Counter(line for line in raw.split(b"\n") if line.split(None, 1))
    repeats = repeated_words(words)
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    good, ratio, bad, chunks = bands_ok(raw, compressor)
    symbols = sum(raw.count(bytes((s,))) for s in SYMBOLS)
    return len(words), len(text) - spaces, symbols, sum(lines.values()) - len(lines), repeats, failed, good and not failed, ratio, bad, chunks


def add_quality(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with the quality fields.

    Every document gets a row, a repeated one as many rows; an empty table gives none. Null and empty texts have no words
    and fail; texts of any length are measured whole. Other columns are not read, so their names don't matter; a column
    of `keep` that is named like a field gives way to it. There is no shuffle: each document is judged by itself.
    """
    fields = {name for name, _ in FIELDS}
    keep = tuple(c for c in keep if c.lower() not in fields)
    kept = docs.select(*[f"`{c}`" for c in keep])
    source = free_name(keep, "text")
    kinds = {pa.int64(): T.LongType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType()}
    schema = T.StructType([*kept.schema, *[T.StructField(name, kinds[kind]) for name, kind in FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows = [measure(t, compressor) for t in table.column(source).to_pylist()]
            table = table.drop_columns([source])
            for (name, kind), values in zip(FIELDS, list(zip(*rows)) if rows else [[] for _ in FIELDS]):
                table = table.append_column(name, pa.array(values, kind))
            yield from table.to_batches()

    return docs.select(*[f"`{c}`" for c in keep], docs[text_col].alias(source)).mapInArrow(run, schema)


def passing(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text passes; cases are those of add_quality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=3)
        verdict = [name for name, _ in FIELDS].index("kept")
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([measure(t, compressor)[verdict] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents` with its measures and verdict."""
    return add_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
