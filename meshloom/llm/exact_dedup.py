"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A new batch is reduced to one candidate per digest, anti-joined with
the index by sort-merge (the index side is read in bucket order, without a shuffle), and what is new is appended. Only
digests, ids and lengths are ever shuffled, never texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.common import SPACE, durable, fresh_path, join_on_hot

SCHEMA = "digest BINARY, keep_id BIGINT, keep_chars BIGINT, members BIGINT, batch STRING"


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", ""), 256)


class DigestIndex:
    """A persistent index of the texts seen so far, one row per digest.

    `path` is a folder in shared storage; a later session opens the same index by giving it again. Each ingested batch
    either finishes its append or leaves the rows of an unfinished write job invisible to readers.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
            f"INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Takes the index out of the session's catalog; its files stay, and results that were handed out stay valid."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_id: str | None = None) -> DataFrame:
        """Deduplicate docs against the index and among themselves, append what is new, and return a row per document.

        Of equal new texts, the one with the most code points, then the smallest id (null last) stays. A digest that an
        earlier batch appended keeps that batch's document, so none of the new ones stays. group_size counts the rows of
        this batch and those of the batch that appended the digest. Rows that agree in id and length are one document:
        all of them are kept or dropped together. Texts of any length are digested whole where they are read; only digests
        move. Other columns are ignored, whatever their names; an empty input gives an empty result and appends nothing.

        A batch_id names the batch: if a job that fails after its append is run again with the same id and documents,
        the digests that it appended are its own, so nothing is appended twice and the result is that of one run. Without
        one each call is a batch of its own.

        Columns: doc_id, keep_id, group_size, kept, text_sha256.
        """
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = durable(
            docs.select(
                F.col(id_col).cast("long").alias("doc_id"),
                F.length(text).cast("long").alias("n_chars"),
                F.unhex(text_digest(F.col(text_col))).alias("digest"),
            )
        )
        best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i")))
        batch = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
        batch = batch.select("digest", F.col("best.i").alias("keep_id"), (-F.col("best.c")).alias("keep_chars"), F.col("n").alias("members"))
        name = batch_id or uuid.uuid4().hex
        new = batch.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(name))
        new.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        known = self.rows().withColumnsRenamed({"members": "known"})
        joined = batch.select("digest", "members").join(known.hint("merge"), "digest")
        mine = F.col("batch") == F.lit(name)
        classes = durable(
            joined.select(
                "digest", "keep_id", "members", mine.alias("new"), "keep_chars",
                F.when(mine, F.col("members")).otherwise(F.col("members") + F.col("known")).alias("group_size"),
            )
        )
        out = join_on_hot(rows, classes, "digest", "members", rows.count(), "inner")
        kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
        return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` as the first batch of a new index."""
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    out = index.ingest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    index.close()
    return out


ORACLE = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(n) OVER w AS keep_n,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size,
       (doc_id IS NOT DISTINCT FROM keep_id AND n = keep_n) AS kept, text_sha256
FROM g
"""
