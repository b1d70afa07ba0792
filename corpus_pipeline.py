"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's result is written as Parquet and read again as
the next one's docs. All but the last return the columns of `documents`, whatever further columns there are and whatever
their names: a stage carries them in a struct beside its own. An empty table gives an empty table in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from meshloom.llm.common import SPACE, columns_of, free_name, fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them. Repeated rows are judged alike."""
    return quality_rules.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay only where they come first; a document that is left without a word goes.

    So do null texts. The first place is that of the smallest id, null ids last; n_chars counts what is left of a text
    that has lost lines, and is the given one otherwise.
    """
    doc = free_name(docs.columns, "doc")
    inner = docs.select(F.struct(*columns_of(docs, ("text",))).alias(doc), "doc_id", "source", "text")
    cleaned = line_dedup.remove_spread_lines(inner).where(F.col("text").rlike(f"[^{SPACE}]"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col(doc).getField("n_chars"))}
    return cleaned.select(*[(new[c] if c in new else F.col(doc).getField(c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, null ids last, then by the text's hash.

    Rows that agree in id and text are one document: one of them stays. Documents without a word are in no group.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))
    found = ngram_join.near_duplicate_components(docs.select(key.alias("doc_id"), "text"))
    rank = F.struct(F.col("doc_id").startswith(":").alias("z"), F.expr("try_cast(substring_index(doc_id, ':', 1) AS BIGINT)").alias("i"), F.col("doc_id").alias("k"))
    stay = found.groupBy("component_id").agg(F.min(rank).alias("least")).select(F.col("least.k").alias("key"))
    keyed = docs.select(F.struct(*columns_of(docs)).alias("doc"), key.alias("key")).join(stay.hint("shuffle_hash"), "key", "left_semi")
    return keyed.dropDuplicates(["key"]).select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: whole passes, and one more with the chance of what is left.

    The chance is drawn from a hash of the document, so reruns agree. A document without words is in no mix and goes.
    Rows that agree in id and text are each taken equally often.
    """
    key = F.xxhash64("doc_id", "text")
    sized = docs.select(key.alias("doc_id"), "source", mixing.word_count(F.col("text")).alias("size"))
    share = mixing.taken_words(sized).where("taken > 0").groupBy("doc_id").agg(F.avg(F.col("taken") / F.col("size")).alias("share")).withColumnRenamed("doc_id", "key")
    copies = F.least(F.floor(F.col("share") + mixing.unit_draw(F.lit(mixing.SEED), F.lit("copies"), F.col("key"))).cast("int"), F.lit(mixing.MOST))
    keyed = docs.select(F.struct(*columns_of(docs)).alias("doc"), key.alias("key")).join(share.hint("shuffle_hash"), "key")
    return keyed.select("doc", copies.alias("n")).where("n > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("n")))).select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, a row per piece; a null text is its end token only."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The compression bands, the mix's draws and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = fresh_path(spark, "corpus-pipeline")
    for number, (name, stage) in enumerate(STAGES, 1):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{number}-{name}")
        docs = spark.read.parquet(f"{top}/{number}-{name}")
    return docs
