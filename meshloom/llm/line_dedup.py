"""Removal of lines that spread over many sites.

Menus, notices and licences stand on the pages of many sites; a line that one site repeats is that site's own affair.
Per line hash a HyperLogLog sketch of the sites is built on the map side and merged by aggregation, so a line in a third
of all documents costs one sketch per task. A sketch's estimate decides where it is far from the threshold; lines whose
estimate is near it get an exact distinct count. Texts are moved once, to meet the places of lines to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm.common import columns_of, durable, free_name, join_on_hot

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 5
#: Sketches have 2**LG_K registers; the relative standard error is 1.04 / 2**(LG_K / 2).
LG_K = 12
#: Estimates within this share of the threshold are counted exactly; over six standard errors.
NEAR = 0.1


def with_lines(docs: DataFrame) -> DataFrame:
    """docs(row, site, text) -> a row per line that has a word: row, site, pos, line (128-bit hash of it, trimmed)."""
    lines = docs.select("row", "site", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    trimmed = lines.withColumn("raw", F.btrim("raw", F.lit(" \t\n\v\f\r"))).where("raw <> ''")
    return trimmed.select("row", "site", "pos", F.unhex(F.md5("raw")).alias("line"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, near: float = NEAR) -> DataFrame:
    """Lines on at least min_sites distinct sites: line, places (how many), first (the place with the smallest row, pos).

    A null site counts as no site.
    """
    sketch = lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.count(F.lit(1)).alias("places"), F.min(F.struct("row", "pos")).alias("first"))
    found = durable(sketch.where(F.col("places") >= min_sites).select("line", "places", "first", F.hll_sketch_estimate("sites").cast("double").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - near)))
    sure = found.where(F.col("estimate") > min_sites * (1 + near))
    unsure = found.where(F.col("estimate") <= min_sites * (1 + near))
    pairs = lines.select("line", "site").where(F.col("site").isNotNull()).distinct()
    exact = pairs.join(unsure.select("line"), "line", "left_semi").groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(unsure.join(exact.select("line"), "line", "left_semi")).drop("estimate")


def remove_spread_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id", min_sites: int = MIN_SITES, keep_first: bool = True) -> DataFrame:
    """docs with boilerplate lines taken out of text_col, and n_lines and n_removed.

    Lines are equal when they are after trimming; lines without a word are never removed. With keep_first, the place
    with the smallest id (null last, then a hash of the text), then line number, keeps the line, so a document that many
    sites copy whole is not lost. A null text has no lines and stays null, an empty one has one; an empty table gives an
    empty result. Texts of any length are read whole, and what is removed of one is found in time linear in its lines.
    Repeated rows are treated alike. All columns of docs are returned, whatever their names, but for columns named
    n_lines or n_removed, which give way to the results. No document is dropped, even if nothing is left of its text.
    """
    row = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).cast("long").alias("i"), F.xxhash64(F.col(text_col)).alias("h"))
    # the user's columns travel in a struct, so their names can't clash with the names here
    doc = free_name(docs.columns, "doc")
    keyed = docs.select(F.struct(*columns_of(docs, ("n_lines", "n_removed"))).alias(doc), row.alias("row"))
    whole = F.col(doc).getField(text_col)
    # hashes and places only: splitting and hashing the texts is most of the work, so it is done once
    lines = durable(with_lines(keyed.select("row", F.col(doc).getField(site_col).cast("string").alias("site"), whole.alias("text"))))
    spread = durable(spread_lines(lines, min_sites))
    total = lines.count()
    hits = join_on_hot(lines.select("row", "pos", "line"), spread, "line", "places", total, "inner")
    if keep_first:
        hits = hits.where(F.struct("row", "pos") != F.col("first"))
    # a null field makes a struct key null-unsafe to join on, so the key's parts are joined without nulls
    key = [F.col("row.z").alias("z"), F.coalesce("row.i", F.lit(0)).alias("i"), F.coalesce("row.h", F.lit(0)).alias("h")]
    gone = hits.select(*key, "pos").groupBy("z", "i", "h").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    parts = F.split(whole, "\n")
    out = keyed.select(doc, *key).join(gone.hint("shuffle_hash"), ["z", "i", "h"], "left")
    # what stays are the slices between removed lines: linear in the number of lines
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(parts)))
    slices = F.transform(F.sequence(F.lit(1), F.size("gone") + 1), lambda j: F.slice(parts, F.element_at(edges, j) + 2, F.element_at(edges, j + 1) - F.element_at(edges, j) - 1))
    text = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(F.flatten(slices), "\n"))
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    cleaned = [(text if c.lower() == text_col.lower() else F.col(doc).getField(c)).alias(c) for c in names]
    n_lines = F.when(whole.isNull(), F.lit(0)).otherwise(F.size(parts)).cast("long")
    return out.select(*cleaned, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of `documents`, with what is left of its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_spread_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_left"))


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, u.pos, u.raw, regexp_replace(u.raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line
  FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(raw, pos)),
s AS (
  SELECT line, count(DISTINCT source) AS sites, min((doc_id, pos)) AS first
  FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (
  SELECT l.doc_id, l.pos, l.raw, s.line IS NULL OR (l.doc_id, l.pos) = s.first AS stays
  FROM l LEFT JOIN s ON l.line = s.line),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (stays), '') AS t
  FROM k GROUP BY doc_id)
SELECT o.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(t) AS text_sha256, length(t) AS n_left
FROM documents o LEFT JOIN d ON o.doc_id = d.doc_id
"""
