"""Exact dedup: two-pass Bloom filtering, then a shuffle of the possibly repeated hashes only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import SPACES, bloom, bloom_bits, cut, join_groups, probe


def normalised(text: Column) -> Column:
    """The text without the characters that count as white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    sha = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    return docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n"), sha.alias("sha"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Pass one counts the cells of a Bloom filter over the digests' hashes: a few bytes of each row move, summed
    before they do. Pass two asks which rows may be repeated; only these are grouped by digest, all others are
    their own group at once. Of equal texts the row with the most code points stays, then the smallest id.

    Null text counts as empty, and so all empty and null texts are one group. A null id loses against any other
    id of the same length. Rows that repeat an id with an equal text are all marked kept if that id is. Other
    columns, whatever their names, are not looked at. An empty table gives an empty one.
    """
    rows = cut(_digests(docs, id_col, text_col).withColumn("h", F.xxhash64("sha")))
    n = rows.count()
    bits = bloom_bits(n)
    marked = cut(probe(rows, "h", bloom(rows, "h", bits, repeated=True), bits, "maybe"))
    alone = marked.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
    maybe = marked.filter("maybe").select("doc_id", "n", "sha")
    order = F.struct((-F.col("n")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id")
    groups = cut(maybe.groupBy("sha").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")).select("sha", F.col("first.doc_id").alias("keep_id"), "group_size"))
    met = join_groups(maybe, groups, "sha", "group_size", n).select("doc_id", "keep_id", "group_size", "sha")
    return alone.unionByName(met).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; exactly one of each group, repeated rows included.

    Rows that the Bloom filter clears don't shuffle. The others meet by digest; Spark's top-1 window drops all
    but one row of a digest in each task before the shuffle, so hot groups don't travel. Columns of any name are kept.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # so that no name of the caller's clashes
    text, row_id = F.col(names[text_col]), F.col(names[id_col])
    rows = docs.select(*[F.col(c).alias(k) for c, k in names.items()]).withColumn("sha", F.sha2(normalised(text), 256)).withColumn("h", F.xxhash64("sha"))
    hashes = cut(rows.select("h"))
    bits = bloom_bits(hashes.count())
    filter_ = cut(bloom(hashes, "h", bits, repeated=True))
    marked = probe(rows, "h", filter_, bits, "maybe")
    first = F.row_number().over(Window.partitionBy("sha").orderBy(F.length(F.coalesce(text, F.lit(""))).desc(), row_id.asc_nulls_last()))
    best = marked.filter("maybe").withColumn("first", first).filter("first = 1")
    kept = marked.filter("not maybe").select(*names.values()).unionByName(best.select(*names.values()))
    return kept.select(*[F.col(k).alias(c) for c, k in names.items()])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM w"""
}
