"""The training-data pipeline: quality, exact and near duplicates, benchmark leaks, then the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, exact, mixing, quality, shingles
from quadrille.llm.common import cut, plain_names, row_hash, stored

#: Keys of equal rows are broadcast up to so many (16 bytes each); a shuffle join takes them beyond.
SMALL = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, as junk or as toxic, go.

    Null and empty texts are judged as texts without words; equal rows stay or go together; without labels every row
    stays, and an empty table stays empty. Columns may have any name.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the longest, then that of the least id; of equal rows one.

    Null texts count as empty, so they and empty ones are one group. Columns may have any name.
    """
    return exact.dedup(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity of 5-word shingles 0.8 or more) stays, that of the least id.

    SimHash links of the shingles join what they reach; an exact join of shingle prefixes joins all else. Texts of any
    length are compared whole, and columns may have any name.
    """
    return shingles.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold test items of the benchmark go, each row by its own text, whatever its id.

    Null and empty texts hold none and stay; an empty benchmark removes nothing. Columns may have any name.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: rows with copies of 1 or more, and the words of all their copies.

    Rows meet their copies by id, null or not, and a hash of all columns; of equal rows the first get the most copies.
    Columns of documents may have any name; those named copies, taken or target give way to the stage's own.
    """
    out = ("copies", "taken", "target")
    kept = [c for c in docs.columns if c not in out]
    rows, (id_col, text_col, source_col), _ = plain_names(docs.select(*kept), "doc_id", "text", "source")
    keyed = rows.withColumn("__row", row_hash(rows))
    equal = Window.partitionBy("doc_id", "row").orderBy(F.desc("copies"))
    mix = mixing.mixture(keyed, id_col, text_col, source_col, row_col="__row").withColumn("rank", F.row_number().over(equal))
    mix = cut(mix.select(F.col("doc_id").alias("__id"), F.col("row").alias("__r"), F.col("rank").alias("__k"), *out))
    twice = cut(mix.filter("__k = 2").select("__id", "__r"))
    if not twice.isEmpty():  # only equal rows need ranks, so only they move for them
        few = F.broadcast(twice) if twice.count() <= SMALL else twice
        met = keyed[id_col].eqNullSafe(few["__id"]) & (keyed["__row"] == few["__r"])
        again = keyed.join(few, met, "left_semi").withColumn("__rank", F.row_number().over(Window.partitionBy(id_col, "__row").orderBy(id_col)))
        keyed = keyed.join(few, met, "left_anti").withColumn("__rank", F.lit(1)).union(again)
    else:
        keyed = keyed.withColumn("__rank", F.lit(1))
    taken = mix.filter("copies > 0")
    met = keyed[id_col].eqNullSafe(taken["__id"]) & (keyed["__row"] == taken["__r"]) & (keyed["__rank"] == taken["__k"])
    return keyed.join(taken, met).select(*rows.columns, *out).toDF(*kept, *out)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier has no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None
