"""What iterative operators share: rows written to the shared checkpoint folder, so that a step forgets its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, of spark.checkpoint.dir; an own one only for a local master that sets none."""
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def fresh_folder(spark: SparkSession) -> str:
    """A path in the shared folder that nothing else writes."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute now and keep the rows in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Compute now and keep the rows in the shared folder in buckets of the keys.

    Joins and grouped sums by exactly these keys then leave the rows where they are, however often they are read.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"dealt_{uuid.uuid4().hex}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", fresh_folder(spark)).saveAsTable(name)
    rows = spark.table(name)  # bound to the files, which stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return rows


def by_size(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The rows of groups of up to `most` rows, which one task may hold, and those of larger groups."""
    sizes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")))
    return tuple(rows.join(sizes.filter(c).select(*keys), keys, "left_semi") for c in (F.col("__size") <= most, F.col("__size") > most))
