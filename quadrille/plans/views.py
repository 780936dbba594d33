"""Point, descriptor and pixel tables derived from the driver's tables, with the same definitions as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.plans.registry import table

#: The planted similarity of tie_points: x2 = A0 x + A1 y + A2, y2 = -A1 x + A0 y + A3.
A0, A1, A2, A3 = 0.9, 0.2, 5.0, -3.0


def tie_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, pt, x, y, x2, y2, score: a planted similarity, with a tenth of the points moved far away."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    x, y = F.col("l_extendedprice") / 1000, F.col("l_quantity")
    out = F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10 == 0, 1.0).otherwise(0.0)
    return li.select(
        F.col("l_suppkey").alias("pair_id"), (F.row_number().over(order) - 1).cast("long").alias("pt"), x.alias("x"), y.alias("y"),
        (A0 * x + A1 * y + A2 + 500 * out).alias("x2"), (-A1 * x + A0 * y + A3 - 300 * out).alias("y2"), (F.col("l_partkey") % 97).alias("score"),
    )


TIE_SQL = f"""tie AS (
  SELECT l_suppkey AS pair_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pt,
         l_extendedprice / 1000 AS x, l_quantity AS y,
         {A0} * (l_extendedprice / 1000) + {A1} * l_quantity + {A2} + 500 * (CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 = 0 THEN 1.0 ELSE 0.0 END) AS x2,
         {-A1} * (l_extendedprice / 1000) + {A0} * l_quantity + {A3} - 300 * (CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 = 0 THEN 1.0 ELSE 0.0 END) AS y2,
         l_partkey % 97 AS score
  FROM lineitem)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, band, row, col, value: the embeddings of a label are the rows of an image."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.withColumn("row", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    return rows.select(F.col("label").alias("image_id"), F.lit(0).alias("band"), "row", F.posexplode("embedding").alias("col", "value")).withColumns({"col": F.col("col").cast("long"), "value": F.col("value").cast("double")})


PIXEL_SQL = """px AS (
  SELECT image_id, 0 AS band, row, CAST(c AS BIGINT) AS col, CAST(embedding[c + 1] AS DOUBLE) AS value
  FROM (SELECT label AS image_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, embedding FROM embeddings),
       (SELECT unnest(range(64)) AS c))"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, side, kp_id, descr, x, y: odd and even vectors of a label are the two images of a pair."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("pair_id"), (F.col("vec_id") % 2).alias("side"), F.col("vec_id").alias("kp_id"), F.col("embedding").cast("array<double>").alias("descr"), (F.col("vec_id") % 17).cast("double").alias("x"), (F.col("vec_id") % 23).cast("double").alias("y"))


DESCR_SQL = """de AS (
  SELECT label AS pair_id, vec_id % 2 AS side, vec_id AS kp_id, CAST(embedding AS DOUBLE[64]) AS descr,
         CAST(vec_id % 17 AS DOUBLE) AS x, CAST(vec_id % 23 AS DOUBLE) AS y FROM embeddings)"""


#: The second camera of epipolar_points: turned by THETA in the plane and moved by (TX, TY, TZ).
COS, SIN, TX, TY, TZ = 0.96, 0.28, 30.0, 20.0, 0.2


def epipolar_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, pt, x, y, x2, y2: points of some depth in two cameras, half of them moved by different ways."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    x, y, z = F.col("l_extendedprice") / 1000, F.col("l_quantity").cast("double"), 1 + F.col("l_partkey") % 97 / 97
    moved = F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10 < 5, 1.0).otherwise(0.0)
    u = (COS * x * z - SIN * y * z + TX) / (z + TZ) + moved * (40 + F.col("l_partkey") * 37 % 211)
    v = (SIN * x * z + COS * y * z + TY) / (z + TZ) - moved * (25 + F.col("l_partkey") * 91 % 173)
    return li.select(F.col("l_suppkey").alias("pair_id"), (F.row_number().over(order) - 1).cast("long").alias("pt"), x.alias("x"), y.alias("y"), u.alias("x2"), v.alias("y2"))


EPIPOLAR_SQL = f"""sc AS (
  SELECT l_suppkey AS pair_id, l_extendedprice / 1000 AS x, CAST(l_quantity AS DOUBLE) AS y, 1 + l_partkey % 97 / 97.0::DOUBLE AS z, l_partkey,
         CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS moved FROM lineitem),
ep AS (
  SELECT pair_id, x, y, ({COS} * x * z - {SIN} * y * z + {TX}) / (z + {TZ}) + moved * (40 + l_partkey * 37 % 211) AS x2,
         ({SIN} * x * z + {COS} * y * z + {TY}) / (z + {TZ}) - moved * (25 + l_partkey * 91 % 173) AS y2 FROM sc),
li AS (
  SELECT *, {-TZ * SIN} * x + {-TZ * COS} * y + {TY} AS r0, {TZ * COS} * x + {-TZ * SIN} * y + {-TX} AS r1,
         {TX * SIN - TY * COS} * x + {TX * COS + TY * SIN} * y AS r2,
         {-TZ * SIN} * x2 + {TZ * COS} * y2 + {TX * SIN - TY * COS} AS l0, {-TZ * COS} * x2 + {-TZ * SIN} * y2 + {TX * COS + TY * SIN} AS l1 FROM ep)"""
