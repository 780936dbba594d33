"""Queries of tile matching, blob points, approximate neighbours, flow groups and principal components."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import flow, matching, stats, tiles
from quadrille.plans.registry import query, table
from quadrille.plans.views import PIXEL_SQL, descriptors, pixels, tie_points


@query(
    "ncc_match",
    f"""WITH {PIXEL_SQL}, t AS (SELECT image_id AS k, row - 10 AS r, col - 20 AS c, value - avg(value) OVER (PARTITION BY image_id) AS v, stddev_pop(value) OVER (PARTITION BY image_id) AS sd FROM px WHERE row BETWEEN 10 AND 17 AND col BETWEEN 20 AND 27),
 s AS (SELECT (image_id + 9) % 10 AS k, row, col, value FROM px), o AS (SELECT r0, c0 FROM (SELECT unnest(range((SELECT max(row) FROM px))) AS r0), (SELECT unnest(range(57)) AS c0)),
 a AS (SELECT k, r0, c0, r0 + r AS row, c0 + c AS col, v, sd FROM t, o), j AS (SELECT a.k, r0, c0, sum(v * value) / 64 AS cc, stddev_pop(value) AS wd, max(sd) AS sd FROM a JOIN s ON s.k = a.k AND s.row = a.row AND s.col = a.col GROUP BY 1, 2, 3 HAVING count(*) = 64),
 n AS (SELECT k, r0, c0, CASE WHEN wd * sd > 1e-13 THEN cc / (wd * sd) ELSE 0 END AS score FROM j)
SELECT k AS image_id, r0 AS row, c0 AS col, round(score, 6) AS score FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(score, 12) DESC, r0, c0) = 1""",
)
def ncc_match(spark, sf):
    p = pixels(spark, sf).drop("band")
    template = p.filter(F.col("row").between(10, 17) & F.col("col").between(20, 27))
    search = p.withColumn("image_id", ((F.col("image_id") + 9) % 10).cast(p.schema["image_id"].dataType))
    return tiles.ncc_match(template, search, "image_id").withColumn("score", F.round("score", 6))


@query(
    "ncc_templates",
    f"""WITH {PIXEL_SQL}, p AS (SELECT image_id AS k, col // 16 AS part, row - 10 AS r, col % 16 - 4 AS c, value FROM px WHERE row BETWEEN 10 AND 17 AND col % 16 BETWEEN 4 AND 11),
 t AS (SELECT *, value - avg(value) OVER w AS v, stddev_pop(value) OVER w AS sd FROM p WINDOW w AS (PARTITION BY k, part)),
 s AS (SELECT (image_id + 9) % 10 AS k, row, col, value FROM px), o AS (SELECT r0, c0 FROM (SELECT unnest(range((SELECT max(row) FROM px))) AS r0), (SELECT unnest(range(57)) AS c0)),
 a AS (SELECT k, part, r0, c0, r0 + r AS row, c0 + c AS col, v, sd FROM t, o), j AS (SELECT a.k, part, r0, c0, sum(v * s.value) / 64 AS cc, stddev_pop(s.value) AS wd, max(sd) AS sd FROM a JOIN s ON s.k = a.k AND s.row = a.row AND s.col = a.col GROUP BY 1, 2, 3, 4 HAVING count(*) = 64),
 n AS (SELECT k, part, r0, c0, CASE WHEN wd * sd > 1e-13 THEN cc / (wd * sd) ELSE 0 END AS score FROM j)
SELECT k AS image_id, part, r0 AS row, c0 AS col, round(score, 6) AS score FROM n QUALIFY row_number() OVER (PARTITION BY k, part ORDER BY round(score, 12) DESC, r0, c0) = 1""",
)
def ncc_templates(spark, sf):
    """Four templates of each image, searched in tiles of the next image."""
    p = pixels(spark, sf).drop("band")
    template = p.filter(F.col("row").between(10, 17) & (F.col("col") % 16).between(4, 11)).withColumn("part", F.floor(F.col("col") / 16))
    search = p.withColumn("image_id", ((F.col("image_id") + 9) % 10).cast(p.schema["image_id"].dataType))
    return tiles.ncc_match(template, search, "image_id", "part", size=32).withColumn("score", F.round("score", 6))


@query("hessian_blobs")
def hessian_blobs(spark, sf):
    return tiles.hessian_blobs(pixels(spark, sf), 1e-7, 256, octaves=2)


@query("knn_approx")
def knn_approx(spark, sf):
    d = descriptors(spark, sf)
    return matching.knn_approx(d.filter("side = 0"), d.filter("side = 1"), ["pair_id"], 3, width=0.2)


@query("flow_groups")
def flow_groups(spark, sf):
    t = tie_points(spark, sf).select("pair_id", F.col("pt").alias("id"), "x", "y", "x2", "y2")
    return flow.flow_groups(t, ["pair_id"], 12.0)


@query("pca_bootstrap")
def pca_bootstrap(spark, sf):
    return stats.pca_bootstrap(table(spark, sf, "embeddings"), "embedding", "vec_id")


@query("pca_inverse", "SELECT vec_id, CAST(c AS INTEGER) AS col, round(CAST(embedding[c + 1] AS DOUBLE), 5) + 0.0 AS value FROM embeddings, (SELECT unnest(range(64)) AS c)")
def pca_inverse(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    model = stats.pca_fit(e, "v")
    back = stats.pca_inverse(stats.pca_transform(e, "v", model, 64), "principals", model)
    return back.select("vec_id", F.posexplode("restored").alias("col", "value")).withColumn("value", F.round("value", 5) + 0.0)
