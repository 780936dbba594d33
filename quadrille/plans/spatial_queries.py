"""Queries of the grid joins and point conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import nearest, points, spatial
from quadrille.plans.registry import query, table
from quadrille.plans.views import PIXEL_SQL, TIE_SQL, pixels, tie_points

BOXES = "SELECT {k} AS id, {k} * 37 % 1000 AS xmin, {k} * 91 % 700 AS ymin, {k} * 37 % 1000 + {k} % 23 AS xmax, {k} * 91 % 700 + {k} % 31 AS ymax FROM {t}"


def boxes(df, k):
    k = F.col(k)
    return df.select(k.alias("id"), (k * 37 % 1000).alias("xmin"), (k * 91 % 700).alias("ymin"), (k * 37 % 1000 + k % 23).alias("xmax"), (k * 91 % 700 + k % 31).alias("ymax"))


@query("footprint_join", f"WITH a AS ({BOXES.format(k='p_partkey', t='part')}), b AS ({BOXES.format(k='s_suppkey', t='supplier')}) SELECT a.id AS left_id, b.id AS right_id, greatest(a.xmin, b.xmin) AS xmin, greatest(a.ymin, b.ymin) AS ymin, least(a.xmax, b.xmax) AS xmax, least(a.ymax, b.ymax) AS ymax FROM a JOIN b ON a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax")
def footprint_join(spark, sf):
    return spatial.footprint_join(boxes(table(spark, sf, "part"), "p_partkey"), boxes(table(spark, sf, "supplier"), "s_suppkey"), 32)


KNN = f"{TIE_SQL}, s AS (SELECT pair_id, pt AS id, x, y FROM tie), j AS (SELECT a.pair_id, a.id AS left_id, b.id AS right_id, sqrt(power(a.x-b.x, 2) + power(a.y-b.y, 2)) AS d FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.id % 2 = 0 AND b.id % 2 = 1)"


def sides(spark, sf):
    s = tie_points(spark, sf).select("pair_id", F.col("pt").alias("id"), "x", "y")
    return s.filter("id % 2 = 0"), s.filter("id % 2 = 1")


@query("radius_join", f"WITH {KNN} SELECT pair_id, left_id, right_id, round(d, 6) AS d FROM j WHERE d <= 2.0")
def radius_join(spark, sf):
    return spatial.radius_join(*sides(spark, sf), ["pair_id"], 2.0).withColumn("d", F.round("d", 6))


@query("knn_spatial", f"WITH {KNN} SELECT pair_id, left_id, right_id, round(d, 6) AS d, row_number() OVER w AS rank FROM j WHERE d <= 3.0 WINDOW w AS (PARTITION BY pair_id, left_id ORDER BY d, right_id) QUALIFY row_number() OVER w <= 3")
def knn_spatial(spark, sf):
    return spatial.knn_spatial(*sides(spark, sf), ["pair_id"], 3.0, 3).withColumn("d", F.round("d", 6))


def _nearest_sql(d):
    return f"WITH {TIE_SQL}, s AS (SELECT pair_id, pt AS id, x, y FROM tie), j AS (SELECT a.pair_id, a.id AS left_id, b.id AS right_id, {d} AS d FROM s a JOIN s b ON a.pair_id = b.pair_id AND a.id % 2 = 0 AND b.id % 2 = 1) SELECT pair_id, left_id, right_id, round(d, 6) AS d, row_number() OVER w AS rank FROM j WINDOW w AS (PARTITION BY pair_id, left_id ORDER BY d, right_id) QUALIFY row_number() OVER w <= 3"


@query("k_nearest", _nearest_sql("sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))"))
def k_nearest(spark, sf):
    return nearest.k_nearest(*sides(spark, sf), ["pair_id"], 3).withColumn("d", F.round("d", 6))


@query("k_nearest_l1", _nearest_sql("abs(a.x-b.x) + abs(a.y-b.y)"))
def k_nearest_l1(spark, sf):
    return nearest.k_nearest(*sides(spark, sf), ["pair_id"], 3, norm=1).withColumn("d", F.round("d", 6))


@query("lookup_elevation", f"WITH {TIE_SQL}, {PIXEL_SQL}, dem AS (SELECT row, col, value FROM px WHERE image_id = 0) SELECT pair_id, pt, coalesce(value, -9.0) AS hgt FROM tie LEFT JOIN dem ON dem.row = floor(y) AND dem.col = floor(x)")
def lookup_elevation(spark, sf):
    dem = pixels(spark, sf).filter("image_id = 0")
    return spatial.lookup_elevation(tie_points(spark, sf), dem, -9.0).select("pair_id", "pt", "hgt")


@query("control_grid", "WITH s AS (SELECT s_suppkey AS id, s_suppkey % 7 AS ulx, s_suppkey % 5 AS uly, 1000 + s_suppkey AS w, 800 + s_suppkey AS h, 10.0 AS zmin, 10.0 + s_suppkey AS zmax FROM supplier) SELECT id AS scene_id, l AS level, i AS line, j AS sample, CAST(trunc((w - 1) * (j / 14.0) + ulx) AS INTEGER) AS x, CAST(trunc((h - 1) * (i / 14.0) + uly) AS INTEGER) AS y, round(zmin + l * (zmax - zmin) / 4, 6) AS z FROM s, (SELECT unnest(range(5)) AS l), (SELECT unnest(range(15)) AS i), (SELECT unnest(range(15)) AS j)")
def control_grid(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k.alias("scene_id"), (k % 7).alias("ulx"), (k % 5).alias("uly"), (1000 + k).alias("w"), (800 + k).alias("h"), F.lit(10.0).alias("zmin"), (10.0 + k).alias("zmax"))
    return spatial.control_grid(s, 5, 15, 15).withColumn("z", F.round("z", 6))


@query("kmeans_step", f"WITH {TIE_SQL}, c AS (SELECT s_suppkey AS k, s_suppkey * 13.0 AS cx, s_suppkey * 5.0 AS cy FROM supplier WHERE s_suppkey < 8), d AS (SELECT t.x, t.y, t.x2 - t.x AS dx, t.y2 - t.y AS dy, arg_min(k, struct_pack(d := (t.x-cx)*(t.x-cx) + (t.y-cy)*(t.y-cy), k := k)) AS k FROM tie t, c GROUP BY t.pair_id, t.pt, t.x, t.y, t.x2, t.y2) SELECT k, count(*) AS n, round(avg(x), 5) AS x, round(avg(y), 5) AS y, round(avg(dx), 5) AS dx, round(avg(dy), 5) AS dy FROM d GROUP BY k")
def kmeans_step(spark, sf):
    k = F.col("s_suppkey")
    centres = table(spark, sf, "supplier").filter("s_suppkey < 8").select(k.alias("k"), (k * 13.0).alias("cx"), (k * 5.0).alias("cy"))
    points = tie_points(spark, sf).select("x", "y", (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"))
    return spatial.kmeans_step(points, centres).select("k", "n", *[F.round(c, 5).alias(c) for c in ("x", "y", "dx", "dy")])


@query("target_grid", f"WITH a AS ({BOXES.format(k='p_partkey', t='part')}), g AS (SELECT floor(min(xmin)/7.0)*7.0 AS xmin, ceil(max(ymax)/7.0)*7.0 AS ymax, floor(min(ymin)/7.0)*7.0 AS ymin, ceil(max(xmax)/7.0)*7.0 AS xmax FROM a) SELECT xmin, ymin, xmax, ymax, 7.0::DOUBLE AS step_x, 7.0::DOUBLE AS step_y, CAST(round((xmax - xmin) / 7.0) AS BIGINT) AS cols, CAST(round((ymax - ymin) / 7.0) AS BIGINT) AS rows FROM g")
def target_grid(spark, sf):
    return spatial.target_grid(boxes(table(spark, sf, "part"), "p_partkey"), tr=7.0, align=True)


@query("kmeans_points")
def kmeans_points(spark, sf):
    """The clusters after Lloyd's loop has stopped; a test holds the loop to a plain version."""
    t = tie_points(spark, sf).select(F.xxhash64("pair_id", "pt").alias("id"), "x", "y", (F.col("x2") - F.col("x")).alias("dx"), (F.col("y2") - F.col("y")).alias("dy"))
    _, clusters, _ = spatial.kmeans_points(t, 4)
    return clusters


@query("target_extent", f"WITH a AS ({BOXES.format(k='p_partkey', t='part')}) SELECT floor(min(xmin)/30.0)*30.0 AS xmin, floor(min(ymin)/30.0)*30.0 AS ymin, ceil(max(xmax)/30.0)*30.0 AS xmax, ceil(max(ymax)/30.0)*30.0 AS ymax FROM a")
def target_extent(spark, sf):
    return spatial.target_extent(boxes(table(spark, sf, "part"), "p_partkey"), 30.0)


GEO = "SELECT c_custkey, (c_custkey * 37 % 36000) / 100.0 - 180 AS lon, (c_custkey * 91 % 16000) / 100.0 - 80 AS lat, c_acctbal / 10 AS hgt FROM customer"


@query("datum_shift", f"""WITH g AS ({GEO}), n AS (SELECT *, radians(lon) AS l, radians(lat) AS p, 6378137.0 AS a, 1/298.257223563 AS f FROM g),
 m AS (SELECT *, f*(2-f) AS e2, a*(1-f) AS b, a / sqrt(1 - f*(2-f)*sin(p)*sin(p)) AS n FROM n),
 x AS (SELECT *, (n+hgt)*cos(p)*cos(l) + 100.0 AS x, (n+hgt)*cos(p)*sin(l) - 50.0 AS y, (n*(1-e2)+hgt)*sin(p) + 25.0 AS z FROM m),
 t AS (SELECT *, sqrt(x*x+y*y) AS r, atan2(z*a, sqrt(x*x+y*y)*b) AS t FROM x),
 u AS (SELECT *, atan2(z + (e2/(1-e2))*b*power(sin(t), 3), r - e2*a*power(cos(t), 3)) AS u FROM t)
SELECT c_custkey, round(degrees(atan2(y, x)), 8) AS lon, round(degrees(u), 8) AS lat, round(r/cos(u) - a/sqrt(1 - e2*sin(u)*sin(u)), 4) + 0.0 AS hgt FROM u""")
def datum_shift(spark, sf):
    k = F.col("c_custkey")
    g = table(spark, sf, "customer").select(k, ((k * 37 % 36000) / 100.0 - 180).alias("lon"), ((k * 91 % 16000) / 100.0 - 80).alias("lat"), (F.col("c_acctbal") / 10).alias("hgt"))
    return spatial.datum_shift(g, 100.0, -50.0, 25.0).select("c_custkey", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"), (F.round("hgt", 4) + 0.0).alias("hgt"))


@query("ground_residuals", f"WITH g AS (SELECT c.c_nationkey AS image_id, g.* FROM customer c JOIN ({GEO}) g ON c.c_custkey = g.c_custkey), r AS (SELECT image_id, power((c_custkey % 7 - 3) * 1e-5 * 1e5 * cos(radians(lat)), 2) + power((c_custkey % 5 - 2) * 2e-5 * 1e5, 2) + power((c_custkey % 11 - 5) / 10.0, 2) AS s FROM g) SELECT image_id, count(*) AS n, round(sqrt(sum(s) / count(*)), 4) AS rmse, round(avg(sqrt(s)), 4) AS mean_error, round(max(sqrt(s)), 4) AS max_error FROM r GROUP BY ROLLUP (image_id)")
def ground_residuals(spark, sf):
    k = F.col("c_custkey")
    g = table(spark, sf, "customer").select(F.col("c_nationkey").alias("image_id"), k, ((k * 37 % 36000) / 100.0 - 180).alias("lon"), ((k * 91 % 16000) / 100.0 - 80).alias("lat"), (F.col("c_acctbal") / 10).alias("hgt"))
    modelled = g.withColumns({"mlon": F.col("lon") - (k % 7 - 3) * 1e-5, "mlat": F.col("lat") - (k % 5 - 2) * 2e-5, "mhgt": F.col("hgt") - (k % 11 - 5) / 10.0})
    found = points.residual_report(points.ground_residuals(modelled), "image_id", ("dx", "dy", "dz"))
    return found.select("image_id", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mean_error", "max_error")])
