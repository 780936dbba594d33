"""Queries of the raster, matching, statistics and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.functions import text
from quadrille.operators import matching, raster
from quadrille.plans.registry import query, table
from quadrille.plans.views import DESCR_SQL, PIXEL_SQL, descriptors, pixels

P = "image_id, band, row, col"
COLS = P.split(", ")


def out(df, digits=6):
    return df.select(*COLS, (F.round("value", digits) + 0.0).alias("value"))


ROWW, COLW = "PARTITION BY image_id, band, row ORDER BY col", "PARTITION BY image_id, band, col ORDER BY row"


@query("integral_image", f"WITH {PIXEL_SQL}, r AS (SELECT *, sum(value) OVER ({ROWW}) AS a, sum(value*value) OVER ({ROWW}) AS b FROM px) SELECT {P}, round(sum(a) OVER ({COLW}), 5) + 0.0 AS s, round(sum(b) OVER ({COLW}), 5) + 0.0 AS s2 FROM r")
def integral_image(spark, sf):
    return raster.integral_image(pixels(spark, sf)).select(*COLS, (F.round("s", 5) + 0.0).alias("s"), (F.round("s2", 5) + 0.0).alias("s2"))


@query("box_stats", f"WITH {PIXEL_SQL}, b AS (SELECT p_partkey AS box_id, p_partkey % 10 AS image_id, 0 AS band, p_partkey % 20 AS r0, p_partkey % 30 AS c0, p_partkey % 20 + 5 AS r1, p_partkey % 30 + 50 AS c1 FROM part) SELECT box_id, round(greatest(0.0, sum(value)), 5) + 0.0 AS total, round(avg(value), 5) + 0.0 AS mean, round(stddev_pop(value), 5) AS std FROM b JOIN px p ON p.image_id = b.image_id AND p.row BETWEEN r0 AND r1 AND p.col BETWEEN c0 AND c1 GROUP BY box_id")
def box_stats(spark, sf):
    k = F.col("p_partkey")
    boxes = table(spark, sf, "part").select(k.alias("box_id"), (k % 10).cast("int").alias("image_id"), F.lit(0).alias("band"), (k % 20).alias("r0"), (k % 30).alias("c0"), (k % 20 + 5).alias("r1"), (k % 30 + 50).alias("c1"))
    return raster.box_sums(raster.integral_image(pixels(spark, sf)), boxes).select("box_id", (F.round("total", 5) + 0.0).alias("total"), (F.round("mean", 5) + 0.0).alias("mean"), F.round("std", 5).alias("std"))


@query("convolve_1d", f"WITH {PIXEL_SQL} SELECT {P}, round(-0.5 * coalesce(lag(value) OVER w, value) + 0.5 * coalesce(lead(value) OVER w, value), 6) + 0.0 AS value FROM px WINDOW w AS ({ROWW})")
def convolve_1d(spark, sf):
    return out(raster.convolve_1d(pixels(spark, sf), [-0.5, 0.0, 0.5], "col"))


K = raster.gaussian_kernel()


def _pass(src, w):
    return f"SELECT {P}, {K[0]!r} * lag(value, 2) OVER w + {K[1]!r} * lag(value) OVER w + {K[2]!r} * value + {K[3]!r} * lead(value) OVER w + {K[4]!r} * lead(value, 2) OVER w AS value FROM {src} WINDOW w AS ({w})"


@query("gaussian_smooth", f"WITH {PIXEL_SQL}, a AS ({_pass('px', ROWW)}), b AS ({_pass('a', COLW)}) SELECT {P}, round(value, 6) + 0.0 AS value FROM b")
def gaussian_smooth(spark, sf):
    return out(raster.gaussian_smooth(pixels(spark, sf)))


@query("square_clamped", f"WITH {PIXEL_SQL} SELECT {P}, round(least(0.05, greatest(0.001, value*value)), 6) + 0.0 AS value FROM px")
def square_clamped(spark, sf):
    return out(pixels(spark, sf).withColumn("value", raster.clamped(F.col("value") * F.col("value"), 0.001, 0.05)))


@query("multiply_clamped", f"WITH {PIXEL_SQL} SELECT a.image_id, a.band, a.row, a.col, round(least(0.02, greatest(-0.02, a.value * b.value)), 6) + 0.0 AS value FROM px a JOIN px b ON b.image_id = (a.image_id + 1) % 10 AND a.band = b.band AND a.row = b.row AND a.col = b.col")
def multiply_clamped(spark, sf):
    p = pixels(spark, sf)
    return out(raster.multiply(p, p.withColumn("image_id", (F.col("image_id") + 9) % 10), -0.02, 0.02))


@query("band_math", f"WITH {PIXEL_SQL}, b AS (SELECT (image_id + 10 - k) % 10 AS image_id, k, row, col, value FROM px, (SELECT unnest(range(3)) AS k)), w AS (SELECT image_id, row, col, max(CASE WHEN k = 0 THEN value END) AS b0, max(CASE WHEN k = 1 THEN value END) AS b1, max(CASE WHEN k = 2 THEN value END) AS b2 FROM b GROUP BY 1, 2, 3) SELECT image_id, row, col, round((b0*b2 - b1*b1) - 0.05*(b0+b2)*(b0+b2), 6) + 0.0 AS value FROM w")
def band_math(spark, sf):
    """Each image with the two that follow it as its bands."""
    p = pixels(spark, sf).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("band"), "row", "col", "value")
    p = p.withColumn("image_id", ((F.col("image_id") + 10 - F.col("band")) % 10).cast("int"))
    w = raster.band_math(p, {"b0": 0, "b1": 1, "b2": 2}, "(b0*b2 - b1*b1) - 0.05D*(b0+b2)*(b0+b2)", ("image_id", "row", "col"))
    return w.withColumn("value", F.round("value", 6) + 0.0)


@query("stack_bands", f"WITH {PIXEL_SQL} SELECT row, col, " + ", ".join(f"max(CASE WHEN image_id = {i} THEN value END) AS b{i}" for i in range(10)) + " FROM px GROUP BY 1, 2")
def stack_bands(spark, sf):
    return raster.stacked(pixels(spark, sf), list(range(10)), [f"b{i}" for i in range(10)])


@query("local_minima", f"WITH {PIXEL_SQL}, nb AS (SELECT a.image_id, a.band, a.row, a.col, a.value, count(*) AS n, min(b.value) AS m FROM px a JOIN px b ON a.image_id = b.image_id AND a.band = b.band AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY a.image_id, a.band, a.row, a.col, a.value) SELECT {P}, CASE WHEN n = 8 AND value <= m THEN value END AS value FROM nb")
def local_minima(spark, sf):
    return raster.local_minima(pixels(spark, sf), strict=False)


@query("local_extrema", f"WITH {PIXEL_SQL}, nb AS (SELECT a.image_id, a.band, a.row, a.col, a.value, count(*) AS n, max(b.value) AS m FROM px a JOIN px b ON a.image_id = b.image_id AND a.band = b.band AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY a.image_id, a.band, a.row, a.col, a.value) SELECT {P}, CASE WHEN n = 8 AND value > m THEN value END AS value FROM nb")
def local_extrema(spark, sf):
    return raster.local_maxima(pixels(spark, sf))


@query("density_reduce", f"WITH {PIXEL_SQL} SELECT {P}, CASE WHEN row_number() OVER (PARTITION BY image_id, band, row // 16, col // 16 ORDER BY value DESC, row, col) <= 26 THEN value END AS value FROM px")
def density_reduce(spark, sf):
    return raster.density_reduce(pixels(spark, sf), 16, 0.1)


def _smooth(name, v):
    return f"{name}0 AS (SELECT {P}, {v} AS value FROM gr), {name}1 AS ({_pass(name + '0', ROWW)}), {name} AS ({_pass(name + '1', COLW)})"


@query(
    "harris_corners",
    f"""WITH {PIXEL_SQL}, gr AS (SELECT {P}, -0.5*coalesce(lag(value) OVER a, value) + 0.5*coalesce(lead(value) OVER a, value) AS dx,
  -0.5*coalesce(lag(value) OVER b, value) + 0.5*coalesce(lead(value) OVER b, value) AS dy FROM px WINDOW a AS ({ROWW}), b AS ({COLW})),
  {_smooth("sa", "dx*dx")}, {_smooth("sb", "dx*dy")}, {_smooth("sc", "dy*dy")},
  co AS (SELECT sa.image_id, sa.band, sa.row, sa.col, (sa.value*sc.value - sb.value*sb.value) - 0.05*(sa.value+sc.value)*(sa.value+sc.value) AS value
    FROM sa JOIN sb USING (image_id, band, row, col) JOIN sc USING (image_id, band, row, col)),
  nb AS (SELECT a.image_id, a.band, a.row, a.col, a.value, count(b.value) AS n, max(b.value) AS m FROM co a JOIN co b ON a.image_id = b.image_id AND a.band = b.band AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND NOT (a.row = b.row AND a.col = b.col) GROUP BY a.image_id, a.band, a.row, a.col, a.value),
  pk AS (SELECT {P}, value FROM nb WHERE n = 8 AND value > m)
SELECT {P}, round(value, 9) + 0.0 AS value FROM pk QUALIFY row_number() OVER (PARTITION BY image_id, band, row // 16, col // 16 ORDER BY value DESC, row, col) <= 8""",
)
def harris_corners(spark, sf):
    return out(raster.harris_corners(pixels(spark, sf)), 9)


def _levels(most: int) -> str:
    """SQL of the levels of means from 1 on while the side before them is over 16; `most` bounds the text alone."""
    one = "SELECT image_id, band, row // 2 AS row, col // 2 AS col, avg(value) AS value FROM {} WHERE (SELECT s FROM side) > {} GROUP BY ALL"
    parts = ["side AS (SELECT greatest(max(row), max(col)) + 1 AS s FROM px)", *[f"l{k} AS ({one.format(f'l{k - 1}' if k > 1 else 'px', 16 << (k - 1))})" for k in range(1, most + 1)]]
    return ", ".join(parts) + f" SELECT {P}, round(value, 6) + 0.0 AS value, level FROM (" + " UNION ALL ".join(f"SELECT *, {k} AS level FROM l{k}" for k in range(1, most + 1)) + ")"


@query("build_overviews", f"WITH {PIXEL_SQL}, {_levels(16)}")
def build_overviews(spark, sf):
    return raster.overviews(pixels(spark, sf), 16).select(*COLS, (F.round("value", 6) + 0.0).alias("value"), "level")


@query("histogram", f"WITH {PIXEL_SQL} SELECT image_id, band, CAST(CASE WHEN value < -0.3 THEN 0 WHEN value >= 0.3 THEN 33 ELSE floor(32 * ((value + 0.3) / 0.6)) + 1 END AS BIGINT) AS bin, count(*) AS n FROM px GROUP BY ALL")
def histogram(spark, sf):
    return raster.histogram(pixels(spark, sf), -0.3, 0.3, 32)


@query("histogram_fast", f"WITH {PIXEL_SQL} SELECT image_id, band, CAST(CASE WHEN value < -0.3 THEN 0 WHEN value >= 0.3 THEN 33 ELSE floor(32 * ((value + 0.3) / 0.6)) + 1 END AS BIGINT) AS bin, count(*) AS n FROM px WHERE ((row // 16) * 7919 + (col // 16) * 104729 + 13) % 997 < 498.5 GROUP BY ALL")
def histogram_fast(spark, sf):
    return raster.histogram(pixels(spark, sf), -0.3, 0.3, 32, share=0.5)


@query("scan_min_max_null", f"WITH {PIXEL_SQL}, c AS (SELECT image_id, band, value, count(*) AS c FROM px GROUP BY ALL), g AS (SELECT image_id, band, min(value) AS least, arg_min(c, value) AS n_least, max(value) AS most, arg_max(c, value) AS n_most FROM c GROUP BY ALL) SELECT *, CASE WHEN n_most > n_least THEN most ELSE least END AS null_guess FROM g")
def scan_min_max_null(spark, sf):
    return raster.scan_min_max_null(pixels(spark, sf))


@query("alpha_mask", f"WITH {PIXEL_SQL} SELECT image_id, row, col, bool_or(value BETWEEN 0.0 AND 0.05) AS masked FROM px GROUP BY ALL")
def alpha_mask(spark, sf):
    return raster.alpha_mask(pixels(spark, sf), 0.0, 0.05)


@query("mosaic", f"WITH {PIXEL_SQL} SELECT band, row, col, coalesce(arg_max(CASE WHEN value > 0 THEN value END, image_id), -1.0) AS value FROM px GROUP BY ALL")
def mosaic(spark, sf):
    p = pixels(spark, sf)
    return raster.mosaic(p.withColumn("value", F.when(F.col("value") > 0, F.col("value"))), "image_id", -1.0)


DIST = "array_distance(l.descr, r.descr)"
PAIRS = f"{DESCR_SQL}, pr AS (SELECT l.pair_id, l.kp_id, r.kp_id AS match_id, l.x, l.y, r.x AS rx, r.y AS ry, {DIST} AS d FROM de l JOIN de r ON l.pair_id = r.pair_id AND l.side = 0 AND r.side = 1)"


def _sides(spark, sf):
    d = descriptors(spark, sf)
    return d.filter("side = 0").drop("side"), d.filter("side = 1").drop("side")


@query("match_ratio", f"WITH {PAIRS}, k AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS d2 FROM pr WINDOW w AS (PARTITION BY pair_id, kp_id ORDER BY d, match_id)) SELECT pair_id, kp_id, match_id, round(d, 6) AS d1, round(d2, 6) AS d2, rx - x AS dx, ry - y AS dy FROM k WHERE n = 1 AND d < 0.9 * d2")
def match_ratio(spark, sf):
    left, right = _sides(spark, sf)
    return matching.match_ratio(left, right, ["pair_id"], 0.9).withColumns({"d1": F.round("d1", 6), "d2": F.round("d2", 6)})


@query("match_correlation", f"WITH {DESCR_SQL}, pr AS (SELECT l.pair_id, l.kp_id, r.kp_id AS match_id, array_inner_product(l.descr, r.descr) AS s FROM de l JOIN de r ON l.pair_id = r.pair_id AND l.side = 0 AND r.side = 1), k AS (SELECT *, row_number() OVER w AS n, lead(s) OVER w AS s2 FROM pr WINDOW w AS (PARTITION BY pair_id, kp_id ORDER BY s DESC, match_id)) SELECT pair_id, kp_id, match_id, round(s, 6) AS score, round(s2 / (s + 1e-6), 6) AS ambiguity FROM k WHERE n = 1 AND s > 0.3 AND s2 / (s + 1e-6) < 0.95")
def match_correlation(spark, sf):
    left, right = _sides(spark, sf)
    return matching.match_correlation(left, right, ["pair_id"], 0.3).withColumns({"score": F.round("score", 6), "ambiguity": F.round("ambiguity", 6)})


@query("knn_in_window", f"WITH {PAIRS} SELECT pair_id, kp_id, row_number() OVER w AS rank, match_id, round(d, 6) AS d FROM pr WHERE rx BETWEEN 2 AND 12 AND ry BETWEEN 3 AND 20 WINDOW w AS (PARTITION BY pair_id, kp_id ORDER BY d, match_id) QUALIFY row_number() OVER w <= 3")
def knn_in_window(spark, sf):
    left, right = _sides(spark, sf)
    return matching.knn_in_window(left, right, ["pair_id"], 2, 3, 12, 20, 3).withColumn("d", F.round("d", 6))


@query("match_group_threshold", f"WITH {DESCR_SQL}, pr AS (SELECT l.pair_id, l.kp_id // 20 AS line_id, r.kp_id // 20 AS m, {DIST} AS d FROM de l JOIN de r ON l.pair_id = r.pair_id AND l.side = 0 AND r.side = 1), g AS (SELECT pair_id, line_id, m, min(d) AS d FROM pr GROUP BY ALL) SELECT pair_id, line_id, m AS match_group, round(d, 6) AS d FROM g QUALIFY row_number() OVER (PARTITION BY pair_id, line_id ORDER BY d, m) = 1 AND d < 1.1")
def match_group_threshold(spark, sf):
    left, right = (x.withColumn("line_id", F.floor(F.col("kp_id") / 20)) for x in _sides(spark, sf))
    return matching.match_groups(left, right, ["pair_id"], "line_id", 1.1).withColumn("d", F.round("d", 6))


@query("column_stats", f"WITH {PIXEL_SQL} SELECT col, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) AS sigma FROM px GROUP BY 1")
def column_stats(spark, sf):
    from quadrille.operators.stats import column_stats as stats_of

    return stats_of(pixels(spark, sf), ["col"], "value").select("col", "n", (F.round("mean", 6) + 0.0).alias("mean"), F.round("sigma", 6).alias("sigma"))


@query("normalise", f"WITH {PIXEL_SQL}, m AS (SELECT col, avg(value) AS mean, stddev_samp(value) AS sigma FROM px GROUP BY 1) SELECT image_id, row, px.col, round((value - mean) / sigma, 5) + 0.0 AS value FROM px JOIN m ON px.col = m.col")
def normalise(spark, sf):
    from quadrille.operators.stats import normalised

    return normalised(pixels(spark, sf), ["col"], "value").select("image_id", "row", "col", (F.round("value", 5) + 0.0).alias("value"))


@query("covariance", f"WITH {PIXEL_SQL} SELECT a.col AS i, b.col AS j, round(covar_samp(a.value, b.value), 7) + 0.0 AS cov FROM px a JOIN px b ON a.image_id = b.image_id AND a.row = b.row AND a.col <= b.col GROUP BY 1, 2")
def covariance(spark, sf):
    from quadrille.operators.stats import covariance as entries

    return entries(table(spark, sf, "embeddings"), "embedding").select("i", "j", (F.round("cov", 7) + 0.0).alias("cov"))


@query("count_term", "SELECT lang, source, CAST(sum(coalesce((length(text) - length(replace(text, 'the', ''))) // 3, 0)) AS BIGINT) AS n FROM documents GROUP BY ALL")
def count_term(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.sum(text.count_term(F.col("text"), "the")).alias("n"))


@query("str_parts", "SELECT page_id, CASE WHEN strpos(url, '/') > 0 THEN substr(url, 1, strpos(url, '/') - 1) ELSE url END AS before_first, CASE WHEN strpos(url, '/') > 0 THEN substr(url, strpos(url, '/') + 1) ELSE url END AS after_first, regexp_extract(url, '^(?:(.*)/)?[^/]*$', 1) AS before_last, regexp_extract(url, '([^/]*)$', 1) AS after_last FROM pages")
def str_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.before_first(u, "/").alias("before_first"), text.after_first(u, "/").alias("after_first"), text.before_last(u, "/").alias("before_last"), text.after_last(u, "/").alias("after_last"))


@query("scene_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) AS leap FROM orders")
def scene_dates(spark, sf):
    day = text.scene_date(F.date_format("o_orderdate", "yyyyMMdd"))
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"), text.leap_year(F.year("o_orderdate")).alias("leap"))
