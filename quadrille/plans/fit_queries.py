"""Queries of the fits and point-table operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quadrille.operators import fitting
from quadrille.plans.registry import query, table
from quadrille.plans.views import TIE_SQL, tie_points

MOMENTS = """mo AS (SELECT pair_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x2) AS mu, avg(y2) AS mv,
  sum(x*x) - sum(x)*sum(x)/count(*) AS xx, sum(y*y) - sum(y)*sum(y)/count(*) AS yy, sum(x*y) - sum(x)*sum(y)/count(*) AS xy,
  sum(x*x2) - sum(x)*sum(x2)/count(*) AS xu, sum(y*x2) - sum(y)*sum(x2)/count(*) AS yu,
  sum(x*y2) - sum(x)*sum(y2)/count(*) AS xv, sum(y*y2) - sum(y)*sum(y2)/count(*) AS yv FROM {src} GROUP BY pair_id)"""
#: Error of a similarity at a point.
ERROR = "sqrt(power(a0*x + a1*y + a2 - x2, 2) + power(-a1*x + a0*y + a3 - y2, 2))"
RANSAC_SQL = f"""{TIE_SQL}, np AS (SELECT pair_id, count(*) AS np FROM tie GROUP BY 1),
pick AS (SELECT pair_id, np, h, (h*7919+13) % np AS i, (h*104729+71) % np AS j0 FROM np, (SELECT unnest(range(16)) AS h)),
pick2 AS (SELECT pair_id, h, i, CASE WHEN i = j0 THEN (j0+1) % np ELSE j0 END AS j FROM pick),
two AS (SELECT p.pair_id, h, b.x-a.x AS dx, b.y-a.y AS dy, b.x2-a.x2 AS du, b.y2-a.y2 AS dv, (a.x+b.x)/2 AS mx, (a.y+b.y)/2 AS my, (a.x2+b.x2)/2 AS mu, (a.y2+b.y2)/2 AS mv
  FROM pick2 p JOIN tie a ON a.pair_id = p.pair_id AND a.pt = i JOIN tie b ON b.pair_id = p.pair_id AND b.pt = j),
mod AS (SELECT pair_id, h, (dx*du+dy*dv)/(dx*dx+dy*dy) AS a0, (dy*du-dx*dv)/(dx*dx+dy*dy) AS a1, mx, my, mu, mv FROM two WHERE dx*dx+dy*dy > 0),
mods AS (SELECT pair_id, h, a0, a1, mu - a0*mx - a1*my AS a2, mv + a1*mx - a0*my AS a3 FROM mod),
sc AS (SELECT t.pair_id, h, a0, a1, a2, a3, CAST(sum(CASE WHEN {ERROR} < 0.96 THEN 1 ELSE 0 END) AS BIGINT) AS inliers FROM tie t JOIN mods m ON t.pair_id = m.pair_id GROUP BY ALL),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY inliers DESC, h) = 1),
inl AS (SELECT t.pair_id, x, y, x2, y2 FROM tie t JOIN best b ON t.pair_id = b.pair_id WHERE {ERROR} < 0.96),
{MOMENTS.format(src="inl")},
sim AS (SELECT pair_id, n, (xu+yv)/(xx+yy) AS a0, (yu-xv)/(xx+yy) AS a1, mx, my, mu, mv FROM mo),
fit AS (SELECT s.pair_id, b.h, b.inliers, s.n, s.a0, s.a1, mu - s.a0*mx - s.a1*my AS a2, mv + s.a1*mx - s.a0*my AS a3 FROM sim s JOIN best b ON s.pair_id = b.pair_id)"""


def rounded(*names, digits=4):
    # adding 0.0 turns -0.0 into 0.0
    return [(F.round(c, digits) + 0.0).alias(c) for c in names]


def rsql(*names, digits=4):
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)


@query("fit_similarity", f"WITH {TIE_SQL}, {MOMENTS.format(src='tie')}, s AS (SELECT *, (xu+yv)/(xx+yy) AS a0, (yu-xv)/(xx+yy) AS a1 FROM mo), f AS (SELECT pair_id, CAST(n AS BIGINT) AS n, a0, a1, mu - a0*mx - a1*my AS a2, mv + a1*mx - a0*my AS a3 FROM s) SELECT pair_id, n, {rsql('a0', 'a1', 'a2', 'a3')} FROM f")
def fit_similarity(spark, sf):
    return fitting.fit_similarity(tie_points(spark, sf), ["pair_id"]).select("pair_id", F.col("n").cast("long").alias("n"), *rounded("a0", "a1", "a2", "a3"))


@query("fit_affine", f"WITH {TIE_SQL}, {MOMENTS.format(src='tie')}, s AS (SELECT *, xx*yy-xy*xy AS det FROM mo), t AS (SELECT *, (xu*yy-yu*xy)/det AS m1, (yu*xx-xu*xy)/det AS m2, (xv*yy-yv*xy)/det AS m4, (yv*xx-xv*xy)/det AS m5 FROM s), f AS (SELECT pair_id, CAST(n AS BIGINT) AS n, mu-m1*mx-m2*my AS m0, m1, m2, mv-m4*mx-m5*my AS m3, m4, m5 FROM t) SELECT pair_id, n, {rsql('m0', 'm1', 'm2', 'm3', 'm4', 'm5')} FROM f")
def fit_affine(spark, sf):
    return fitting.fit_affine(tie_points(spark, sf), ["pair_id"]).select("pair_id", F.col("n").cast("long").alias("n"), *rounded(*fitting.AFFINE))


@query("fit_line_ols", f"WITH {TIE_SQL} SELECT pair_id, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM tie GROUP BY 1")
def fit_line_ols(spark, sf):
    return fitting.fit_line_ols(tie_points(spark, sf), ["pair_id"]).select("pair_id", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("fit_line_tls", f"WITH {TIE_SQL}, {MOMENTS.format(src='tie')}, s AS (SELECT *, ((xx+yy)-sqrt((xx-yy)*(xx-yy)+4*xy*xy))/2 AS l FROM mo), f AS (SELECT pair_id, CAST(n AS BIGINT) AS n, xy/sqrt(xy*xy+(l-xx)*(l-xx)) AS nx, (l-xx)/sqrt(xy*xy+(l-xx)*(l-xx)) AS ny, mx AS ax, my AS ay FROM s) SELECT pair_id, n, {rsql('nx', 'ny', 'ax', 'ay')} FROM f")
def fit_line_tls(spark, sf):
    return fitting.fit_line_tls(tie_points(spark, sf), ["pair_id"]).select("pair_id", F.col("n").cast("long").alias("n"), *rounded("nx", "ny", "ax", "ay"))


@query("ransac_similarity", f"WITH {RANSAC_SQL} SELECT pair_id, h, inliers, CAST(n AS BIGINT) AS n, {rsql('a0', 'a1', 'a2', 'a3')} FROM fit")
def ransac_similarity(spark, sf):
    return fitting.ransac_similarity(tie_points(spark, sf)).select("pair_id", "h", "inliers", F.col("n").cast("long").alias("n"), *rounded("a0", "a1", "a2", "a3"))


@query("residual_report", f"WITH {RANSAC_SQL}, r AS (SELECT t.pair_id, {ERROR} AS e FROM tie t JOIN fit f ON t.pair_id = f.pair_id) SELECT pair_id, count(*) AS n, round(sqrt(sum(e*e)/count(*)), 4) AS rmse, round(avg(e), 4) AS mean_error, round(max(e), 4) AS max_error FROM r GROUP BY ROLLUP (pair_id)")
def residual_report(spark, sf):
    from quadrille.operators.points import image_residuals
    from quadrille.operators.points import residual_report as report

    points = tie_points(spark, sf)
    models = fitting.ransac_similarity(points).select("pair_id", *fitting.SIMILARITY)
    a0, a1, x, y = (F.col(c) for c in ("a0", "a1", "x", "y"))
    met = points.join(models, "pair_id").select("pair_id", F.col("x2").alias("x"), F.col("y2").alias("y"), (a0 * x + a1 * y + F.col("a2")).alias("mx"), (-a1 * x + a0 * y + F.col("a3")).alias("my"))
    found = report(image_residuals(met), "pair_id")
    return found.select("pair_id", "n", *[F.round(c, 4).alias(c) for c in ("rmse", "mean_error", "max_error")])


@query("robust_weights", f"WITH {TIE_SQL}, r AS (SELECT pair_id, pt, abs(x2 - y2) / 100 AS r FROM tie), w AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY r, pt) AS k, count(*) OVER (PARTITION BY pair_id) AS c FROM r) SELECT pair_id, pt, round(0.8/(power(r, 1.2)+1e-8), 4) AS w_pnorm, round(CASE WHEN r >= 1 THEN 0.0 ELSE power(1-r*r, 2) END, 4) AS w_tukey, round(1/(1+r), 4) AS w_fair, round(CASE WHEN r < 1e-12 THEN 1.0 ELSE ((exp(r)-exp(-r))/(exp(r)+exp(-r)))/r END, 4) AS w_logistic, CASE WHEN k <= floor(c*0.5) THEN 1.0 ELSE 0.0 END AS w_trimmed, 1.0 AS w_uniform FROM w")
def robust_weights(spark, sf):
    r = tie_points(spark, sf).select("pair_id", "pt", (F.abs(F.col("x2") - F.col("y2")) / 100).alias("r"))
    w = fitting.robust_weights(r, "pair_id", "r")
    names = [c for c in w.columns if c.startswith("w_")]
    return w.select("pair_id", "pt", *[F.round(c, 4).alias(c) for c in names])


@query("min_inliers", f"WITH {TIE_SQL}, n AS (SELECT pair_id, count(*) AS n FROM tie GROUP BY 1), i AS (SELECT pair_id, n, unnest(range(3, n + 1)) AS i FROM n), p AS (SELECT pair_id, n, i, exp(lgamma(n-2+1.0) - lgamma(i-2+1.0) - lgamma(n-i+1.0) + (i-2)*ln(0.25) + (n-i)*ln(0.75)) AS p FROM i), t AS (SELECT pair_id, n, i, sum(p) OVER (PARTITION BY pair_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS tail FROM p) SELECT pair_id, n, CAST(min(i) FILTER (tail < 0.05) AS BIGINT) AS least FROM t GROUP BY 1, 2")
def min_inliers(spark, sf):
    from quadrille.operators.points import min_inliers as least

    pairs = tie_points(spark, sf).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select("pair_id", "n", least(F.col("n"), 2, 0.25, 0.05).alias("least"))


@query("split_roles", f"WITH {TIE_SQL} SELECT pair_id, pt, x, y, CASE WHEN (pair_id * 31 + pt * 17) % 5 = 0 THEN 'check' ELSE 'control' END AS kind FROM tie")
def split_roles(spark, sf):
    from quadrille.operators.points import split_roles as split

    return split(tie_points(spark, sf), (F.col("pair_id") * 31 + F.col("pt") * 17) % 5 == 0).select("pair_id", "pt", "x", "y", "kind")


@query("merge_tie_points", f"WITH {TIE_SQL} SELECT pair_id, count(*) AS n, round(sum(x), 4) AS sx, count(score) AS scored FROM (SELECT pair_id, x, score FROM tie WHERE pt % 2 = 0 UNION ALL SELECT pair_id, x, NULL FROM tie WHERE pt % 2 = 1) GROUP BY 1")
def merge_tie_points(spark, sf):
    from quadrille.operators.points import merge_tie_points as merge

    t = tie_points(spark, sf).select("pair_id", "pt", "x", "score")
    return merge(t.filter("pt % 2 = 0"), t.filter("pt % 2 = 1").drop("score")).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.count("score").alias("scored"))


BLOCK_SQL = f"{TIE_SQL}, bl AS (SELECT *, CAST(floor(x / 16) AS BIGINT) AS bx, CAST(floor(y / 16) AS BIGINT) AS by_ FROM tie)"


@query("assign_blocks", f"WITH {BLOCK_SQL}, u AS (SELECT pair_id, bx, by_, count(*) AS n FROM bl GROUP BY ALL) SELECT pair_id, bx, by_ AS by, n, row_number() OVER (PARTITION BY pair_id ORDER BY abs(bx - 2) + abs(by_ - 1), by_, bx) AS rank FROM u")
def assign_blocks(spark, sf):
    from quadrille.operators.points import assign_blocks as assign
    from quadrille.operators.points import ordered_blocks

    return ordered_blocks(assign(tie_points(spark, sf), 16), 2, 1)


@query("best_per_block", f"WITH {BLOCK_SQL} SELECT pair_id, bx, by_ AS by, pt, score FROM bl QUALIFY row_number() OVER (PARTITION BY pair_id, bx, by_ ORDER BY score DESC, pt) <= 2")
def best_per_block(spark, sf):
    from quadrille.operators.points import assign_blocks as assign
    from quadrille.operators.points import best_per_block as best

    return best(assign(tie_points(spark, sf), 16), 2).select("pair_id", "bx", "by", "pt", "score")


@query("prosac_samples", f"WITH {TIE_SQL}, s AS (SELECT pair_id, pt, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, pt) - 1 AS k FROM tie), n AS (SELECT pair_id, count(*) AS n FROM tie GROUP BY 1 HAVING count(*) >= 2), h AS (SELECT pair_id, h, least(n, 2 + h) AS m FROM n, (SELECT unnest(range(16)) AS h)), t AS (SELECT pair_id, h, m - 1 AS newest, (h*7919+13) % (m-1) AS other FROM h) SELECT t.pair_id, t.h, a.pt AS newest, b.pt AS other FROM t JOIN s a ON a.pair_id = t.pair_id AND a.k = newest JOIN s b ON b.pair_id = t.pair_id AND b.k = other")
def prosac_samples(spark, sf):
    from quadrille.operators.points import prosac_samples as samples

    return samples(tie_points(spark, sf), 16)


@query("prosac_prefix", f"WITH {TIE_SQL}, np AS (SELECT pair_id, count(*) AS np FROM tie GROUP BY 1 HAVING count(*) >= 3), m AS (SELECT DISTINCT np, unnest(range(3, np + 1)) AS m FROM np), t AS (SELECT np, m, floor(200000.0 * m / np * (m - 1) / (np - 1) * (m - 2) / (np - 2)) AS t FROM m), k AS (SELECT np, m, CAST(greatest(1, t - coalesce(lag(t) OVER (PARTITION BY np ORDER BY m), 0)) AS BIGINT) AS times FROM t), u AS (SELECT *, sum(times) OVER (PARTITION BY np ORDER BY m) AS until FROM k), h AS (SELECT pair_id, np, unnest(range(0, 300)) AS h FROM np) SELECT pair_id, h, coalesce(u.m, h.np) AS m, u.m IS NULL AS grown FROM h LEFT JOIN u ON u.np = h.np AND h.h < until AND h.h >= until - times")
def prosac_prefix(spark, sf):
    from quadrille.operators.points import prosac_prefix as prefix

    pairs = tie_points(spark, sf).groupBy("pair_id").agg(F.count(F.lit(1)).alias("np")).filter("np >= 3")
    return prefix(pairs.select("pair_id", "np", F.explode(F.sequence(F.lit(0), F.lit(299)).cast("array<bigint>")).alias("h")), 3).select("pair_id", "h", "m", "grown")


@query("kth_value", f"WITH {TIE_SQL}, r AS (SELECT pair_id, x, row_number() OVER (PARTITION BY pair_id ORDER BY x, pt) AS k, count(*) OVER (PARTITION BY pair_id) AS c FROM tie) SELECT pair_id, x AS value FROM r WHERE k = least(300, c)")
def kth_value(spark, sf):
    from quadrille.operators.points import kth_value as kth

    return kth(tie_points(spark, sf), ["pair_id"], "x", "pt", 300)


RANKS = (1, 100, 5000, 1 << 40)


@query("select_kth", "WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS i, count(*) OVER () AS n FROM lineitem), k AS (SELECT CAST(unnest([" + ", ".join(map(str, RANKS)) + "]) AS BIGINT) AS k) SELECT k, v AS value FROM k JOIN r ON i = least(k, n)")
def select_kth(spark, sf):
    from quadrille.operators.points import select_kth as kth

    li = table(spark, sf, "lineitem")
    return spark.createDataFrame([(k, kth(li, "l_extendedprice", k)) for k in RANKS], "k long, value double")


@query("merge_metadata", "WITH m AS (SELECT user_id % 50 AS source, event_type AS key, max(props->>'$.k') AS value FROM events GROUP BY 1, 2), n AS (SELECT count(DISTINCT source) AS n FROM m), f AS (SELECT min(source) AS s FROM m) SELECT key, CASE WHEN count(DISTINCT value) = 1 AND count(*) = (SELECT n FROM n) THEN min(value) ELSE '*' END AS value FROM m GROUP BY key HAVING bool_or(source = (SELECT s FROM f))")
def merge_metadata(spark, sf):
    from quadrille.operators.points import merge_metadata as merge

    e = table(spark, sf, "events")
    m = e.groupBy((F.col("user_id") % 50).alias("source"), F.col("event_type").alias("key")).agg(F.max(F.get_json_object("props", "$.k")).alias("value"))
    return merge(m)
