"""Queries of projections, line segments, homographies, affine RANSAC and further resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import fitting, line_matching, lines, normal, projection, spatial, warp
from quadrille.operators.steps import dealt
from quadrille.plans.fit_queries import rounded
from quadrille.plans.registry import query, table
from quadrille.plans.views import A0, A1, A2, A3, DESCR_SQL, EPIPOLAR_SQL, PIXEL_SQL, TIE_SQL, descriptors, epipolar_points, pixels, tie_points

PROJ_SQL = """pj AS (SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'll' WHEN 1 THEN 'tm' ELSE 'lcc' END AS kind, radians(n_nationkey / 50) AS l0, radians(CAST(30 AS DOUBLE)) AS p0,
  radians(CAST(31 + n_nationkey % 3 AS DOUBLE)) AS p1, radians(CAST(38 + n_nationkey % 5 AS DOUBLE)) AS p2, 0.9996::DOUBLE AS k0, 500000.0::DOUBLE AS fe, n_nationkey * 1000.0::DOUBLE AS fn FROM nation)"""


def _conformal(p):
    return f"(tan(0.7853981633974483 - {p}/2) / power((1 - sqrt(e2)*sin({p})) / (1 + sqrt(e2)*sin({p})), sqrt(e2)/2))"


def _arc(p):
    return f"(6378137.0::DOUBLE * ((1 - e2/4 - 3*e2*e2/64 - 5*power(e2,3)/256)*{p} - (3*e2/8 + 3*e2*e2/32 + 45*power(e2,3)/1024)*sin(2*{p}) + (15*e2*e2/256 + 45*power(e2,3)/1024)*sin(4*{p}) - (35*power(e2,3)/3072)*sin(6*{p})))"


@query(
    "reproject_points",
    f"""WITH {PROJ_SQL}, f AS (SELECT 1/298.257223563::DOUBLE AS f), c AS (SELECT c_custkey, CAST(c_custkey * 37 % 200 AS DOUBLE) / 100 - 1 AS lon, 30 + CAST(c_custkey * 91 % 1000 AS DOUBLE) / 100 AS lat, (c_nationkey + 1) % 25 AS k FROM customer),
 g AS (SELECT c_custkey, lon, lat, kind, l0, p0, p1, p2, k0, fe, fn, f.f * (2 - f.f) AS e2, radians(lon) AS l, radians(lat) AS p FROM c JOIN pj USING (k), f),
 t AS (SELECT *, e2/(1-e2)*cos(p)*cos(p) AS cc, e2/(1-e2) AS ep, tan(p)*tan(p) AS tt, (l-l0)*cos(p) AS a, 6378137.0::DOUBLE/sqrt(1-e2*sin(p)*sin(p)) AS n,
   cos(p1)/sqrt(1-e2*sin(p1)*sin(p1)) AS m1, cos(p2)/sqrt(1-e2*sin(p2)*sin(p2)) AS m2 FROM g),
 u AS (SELECT *, (ln(m1)-ln(m2)) / (ln({_conformal('p1')})-ln({_conformal('p2')})) AS cn FROM t),
 v AS (SELECT *, 6378137.0::DOUBLE*k0*m1/(cn*power({_conformal('p1')}, cn)) AS sc FROM u),
 w AS (SELECT *, sc*power({_conformal('p')}, cn) AS r, sc*power({_conformal('p0')}, cn) AS r0 FROM v)
SELECT c_custkey, CASE kind WHEN 'tm' THEN round(fe + k0*n*(a + (1-tt+cc)*power(a,3)/6 + (5-18*tt+tt*tt+72*cc-58*ep)*power(a,5)/120), 0) WHEN 'lcc' THEN round(fe + r*sin(cn*(l-l0)), 0) ELSE round(lon, 6) END + 0.0 AS x,
 CASE kind WHEN 'tm' THEN round(fn + k0*({_arc('p')} - {_arc('p0')} + n*tan(p)*(a*a/2 + (5-tt+9*cc+4*cc*cc)*power(a,4)/24 + (61-58*tt+tt*tt+600*cc-330*ep)*power(a,6)/720)), 0) WHEN 'lcc' THEN round(fn + r0 - r*cos(cn*(l-l0)), 0) ELSE round(lat, 6) END + 0.0 AS y FROM w""",
)
def reproject_points(spark, sf):
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    kind = F.when(k % 3 == 0, "ll").when(k % 3 == 1, "tm").otherwise("lcc")
    table_ = table(spark, sf, "nation").select(k.alias("k"), kind.alias("kind"), (k / 50).alias("lon0"), F.lit(30.0).alias("lat0"), (31 + k % 3).cast("double").alias("lat1"), (38 + k % 5).cast("double").alias("lat2"), F.lit(0.9996).alias("k0"), F.lit(500000.0).alias("fe"), (k * 1000.0).alias("fn"))
    points = table(spark, sf, "customer").select(c, ((c * 37 % 200) / 100 - 1).alias("lon"), (30 + (c * 91 % 1000) / 100).alias("lat"), F.col("c_nationkey").alias("k"))
    target = table_.withColumn("k", (F.col("k") + 24) % 25)
    got = projection.reproject(projection.project(points, table_, "k"), table_, target, "k")
    at = got.join(target.select("k", "kind"), "k")
    return at.select("c_custkey", *[(F.when(F.col("kind") == "ll", F.round(v, 6)).otherwise(F.round(v, 0)) + 0.0).alias(v) for v in "xy"])


SEG_SQL = f"""{TIE_SQL}, ok AS (SELECT *, pt // 2 AS line_id FROM tie WHERE abs(x2 - {A0}*x - {A1}*y - {A2}) < 1),
seg AS (SELECT pair_id, line_id, max(CASE WHEN pt % 2 = 0 THEN x END) AS ax, max(CASE WHEN pt % 2 = 0 THEN y END) AS ay, max(CASE WHEN pt % 2 = 1 THEN x END) AS bx, max(CASE WHEN pt % 2 = 1 THEN y END) AS b_y,
  max(CASE WHEN pt % 2 = 0 THEN x2 END) AS cx, max(CASE WHEN pt % 2 = 0 THEN y2 END) AS cy, max(CASE WHEN pt % 2 = 1 THEN x2 END) AS dx, max(CASE WHEN pt % 2 = 1 THEN y2 END) AS dy FROM ok GROUP BY ALL HAVING count(*) = 2)"""


def segments(spark, sf):
    """pair_id, line_id and the end points in both images, of the points that were not moved away."""
    t = tie_points(spark, sf).filter(F.abs(F.col("x2") - A0 * F.col("x") - A1 * F.col("y") - A2) < 1)

    def end(k, c):
        return F.max(F.when(F.col("pt") % 2 == k, F.col(c)))

    g = t.groupBy("pair_id", F.floor(F.col("pt") / 2).alias("line_id"))
    return g.agg(F.count(F.lit(1)).alias("c"), *[end(k, c).alias(n) for k, c, n in ((0, "x", "ax"), (0, "y", "ay"), (1, "x", "bx"), (1, "y", "by"), (0, "x2", "cx"), (0, "y2", "cy"), (1, "x2", "dx"), (1, "y2", "dy"))]).filter("c = 2").drop("c")


@query("fit_line_affine", f"WITH {SEG_SQL} SELECT pair_id, count(*) AS n, {A2} + 0.0::DOUBLE AS p0, {A0} + 0.0::DOUBLE AS p1, {A1} + 0.0::DOUBLE AS p2, {A3} + 0.0::DOUBLE AS p3, {-A1} + 0.0::DOUBLE AS p4, {A0} + 0.0::DOUBLE AS p5 FROM seg GROUP BY 1")
def fit_line_affine(spark, sf):
    s = segments(spark, sf)
    target = lines.polar(s.select("pair_id", "line_id", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("dx").alias("bx"), F.col("dy").alias("by"))).select("pair_id", "line_id", "theta", "rho")
    pairs = s.select("pair_id", "line_id", "ax", "ay", "bx", "by").join(target, ["pair_id", "line_id"])
    return normal.fit_line_affine(pairs, ["pair_id"]).select("pair_id", "n", *rounded(*normal.AFFINE6))


H = (1.1, 0.1, 4.0, -0.2, 0.9, -2.0, 0.0005, 0.001)


def _warped(spark, sf):
    """Tie points whose x2, y2 are a planted homography; a tenth of them moved away where `out`."""
    h = tie_points(spark, sf).withColumns({f"h{i}": F.lit(v) for i, v in enumerate(H)})
    u, v = normal.homography_map()
    return h.select("pair_id", "pt", "x", "y", u.alias("x2"), v.alias("y2"), (F.col("x2") > 200).alias("out"))


@query("fit_homography", f"WITH {TIE_SQL} SELECT pair_id, count(*) AS n, " + ", ".join(f"{v} + 0.0::DOUBLE AS h{i}" for i, v in enumerate(H)) + " FROM tie GROUP BY 1")
def fit_homography(spark, sf):
    return normal.fit_homography(_warped(spark, sf), ["pair_id"]).select("pair_id", "n", *rounded(*normal.HOMOGRAPHY, digits=6))


@query("refine_homography", f"WITH {TIE_SQL} SELECT pair_id, count(*) AS n, CAST(sum(CASE WHEN (l_out) THEN 0 ELSE 1 END) AS BIGINT) AS fitted FROM (SELECT pair_id, abs(x2 - {A0}*x - {A1}*y - {A2}) > 1 AS l_out FROM tie) GROUP BY 1")
def refine_homography(spark, sf):
    w = _warped(spark, sf)
    moved = w.withColumn("x2", F.when(F.col("out"), F.col("x2") + 400).otherwise(F.col("x2")))
    start = normal.fit_homography(w.filter("pt < 40"), ["pair_id"]).withColumn("h2", F.col("h2") + 0.5)
    return normal.refine_homography(moved, start, ["pair_id"], loops=4).select("pair_id", "n", "fitted")




@query(
    "global_rotation",
    f"""WITH {SEG_SQL}, li AS (SELECT pair_id, 0 AS side, atan2(b_y - ay, bx - ax) AS theta, sqrt(power(bx-ax, 2) + power(b_y-ay, 2)) AS length FROM seg UNION ALL SELECT pair_id, 1, atan2(dy - cy, dx - cx), sqrt(power(dx-cx, 2) + power(dy-cy, 2)) FROM seg),
 tu AS (SELECT *, theta + pi() + pi()/18 AS t FROM li), b AS (SELECT pair_id, side, floor((CASE WHEN t < 2*pi() THEN t ELSE t - 2*pi() END) * 18 / (2*pi())) AS bin, length FROM tu),
 h AS (SELECT pair_id, side, bin, CAST(count(*) AS DOUBLE) AS c, sum(length) AS l FROM b GROUP BY ALL), nm AS (SELECT pair_id, side, sqrt(sum(c*c)) AS c, sqrt(sum(l*l)) AS l FROM h GROUP BY ALL),
 s AS (SELECT DISTINCT pair_id, s FROM nm, (SELECT unnest(range(18)) AS s)),
 d AS (SELECT s.pair_id, s.s, coalesce(sum(x.c*y.c), 0) AS c, coalesce(sum(x.l*y.l), 0) AS l FROM s LEFT JOIN h x ON x.pair_id = s.pair_id AND x.side = 0 LEFT JOIN h y ON y.pair_id = s.pair_id AND y.side = 1 AND y.bin = (x.bin + s.s) % 18 GROUP BY ALL),
 e AS (SELECT d.pair_id, d.s, sqrt(greatest(0.0, round(2 - 2*d.c/(a.c*b.c), 9))) AS c, sqrt(greatest(0.0, round(2 - 2*d.l/(a.l*b.l), 9))) AS l FROM d JOIN nm a ON a.pair_id = d.pair_id AND a.side = 0 JOIN nm b ON b.pair_id = d.pair_id AND b.side = 1),
 m AS (SELECT pair_id, first(s ORDER BY c, s) AS shift, min(c) AS cd, min(l) AS ld FROM e GROUP BY 1)
SELECT pair_id, CAST(shift AS INTEGER) AS shift, round(cd, 4) AS count_diff, round(ld, 4) AS length_diff, round(CASE WHEN cd < 0.49 AND ld < 0.4 THEN radians(CASE WHEN shift*20 > 90 AND 360 - shift*20 > 90 THEN shift*20.0 - 180 ELSE shift*20.0 END) ELSE 2*pi() END, 6) AS rotation FROM m""",
)
def global_rotation(spark, sf):
    s = segments(spark, sf)
    one = s.select("pair_id", F.lit(0).alias("side"), "ax", "ay", "bx", "by")
    two = s.select("pair_id", F.lit(1).alias("side"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("dx").alias("bx"), F.col("dy").alias("by"))
    got = lines.global_rotation(lines.polar(one.unionByName(two)), ["pair_id"])
    return got.select("pair_id", "shift", F.round("count_diff", 4).alias("count_diff"), F.round("length_diff", 4).alias("length_diff"), F.round("rotation", 6).alias("rotation"))


@query(
    "candidate_line_pairs",
    f"""WITH {DESCR_SQL}, li AS (SELECT *, 1.0::DOUBLE + kp_id % 7 AS len, CAST(kp_id * 37 % 628 AS DOUBLE) / 100 - 3.14::DOUBLE AS theta FROM de),
 j AS (SELECT l.pair_id, l.kp_id AS left_id, r.kp_id AS right_id, array_distance(l.descr, r.descr) AS d, l.len AS ll, r.len AS rl, l.theta + 0.3::DOUBLE - r.theta AS off, l.pair_id % 3 = 0 AS free FROM li l JOIN li r ON l.pair_id = r.pair_id AND l.side = 0 AND r.side = 1)
SELECT pair_id, left_id, right_id, round(d, 6) AS d FROM j WHERE d <= 1.3 AND abs(ll - rl) <= 2.0 * least(ll, rl) AND (free OR abs(off) <= 0.7854 OR abs(2*pi() - abs(off)) <= 0.7854)""",
)
def candidate_line_pairs(spark, sf):
    k = F.col("line_id")
    d = descriptors(spark, sf).select("pair_id", "side", F.col("kp_id").alias("line_id"), "descr").withColumns({"length": 1.0 + k % 7, "theta": (k * 37 % 628) / 100 - 3.14})
    left = d.filter("side = 0").withColumn("rotation", F.when(F.col("pair_id") % 3 == 0, 7.0).otherwise(0.3))
    return lines.candidate_line_pairs(left, d.filter("side = 1"), ["pair_id"], descriptor=1.3, length=2.0).withColumn("d", F.round("d", 6))




@query("ransac_affine", f"WITH {TIE_SQL}, f AS (SELECT pair_id, count(*) AS n FROM tie WHERE abs(x2 - {A0}*x - {A1}*y - {A2}) < 1 GROUP BY 1) SELECT pair_id, CAST(n AS BIGINT) AS inliers, {A2} + 0.0::DOUBLE AS m0, {A0} + 0.0::DOUBLE AS m1, {A1} + 0.0::DOUBLE AS m2, {A3} + 0.0::DOUBLE AS m3, {-A1} + 0.0::DOUBLE AS m4, {A0} + 0.0::DOUBLE AS m5 FROM f")
def ransac_affine(spark, sf):
    return fitting.ransac_affine(tie_points(spark, sf)).select("pair_id", "inliers", *rounded(*fitting.AFFINE))


@query("warp_average", f"WITH {PIXEL_SQL} SELECT image_id, band, CAST(floor(0.5*row + 0.25*col) AS BIGINT) AS row, CAST(floor(0.75*col - 0.25*row + 12) AS BIGINT) AS col, round(avg(value), 6) + 0.0 AS value FROM px GROUP BY ALL")
def warp_average(spark, sf):
    r, c = F.col("row"), F.col("col")
    return warp.warp_average(pixels(spark, sf), 0.5 * r + 0.25 * c, 0.75 * c - 0.25 * r + 12).withColumn("value", F.round("value", 6) + 0.0)


@query("warp_mode", f"WITH {PIXEL_SQL}, c AS (SELECT image_id, band, row // 4 AS row, col // 4 AS col, round(value, 1) + 0.0 AS value, count(*) AS c FROM px GROUP BY ALL) SELECT image_id, band, row, col, first(value ORDER BY c DESC, value) AS value FROM c GROUP BY ALL")
def warp_mode(spark, sf):
    px = pixels(spark, sf).withColumn("value", F.round("value", 1) + 0.0)
    return warp.warp_mode(px, F.col("row") / 4, F.col("col") / 4)


@query("interpolate_elevation", f"WITH {TIE_SQL}, {PIXEL_SQL}, c AS (SELECT pair_id, pt, floor(y) + j AS r, floor(x) + i AS k, (CASE WHEN i = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM tie, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) SELECT pair_id, pt, round(coalesce(sum(w * value) / nullif(sum(CASE WHEN value IS NOT NULL THEN w END), 0), -9.0), 5) + 0.0 AS hgt FROM c LEFT JOIN px ON px.image_id = 0 AND px.row = r AND px.col = k GROUP BY ALL")
def interpolate_elevation(spark, sf):
    dem = pixels(spark, sf).filter("image_id = 0")
    return spatial.interpolate_elevation(tie_points(spark, sf), ["pair_id", "pt"], dem, -9.0).select("pair_id", "pt", (F.round("hgt", 5) + 0.0).alias("hgt"))


@query("ransac_fundamental", f"WITH {EPIPOLAR_SQL} SELECT pair_id, count(*) AS inliers FROM li WHERE power(x2*r0 + y2*r1 + r2, 2) / (r0*r0 + r1*r1 + l0*l0 + l1*l1) < 0.96 GROUP BY 1")
def ransac_fundamental(spark, sf):
    return fitting.ransac_fundamental(epipolar_points(spark, sf)).select("pair_id", "inliers")


@query("prosac_affine", f"WITH {TIE_SQL}, f AS (SELECT pair_id, count(*) AS n FROM tie WHERE abs(x2 - {A0}*x - {A1}*y - {A2}) < 1 GROUP BY 1) SELECT pair_id, CAST(n AS BIGINT) AS inliers, {A2} + 0.0::DOUBLE AS m0, {A0} + 0.0::DOUBLE AS m1, {A1} + 0.0::DOUBLE AS m2, {A3} + 0.0::DOUBLE AS m3, {-A1} + 0.0::DOUBLE AS m4, {A0} + 0.0::DOUBLE AS m5 FROM f")
def prosac_affine(spark, sf):
    return fitting.prosac(tie_points(spark, sf), fitting.AFFINE_MODEL).select("pair_id", "inliers", *rounded(*fitting.AFFINE))


@query("ransac_line", f"WITH {TIE_SQL}, f AS (SELECT pair_id, count(*) AS n, avg(x) AS ax FROM tie WHERE abs(x2 - {A0}*x - {A1}*y - {A2}) < 1 GROUP BY 1) SELECT pair_id, CAST(n AS BIGINT) AS inliers, round(1 / sqrt(5::DOUBLE), 4) AS nx, round(-2 / sqrt(5::DOUBLE), 4) AS ny, round(ax, 4) AS ax, round(ax / 2 + 3, 4) AS ay FROM f")
def ransac_line(spark, sf):
    t = tie_points(spark, sf)
    moved = F.abs(F.col("x2") - A0 * F.col("x") - A1 * F.col("y") - A2) >= 1
    on = t.select("pair_id", "pt", "x", (F.col("x") / 2 + 3 + F.when(moved, 500.0).otherwise(0.0)).alias("y"))
    return fitting.ransac_line(on).select("pair_id", "inliers", *rounded("nx", "ny", "ax", "ay"))


@query("ransac_homography", f"WITH {TIE_SQL} SELECT pair_id, CAST(count(*) AS BIGINT) AS inliers, " + ", ".join(f"{v} + 0.0::DOUBLE AS h{i}" for i, v in enumerate(H)) + f" FROM tie WHERE abs(x2 - {A0}*x - {A1}*y - {A2}) < 1 GROUP BY 1")
def ransac_homography(spark, sf):
    w = _warped(spark, sf)
    moved = w.withColumn("x2", F.when(F.col("out"), F.col("x2") + 400).otherwise(F.col("x2"))).drop("out")
    return fitting.ransac_homography(moved).select("pair_id", "inliers", *rounded(*normal.HOMOGRAPHY, digits=6))


def _line_pairs(spark, sf):
    """All segments of both images with errors of up to half a unit in the second, and a similarity fitted to the points."""
    def error(c, k):
        return F.col(c) + F.pmod(F.xxhash64("pair_id", "pt", F.lit(k)), F.lit(1001)) / 1000 - 0.5

    t = tie_points(spark, sf).withColumns({"x2": error("x2", 1), "y2": error("y2", 2)})
    t = dealt(t.select("pair_id", "pt", "x", "y", "x2", "y2"), ["pair_id"])
    coarse = fitting.ransac_similarity(t, sigma=2.0).select("pair_id", *fitting.SIMILARITY)
    g = t.groupBy("pair_id", F.floor(F.col("pt") / 2).alias("line_id"))

    def side(x, y):
        ends = [F.max(F.when(F.col("pt") % 2 == k, F.col(c))).alias(n) for k, c, n in ((0, x, "ax"), (0, y, "ay"), (1, x, "bx"), (1, y, "by"))]
        return g.agg(F.count(F.lit(1)).alias("c"), *ends).filter("c = 2").drop("c")

    return side("x", "y"), side("x2", "y2"), coarse


@query("spectral_match")
def spectral_match(spark, sf):
    """Left lines are moved by the similarity of the points; candidates are all lines of the pair near enough to them."""
    left, right, coarse = _line_pairs(spark, sf)

    def moved(e):
        x, y = F.col(f"{e}x"), F.col(f"{e}y")
        return (F.col("a0") * x + F.col("a1") * y + F.col("a2")).alias(f"{e}x"), (-F.col("a1") * x + F.col("a0") * y + F.col("a3")).alias(f"{e}y")

    left = left.join(coarse, "pair_id").select("pair_id", "line_id", *moved("a"), *moved("b"))
    got = line_matching.match_lines(left, right, ["pair_id"])
    return got.select("pair_id", "left_id", "right_id", F.round("score", 4).alias("score"))


@query("em_line_registration")
def em_line_registration(spark, sf):
    """From the similarity of the points, all lines of a pair against all."""
    left, right, coarse = _line_pairs(spark, sf)
    start = coarse.select("pair_id", F.col("a2").alias("p0"), F.col("a0").alias("p1"), F.col("a1").alias("p2"), F.col("a3").alias("p3"), (-F.col("a1")).alias("p4"), F.col("a0").alias("p5"), F.lit(16.0).alias("delta2"))
    _, found = line_matching.em_line_registration(left, right, start, ["pair_id"])
    return found.select("pair_id", "left_id", "right_id", F.round("distance", 3).alias("distance"))
