"""Queries of resampling, clipping and segment distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import warp
from quadrille.plans.registry import query, table
from quadrille.plans.views import PIXEL_SQL, TIE_SQL, pixels, tie_points

MAP = "0.5 * col + 0.25 * row AS sx, 0.75 * row - 0.25 * col + 3 AS sy"


def inverse(df):
    return df, 0.5 * F.col("col") + 0.25 * F.col("row"), 0.75 * F.col("row") - 0.25 * F.col("col") + 3


@query("warp_nearest", f"WITH {PIXEL_SQL}, t AS (SELECT image_id, band, row, col, {MAP} FROM px) SELECT t.image_id, t.band, t.row, t.col, p.value FROM t LEFT JOIN px p ON p.image_id = t.image_id AND p.row = floor(sy + 0.5) AND p.col = floor(sx + 0.5)")
def warp_nearest(spark, sf):
    p = pixels(spark, sf)
    return warp.warp_nearest(p, *inverse(p.drop("value")))


@query("warp_bilinear", f"WITH {PIXEL_SQL}, t AS (SELECT image_id, band, row, col, {MAP} FROM px), c AS (SELECT t.*, floor(sy) + j AS r, floor(sx) + i AS k, (CASE WHEN i = 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE WHEN j = 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)) SELECT c.image_id, c.band, c.row, c.col, round(sum(w * p.value) / nullif(sum(CASE WHEN p.value IS NOT NULL THEN w END), 0), 6) + 0.0 AS value FROM c LEFT JOIN px p ON p.image_id = c.image_id AND p.row = c.r AND p.col = c.k GROUP BY ALL")
def warp_bilinear(spark, sf):
    p = pixels(spark, sf)
    return warp.warp_bilinear(p, *inverse(p.drop("value"))).withColumn("value", F.round("value", 6) + 0.0)


_T = "abs({s} - c{s})"
_CUBIC = " * ".join(f"(CASE WHEN {t} <= 1 THEN 1.5*{t}*{t}*{t} - 2.5*{t}*{t} + 1 WHEN {t} < 2 THEN -0.5*{t}*{t}*{t} + 2.5*{t}*{t} - 4*{t} + 2 ELSE 0 END)" for t in (_T.format(s="sx"), _T.format(s="sy")))


@query("warp_cubic", f"WITH {PIXEL_SQL}, t AS (SELECT image_id, band, row, col, {MAP} FROM px), c AS (SELECT t.*, floor(sx) + i AS csx, floor(sy) + j AS csy FROM t, (SELECT unnest([-1, 0, 1, 2]) AS i), (SELECT unnest([-1, 0, 1, 2]) AS j)), m AS (SELECT c.image_id, c.band, c.row, c.col, p.value, {_CUBIC} AS w FROM c LEFT JOIN px p ON p.image_id = c.image_id AND p.row = csy AND p.col = csx), g AS (SELECT image_id, band, row, col, sum(w * value) AS v, sum(CASE WHEN value IS NOT NULL THEN w END) AS w FROM m GROUP BY ALL) SELECT image_id, band, row, col, CASE WHEN abs(w) > 1e-9 THEN round(v / w, 6) + 0.0 END AS value FROM g")
def warp_cubic(spark, sf):
    p = pixels(spark, sf)
    return warp.warp_kernel(p, *inverse(p.drop("value")), source=32, block=40).withColumn("value", F.round("value", 6) + 0.0)


POLY = "SELECT p_partkey AS poly_id, CAST(p_partkey * 13 % 60 AS DOUBLE) AS x, CAST(p_partkey * 7 % 60 AS DOUBLE) AS y FROM part"


@query("cutline_clip", f"WITH {PIXEL_SQL}, g AS ({POLY}), e AS (SELECT poly_id, x - 3.5 AS x1, y - 2.5 AS y1, x + 6.5 AS x2, y + 0.5 AS y2 FROM g UNION ALL SELECT poly_id, x + 6.5, y + 0.5, x + 1.5, y + 7.5 FROM g UNION ALL SELECT poly_id, x + 1.5, y + 7.5, x - 3.5, y - 2.5 FROM g), h AS (SELECT DISTINCT image_id, band, row, col FROM (SELECT image_id, band, row, col, poly_id FROM px JOIN e ON row >= least(y1, y2) AND row < greatest(y1, y2) AND x1 + (row - y1) / (y2 - y1) * (x2 - x1) > col GROUP BY ALL HAVING count(*) % 2 = 1)) SELECT image_id, band, row, col, value FROM px JOIN h USING (image_id, band, row, col)")
def cutline_clip(spark, sf):
    k = F.col("p_partkey")
    x, y = (k * 13 % 60).cast("double"), (k * 7 % 60).cast("double")
    corners = [F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((-3.5, -2.5), (6.5, 0.5), (1.5, 7.5))]
    polygons = table(spark, sf, "part").select(k.alias("poly_id"), F.array(*corners).alias("points"))
    return warp.cutline_clip(pixels(spark, sf), polygons).select("image_id", "band", "row", "col", "value")


def _off(x, y, p, q):
    px, py, qx, qy = (f'"{e}{c}"' for e in (p, q) for c in "xy")
    length = f"nullif(sqrt(power({qx} - {px}, 2) + power({qy} - {py}, 2)), 0)"
    return f'abs(-("{x}" - {px}) * ({qy} - {py}) / {length} + ("{y}" - {py}) * ({qx} - {px}) / {length})'


@query("segment_distance", f"WITH {TIE_SQL}, s AS (SELECT a.pair_id, a.pt // 2 AS seg_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS \"by\", a.x2 AS cx, a.y2 AS cy, b.x2 AS dx, b.y2 AS dy FROM tie a JOIN tie b ON a.pair_id = b.pair_id AND a.pt % 2 = 0 AND b.pt = a.pt + 1) SELECT pair_id, seg_id, round(({_off('ax', 'ay', 'c', 'd')} + {_off('bx', 'by', 'c', 'd')} + {_off('cx', 'cy', 'a', 'b')} + {_off('dx', 'dy', 'a', 'b')}) / 4, 4) AS d FROM s")
def segment_distance(spark, sf):
    t = tie_points(spark, sf).withColumn("seg_id", F.floor(F.col("pt") / 2))

    def end(k):
        return [F.max(F.when(F.col("pt") % 2 == k, F.col(c))).alias(n) for c, n in zip(("x", "y", "x2", "y2"), (("ax", "ay", "cx", "cy"), ("bx", "by", "dx", "dy"))[k], strict=True)]

    s = t.groupBy("pair_id", "seg_id").agg(*end(0), *end(1)).filter("bx is not null")
    return warp.segment_distance(s).select("pair_id", "seg_id", F.round("d", 4).alias("d"))
