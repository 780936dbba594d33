"""Operators on pixel tables (image_id, band, row, col, value): separable windows, grouped sums and equi-joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.steps import cut

KEY = ["image_id", "band"]


def _along(axis: str):
    other = "row" if axis == "col" else "col"
    return Window.partitionBy(*KEY, other).orderBy(axis)


def _near(column: str, axis: str, step: int) -> Column:
    """The value `step` cells along the axis; null where that cell is missing."""
    return F.max(column).over(_along(axis).rangeBetween(step, step))


def integral_image(px: DataFrame, side: int = 256) -> DataFrame:
    """Add s, s2: sums of value and value squared over all cells up to and including this one.

    In two levels: totals of the rows, columns and whole of each tile of `side` cells are summed over the tiles before
    it and stand around the tile as a margin row and column, so that running sums inside tiles are those of the image.
    No window holds more than a tile's width, and pixels move once. Images are whole rectangles; null values count 0.
    """
    tile = ["__tr", "__tc"]
    cells = px.withColumns({"__tr": F.floor(F.col("row") / side), "__tc": F.floor(F.col("col") / side), "__v": F.col("value"), "__v2": F.col("value") * F.col("value")})

    def before(sums: DataFrame, fixed: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*KEY, *fixed).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return sums.withColumns({c: F.sum(c).over(w) for c in ("__v", "__v2")})

    def totals(of: DataFrame, by: list[str]) -> DataFrame:
        return of.groupBy(*KEY, *by).agg(*[F.sum(c).alias(c) for c in ("__v", "__v2")])

    rows, columns = totals(cells, [*tile, "row"]), totals(cells, [*tile, "col"])
    left, above = before(rows, ["row"], "__tc"), before(columns, ["col"], "__tr")
    corner = before(before(totals(rows, tile), ["__tr"], "__tc"), ["__tc"], "__tr")
    margin = [m.withColumns({c: F.lit(None).cast(px.schema[c].dataType) for c in ("row", "col") if c not in m.columns}) for m in (left, above, corner)]
    met = cells.withColumn("__cell", F.lit(True))
    for m in margin:
        met = met.unionByName(m, allowMissingColumns=True)
    met = met.repartition(*KEY, *tile)

    def running(fixed: str, order: str) -> Window:
        return Window.partitionBy(*KEY, *tile, fixed).orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, 0)

    across = met.withColumns({f"__r{c}": F.sum(c).over(running("row", "col")) for c in ("__v", "__v2")})
    down = across.withColumns({o: F.sum(f"__r{c}").over(running("col", "row")) for c, o in (("__v", "s"), ("__v2", "s2"))})
    return down.filter("__cell").select(*px.columns, "s", "s2")


def box_sums(integral: DataFrame, boxes: DataFrame) -> DataFrame:
    """box_id, total, n, mean, std (of n) of value in each box (box_id, image_id, band, r0, c0, r1, c1, ends included).

    By its four corners: one outside counts 0, one beyond the edge is clipped to it; sums below 0 become 0. A box
    without cells has null mean and std.
    """
    edge = integral.groupBy(*KEY).agg(F.max("row").alias("mr"), F.max("col").alias("mc"))
    b = boxes.join(edge, KEY).withColumns({"r1": F.least("r1", "mr"), "c1": F.least("c1", "mc")})
    sides = [F.greatest(F.lit(0), F.col(h) - F.greatest(F.lit(0), F.col(lo)) + 1) for lo, h in (("r0", "r1"), ("c0", "c1"))]
    corners = F.array(*[F.struct(r.alias("row"), c.alias("col"), F.lit(s).alias("sign")) for r, c, s in ((F.col("r1"), F.col("c1"), 1), (F.col("r0") - 1, F.col("c1"), -1), (F.col("r1"), F.col("c0") - 1, -1), (F.col("r0") - 1, F.col("c0") - 1, 1))])
    at = b.select("box_id", *KEY, (sides[0] * sides[1]).cast("long").alias("n"), F.inline(corners))
    met = at.join(integral.select(*KEY, "row", "col", "s", "s2"), [*KEY, "row", "col"], "left")
    sums = met.groupBy("box_id", "n").agg(*[F.greatest(F.lit(0.0), F.sum(F.coalesce(F.col("sign") * F.col(c), F.lit(0.0)))).alias(o) for c, o in (("s", "total"), ("s2", "__t2"))], F.sum(F.coalesce(F.col("sign") * F.col("s"), F.lit(0.0))).alias("__t"))
    mean = F.col("__t") / F.nullif(F.col("n"), F.lit(0))
    return sums.select("box_id", "total", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("__t2") / F.nullif(F.col("n"), F.lit(0)) - mean * mean)).alias("std"))


def _convolved(column: str, kernel: list[float], axis: str, strict: bool) -> Column:
    half = len(kernel) // 2
    total = None
    for i, k in enumerate(kernel):
        step = i - half
        if strict or not step:
            v = _near(column, axis, step) if step else F.col(column)
        else:  # the farthest cell that is there
            side = 1 if step > 0 else -1
            v = F.coalesce(*[_near(column, axis, s) for s in range(step, 0, -side)], F.col(column))
        total = F.lit(k) * v if total is None else total + F.lit(k) * v
    return total


def convolve_1d(px: DataFrame, kernel: list[float], axis: str, strict: bool = False) -> DataFrame:
    """Weighted sum along an axis. At edges the nearest cell counts; strict: a missing or null cell makes null."""
    return px.withColumn("value", _convolved("value", kernel, axis, strict))


def gaussian_kernel(std: float = 1.0, half: int = 2) -> list[float]:
    w = [math.exp(-k * k / (2 * std * std)) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def gaussian_smooth(px: DataFrame, std: float = 1.0, half: int = 2) -> DataFrame:
    """Two strict passes of a Gaussian."""
    kernel = gaussian_kernel(std, half)
    return convolve_1d(convolve_1d(px, kernel, "col", True), kernel, "row", True)


def clamped(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), value)))


def multiply(a: DataFrame, b: DataFrame, low: float, high: float) -> DataFrame:
    """Product of two rasters where both have a value, clamped."""
    b = b.select(*KEY, "row", "col", F.col("value").alias("other"))
    return a.join(b, [*KEY, "row", "col"]).select(*KEY, "row", "col", clamped(F.col("value") * F.col("other"), low, high).alias("value"))


def local_maxima(px: DataFrame, strict: bool = True) -> DataFrame:
    """Keep value where it is above (or not below) all 8 neighbours, else null; cells without 8 neighbours are null."""
    x = px.withColumns({"w": _near("value", "col", -1), "e": _near("value", "col", 1)})
    x = x.withColumns({"h": F.greatest("w", "value", "e"), "k": sum((F.col(c).isNotNull().cast("int") for c in ("w", "value", "e")), F.lit(0))})
    x = x.withColumns({f"{c}{n}": F.max(c).over(_along("row").rangeBetween(s, s)) for c in "hk" for n, s in (("u", -1), ("d", 1))})
    around = F.greatest("w", "e", "hu", "hd")
    full = (F.col("ku") == 3) & (F.col("kd") == 3) & (F.col("k") == 3)
    best = F.col("value") > around if strict else F.col("value") >= around
    return x.select(*KEY, "row", "col", F.when(full & best, F.col("value")).alias("value"))


def local_minima(px: DataFrame, strict: bool = True) -> DataFrame:
    """As local_maxima, where value is below (or not above) all 8 neighbours."""
    turned = local_maxima(px.withColumn("value", -F.col("value")), strict)
    return turned.withColumn("value", -F.col("value"))


def stacked(px: DataFrame, images: list, names: list[str]) -> DataFrame:
    """row, col and one column for each of `images`, null where it has no cell."""
    w = px.groupBy("row", "col").pivot("image_id", images).agg(F.max("value"))
    return w.select("row", "col", *[F.col(f"`{i}`").alias(n) for i, n in zip(images, names, strict=True)])


def band_math(px: DataFrame, bands: dict[str, object], expression: str, keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """keys, value: an SQL expression over named bands (name -> value of column band), null where one it needs is."""
    one = [F.max(F.when(F.col("band") == F.lit(b), F.col("value"))).alias(n) for n, b in bands.items()]
    return px.groupBy(*keys).agg(*one).select(*keys, F.expr(expression).alias("value"))


def density_reduce(px: DataFrame, size: int, density: float) -> DataFrame:
    """In each tile keep the ceil(density * size^2) largest values, others null; ties go to the first row and column."""
    keep = math.ceil(density * size * size)
    tile = [F.floor(F.col("row") / size), F.floor(F.col("col") / size)]
    rank = F.row_number().over(Window.partitionBy(*KEY, *tile).orderBy(F.desc_nulls_last("value"), "row", "col"))
    return px.withColumn("rank", rank).withColumn("value", F.when(F.col("rank") <= keep, F.col("value"))).drop("rank")


def harris_corners(px: DataFrame, k: float = 0.05, size: int = 16, density: float = 0.03) -> DataFrame:
    """Gradients, their products smoothed, the corner measure, strict maxima, and the densest allowed per tile.

    All are columns of the same cells: one sort along each axis takes the place of joins.
    """
    g, kernel = [-0.5, 0.0, 0.5], gaussian_kernel()
    d = px.withColumn("dx", _convolved("value", g, "col", False)).withColumn("dy", _convolved("value", g, "row", False))
    m = d.select(*KEY, "row", "col", *[(F.col(u) * F.col(v)).alias(n) for n, u, v in (("a", "dx", "dx"), ("b", "dx", "dy"), ("c", "dy", "dy"))])
    for axis in ("col", "row"):
        m = m.withColumns({n: _convolved(n, kernel, axis, True) for n in "abc"})
    corner = (F.col("a") * F.col("c") - F.col("b") * F.col("b")) - k * (F.col("a") + F.col("c")) * (F.col("a") + F.col("c"))
    peaks = local_maxima(m.select(*KEY, "row", "col", corner.alias("value")))
    return density_reduce(peaks, size, density).filter("value is not null")


def overview(px: DataFrame) -> DataFrame:
    """The next level: means of 2 by 2 cells."""
    return px.groupBy(*KEY, F.floor(F.col("row") / 2).alias("row"), F.floor(F.col("col") / 2).alias("col")).agg(F.avg("value").alias("value"))


def overviews(px: DataFrame, stop: int) -> DataFrame:
    """All levels from 1 until both sides are at most `stop`, with column level; each is made once, from the one before."""
    side = px.agg(F.greatest(F.max("row"), F.max("col"))).first()[0]
    out, at, level = None, px, 0
    side = 0 if side is None else side + 1
    while side > stop:
        at, level, side = cut(overview(at)), level + 1, (side + 1) // 2
        named = at.withColumn("level", F.lit(level))
        out = named if out is None else out.unionByName(named)
    return px.limit(0).withColumn("level", F.lit(0)) if out is None else out


def histogram(px: DataFrame, low: float, high: float, bins: int, share: float = 1.0, tile: int = 16) -> DataFrame:
    """Counts by band and bin 1..bins; 0 and bins + 1 hold what lies below and above.

    share below 1 is the fast mode: of the tiles of `tile` by `tile` pixels about that share counts, picked by an
    integer hash of their place, so reruns agree.
    """
    if share < 1:
        trow, tcol = (F.floor(F.col(c) / tile) for c in ("row", "col"))
        px = px.filter(F.pmod(trow * 7919 + tcol * 104729 + 13, F.lit(997)) < share * 997)
    return px.filter("value is not null").groupBy(*KEY, F.width_bucket("value", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scan_min_max_null(px: DataFrame) -> DataFrame:
    """Least and largest value of each band, how often each stands, and the more frequent one as the guessed null."""
    counts = px.filter("value is not null").groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("c"))
    g = counts.groupBy(*KEY).agg(F.min(F.struct("value", "c")).alias("lo"), F.max(F.struct("value", "c")).alias("hi"))
    return g.select(*KEY, F.col("lo.value").alias("least"), F.col("lo.c").alias("n_least"), F.col("hi.value").alias("most"), F.col("hi.c").alias("n_most"), F.when(F.col("hi.c") > F.col("lo.c"), F.col("hi.value")).otherwise(F.col("lo.value")).alias("null_guess"))


def alpha_mask(px: DataFrame, low: float, high: float, every: bool = False) -> DataFrame:
    """masked: the value is within [low, high] in any band, or in every band."""
    hit = F.col("value").between(low, high)
    return px.groupBy("image_id", "row", "col").agg((F.bool_and(hit) if every else F.bool_or(hit)).alias("masked"))


def mosaic(px: DataFrame, order: str, init: float) -> DataFrame:
    """One grid of all images: the last in order with a value wins."""
    g = px.groupBy("band", "row", "col").agg(F.max(F.when(F.col("value").isNotNull(), F.struct(order, "value")))["value"].alias("value"))
    return g.withColumn("value", F.coalesce("value", F.lit(init)))
