"""Operators on tables of control, check and tie points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_roles(points: DataFrame, check: Column) -> DataFrame:
    """Add kind: check where the condition holds, else control."""
    return points.withColumn("kind", F.when(check, "check").otherwise("control"))


def merge_tie_points(*sets: DataFrame) -> DataFrame:
    """All points of all sets; columns that a set lacks are null."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def assign_blocks(points: DataFrame, size: float) -> DataFrame:
    """Add bx, by: the block of `size` that a point lies in."""
    return points.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})


def ordered_blocks(blocked: DataFrame, start_x: int, start_y: int) -> DataFrame:
    """pair_id, bx, by, n, rank: the blocks that have points, by their distance in rows and columns from a start."""
    used = blocked.groupBy("pair_id", "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    far = F.abs(F.col("bx") - start_x) + F.abs(F.col("by") - start_y)
    return used.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id").orderBy(far, "by", "bx")).cast("long"))


def best_per_block(blocked: DataFrame, most: int = 1) -> DataFrame:
    """The `most` points of best score in each block; ties go to the lower pt."""
    rank = F.row_number().over(Window.partitionBy("pair_id", "bx", "by").orderBy(F.desc("score"), "pt"))
    return blocked.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def image_residuals(points: DataFrame) -> DataFrame:
    """Add dx, dy: observed (x, y) less modelled (mx, my)."""
    return points.withColumns({"dx": F.col("x") - F.col("mx"), "dy": F.col("y") - F.col("my")})


def ground_residuals(points: DataFrame) -> DataFrame:
    """Add dx, dy, dz: observed (lon, lat in degrees, hgt) less modelled (mlon, mlat, mhgt), angles by 1e5.

    A hundred-thousandth of a degree is about a metre; of longitudes it shrinks with the cosine of the latitude.
    """
    return points.withColumns({"dx": (F.col("lon") - F.col("mlon")) * 1e5 * F.cos(F.radians("lat")), "dy": (F.col("lat") - F.col("mlat")) * 1e5, "dz": F.col("hgt") - F.col("mhgt")})


def residual_report(residuals: DataFrame, key: str, axes: tuple[str, ...] = ("dx", "dy")) -> DataFrame:
    """key, n, rmse (root of the summed squares over the points), mean_error, max_error of each image; of all where key is null."""
    total = None
    for c in axes:
        total = F.col(c) * F.col(c) if total is None else total + F.col(c) * F.col(c)
    e = residuals.select(key, total.alias("s"))
    return e.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum("s") / F.count(F.lit(1))).alias("rmse"), F.avg(F.sqrt("s")).alias("mean_error"), F.max(F.sqrt("s")).alias("max_error"))


def min_inliers(n: Column, model: int, support: float, doubt: float) -> Column:
    """The least j in model+1..n such that j or more inliers of n by chance are less likely than `doubt`, or null.

    Beyond the `model` points of the sample, each is an inlier by chance with probability `support`. The binomial
    tail is summed downward, its terms by the ratio of neighbours in logarithms, over the counts outside of which less
    than 1e-17 lies by Bernstein's bound: some 18 standard deviations and 120, whatever n is.
    """
    rest = (n - model).cast("long")
    odds = math.log((1 - support) / support)
    far = 9 * F.sqrt(rest * (support * (1 - support))) + 60
    top = F.least(rest, F.ceil(rest * support + far))
    low = F.greatest(F.lit(1).cast("long"), F.floor(rest * support - far))
    first = _log_factorial(rest) - _log_factorial(top) - _log_factorial(rest - top) + top * math.log(support) + (rest - top) * math.log(1 - support)
    start = F.struct(first.cast("double").alias("term"), F.lit(0.0).alias("tail"), F.lit(None).cast("long").alias("least"))

    def down(s: Column, k: Column) -> Column:
        tail = s["tail"] + F.exp(s["term"])
        return F.struct((s["term"] + F.log(k / (rest - k + 1)) + odds).alias("term"), tail.alias("tail"), F.when(tail < doubt, k).otherwise(s["least"]).alias("least"))

    return F.when(rest > 0, F.aggregate(F.sequence(top, low, F.lit(-1).cast("long")), start, down)["least"] + model)


def _log_factorial(n: Column) -> Column:
    """log n! by Stirling's series from n + 8 on, less the logarithm of the eight factors between."""
    x = n.cast("double") + 8
    between = n.cast("double") + 1
    for i in range(2, 9):
        between = between * (n.cast("double") + i)
    return (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x) - F.log(between)


def prosac_samples(points: DataFrame, rounds: int) -> DataFrame:
    """pair_id, h, newest, other: pairs of points (pair_id, pt, score) in the order of growing prefixes by score.

    Round h draws from the h + 2 best points: the last of them, and one before it by a hash of h.
    """
    s = points.select("pair_id", "pt", (F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("score"), "pt")) - 1).alias("k")).filter(F.col("k") <= rounds)
    n = points.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    h = n.select("pair_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long"))).alias("h")).withColumn("m", F.least("n", F.col("h") + 2))
    picks = h.select("pair_id", "h", (F.col("m") - 1).alias("a"), ((F.col("h") * 7919 + 13) % (F.col("m") - 1)).alias("b"))
    one = s.select("pair_id", F.col("k").alias("a"), F.col("pt").alias("newest"))
    two = s.select("pair_id", F.col("k").alias("b"), F.col("pt").alias("other"))
    return picks.join(one, ["pair_id", "a"]).join(two, ["pair_id", "b"]).select("pair_id", "h", "newest", "other")


#: Rounds after which growing prefixes have drawn as plain sampling does.
GROWTH = 200_000


def prosac_prefix(rounds: DataFrame, size: int, budget: int = GROWTH) -> DataFrame:
    """Add m, grown to (np, h, ...): the prefix of the np best points that round h draws `size` points from.

    Of `budget` rounds on all points, T(n) = floor(budget C(n, size) / C(np, size)) would have stayed within the first
    n, so prefix n is drawn from T(n) - T(n - 1) times, once at least. grown: all points have had their turn. A prefix
    takes a round or more, so only as many prefixes as rounds are looked at, once for each np.
    """
    n = F.col("m")
    within = F.lit(float(budget))
    before = F.lit(float(budget))
    for i in range(size):
        within = within * (n - i) / (F.col("np") - i)
        before = before * (n - 1 - i) / (F.col("np") - i)
    times = F.greatest(F.floor(within) - F.floor(before), F.lit(1))
    first = F.when(n == size, F.greatest(F.floor(within), F.lit(1))).otherwise(times)
    lengths = rounds.groupBy("np").agg(F.max("h").alias("last"))
    lengths = lengths.select("np", "last", F.explode(F.sequence(F.lit(size).cast("long"), F.least(F.col("np"), size + F.col("last")).cast("long"))).alias("m")).withColumn("times", first)
    until = F.sum("times").over(Window.partitionBy("np").orderBy("m"))
    spans = lengths.withColumn("until", until).filter(F.col("until") - F.col("times") <= F.col("last"))
    turns = spans.select("np", "m", F.explode(F.sequence(F.col("until") - F.col("times"), F.least(F.col("until") - 1, F.col("last").cast("long")))).alias("h"))
    met = rounds.join(turns, ["np", "h"], "left")
    return met.withColumn("grown", F.col("m").isNull()).withColumn("m", F.coalesce("m", F.col("np").cast("long")))


def kth_value(rows: DataFrame, keys: list[str], value: str, tie: str, k: int) -> DataFrame:
    """keys, value: the k-th smallest of each group, or the largest where it has fewer rows."""
    w = Window.partitionBy(*keys)
    r = rows.select(*keys, value, F.row_number().over(w.orderBy(value, tie)).alias("k"), F.count(F.lit(1)).over(w).alias("c"))
    return r.filter(F.col("k") == F.least(F.lit(k), "c")).select(*keys, F.col(value).alias("value"))


def select_kth(rows: DataFrame, value: str, k: int, bins: int = 4096) -> float | None:
    """The k-th smallest (from 1; k is clipped to the rows) of a whole table's values, nulls left out; None if there are none.

    Each round counts the values of the range that still holds the k-th one, in `bins` equal parts, and goes on with
    one part; the driver sees its count and ends. No rows are sorted or moved. It ends once a range holds one value.
    NaN is larger than any other value, infinite ones are counted apart.
    """
    v = F.col(value).cast("double")
    whole = rows.select(v.alias("v")).filter("v is not null")
    finite = whole.filter(~F.isnan("v") & (F.abs("v") < float("inf")))
    low, n, nan = F.lit(float("-inf")), F.count(F.lit(1)), F.isnan("v")
    r = whole.agg(n.alias("n"), F.sum((F.col("v") == low).cast("long")).alias("below"), F.sum(((F.col("v") == float("inf")) & ~nan).cast("long")).alias("above"), F.sum(nan.cast("long")).alias("nan")).first()
    if not r.n:
        return None
    k = min(max(k, 1), r.n)
    if k <= r.below:
        return float("-inf")
    if k > r.n - r.nan:
        return float("nan")
    if k > r.n - r.nan - r.above:
        return float("inf")
    k -= r.below
    lo, hi = finite.agg(F.min("v"), F.max("v")).first()
    while lo < hi:
        half = hi / bins - lo / bins  # a part's width, without overflow
        part = F.least(F.floor((F.col("v") / bins - lo / bins) / half * bins), F.lit(bins - 1)) if half > 0 else (F.col("v") > lo).cast("long")
        inside = finite.filter(F.col("v").between(lo, hi))
        counts = inside.groupBy(part.alias("b")).agg(n.alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()  # `bins` rows at most
        for c in counts:
            if k <= c.c:
                lo, hi = c.lo, c.hi
                break
            k -= c.c
    return float(lo)


def merge_metadata(items: DataFrame) -> DataFrame:
    """key, value of (source, key, value) for the keys of the first source by name: '*' where sources differ or lack it.

    Rows that repeat change nothing.
    """
    n, first = items.agg(F.countDistinct("source"), F.min("source")).first()
    g = items.groupBy("key").agg(F.countDistinct("value").alias("v"), F.countDistinct("source").alias("c"), F.min("value").alias("m"), F.bool_or(F.col("source") == F.lit(first)).alias("has"))
    return g.filter("has").select("key", F.when((F.col("v") == 1) & (F.col("c") == n), F.col("m")).otherwise("*").alias("value"))
