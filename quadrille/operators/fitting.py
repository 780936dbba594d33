"""Least-squares and robust fits per group: each is one pass of partial sums and a closed form in columns."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators import consensus, whole_pairs
from quadrille.operators.epipolar import FUNDAMENTAL, fit_fundamental, fundamental_of, sample_models, sampson_error, sampson_errors, seven_point
from quadrille.operators.normal import HOMOGRAPHY, fit_homography, homography_error
from quadrille.operators.points import GROWTH, min_inliers, prosac_prefix
from quadrille.operators.steps import cut
from quadrille.operators.whole_pairs import UNIT, Whole

SIMILARITY = ("a0", "a1", "a2", "a3")
AFFINE = ("m0", "m1", "m2", "m3", "m4", "m5")


def _moments(names: list[str], weight: Column | None = None) -> list[Column]:
    """Sums of the columns and of all their products, and n."""
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(w * F.col(a)).alias(f"s_{a}") for a in names]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return [*sums, F.sum(w).alias("n")]


def _cov(a: str, b: str) -> Column:
    a, b = sorted((a, b), key=("x", "y", "x2", "y2").index)
    return F.col(f"s_{a}_{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / F.col("n")


def _mean(a: str) -> Column:
    return F.col(f"s_{a}") / F.col("n")


def fit_similarity(points: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, n, a0..a3 with x2 = a0 x + a1 y + a2 and y2 = -a1 x + a0 y + a3; null where the points coincide."""
    m = points.groupBy(*keys).agg(*_moments(["x", "y", "x2", "y2"], weight))
    s = F.nullif(_cov("x", "x") + _cov("y", "y"), F.lit(0.0))
    a0 = (_cov("x", "x2") + _cov("y", "y2")) / s
    a1 = (_cov("y", "x2") - _cov("x", "y2")) / s
    return m.select(*keys, "n", a0.alias("a0"), a1.alias("a1"), (_mean("x2") - a0 * _mean("x") - a1 * _mean("y")).alias("a2"), (_mean("y2") + a1 * _mean("x") - a0 * _mean("y")).alias("a3"))


def similarity_of(p: np.ndarray) -> np.ndarray | None:
    """As fit_similarity, of one group's points (4 x n)."""
    a, of = two_points(p.T[None])
    return a[0] if len(of) else None


def two_points(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a0..a3 (k x 4) of samples (n x size x 4: x, y, x2, y2), and the sample of each; none where the points coincide."""
    centre = samples.mean(1)
    x, y, u, v = np.moveaxis(samples - centre[:, None], 2, 0)
    s = (x * x + y * y).sum(1)
    of = np.flatnonzero(s)
    a0, a1 = ((x * u + y * v).sum(1)[of] / s[of], (y * u - x * v).sum(1)[of] / s[of])
    x, y, u, v = centre[of].T
    return np.stack([a0, a1, u - a0 * x - a1 * y, v + a1 * x - a0 * y], 1), of


def fit_affine(points: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, n, m0..m5 with x2 = m0 + m1 x + m2 y and y2 = m3 + m4 x + m5 y; null where the points are collinear."""
    m = points.groupBy(*keys).agg(*_moments(["x", "y", "x2", "y2"], weight))
    det = F.nullif(_cov("x", "x") * _cov("y", "y") - _cov("x", "y") * _cov("x", "y"), F.lit(0.0))
    out = []
    for first, t in ((0, "x2"), (3, "y2")):
        p = (_cov("x", t) * _cov("y", "y") - _cov("y", t) * _cov("x", "y")) / det
        q = (_cov("y", t) * _cov("x", "x") - _cov("x", t) * _cov("x", "y")) / det
        out += [(_mean(t) - p * _mean("x") - q * _mean("y")).alias(f"m{first}"), p.alias(f"m{first + 1}"), q.alias(f"m{first + 2}")]
    return m.select(*keys, "n", *out)


def similarity_error() -> Column:
    dx = F.col("a0") * F.col("x") + F.col("a1") * F.col("y") + F.col("a2") - F.col("x2")
    dy = -F.col("a1") * F.col("x") + F.col("a0") * F.col("y") + F.col("a3") - F.col("y2")
    return F.sqrt(dx * dx + dy * dy)


def affine_error() -> Column:
    dx = F.col("m0") + F.col("m1") * F.col("x") + F.col("m2") * F.col("y") - F.col("x2")
    dy = F.col("m3") + F.col("m4") * F.col("x") + F.col("m5") * F.col("y") - F.col("y2")
    return F.sqrt(dx * dx + dy * dy)


def fit_line_ols(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, slope, intercept of y over x."""
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def fit_line_tls(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, nx, ny, ax, ay: unit normal and centre of the orthogonal line; a vertical one has normal (1, 0)."""
    m = points.groupBy(*keys).agg(*_moments(["x", "y"]))
    xx, xy, yy = _cov("x", "x"), _cov("x", "y"), _cov("y", "y")
    least = ((xx + yy) - F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)) / 2
    norm = F.sqrt(xy * xy + (least - xx) * (least - xx))
    flat = norm < 1e-12
    return m.select(*keys, "n", F.when(xx < 1e-12, 1.0).when(flat, 0.0).otherwise(xy / norm).alias("nx"), F.when(xx < 1e-12, 0.0).when(flat, 1.0).otherwise((least - xx) / norm).alias("ny"), _mean("x").alias("ax"), _mean("y").alias("ay"))


def line_error() -> Column:
    return F.abs(F.col("nx") * (F.col("x") - F.col("ax")) + F.col("ny") * (F.col("y") - F.col("ay")))


class Model(NamedTuple):
    """What RANSAC needs of a model: points in a minimal sample, parameters, the fit per group, its error column and the
    same error of many models over many points; axes of a point; the models of samples, where a sample gives several;
    what a task needs to take a pair whole.
    """

    size: int
    names: tuple[str, ...]
    fit: Callable[[DataFrame, list[str]], DataFrame]
    error: Callable[[], Column]
    errors: Callable[[np.ndarray, np.ndarray], np.ndarray]
    axes: tuple[str, ...] = ("x", "y", "x2", "y2")
    sample: Callable[[DataFrame], DataFrame] | None = None
    whole: Whole | None = None


SIMILARITY_MODEL = Model(2, SIMILARITY, fit_similarity, similarity_error, consensus.similarity_errors, whole=Whole(two_points, 1, similarity_of, T.DoubleType()))
AFFINE_MODEL = Model(3, AFFINE, fit_affine, affine_error, consensus.affine_errors)
LINE_MODEL = Model(2, ("nx", "ny", "ax", "ay"), fit_line_tls, line_error, consensus.line_errors, ("x", "y"))
HOMOGRAPHY_MODEL = Model(4, tuple(HOMOGRAPHY), fit_homography, homography_error, consensus.homography_errors)
FUNDAMENTAL_MODEL = Model(7, FUNDAMENTAL, fit_fundamental, sampson_error, sampson_errors, sample=sample_models, whole=Whole(seven_point, 3, fundamental_of, T.LongType()))


def distinct_places(h: Column, n: Column, size: int) -> Column:
    """`size` different numbers below n (of size or more), picked by hashes of h: each among those that are still free."""

    def pick(taken: Column, k: Column) -> Column:
        free = F.pmod(F.xxhash64(h, k), n - F.size(taken))
        at = F.aggregate(F.array_sort(taken), free, lambda a, t: F.when(t <= a, a + 1).otherwise(a))
        return F.array_append(taken, at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.array().cast("array<bigint>"), pick)


def picked_points(rounds: int, size: int) -> Column:
    """The places of round h in a pair of np points; the first `rounds` by a formula that SQL has too."""
    h, np_ = F.col("h"), F.col("np")
    if size > 4:
        return distinct_places(h, np_, size)
    picked: list[Column] = []
    for times, plus in ((7919, 13), (104729, 71), (15485863, 29), (32452843, 53))[:size]:
        at = F.when(h < rounds, (h * times + plus) % np_).otherwise(F.pmod(F.xxhash64("h", F.lit(times)), np_))
        for _ in picked:
            at = F.when(F.array_contains(F.array(*picked), at), (at + 1) % np_).otherwise(at)
        picked.append(at)
    return F.array(*picked)


def prosac_places(size: int) -> Column:
    """The places of round h among a pair's points by falling score: the newest of the prefix `m` and others before it.

    Once the prefix has grown to all np points, any `size` of them.
    """
    h, m = F.col("h"), F.col("m")
    newest = F.concat(distinct_places(h, m - 1, size - 1), F.array(m - 1)) if size > 1 else F.array(m - 1)
    return F.when(F.col("grown"), distinct_places(h, F.col("np"), size)).otherwise(newest)


def hypotheses(blocks: DataFrame, sizes: DataFrame, rounds: int, model: Model = SIMILARITY_MODEL, todo: DataFrame | None = None, ordered: bool = False, budget: int = GROWTH) -> DataFrame:
    """pair_id, h, and a model through points of consensus.point_blocks that an integer hash of h picks.

    todo: (pair_id, since, until), the pairs and rounds to draw; else all pairs, `rounds` each. ordered: pt is the order
    of falling quality, and samples come from growing prefixes of it (prosac_prefix).
    """
    n = sizes.filter(F.col("np") >= model.size)
    if todo is None:
        n = n.withColumns({"since": F.lit(0).cast("long"), "until": F.lit(rounds).cast("long")})
    else:
        n = n.join(todo, "pair_id")
    h = n.select("pair_id", "np", F.explode(F.sequence("since", F.col("until") - 1)).alias("h"))
    if ordered:
        h = prosac_prefix(h, model.size, budget)
    picks = h.select("pair_id", "h", F.explode(prosac_places(model.size) if ordered else picked_points(rounds, model.size)).alias("pt"))
    drawn = consensus.points_at(blocks, picks, list(model.axes))
    if model.sample is not None:
        return model.sample(drawn)
    return model.fit(drawn, ["pair_id", "h"]).dropna(subset=[model.names[0]]).drop("n")


def ransac(points: DataFrame, model: Model, rounds: int = 16, sigma: float = 0.5, factor: float = 3.84, confidence: float = 0.99, most: int = 1000, support: float | None = None, doubt: float = 0.05, ordered: bool = False, budget: int = GROWTH, inner: int = 0) -> DataFrame:
    """pair_id, h, inliers, n and the model: the hypothesis with most inliers (error < factor sigma^2), refitted on them.

    Each pair is tried `rounds` times, and then on while its best share w of inliers asks for more: a sample of clean
    points has come up with `confidence` after log(1 - confidence) / log(1 - w^size) rounds, `most` at most. Only
    pairs that need more are tried on. support: pairs whose inliers may be chance (min_inliers) are left out.
    ordered: pt is the order of falling quality and samples grow with it; a pair also stops at what the prefix
    of its last round needs, once the best has more inliers there than chance gives. inner: the best of each pair is then
    improved by so many samples of its own inliers at a time, as improved_best tells.

    Points are packed into blocks once (pt counts 0..n-1 in each pair). Each batch of hypotheses is fitted and written
    before it meets them as the matrix of its pair, so what moves is one count for each hypothesis and task.
    Pairs of up to whole_pairs.LOCAL points, of a model that a task can take whole, are each one task's work, and move once.
    """
    limit, names, axes = factor * sigma * sigma, model.names, list(model.axes)
    blocks = consensus.point_blocks(points, axes)
    sizes = cut(consensus.block_sizes(blocks))
    small = None
    if model.whole is not None and not ordered:
        small = whole_pairs.in_tasks(blocks, sizes, model, rounds, limit, confidence, most, inner)
        small = (small if support is None else small.filter(F.col("inliers") >= min_inliers(F.col("np"), model.size, support, doubt))).drop("np")
        sizes = cut(sizes.filter(F.col("np") > whole_pairs.LOCAL))
        if sizes.isEmpty():
            return small
    best, todo, zero = None, None, F.lit(0).cast("long")
    while True:
        models = cut(hypotheses(blocks, sizes, rounds, model, todo, ordered, budget))
        sized = models.join(sizes, "pair_id")
        sized = sized.withColumn("known", zero) if best is None else sized.join(best.select("pair_id", F.col("b.inliers").alias("known")), "pair_id", "left").withColumn("known", F.coalesce("known", zero))
        top = consensus.inlier_counts(blocks, sized, axes, names, model.errors, limit).groupBy("pair_id").agg(F.max(F.struct("inliers", (-F.col("h")).alias("h"))).alias("t"))
        met = top.select("pair_id", (-F.col("t.h")).alias("h"), F.col("t.inliers").alias("inliers")).join(models, ["pair_id", "h"])
        found = met.select("pair_id", F.struct("inliers", (-F.col("h")).alias("h"), *names).alias("b"))
        tried = sizes.filter(F.col("np") >= model.size).withColumn("tried", F.lit(rounds).cast("long")) if todo is None else todo.select("pair_id", F.col("until").alias("tried")).join(sizes, "pair_id")
        found = tried.join(found, "pair_id", "left")  # a pair whose samples were all degenerate is tried on
        if best is not None:
            found = found.unionByName(best).groupBy("pair_id", "np").agg(F.max("b").alias("b"), F.max("tried").alias("tried"))
        best = cut(found)
        clean = F.least(F.lit(1 - 1e-12), F.pow(F.col("b.inliers") / F.col("np"), F.lit(float(model.size))))
        need = F.when(clean > 0, F.ceil(math.log(1 - confidence) / F.log(1 - clean))).otherwise(most)
        state = best
        if ordered:
            state = best.join(prefix_inliers(blocks, best, model, limit, budget), "pair_id", "left")
            share = F.least(F.lit(1 - 1e-12), F.pow(F.col("within") / F.col("m"), F.lit(float(model.size))))
            enough = F.col("within") > F.coalesce(min_inliers(F.col("m"), model.size, 0.05, 0.05), F.col("m"))
            need = F.when(enough, F.least(need, F.ceil(math.log(1 - confidence) / F.log(1 - share)))).otherwise(need)
        open_ = state.withColumn("until", F.least(need, F.lit(most), 4 * F.col("tried")).cast("long")).filter("until > tried")
        todo = open_.select("pair_id", F.col("tried").alias("since"), "until")
        todo = cut(todo) if ordered else todo
        if todo.isEmpty():
            break
    best = best.filter("b is not null")
    if inner:
        best = improved_best(blocks, best, model, limit, inner, model.size * most)
    if support is not None:
        best = best.filter(F.col("b.inliers") >= min_inliers(F.col("np"), model.size, support, doubt))
    best = best.select("pair_id", "np", (-F.col("b.h")).alias("h"), "b.inliers", *[F.col(f"b.{c}").alias(c) for c in names])
    kept = points_under(blocks, best, axes).filter(model.error() < limit).select("pair_id", "h", "inliers", *axes)
    rest = model.fit(kept, ["pair_id", "h", "inliers"])
    return rest if small is None else small.unionByName(rest)


def points_under(blocks: DataFrame, models: DataFrame, axes: list[str]) -> DataFrame:
    """pair_id, pt, axes and what each pair's row of models (pair_id, np, ...) holds: models go to the points' blocks."""
    own = [c for c in models.columns if c != "pair_id"]
    met = blocks.join(consensus.each_run(models).hint("shuffle_hash"), ["pair_id", "run"])
    return consensus.block_points(met, axes, own)


def improved_best(blocks: DataFrame, best: DataFrame, model: Model, limit: float, inner: int, since: int) -> DataFrame:
    """best (pair_id, np, b) with the models of least error among samples of its inliers, and of theirs in turn.

    Where many points are wrong the best sample is seldom clean, but most of its inliers are, so few samples of these
    find the clean model. Samples are scored over all points of the pair by errors cut at the limit, as by number alone a
    model bent to one more wrong point would win. Pairs go on until none of `inner` samples is better; these
    have numbers from `since` on.
    """
    axes, names = list(model.axes), list(model.names)

    def scored(models: DataFrame, unit: int = UNIT) -> DataFrame:
        return consensus.inlier_counts(blocks, models, axes, model.names, model.errors, limit, unit)

    zero = F.lit(0).cast("long").alias("known")
    flat = cut(best.select("pair_id", "np", zero, (-F.col("b.h")).alias("h"), *[F.col(f"b.{c}").alias(c) for c in names]))
    best = cut(flat.join(scored(flat).withColumnRenamed("inliers", "gain"), ["pair_id", "h"]).select("pair_id", "np", "h", "gain", *names))
    active = best
    while not active.isEmpty():
        near = points_under(blocks, active, axes).filter(model.error() < limit)
        near = near.withColumn("pt", (F.row_number().over(Window.partitionBy("pair_id").orderBy("pt")) - 1).cast("long"))
        own = consensus.point_blocks(near.select("pair_id", "pt", *axes), axes)
        models = hypotheses(own, cut(consensus.block_sizes(own)), inner, model)
        models = cut(models.withColumn("h", F.col("h") + since))
        known = active.select("pair_id", "np", F.col("gain").alias("known"))
        top = scored(models.join(known, "pair_id")).groupBy("pair_id").agg(F.max(F.struct(F.col("inliers").alias("gain"), (-F.col("h")).alias("h"))).alias("t"))
        top = top.join(known, "pair_id").filter(F.col("t.gain") > F.col("known")).select("pair_id", "np", (-F.col("t.h")).alias("h"), "t.gain")
        active = cut(top.join(models, ["pair_id", "h"]).select("pair_id", "np", "h", "gain", *names))
        best = cut(best.join(active.select("pair_id"), "pair_id", "left_anti").unionByName(active))
        since += model.size * inner
    counts = scored(best.withColumn("known", zero), 1)
    return best.join(counts, ["pair_id", "h"]).select("pair_id", "np", F.struct("inliers", (-F.col("h")).alias("h"), *names).alias("b"))


def prefix_inliers(blocks: DataFrame, best: DataFrame, model: Model, limit: float, budget: int) -> DataFrame:
    """pair_id, m, within: the prefix of each pair's last round, and the best model's inliers in it."""
    best = best.filter("b is not null")
    last = prosac_prefix(best.select("pair_id", "np", (F.col("tried") - 1).alias("h")), model.size, budget).select("pair_id", "m")
    models = best.select("pair_id", "np", *[F.col(f"b.{c}").alias(c) for c in model.names]).join(last, "pair_id")
    points = points_under(blocks, models, list(model.axes)).filter(F.col("pt") < F.col("m"))
    return points.groupBy("pair_id", "m").agg(F.sum((model.error() < limit).cast("long")).alias("within"))


def ransac_similarity(points: DataFrame, rounds: int = 16, sigma: float = 0.5, factor: float = 3.84) -> DataFrame:
    return ransac(points, SIMILARITY_MODEL, rounds, sigma, factor)


def ransac_affine(points: DataFrame, rounds: int = 32, sigma: float = 0.5, factor: float = 3.84) -> DataFrame:
    return ransac(points, AFFINE_MODEL, rounds, sigma, factor)


def ransac_line(points: DataFrame, rounds: int = 16, sigma: float = 0.5, factor: float = 3.84) -> DataFrame:
    """As ransac, of the orthogonal line through pair_id, pt, x, y."""
    return ransac(points, LINE_MODEL, rounds, sigma, factor)


def ransac_homography(points: DataFrame, rounds: int = 32, sigma: float = 0.5, factor: float = 3.84) -> DataFrame:
    return ransac(points, HOMOGRAPHY_MODEL, rounds, sigma, factor)


def ransac_fundamental(points: DataFrame, rounds: int = 64, sigma: float = 0.5, factor: float = 3.84) -> DataFrame:
    """As ransac, of the fundamental matrix f0..f8; the error is Sampson's. h is three times the round, plus the root.

    Seven clean points are rare where half are wrong, so the best is improved by samples of its inliers.
    """
    return ransac(points, FUNDAMENTAL_MODEL, rounds, sigma, factor, inner=rounds)


def prosac(points: DataFrame, model: Model, rounds: int = 16, sigma: float = 0.5, factor: float = 3.84, **more) -> DataFrame:
    """As ransac, with samples from growing prefixes of the pair's points by falling score (ties by pt)."""
    order = Window.partitionBy("pair_id").orderBy(F.desc("score"), "pt")
    return ransac(points.withColumn("pt", (F.row_number().over(order) - 1).cast("long")), model, rounds, sigma, factor, ordered=True, **more)


def robust_weights(rows: DataFrame, partition: str, residual: str, scale: float = 1.0, share: float = 0.5, p: float = 0.8) -> DataFrame:
    """Add w_pnorm, w_tukey, w_fair, w_logistic, w_trimmed and w_uniform of a residual."""
    r = F.col(residual) / scale
    rank = F.row_number().over(Window.partitionBy(partition).orderBy(residual, "pt"))
    count = F.count(F.lit(1)).over(Window.partitionBy(partition))
    return rows.withColumns(
        {
            "w_pnorm": p / (F.pow(F.col(residual), F.lit(2 - p)) + 1e-8),
            "w_tukey": F.when(r >= 1, 0.0).otherwise(F.pow(1 - r * r, F.lit(2.0))),
            "w_fair": 1 / (1 + r),
            "w_logistic": F.when(r < 1e-12, 1.0).otherwise(F.tanh(r) / r),
            "w_trimmed": F.when(rank <= F.floor(count * share), 1.0).otherwise(0.0),
            "w_uniform": F.lit(1.0),
        }
    )
