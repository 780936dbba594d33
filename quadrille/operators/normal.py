"""Least squares with many unknowns: grouped sums of a normal equation in Spark, then one small solve for each group."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.steps import cut, dealt


def normal_sums(rows: DataFrame, keys: list[str], equations: list[tuple[list[Column | None], Column]], weight: Column | None = None) -> DataFrame:
    """keys, n, and the sums a_i_j (i <= j) and b_i of each row's equations: coefficients (None is 0), right side."""
    size = len(equations[0][0])
    # coefficients are columns first: each stands in many sums and would be computed anew in all of them
    each = {f"__c{k}_{i}": c for k, (row, right) in enumerate(equations) for i, c in enumerate([*row, right]) if c is not None}
    rows = rows.select(*keys, (F.lit(1.0) if weight is None else weight).alias("__w"), *[c.alias(name) for name, c in each.items()])

    def total(i: int, j: int) -> Column:
        terms = [F.col(f"__c{k}_{i}") * F.col(f"__c{k}_{j}") for k in range(len(equations)) if f"__c{k}_{i}" in each and f"__c{k}_{j}" in each]
        return F.sum(F.col("__w") * reduce(Column.__add__, terms)) if terms else F.sum(F.lit(0.0))

    a = [total(i, j).alias(f"a_{i}_{j}") for i in range(size) for j in range(i, size)]
    b = [total(i, size).alias(f"b_{i}") for i in range(size)]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *a, *b)


def matrices(sums: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The symmetric matrices and right sides of rows of normal_sums."""
    a = np.zeros((len(sums), size, size))
    for i in range(size):
        for j in range(i, size):
            a[:, i, j] = a[:, j, i] = sums[f"a_{i}_{j}"].to_numpy(float)
    return a, sums[[f"b_{i}" for i in range(size)]].to_numpy(float)


def solved(sums: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, n and the unknowns of each group; null where the equation is singular. One aggregated row per group."""

    def run(batches):
        for pdf in batches:
            a, b = matrices(pdf, len(names))
            out = pdf[[*keys, "n"]].copy()
            x = np.full(b.shape, np.nan)
            k = np.arange(len(names))
            scale = np.sqrt(np.maximum(a[:, k, k], 1e-300))
            m = a / (scale[:, :, None] * scale[:, None, :])
            good = np.flatnonzero(np.isfinite(m).all((1, 2)))
            good = good[np.linalg.cond(m[good]) < 1e14] if len(good) else good
            x[good] = np.linalg.solve(m[good], (b / scale)[good][:, :, None])[:, :, 0] / scale[good]
            for i, name in enumerate(names):
                out[name] = pd.array(x[:, i], "Float64") if not np.isnan(x[:, i]).any() else pd.Series(x[:, i], index=out.index).astype(object).where(~np.isnan(x[:, i]), None)
            yield out

    schema = T.StructType([*[sums.schema[k] for k in keys], sums.schema["n"], *[T.StructField(n, T.DoubleType()) for n in names]])
    return sums.mapInPandas(run, schema)


AFFINE6 = ["p0", "p1", "p2", "p3", "p4", "p5"]


def fit_line_affine(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, n, p0..p5: the affine map that moves the end points (ax, ay), (bx, by) of segments onto lines
    -x sin(theta) + y cos(theta) = rho. Two equations for each segment."""
    s, c = -F.sin("theta"), F.cos("theta")
    equations = [([s, s * F.col(x), s * F.col(y), c, c * F.col(x), c * F.col(y)], F.col("rho")) for x, y in (("ax", "ay"), ("bx", "by"))]
    return solved(normal_sums(pairs, keys, equations, weight), keys, AFFINE6)


HOMOGRAPHY = ["h0", "h1", "h2", "h3", "h4", "h5", "h6", "h7"]


def homography_map(x: str = "x", y: str = "y") -> tuple[Column, Column]:
    """x, y as the homography h0..h7 (h8 = 1) maps them."""
    den = F.col("h6") * F.col(x) + F.col("h7") * F.col(y) + 1
    return (F.col("h0") * F.col(x) + F.col("h1") * F.col(y) + F.col("h2")) / den, (F.col("h3") * F.col(x) + F.col("h4") * F.col(y) + F.col("h5")) / den


def homography_error() -> Column:
    """Distance between the mapped point and (x2, y2)."""
    u, v = homography_map()
    return F.sqrt((u - F.col("x2")) * (u - F.col("x2")) + (v - F.col("y2")) * (v - F.col("y2")))


def fit_homography(points: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """keys, n, h0..h7 by linear least squares over x, y, x2, y2; fewer than four points or degenerate ones: nulls.

    Coordinates are centred and scaled for each group first (one row for each group, joined by key), so the sums
    stay well conditioned; the result is turned back to the given coordinates.
    """
    stats = spot_stats(points, keys)
    return scaled_fit(points.join(stats, keys), stats, keys, weight)


SPOTS = ("x", "y", "x2", "y2")


def spot_stats(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m_ and d_ of each coordinate: its mean and deviation."""
    return points.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in SPOTS], *[F.greatest(F.stddev_pop(c), F.lit(1e-12)).alias(f"d_{c}") for c in SPOTS])


def scaled_fit(rows: DataFrame, stats: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """fit_homography of points that hold their group's row of spot_stats."""
    x, y, u, v = ((F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}") for c in SPOTS)
    one = F.lit(1.0)
    equations = [([x, y, one, None, None, None, -x * u, -y * u], u), ([None, None, None, x, y, one, -x * v, -y * v], v)]
    scaled = solved(normal_sums(rows, keys, equations, weight), keys, HOMOGRAPHY).join(stats, keys)

    def run(batches):
        for pdf in batches:
            h = np.c_[pdf[HOMOGRAPHY].to_numpy(float), np.ones(len(pdf))].reshape(-1, 3, 3)
            m, d = pdf[[f"m_{c}" for c in SPOTS]].to_numpy(float), pdf[[f"d_{c}" for c in SPOTS]].to_numpy(float)
            out = pdf[[*keys, "n"]].copy()
            full = np.full((len(pdf), 8), np.nan)
            before, after = (np.tile(np.eye(3), (len(pdf), 1, 1)) for _ in range(2))
            for k in (0, 1):
                before[:, k, k], before[:, k, 2] = 1 / d[:, k], -m[:, k] / d[:, k]
                after[:, k, k], after[:, k, 2] = d[:, k + 2], m[:, k + 2]
            t = after @ h @ before
            good = np.isfinite(t).all((1, 2)) & (np.abs(t[:, 2, 2]) > 1e-300)
            full[good] = (t[good] / t[good, 2:, 2:]).reshape(-1, 9)[:, :8]
            for i, name in enumerate(HOMOGRAPHY):
                out[name] = pd.Series(full[:, i], index=out.index).astype(object).where(~np.isnan(full[:, i]), None)
            yield out

    schema = T.StructType([*[scaled.schema[k] for k in keys], scaled.schema["n"], *[T.StructField(n, T.DoubleType()) for n in HOMOGRAPHY]])
    return scaled.mapInPandas(run, schema)


def refine_homography(points: DataFrame, start: DataFrame, keys: list[str], loops: int = 5, limit: float = 3.0) -> DataFrame:
    """keys, n, fitted, h0..h7: refits in which a point of squared error e weighs limit^2 / (e + limit^2).

    start: keys, h0..h7. fitted counts the points nearer than limit at the end. Each loop is one grouped sum.
    """
    wide, model = limit * limit, cut(start.select(*keys, *HOMOGRAPHY))
    points = dealt(points.select(*keys, "x", "y", "x2", "y2"), keys)  # so that loops move sums only
    stats = cut(spot_stats(points, keys))
    for _ in range(loops):
        e = homography_error()
        at = points.join(model.join(stats, keys).hint("shuffle_hash"), keys)
        model = cut(scaled_fit(at, stats, keys, wide / (e * e + wide)).select(*keys, *HOMOGRAPHY))
    return points.join(model.hint("shuffle_hash"), keys).groupBy(*keys, *HOMOGRAPHY).agg(F.count(F.lit(1)).alias("n"), F.sum((homography_error() < limit).cast("long")).alias("fitted"))
