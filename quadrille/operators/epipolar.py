"""Epipolar geometry of a pair of images: fundamental matrices of seven points, the refit on many, the Sampson error.

A matrix f0..f8 (by rows, of norm 1, its largest entry positive) says (x2, y2, 1) F (x, y, 1)' = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.normal import matrices, normal_sums
from quadrille.operators.steps import cut

FUNDAMENTAL = tuple(f"f{i}" for i in range(9))


def sampson_error() -> Column:
    """Squared distance, to first order, between a pair of points and the nearest pair that fits f0..f8."""
    f, x, y, u, v = [F.col(c) for c in FUNDAMENTAL], F.col("x"), F.col("y"), F.col("x2"), F.col("y2")
    right = [f[3 * i] * x + f[3 * i + 1] * y + f[3 * i + 2] for i in range(3)]
    left = [f[i] * u + f[3 + i] * v + f[6 + i] for i in range(2)]
    off = u * right[0] + v * right[1] + right[2]
    return off * off / (right[0] * right[0] + right[1] * right[1] + left[0] * left[0] + left[1] * left[1])


def sampson_errors(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    """As sampson_error, of models (n x 9) and points (4 x k)."""
    x, y, u, v = p
    one, two = np.stack([x, y, np.ones_like(x)]), np.stack([u, v, np.ones_like(u)])
    right = [m[:, 3 * i : 3 * i + 3] @ one for i in range(3)]
    left = [m[:, [i, 3 + i, 6 + i]] @ two for i in range(2)]
    off = u * right[0] + v * right[1] + right[2]
    return off * off / (right[0] ** 2 + right[1] ** 2 + left[0] ** 2 + left[1] ** 2)


def normalised(f: np.ndarray) -> np.ndarray:
    """Matrices (n x 9) of norm 1 whose largest entry is positive."""
    f = f / np.linalg.norm(f, axis=1, keepdims=True)
    return f * np.sign(np.take_along_axis(f, np.abs(f).argmax(1)[:, None], 1))


def seven_point(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fundamental matrices (k x 9) of samples (n x 7 x 4: x, y, x2, y2), and the sample of each: one to three, or none.

    Seven equations leave a pencil A + t B of the two last right singular vectors; det(A + t B) = 0 is a cubic in t,
    found here from its values at four t and solved by the eigenvalues of its companion matrix.
    """
    centre = samples.mean(1, keepdims=True)
    scale = np.maximum(samples.std(1).reshape(-1, 2, 2).mean(2), 1e-12)[:, None].repeat(2, axis=2)
    x, y, u, v = np.moveaxis((samples - centre) / scale, 2, 0)
    rows = np.stack([u * x, u * y, u, v * x, v * y, v, x, y, np.ones_like(x)], 2)
    _, size, right = np.linalg.svd(rows)
    a, b = right[:, 8].reshape(-1, 3, 3), right[:, 7].reshape(-1, 3, 3)
    t = np.array([-1.0, 0.0, 1.0, 2.0])
    values = np.stack([np.linalg.det(a + k * b) for k in t], 1)
    cubic = values @ np.linalg.inv(np.vander(t)).T  # highest power first
    good = (size[:, 6] > 1e-9 * size[:, 0]) & (np.abs(cubic[:, 0]) > 1e-12 * np.abs(cubic).max(1))
    which = np.flatnonzero(good)
    companion = np.zeros((len(which), 3, 3))
    companion[:, 0] = -cubic[which, 1:] / cubic[which, :1]
    companion[:, 1, 0] = companion[:, 2, 1] = 1
    roots = np.linalg.eigvals(companion) if len(which) else np.zeros((0, 3))
    at, k = np.nonzero(np.abs(roots.imag) < 1e-7 * (1 + np.abs(roots.real)))
    f = a[which[at]] + roots.real[at, k][:, None, None] * b[which[at]]
    turn = np.zeros((2, len(samples), 3, 3))
    for side in range(2):
        turn[side, :, 0, 0] = turn[side, :, 1, 1] = 1 / scale[:, 0, 2 * side]
        turn[side, :, :2, 2] = -centre[:, 0, 2 * side : 2 * side + 2] / scale[:, 0, 2 * side : 2 * side + 2]
        turn[side, :, 2, 2] = 1
    back = np.swapaxes(turn[1, which[at]], 1, 2) @ f @ turn[0, which[at]]
    return normalised(back.reshape(-1, 9)) if len(back) else np.zeros((0, 9)), which[at]


def sample_models(samples: DataFrame) -> DataFrame:
    """pair_id, h, f0..f8 of samples (pair_id, h, x, y, x2, y2; seven rows each): h is three times the sample's, plus the root."""
    packed = samples.groupBy("pair_id", "h").agg(F.array_sort(F.collect_list(F.struct("x", "y", "x2", "y2"))).alias("s")).filter(F.size("s") == 7)
    packed = packed.select("pair_id", "h", *[F.col(f"s.{c}").cast("array<double>").alias(c) for c in ("x", "y", "x2", "y2")])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.stack([np.asarray(batch.column(c).flatten()).reshape(-1, 7) for c in ("x", "y", "x2", "y2")], 2)
            f, of = seven_point(s)
            root = np.arange(len(of)) - np.searchsorted(of, of)
            h = 3 * np.asarray(batch.column("h"))[of] + root
            yield pa.RecordBatch.from_arrays([batch.column("pair_id").take(pa.array(of)), pa.array(h), *map(pa.array, f.T.copy())], names=["pair_id", "h", *FUNDAMENTAL])

    schema = T.StructType([samples.schema["pair_id"], T.StructField("h", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in FUNDAMENTAL]])
    return packed.mapInArrow(solve, schema)


def _least(a: np.ndarray, m: list[float], d: list[float]) -> np.ndarray | None:
    """f0..f8 of rank 2 from the 9 x 9 products of points of middle m and width d (x, y, x2, y2); None if these are degenerate."""
    size, vectors = np.linalg.eigh(a)
    if size[1] < 1e-12 * size[8]:
        return None
    p, s, q = np.linalg.svd(vectors[:, 0].reshape(3, 3))
    f = p @ np.diag([s[0], s[1], 0.0]) @ q
    one, two = (np.array([[1 / d[k], 0, -m[k] / d[k]], [0, 1 / d[k + 1], -m[k + 1] / d[k + 1]], [0, 0, 1]]) for k in (0, 2))
    return normalised((two.T @ f @ one).reshape(1, 9))[0]


def fundamental_of(p: np.ndarray) -> np.ndarray | None:
    """As fit_fundamental, of one group's points (4 x n)."""
    if p.shape[1] < 8:
        return None
    m, d = p.mean(1), np.maximum(p.std(1), 1e-12)
    x, y, u, v = (p - m[:, None]) / d[:, None]
    rows = np.stack([u * x, u * y, u, v * x, v * y, v, x, y, np.ones_like(x)])
    return _least(rows @ rows.T, m.tolist(), d.tolist())


def fit_fundamental(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, f0..f8 by least squares over eight or more points, of rank 2; null for fewer or degenerate ones.

    Coordinates are centred and scaled for each group; one grouped sum of the 9 x 9 products, then the least eigenvector.
    """
    spots = ("x", "y", "x2", "y2")
    points = cut(points)
    stats = points.groupBy(*keys).agg(*[F.avg(c).alias(f"m_{c}") for c in spots], *[F.greatest(F.stddev_pop(c), F.lit(1e-12)).alias(f"d_{c}") for c in spots])
    x, y, u, v = ((F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}") for c in spots)
    sums = normal_sums(points.join(stats, keys), keys, [([u * x, u * y, u, v * x, v * y, v, x, y, F.lit(1.0)], F.lit(0.0))]).join(stats, keys)

    def run(batches):
        for pdf in batches:
            a, _ = matrices(pdf, 9)
            out, full = pdf[[*keys, "n"]].copy(), np.full((len(pdf), 9), np.nan)
            for g in range(len(pdf)):
                if pdf["n"].iloc[g] < 8 or not np.isfinite(a[g]).all():
                    continue
                f = _least(a[g], [pdf[f"m_{c}"].iloc[g] for c in spots], [pdf[f"d_{c}"].iloc[g] for c in spots])
                full[g] = np.nan if f is None else f
            for i, name in enumerate(FUNDAMENTAL):
                out[name] = pd.Series(full[:, i], index=out.index).astype(object).where(~np.isnan(full[:, i]), None)
            yield out

    schema = T.StructType([*[sums.schema[k] for k in keys], sums.schema["n"], *[T.StructField(c, T.DoubleType()) for c in FUNDAMENTAL]])
    return sums.mapInPandas(run, schema)
