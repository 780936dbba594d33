"""Joint adjustment of many images: Levenberg-Marquardt over parameters of each image and parameters all images share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.normal import matrices, normal_sums
from quadrille.operators.steps import by_size, cut, dealt


class Sensor(NamedTuple):
    """own: parameters of each image with start values; shared: those of all. predict gives x2, y2 of a point."""

    own: dict[str, float]
    shared: dict[str, float]
    predict: Callable[[dict[str, Column]], tuple[Column, Column]]


def _equations(sensor: Sensor, step: float) -> list[tuple[list[Column | None], Column]]:
    """Central differences by every parameter, and the residuals observed - modelled."""
    at = {p: F.col(p) for p in (*sensor.own, *sensor.shared)}
    sides = [(sensor.predict({**at, p: at[p] + step}), sensor.predict({**at, p: at[p] - step})) for p in at]
    here = sensor.predict(at)
    return [([(plus[k] - minus[k]) * (0.5 / step) for plus, minus in sides], F.col(c) - here[k]) for k, c in enumerate(("x2", "y2"))]


def _normal(points: DataFrame, images: DataFrame, sensor: Sensor, step: float) -> tuple[DataFrame, float, int, float, float]:
    """Each image's parameters and sums of the normal equation; the squared error, the points, the largest diagonal entry and right side."""
    size = len(sensor.own) + len(sensor.shared)
    # the residuals ride along as one more unknown, so that their square is summed in the same pass
    equations = [([*c, r], r) for c, r in _equations(sensor, step)]
    met = points.join(images.hint("shuffle_hash"), "image_id")
    sums = cut(normal_sums(met, ["image_id", *sensor.own], equations))
    most = [F.max(F.greatest(*c) if size > 1 else c[0]) for c in ([F.col(f"a_{i}_{i}") for i in range(size)], [F.abs(F.col(f"b_{i}")) for i in range(size)])]
    got = sums.agg(F.sum(f"a_{size}_{size}"), F.sum("n"), *most).first()
    return sums, got[0] or 0.0, got[1] or 0, got[2], got[3]


def block_adjust(points: DataFrame, sensor: Sensor, rounds: int = 200, tolerance: float = 1e-10, step: float = 0.5) -> tuple[DataFrame, dict[str, float], float, float]:
    """Images (image_id, own parameters), the shared parameters, and the RMSE before and after.

    points: image_id, x, y, x2, y2. A point touches only its image's parameters and the shared ones, so the normal
    equation is one small block for each image, summed by Spark. Images are eliminated block by block in tasks;
    the driver solves for the shared parameters alone. Damping starts at 1e-3 of the largest diagonal entry; it
    shrinks by max(1/3, 1 - (2 rho - 1)^3) on a gain and grows 2, 4, 8 times on a loss. No points: start values, 0.
    """
    own, few = list(sensor.own), len(sensor.shared)
    shared = dict(sensor.shared)
    points = dealt(points, ["image_id"])  # so that rounds move sums only
    images = points.select("image_id").distinct().select("image_id", *[F.lit(float(v)).alias(p) for p, v in (sensor.own | sensor.shared).items()])
    sums, cost, n, largest, right = _normal(points, images, sensor, step)
    start, mu, nu = cost, 1e-3 * (largest or 0.0), 2.0
    # shared parameters stand in each image's row, not in the plan, whose code stays the same in all rounds
    schema = T.StructType([points.schema["image_id"], *[T.StructField(p, T.DoubleType()) for p in (*own, *shared, "gain", "move")]])
    for _ in range(rounds if n else 0):
        if right < tolerance:
            break
        delta = np.zeros(few)
        if few:
            rows = sums.mapInPandas(_reducer(len(own), few, mu), ", ".join(f"s_{i} double" for i in range(few * few + few))).agg(*[F.sum(f"s_{i}") for i in range(few * few + few)]).first()
            total = np.array(rows, float)
            delta = np.linalg.solve(total[: few * few].reshape(few, few) + mu * np.eye(few), total[few * few :])
        named = dict(zip(shared, (v + d for v, d in zip(shared.values(), delta, strict=True)), strict=True))
        moves = cut(sums.mapInPandas(_mover(own, named, delta, mu), schema))
        sums_of = moves.agg(F.sum("gain"), F.sum("move")).first()
        tried = _normal(points, moves.drop("gain", "move"), sensor, step)
        now = tried[1]
        gain = (sums_of[0] or 0.0) + mu * float(delta @ delta)
        rho = (cost - now) / gain if gain > 0 else 0.0
        if rho > 0:
            small = abs(cost - now) <= tolerance * max(cost, tolerance)
            shared, (sums, cost, n, largest, right) = named, tried
            mu, nu = mu * max(1 / 3, 1 - (2 * rho - 1) ** 3), 2.0
            if small:
                break
        else:
            mu, nu = mu * nu, nu * 2
            if (sums_of[1] or 0.0) + float(delta @ delta) < tolerance**2 or nu > 1e12:
                break
    return sums.select("image_id", *own), shared, (start / n) ** 0.5 if n else 0.0, (cost / n) ** 0.5 if n else 0.0


def _reducer(own: int, few: int, mu: float):
    """What each image leaves for the shared parameters once its own are eliminated, summed over a batch."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            a, b = matrices(pdf, own + few)
            out = np.zeros(few * few + few)
            x = np.linalg.solve(a[:, :own, :own] + mu * np.eye(own), np.concatenate([a[:, :own, own:], b[:, :own, None]], 2)) if own else np.zeros((len(a), 0, few + 1))
            out[: few * few] = (a[:, own:, own:] - a[:, own:, :own] @ x[:, :, :few]).sum(0).ravel()
            out[few * few :] = (b[:, own:] - (a[:, own:, :own] @ x[:, :, few:])[:, :, 0]).sum(0)
            yield pd.DataFrame([out], columns=[f"s_{i}" for i in range(len(out))])

    return run


def _mover(names: list[str], shared: dict[str, float], delta: np.ndarray, mu: float):
    """Each image's own parameters after their steps, given those of the shared ones."""
    own = len(names)

    def run(batches):
        for pdf in batches:
            a, b = matrices(pdf, own + len(delta))
            d = np.linalg.solve(a[:, :own, :own] + mu * np.eye(own), (b[:, :own] - a[:, :own, own:] @ delta)[:, :, None])[:, :, 0]
            out = pdf[["image_id"]].copy()
            for i, p in enumerate(names):
                out[p] = pdf[p] + d[:, i]
            for p, v in shared.items():
                out[p] = v
            out["gain"] = (d * (mu * d + b[:, :own])).sum(1) + b[:, own:] @ delta
            out["move"] = (d * d).sum(1)
            yield out

    return run


#: Groups of up to so many points are refined in one task; larger ones in rounds of grouped sums.
LOCAL = 50_000


def refine_gcps(points: DataFrame, keys: list[str], tolerance: float, least: int) -> DataFrame:
    """points without those of the worst affine residual, taken away one at a time per group.

    A group stops once its largest residual is within tolerance or `least` points remain; ties go to the lower pt.
    points: keys, pt, x, y, x2, y2. Groups of up to LOCAL points run each in a task. All larger ones advance
    together: a round is one grouped fit and one grouped maximum.
    """
    points = cut(points)
    small, large = by_size(points, keys, LOCAL)
    kept = small.groupBy(*keys).applyInPandas(_refined(tolerance, least), points.schema)
    return kept if large.isEmpty() else kept.unionByName(_refined_in_rounds(large, keys, tolerance, least))


def _refined(tolerance: float, least: int):
    def run(pdf):
        pdf = pdf.sort_values("pt", ignore_index=True)
        a = np.c_[np.ones(len(pdf)), pdf[["x", "y"]].to_numpy(float)]
        t, left = pdf[["x2", "y2"]].to_numpy(float), np.ones(len(pdf), bool)
        while left.sum() > least:
            model, _, rank, _ = np.linalg.lstsq(a[left], t[left], rcond=None)
            if rank < 3:  # collinear points have no fit, so no residual
                break
            off = np.where(left, np.hypot(*(a @ model - t).T), -1.0)
            if not off.max() > tolerance:
                break
            left[off.argmax()] = False
        return pdf[left]

    return run


def _refined_in_rounds(points: DataFrame, keys: list[str], tolerance: float, least: int) -> DataFrame:
    from quadrille.operators.fitting import affine_error, fit_affine

    at, done = cut(points), []
    while True:
        e = at.join(fit_affine(at, keys), keys).filter(F.col("n") > least).withColumn("__e", affine_error())
        worst = e.groupBy(*keys).agg(F.max(F.struct("__e", (-F.col("pt")).alias("p"))).alias("w")).filter(F.col("w.__e") > tolerance).select(*keys, (-F.col("w.p")).alias("pt"))
        worst = cut(worst)
        rest = at.join(worst.select(*keys), keys, "left_anti")
        if worst.isEmpty():
            return reduce(DataFrame.unionByName, done, at)
        done.append(cut(rest))
        at = cut(at.join(worst.select(*keys), keys, "left_semi").join(worst, [*keys, "pt"], "left_anti").select(*points.columns))
