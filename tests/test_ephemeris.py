"""The sparse adjustment against dense normal equations, over several chunks, and its planted angles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import ephemeris
from quadrille.operators.adjustment import Sensor


def sensor(p):
    x, y = F.col("x"), F.col("y")
    return x + 3 * p["a"] + y * p["b"] + p["k"] * x, y - x * p["b"] + p["k"] * y


def observed(n, rows, seed, noise):
    r = np.random.default_rng(seed)
    truth, k = r.normal(0, 0.2, (2, rows + 1, 2)), 0.1
    out = []
    for image in range(2):
        t = r.uniform(0, rows, n)
        x, y = r.uniform(-1, 1, (2, n))
        e = np.floor(t).astype(int)
        a, b = (truth[image, e].T * (1 - (t - e)) + truth[image, e + 1].T * (t - e))
        u, v = x + 3 * a + y * b + k * x, y - x * b + k * y
        out += [(image, *map(float, z)) for z in zip(t, x, y, u + r.normal(0, noise, n), v + r.normal(0, noise, n), strict=True)]
    return out, truth, k


def dense(rows, count):
    """Least squares over all parameters at once; the model is linear in them."""
    size = 2 * (count + 1) * 2 + 1
    m, right = np.zeros((2 * len(rows), size)), np.zeros(2 * len(rows))
    for i, (image, t, x, y, u, v) in enumerate(rows):
        e, w = int(np.floor(t)), t - np.floor(t)
        for row, share in ((e, 1 - w), (e + 1, w)):
            at = 2 * (image * (count + 1) + row)
            m[2 * i, at], m[2 * i, at + 1], m[2 * i + 1, at + 1] = 3 * share, y * share, -x * share
        m[2 * i, -1], m[2 * i + 1, -1] = x, y
        right[2 * i : 2 * i + 2] = u - x, v - y
    return np.linalg.lstsq(m, right, rcond=None)[0]


@pytest.mark.parametrize("chunk", [512, 3])
def test_rows_equal_dense_least_squares(spark, monkeypatch, chunk):
    monkeypatch.setattr(ephemeris, "CHUNK", chunk)  # with 3, conjugate gradients must join the chunks
    rows, _, _ = observed(150, 7, 1, 0.05)
    table = spark.createDataFrame(rows, "image_id int, t double, x double, y double, x2 double, y2 double")
    got, shared, before, after = ephemeris.ephemeris_adjust(table, Sensor({"a": 0.0, "b": 0.0}, {"k": 0.0}, sensor), 1.0)
    want = dense(rows, 7)
    assert abs(shared["k"] - want[-1]) < 1e-5 and after < before
    for r in got.collect():
        assert np.allclose([r.a, r.b], want[2 * (r.image_id * 8 + r.row) :][:2], atol=2e-5)


def test_gaps_and_empty_tables(spark):
    rows, truth, k = observed(200, 9, 2, 0.0)
    rows = [r for r in rows if not 3 <= r[1] < 5]  # rows 3 and 5 still have points on one side, row 4 none
    table = spark.createDataFrame(rows, "image_id int, t double, x double, y double, x2 double, y2 double")
    got, shared, _, after = ephemeris.ephemeris_adjust(table, Sensor({"a": 0.0, "b": 0.0}, {"k": 0.0}, sensor), 1.0)
    got = {(r.image_id, r.row): (r.a, r.b) for r in got.collect()}
    assert (0, 4) not in got and abs(shared["k"] - k) < 1e-5 and after < 1e-5
    assert all(np.allclose(v, truth[i, e], atol=1e-4) for (i, e), v in got.items())
    none, shared, before, after = ephemeris.ephemeris_adjust(table.limit(0), Sensor({"a": 0.0, "b": 0.0}, {"k": 0.5}, sensor), 1.0)
    assert none.count() == 0 and shared == {"k": 0.5} and before == after == 0


def test_images_of_one_chunk_need_no_gradients(spark, monkeypatch):
    def gradients(*_):
        raise AssertionError("these images can be eliminated")

    monkeypatch.setattr(ephemeris, "_by_gradients", gradients)
    rows = [(i, t, float(x), t, x + i * 0.1 + 0.2 * t + 0.3 * x) for i in range(3) for t in (0.0, 0.25, 0.5, 1.0, 1.75) for x in range(6)]
    rows = [(*r, r[3] - r[0]) for r in rows]
    table = spark.createDataFrame(rows, "image_id int, t double, x double, y double, x2 double, y2 double")

    def predict(p):
        return F.col("x") + p["a"] + p["k"] * F.col("x"), F.col("y") + p["b"]

    got, shared, before, after = ephemeris.ephemeris_adjust(table, Sensor({"a": 0.0, "b": 0.0}, {"k": 0.0}, predict), 1.0)
    assert before > 0.5 and after < 1e-6 and abs(shared["k"] - 0.3) < 1e-6
    assert all(abs(r.a - r.image_id * 0.1 - 0.2 * r.row) < 1e-5 and abs(r.b + r.image_id) < 1e-5 for r in got.collect())
