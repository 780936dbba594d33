"""Kernels over tiles, tiled correlation, selection, residuals and normalised components against plain versions."""

import math
import random

import numpy as np
import pytest

from quadrille.operators import points, stats, tiles, warp
from pyspark.sql import functions as F


@pytest.mark.parametrize("kernel", ["cubic", "lanczos"])
def test_kernels_do_not_depend_on_tiles(spark, kernel):
    rng = np.random.default_rng(3)
    grid = rng.normal(size=(23, 31))
    grid[4:6, 8:12] = np.nan
    cells = [(1, 0, r, c, None if np.isnan(grid[r, c]) else float(grid[r, c])) for r in range(23) for c in range(31) if (r, c) != (20, 20)]
    grid[20, 20] = np.nan
    px = spark.createDataFrame(cells, "image_id int, band int, row long, col long, value double")
    spots = [(1, 0, i, j, -3 + 0.37 * j + 0.1 * i, -2 + 0.41 * i) for i in range(70) for j in range(90)] + [(1, 0, 99, 99, None, 1.0), (2, 0, 0, 0, 1.0, 1.0), (1, 0, 0, 200, 7.0, 9.0)]
    target = spark.createDataFrame(spots, "image_id int, band int, row long, col long, sx double, sy double")
    got = {(x.image_id, x.row, x.col): x.value for x in warp.warp_kernel(px, target, F.col("sx"), F.col("sy"), kernel, source=8, block=16).collect()}
    weigh = {"cubic": lambda t: 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0, "lanczos": lambda t: 1.0 if t == 0 else math.sin(math.pi * t) * math.sin(math.pi * t / 3) * 3 / (math.pi * t) ** 2 if t < 3 else 0.0}[kernel]
    assert len(got) == len(spots) and got[1, 99, 99] is None and got[2, 0, 0] is None and abs(got[1, 0, 200] - grid[9, 7]) < 1e-12
    for image, _, i, j, x, y in random.Random(1).sample(spots[:-3], 400):
        total = weight = 0.0
        for r in range(math.floor(y) - 2, math.floor(y) + 4):
            for c in range(math.floor(x) - 2, math.floor(x) + 4):
                if 0 <= r < 23 and 0 <= c < 31 and not np.isnan(grid[r, c]):
                    w = weigh(abs(y - r)) * weigh(abs(x - c))
                    total, weight = total + w * grid[r, c], weight + w
        want = total / weight if abs(weight) > 1e-9 else None
        assert (got[image, i, j] is None) == (want is None) and (want is None or abs(got[image, i, j] - want) < 1e-6 * max(1, abs(want)))


def test_tiles_find_what_the_whole_image_does(spark):
    rng = np.random.default_rng(4)
    image = rng.normal(size=(40, 50))
    cells = [("k", r - 5, c + 3, float(image[r, c])) for r in range(40) for c in range(50)]
    shapes = {1: (7, 5), 2: (3, 12), 3: (41, 2), 4: (40, 50)}
    rows, want = [], {}
    for t, (h, w) in shapes.items():
        a = rng.normal(size=(h, w)) if t != 4 else image.copy()
        rows += [("k", t, r, c, float(a[r, c])) for r in range(h) for c in range(w)]
        if h <= 40:
            score = tiles.correlation(a, image)
            r, c = np.unravel_index(np.argmax(np.round(score, 12)), score.shape)
            want[t] = (r - 5, c + 3, score[r, c])
    search = spark.createDataFrame([*cells, ("other", 0, 0, 1.0)], "k string, row long, col long, value double")
    template = spark.createDataFrame(rows, "k string, t int, row long, col long, value double")
    for size in (8, 64):
        got = {x.t: (x.row, x.col, x.score) for x in tiles.ncc_match(template, search, "k", "t", size).collect()}
        assert got.keys() == want.keys() == {1, 2, 4}
        assert all(got[t][:2] == want[t][:2] and abs(got[t][2] - want[t][2]) < 1e-9 for t in want)
    assert tiles.ncc_match(template.limit(0), search, "k", "t").count() == 0


def test_selection_equals_a_sort(spark):
    r = random.Random(2)
    values = [r.choice([r.gauss(0, 1), 1e-300, 1e300, -1e300, 7.0, 7.0, math.inf, -math.inf, 5e-324]) for _ in range(600)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5 + [(math.nan,)] * 2, "v double").repartition(3)
    want = sorted(values)
    for k in (1, 2, 60, 150, 300, 450, 599, 600):
        assert points.select_kth(rows, "v", k, bins=16) == want[k - 1], k
    assert math.isnan(points.select_kth(rows, "v", 10_000)) and points.select_kth(rows, "v", -4) == want[0]
    assert points.select_kth(rows.filter("v is null"), "v", 1) is None


def test_ground_residuals(spark):
    rows = [("a", 10.0, 60.0, 5.0, 9.9999, 60.0, 2.0), ("a", 10.0, 0.0, 5.0, 10.0, -0.00004, 5.0), ("b", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    got = {x.k: (x.n, round(x.rmse, 6), round(x.max_error, 6)) for x in points.residual_report(points.ground_residuals(spark.createDataFrame(rows, "k string, lon double, lat double, hgt double, mlon double, mlat double, mhgt double")), "k", ("dx", "dy", "dz")).collect()}
    one, two = 25 + 9, 16
    assert got == {"a": (2, round(math.sqrt((one + two) / 2), 6), round(math.sqrt(one), 6)), "b": (1, 0.0, 0.0), None: (3, round(math.sqrt((one + two) / 3), 6), round(math.sqrt(one), 6))}


def test_normalised_components(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4)) * [1, 100, 0.01, 5] + [3, 0, 1, -200]
    rows = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    model = stats.pca_fit(rows, "v", normalise=True)
    values = np.linalg.eigvalsh(np.corrcoef(x.T))[::-1]
    assert np.allclose(model["values"], values / 4) and abs(model["energy"] - 4) < 1e-9
    stats.pca_save(spark, model, str(tmp_path / "m"))
    again = stats.pca_load(spark, str(tmp_path / "m"))
    checks = stats.pca_checks(rows, "v", again)
    assert checks["accuracy"] > 1 - 1e-9
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    got = {r.id: r.principals for r in stats.pca_transform(rows, "v", again, 2).collect()}
    assert np.allclose([got[i] for i in range(60)], z @ model["vectors"][:2].T)
    cov = {(r.i, r.j): r.cov for r in stats.covariance(rows, "v").collect()}
    assert all(abs(cov[i, j] - np.cov(x.T)[i, j]) < 1e-9 * (1 + abs(cov[i, j])) for i in range(4) for j in range(i, 4))
    assert {r.cov for r in stats.covariance(rows.limit(1), "v").collect()} == {None} and stats.covariance(rows.limit(0), "v").count() == 0
    flat = rows.withColumn("v", F.concat("v", F.array(F.lit(2.0))))
    with pytest.raises(ValueError):
        stats.pca_fit(flat, "v", normalise=True)
