"""RANSAC of pairs in one task each: the same rounds and results as by joins, without tables of hypotheses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import fitting, whole_pairs


def scenes(spark, share):
    """Five pairs: a similarity, or two cameras, with noise, `share` of the points wrong, equal ones and gaps; one of too few points."""
    r, rows = np.random.default_rng(5), []
    for pair in range(5):
        n = 90 + 40 * pair
        x, y, z = r.uniform(0, 100, n).round(1), r.uniform(0, 50, n).round(1), r.uniform(1, 2, n)
        u, v = (0.9 * x + 0.2 * y + pair, -0.2 * x + 0.9 * y - 3) if pair % 2 else ((x * z + 30) / (z + 0.2), (y * z + 20) / (z + 0.2))
        wrong = r.uniform(size=n) < share
        u, v = u + r.normal(0, 0.1, n) + wrong * r.uniform(20, 200, n), v + r.normal(0, 0.1, n) - wrong * r.uniform(20, 200, n)
        rows += [(pair, i, *(float(c[i]) for c in (x, y, u, v))) for i in range(n)] + [(pair, n, None, 1.0, 2.0, 3.0), (pair, n + 1, 1.0, float("nan"), 2.0, 3.0)]
    rows += [(7, i, 1.0, 1.0, 2.0, 2.0) for i in range(30)] + [(8, 0, 1.0, 1.0, 2.0, 2.0)]
    return spark.createDataFrame(rows, "pair_id int, pt long, x double, y double, x2 double, y2 double")


@pytest.mark.parametrize("find", [fitting.ransac_similarity, lambda t: fitting.ransac(t, fitting.SIMILARITY_MODEL, support=0.05)])
def test_pairs_in_one_task_equal_the_joins(spark, monkeypatch, find):
    table = scenes(spark, 0.5)
    one = {r.pair_id: r for r in find(table).collect()}
    monkeypatch.setattr(whole_pairs, "LOCAL", 150)  # some pairs by either way
    other = find(table)
    names, other = other.columns, {r.pair_id: r for r in other.collect()}
    assert set(one) == set(other) and len(one) >= 2
    for pair, r in one.items():
        assert r[:4] == other[pair][:4] and list(r.asDict()) == names
        assert np.allclose(np.array(r[4:], float), np.array(other[pair][4:], float), atol=1e-6, equal_nan=True)


def test_fundamental_matrices_in_one_task_equal_the_joins(spark, monkeypatch):
    table = scenes(spark, 0.4).filter("pair_id in (0, 2)").dropna().filter("not isnan(y)")
    one = {r.pair_id: r for r in fitting.ransac_fundamental(table).collect()}
    monkeypatch.setattr(whole_pairs, "LOCAL", 0)
    other = {r.pair_id: r for r in fitting.ransac_fundamental(table).collect()}
    assert set(one) == set(other) == {0, 2}
    assert all(one[p][:4] == other[p][:4] and np.allclose(one[p][4:], other[p][4:], atol=1e-6) for p in one)


@pytest.mark.parametrize("size", [2, 4, 7])
def test_places_of_rounds_equal_the_columns(spark, size):
    rows = spark.createDataFrame([(n, h) for n in (size, 11, 600) for h in range(120)], "np long, h long")
    got = {(r.np, r.h): r.p for r in rows.select("np", "h", fitting.picked_points(16, size).alias("p")).collect()}
    for n in (size, 11, 600):
        assert whole_pairs.picked_points(np.arange(120), n, 16, size).tolist() == [got[n, h] for h in range(120)]


def test_pairs_of_bounded_size_write_no_hypotheses(spark, monkeypatch):
    monkeypatch.setattr(fitting, "hypotheses", None)
    table = scenes(spark, 0.3).filter(F.col("pair_id") < 5)
    assert fitting.ransac_similarity(table).count() == 5 and fitting.ransac_fundamental(table).count() == 5
