"""ICP's search in tiles against the grid join, whatever the sizes of its parts, and what it moves between rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import registration

KIND = "id int, x double, y double, z double"


def table(spark, v, first=0):
    return spark.createDataFrame([(first + i, *map(float, r)) for i, r in enumerate(v)], KIND)


@pytest.mark.parametrize("most", [(50_000, 400_000, 1_000_000), (7, 9, 50)])
def test_tiles_find_the_partners_of_the_grid_join(spark, monkeypatch, most):
    for name, n in zip(("POINTS", "MASTER", "PAIRS"), most, strict=True):
        monkeypatch.setattr(registration, name, n)
    r = np.random.default_rng(3)
    # coordinates on a lattice tie often; a clump, and points that are equal, far or nowhere
    cloud = np.r_[r.integers(-8, 9, (120, 3)) / 4, 1 + r.normal(size=(80, 3)) * 1e-3, [[50, 50, 50]]]
    points = np.r_[r.integers(-8, 9, (60, 3)) / 4, 1 + r.normal(size=(40, 3)) * 1e-3, [[1, 1, 1]] * 3, [[-90, 0, 0], [np.nan, 0, 0]]]
    at = np.eye(4)
    at[:3, 3] = 0.125, 0.125, -0.125
    one, two = table(spark, points), table(spark, cloud).withColumn("nx", F.col("id") * 1.0)
    want = sorted(tuple(x) for x in registration.nearest_3d(registration.moved(one, at), two, 0.5).drop("id").collect())
    search = registration.Search(one, two, 0.5)
    search.partners(np.eye(4))  # placed where the points start, within the slack of `at`
    tiles, got = search.tiles, []
    for x in search.partners(at).collect():
        got += [(x.x, x.y, x.z, x.d, x.m_x, x.m_y, x.m_z, x.m_nx)] * int(x.times)
    assert search.tiles is tiles and search.split == (most[0] == 7) and sorted(got) == want and len(want) > 60


def test_rounds_of_icp_move_sums_only(spark, monkeypatch):
    r = np.random.default_rng(4)
    cloud = r.uniform(0, 6, (300, 3))
    one, two = table(spark, cloud + [0.05, -0.04, 0.03]), table(spark, cloud)
    plans, places, search, placed = [], [], registration.partners, registration.placed
    monkeypatch.setattr(registration, "partners", lambda *a: plans.append(search(*a)) or plans[-1])
    monkeypatch.setattr(registration, "placed", lambda *a: places.append(1) or placed(*a))
    got = registration.icp(one, two, 0.5, rounds=30)
    assert np.allclose(got[:3, 3], [-0.05, 0.04, -0.03], atol=1e-3)
    assert len(places) == 1 and len(plans) > 1
    assert not any("Exchange" in p._jdf.queryExecution().executedPlan().toString() for p in plans)
