"""k nearest points and box joins against brute force, on clustered points and boxes of all sizes."""

import random

import pytest
from pyspark.sql import functions as F

from quadrille.operators import nearest, spatial


def clustered(r, n, key):
    out = []
    for i in range(n):
        c = r.choice([(0, 0, 1e-4), (5, 5, 0.01), (1000, -3, 1.0)])
        out.append((key, i, c[0] + r.gauss(0, c[2]), c[1] + r.gauss(0, c[2])))
    return out


@pytest.mark.parametrize("norm", [2, 1])
def test_k_nearest_on_clusters(spark, monkeypatch, norm):
    monkeypatch.setattr(nearest, "CAPACITY", 6)
    r = random.Random(3)
    right = clustered(r, 150, "a") + clustered(r, 40, "b") + [("c", 1, 0.0, 0.0), ("c", 2, 3.0, 4.0)]
    right += [("a", 500 + i, 7.0, 7.0) for i in range(60)] + [("a", 900, None, 1.0)]  # many in one place
    left = clustered(r, 60, "a") + [("a", 100, -1e4, 1e4), ("a", 101, 7.0, 7.0), ("a", 102, 7.0, 7.0), ("b", 7, 500.0, 500.0), ("c", 9, 1.0, 1.0), ("d", 1, 0.0, 0.0), ("b", 8, None, None)]
    schema = "k string, id int, x double, y double"
    got = nearest.k_nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], 4, norm).collect()
    want = []
    for key, i, x, y in left:
        if x is None:
            continue
        d = [(abs(x - u) + abs(y - v) if norm == 1 else ((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for q, j, u, v in right if q == key and u is not None]
        want += [(key, i, n + 1, j, round(e, 9)) for n, (e, j) in enumerate(sorted(d)[:4])]
    assert sorted((g.k, g.left_id, g.rank, g.right_id, round(g.d, 9)) for g in got) == sorted(want)


def test_a_far_query_looks_at_few_points(spark):
    right = spark.range(20_000).select(F.lit(0).alias("k"), "id", ((F.col("id") * 7919) % 20_011 / 1000).alias("x"), ((F.col("id") * 104_729) % 20_021 / 1000).alias("y"))
    left = spark.createDataFrame([(0, 1, 500.0, 3.0), (0, 2, -80.0, 900.0)], "k int, id long, x double, y double")
    got = nearest.k_nearest(left, right, ["k"], 3)
    d = F.sqrt((F.col("x") - F.col("u")) ** 2 + (F.col("y") - F.col("v")) ** 2)
    every = left.select("k", F.col("id").alias("q"), F.col("x").alias("u"), F.col("y").alias("v")).join(right, "k").select("q", "id", d.alias("d")).collect()
    want = [(q, j) for q in (1, 2) for _, j in sorted((x.d, x.id) for x in every if x.q == q)[:3]]
    assert [(x.left_id, x.right_id) for x in got.orderBy("left_id", "rank").collect()] == want


def test_boxes_of_all_sizes(spark):
    r = random.Random(6)
    def some(n, wide):
        return [(r.uniform(-50, 50), r.uniform(-50, 50), r.choice(wide)) for _ in range(n)]
    left = [(i, x, y, x + w, y + w / 3) for i, (x, y, w) in enumerate(some(120, [0, 0.1, 1, 8, 64]))] + [(200, -1e6, -1e6, 1e6, 1e6), (201, 0.0, 0.0, None, 1.0), (202, 5.0, 5.0, 4.0, 6.0), (203, -4.0, -4.0, 4.0, 4.0)]
    right = [(i, x, y, x + w / 2, y + w) for i, (x, y, w) in enumerate(some(120, [0, 0.3, 2, 32]))] + [(300, -1e7, 0.0, 1e7, 0.5), (301, 4.0, 4.0, 4.0, 4.0), (302, -8.0, -8.0, -4.0, -4.0)]
    schema = "id int, xmin double, ymin double, xmax double, ymax double"
    got = spatial.footprint_join(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 1.0).collect()
    want = {}
    for a in left:
        for b in right:
            if None not in a and a[1] <= a[3] and a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]:
                want[a[0], b[0]] = (max(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3]), min(a[4], b[4]))
    assert len(got) == len(want) and {(g.left_id, g.right_id): (g.xmin, g.ymin, g.xmax, g.ymax) for g in got} == want


def test_a_large_box_meets_few_cells(spark):
    one = spark.createDataFrame([(1, -2e7, -2e7, 2e7, 2e7)], "id int, xmin double, ymin double, xmax double, ymax double")
    level = spatial._levelled(one, 0.5, "a")
    assert spatial._placed(level, 0.5, "a", F.array("own")).count() <= 4


@pytest.mark.parametrize("group", [80, 0])
@pytest.mark.parametrize("norm", [2, 1])
def test_k_nearest_of_large_groups(spark, monkeypatch, norm, group):
    """The same by the quadtree, for all groups and for those of more than 80 points."""
    monkeypatch.setattr(nearest, "GROUP", group)
    test_k_nearest_on_clusters(spark, monkeypatch, norm)


def test_small_groups_write_no_tree(spark, monkeypatch):
    monkeypatch.setattr(nearest, "_by_quadtree", None)
    monkeypatch.setattr(nearest, "CHUNK", 7)
    p = spark.createDataFrame([("a", i, float(i % 3), 0.0) for i in range(9)] + [("b", 1, 0.0, 0.0), (None, 2, 0.0, 0.0)], "k string, id int, x double, y double")
    got = nearest.k_nearest(p.filter("id < 3"), p, ["k"], 2)
    assert sorted((g.k, g.left_id, g.rank, g.right_id, g.d) for g in got.collect()) == [("a", 0, 1, 0, 0.0), ("a", 0, 2, 3, 0.0), ("a", 1, 1, 1, 0.0), ("a", 1, 2, 4, 0.0), ("a", 2, 1, 2, 0.0), ("a", 2, 2, 5, 0.0), ("b", 1, 1, 1, 0.0)]
