"""Every query against its SQL, and operators against known values."""

import math
import os

import duckdb
import numpy as np
import pytest

from quadrille.operators import fitting, raster, spatial, stats
from quadrille.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split()


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = normal(catalogue.QUERIES[name](spark, SF).toPandas()), normal(con.execute(catalogue.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, rtol=1e-9, atol=1e-9), c
        else:
            assert (got[c].astype(str) == want[c].astype(str)).all(), c


def test_pca_golden(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.5, 42.0, 7.0]), (2, [3.0, 4.2, 90.0, 7.0]), (3, [456.0, 444.0, 0.0, 7.0])], "rec int, v array<double>")
    m = stats.pca_fit(rows, "v")
    assert abs(m["energy"] - 135459.19666667) < 1e-6
    assert np.allclose(m["values"][:2], [0.995745538, 0.00425446249])
    assert np.allclose(m["vectors"][0], [0.7136892, 0.69270403, -0.10396568, 0], atol=1e-6)
    got = [r.principals for r in stats.pca_transform(rows, "v", m, 2).orderBy("rec").collect()]
    assert np.allclose(np.array(got).T, [[-210.846198, -213.231575, 424.077773], [-24.0512596, 23.9612385, 0.0900211615]], atol=1e-5)
    with pytest.raises(ValueError):
        stats.pca_fit(rows.limit(1), "v")


def test_ransac_finds_the_planted_transform(spark):
    pts = [(1, i, float(i % 17), float(i % 23)) for i in range(200)]
    rows = [(p, i, x, y, 0.9 * x + 0.2 * y + 5 + 100 * (i % 4 == 0), -0.2 * x + 0.9 * y - 3) for p, i, x, y in pts]
    r = fitting.ransac_similarity(spark.createDataFrame(rows, "pair_id int, pt long, x double, y double, x2 double, y2 double")).first()
    assert (r.inliers, round(r.a0, 6), round(r.a1, 6), round(r.a2, 6), round(r.a3, 6)) == (150, 0.9, 0.2, 5.0, -3.0)


def test_line_through_two_points(spark):
    r = fitting.fit_line_tls(spark.createDataFrame([("a", 7.0, 7.0), ("a", -1.0, -1.0), ("v", 2.0, 1.0), ("v", 2.0, 5.0)], "k string, x double, y double"), ["k"]).orderBy("k").collect()
    assert abs(abs(r[0].nx) - math.sqrt(0.5)) < 1e-9 and abs(r[0].nx + r[0].ny) < 1e-9 and (r[0].ax, r[0].ay) == (3, 3)
    assert (r[1].nx, r[1].ny) == (1, 0)


def test_peak_plateau_null(spark):
    grid = [[1, 1, 1, 1, 1], [1, 5, 1, 3, 1], [1, 1, 1, 1, 1], [1, 4, 4, 1, None], [1, 1, 1, 1, 1]]
    px = spark.createDataFrame([(0, 0, r, c, None if v is None else float(v)) for r, row in enumerate(grid) for c, v in enumerate(row)], "image_id int, band int, row long, col long, value double")
    peaks = {(r.row, r.col) for r in raster.local_maxima(px).filter("value is not null").collect()}
    assert peaks == {(1, 1), (1, 3)}
    loose = {(r.row, r.col) for r in raster.local_maxima(px, strict=False).filter("value is not null").collect()}
    assert {(3, 1), (3, 2)} <= loose
    smooth = {(r.row, r.col) for r in raster.convolve_1d(px, [0.25, 0.5, 0.25], "col", strict=True).filter("value is not null").collect()}
    assert (3, 3) not in smooth and (0, 0) not in smooth and (0, 1) in smooth


def test_datum_shift_returns(spark):
    p = spark.createDataFrame([(10.0, 50.0, 300.0), (-120.0, -33.0, 0.0)], "lon double, lat double, hgt double")
    back = spatial.datum_shift(spatial.datum_shift(p, 84.0, -97.0, 117.0), -84.0, 97.0, -117.0).orderBy("lon").collect()
    assert np.allclose([[r.lon, r.lat] for r in back], [[-120, -33], [10, 50]], atol=1e-9) and np.allclose([r.hgt for r in back], [0, 300], atol=1e-4)


def test_boxes_on_one_spot_are_dealt_to_many_partitions(spark, monkeypatch):
    """All pairs of a full cell were one task's, or those of the one file that holds the larger side."""
    from quadrille.operators import spatial

    monkeypatch.setattr(spatial, "SHARE", 20)
    monkeypatch.setattr(spatial, "PAIRS", 500)
    one = spark.range(100).selectExpr("id", "id % 7 xmin", "id % 5 ymin", "id % 7 + 3 xmax", "id % 5 + id % 4 ymax").coalesce(1)
    two = spark.range(60).selectExpr("id", "id % 3 xmin", "id % 4 ymin", "id % 3 + id % 40 xmax", "id % 4 + 2 ymax").coalesce(1)
    got = spatial.footprint_join(one, two, 32)
    a, b = ([tuple(r) for r in t.collect()] for t in (one, two))
    want = sorted((i, j) for i, x0, y0, x1, y1 in a for j, u0, v0, u1, v1 in b if max(x0, u0) <= min(x1, u1) and max(y0, v0) <= min(y1, v1))
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == want
    sizes = [n for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 6 and max(sizes) < len(want) / 3
