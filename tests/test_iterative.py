"""Iterative, tile and approximate operators against brute force and the known cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quadrille.operators import adjustment, fitting, flow, line_matching, lines, matching, registration, stats, tiles


def flows(spark, x2):
    rows = [(0, i, float(i + 1), 0.0, float(v), 0.0) for i, v in enumerate(x2)]
    got = flow.flow_groups(spark.createDataFrame(rows, "k int, id int, x double, y double, x2 double, y2 double"), ["k"], 10.0).orderBy("id").collect()
    return [(r.cx, r.cy, r.cu, r.cv) for r in got]


def test_flow_groups_known_cases(spark):
    assert set(flows(spark, range(2, 7))) == {(3, 0, -1, 0)}
    assert flows(spark, [*range(11, 16), *range(-4, 1)]) == [(3, 0, -10, 0)] * 5 + [(8, 0, 10, 0)] * 5
    assert flows(spark, [*range(2, 7), *range(106, 111)]) == [(3, 0, -1, 0)] * 5 + [(8, 0, -100, 0)] * 5


def test_flow_groups_tell_what_still_climbs(spark):
    table = spark.createDataFrame([(0, i, float(i), 0.0, float(i), 0.0) for i in range(40)], "k int, id int, x double, y double, x2 double, y2 double")
    assert not all(r.settled for r in flow.flow_groups(table, ["k"], 10.0, rounds=1).collect())
    assert all(r.settled for r in flow.flow_groups(table, ["k"], 10.0).collect())


def climbing(spark, n, width, length):
    """Points on a line that grow denser to one side."""
    x = (np.log(1 + np.linspace(0, 1, n) * (np.exp(0.05 * length) - 1)) / 0.05).round(6)
    return x, spark.createDataFrame([(0, i, float(v), 0.0, float(v), 0.0) for i, v in enumerate(x)], "k int, id int, x double, y double, x2 double, y2 double")


def test_flow_groups_climb_to_the_end(spark):
    """The first points climb 77 rounds. Each centre is the mean of what is near it."""
    x, table = climbing(spark, 250, 3.0, 16)
    got = flow.flow_groups(table, ["k"], 3.0).collect()
    assert len(got) == 250 and all(r.settled for r in got)
    assert max(abs(x[np.abs(x - r.cx) <= 3.0].mean() - r.cx) for r in got) < 1e-5


def test_flow_groups_by_rounds_keep_what_settled_apart(spark, monkeypatch):
    monkeypatch.setattr(flow, "APART", 2)
    _, table = climbing(spark, 40, 3.0, 6)
    one = sorted(map(tuple, flow.flow_groups(table, ["k"], 3.0).collect()))
    monkeypatch.setattr(flow, "GROUP", 0)
    other = sorted(map(tuple, flow.flow_groups(table, ["k"], 3.0).collect()))
    assert all(g[-1] for g in one) and [(g[:2], g[-1]) for g in one] == [(g[:2], g[-1]) for g in other]
    assert np.allclose([g[2:6] for g in one], [g[2:6] for g in other], atol=2e-6)


def test_flow_groups_query_settles_all(spark):
    from quadrille.plans import catalogue

    assert catalogue.QUERIES["flow_groups"](spark, "/root/testdata/sf0.001").filter("not settled").isEmpty()


@pytest.mark.parametrize("local", [50_000, 0])
def test_refine_gcps_equals_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(adjustment, "LOCAL", local)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(3):
        for i in range(25):
            x, y = rng.uniform(0, 50, 2).tolist()
            far = 40.0 if i < k else 0.0
            rows.append((k, i, x, y, x + 2 * y + far, y - x - far))

    def brute(k):
        left = {r[1]: r for r in rows if r[0] == k}
        while True:
            a = np.array([[1, r[2], r[3]] for r in left.values()])
            t = np.array([r[4:] for r in left.values()])
            e = np.linalg.norm(a @ np.linalg.lstsq(a, t, rcond=None)[0] - t, axis=1)
            if e.max() <= 0.5 or len(left) <= 10:
                return set(left)
            del left[list(left)[int(e.argmax())]]

    got = adjustment.refine_gcps(spark.createDataFrame(rows, "k int, pt int, x double, y double, x2 double, y2 double"), ["k"], 0.5, 10).collect()
    for k in range(3):
        assert {r.pt for r in got if r.k == k} == brute(k) == set(range(k, 25))


def test_block_adjust_of_nothing(spark):
    sensor = adjustment.Sensor({"b": 0.0}, {}, lambda p: (p["b"], p["b"]))
    images, shared, before, after = adjustment.block_adjust(spark.createDataFrame([], "image_id int, x double, y double, x2 double, y2 double"), sensor)
    assert images.count() == 0 and shared == {} and (before, after) == (0.0, 0.0)


def test_ncc_finds_the_planted_tile(spark):
    rng = np.random.default_rng(5)
    search = rng.normal(size=(20, 24))
    cells = [(1, r + 100, c + 7, float(search[r, c])) for r in range(20) for c in range(24)]
    part = [(1, r, c, float(3 * search[r + 6, c + 9] + 2)) for r in range(5) for c in range(6)]
    schema = "k int, row long, col long, value double"
    got = tiles.ncc_match(spark.createDataFrame(part, schema), spark.createDataFrame(cells, schema), "k").first()
    assert (got.row, got.col) == (106, 16) and abs(got.score - 1) < 1e-9
    assert (tiles.correlation(search[:4, :4], np.ones((9, 9))) == 0).all()


def test_blobs_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(6)
    y, x = np.mgrid[0:130, 0:150]
    a = sum(np.exp(-((y - r) ** 2 + (x - c) ** 2) / 18) for r, c in [(40, 60), (70, 100), (64, 64), (90, 40)]) + 0.001 * rng.normal(size=y.shape)
    whole = {(r, c) for r, c, *_ in tiles.blobs(a, 1e-3)}
    px = spark.createDataFrame([(1, 0, int(r), int(c), float(a[r, c])) for r in range(130) for c in range(150)], "image_id int, band int, row long, col long, value double")
    for size in (64, 512):
        got = tiles.hessian_blobs(px, 1e-3, size).collect()
        assert {(r.row, r.col) for r in got} == whole
    assert {(40, 60), (70, 100), (90, 40)} <= {(round(r.y), round(r.x)) for r in got}


def test_octaves_find_larger_blobs(spark):
    assert [tiles.filters(o) for o in (1, 2, 3)] == [(9, 15, 21, 27), (15, 27, 39, 51), (27, 51, 75, 99)]
    y, x = np.mgrid[0:220, 0:200]
    a = sum(np.exp(-((y - r) ** 2 + (x - c) ** 2) / (2 * w * w)) for r, c, w in [(50, 60, 2.5), (130, 110, 5.0)])
    px = spark.createDataFrame([(1, 0, int(r), int(c), float(a[r, c])) for r in range(220) for c in range(200)], "image_id int, band int, row long, col long, value double")
    one, two = ({(round(r.y), round(r.x)): r.scale for r in tiles.hessian_blobs(px, 1e-3, 96, octaves=o).collect()} for o in (1, 2))
    assert (130, 110) not in one and {(50, 60), (130, 110)} <= set(two) and two[130, 110] > 3.6
    assert {(r, c) for r, c, *_ in tiles.blobs(a, 1e-3, 2)} == {(r.row, r.col) for r in tiles.hessian_blobs(px, 1e-3, 96, octaves=2).collect()}


def test_covariance_of_few_and_far_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(50, 3)) + 1e6
    rows = spark.createDataFrame([(x.tolist(),) for x in v] + [(None,)], "v array<double>")
    want = np.cov(v.T)
    assert all(abs(r["cov"] - want[r.i, r.j]) < 1e-6 for r in stats.covariance(rows, "v").collect())
    assert stats.covariance(rows.filter("v is null"), "v").count() == 0
    assert [r["cov"] for r in stats.covariance(spark.createDataFrame([([1.0],)], "v array<double>"), "v").collect()] == [None]


def test_flow_groups_in_tasks_and_by_rounds(spark, monkeypatch):
    r = np.random.default_rng(8)
    rows = [(i % 2, i, *r.integers(0, 40, 2).tolist(), *r.integers(0, 40, 2).tolist()) for i in range(120)] + [(0, 900, 1, 2, None, 3), (None, 901, 1, 2, 3, 4)]
    table = spark.createDataFrame([(k, i, *(None if v is None else float(v) for v in p)) for k, i, *p in rows], "k int, id int, x double, y double, x2 double, y2 double")

    def found():
        return sorted(tuple(g) for g in flow.flow_groups(table, ["k"], 25.0, rounds=4, digits=4).collect())

    one = found()
    monkeypatch.setattr(flow, "GROUP", 0)
    other = found()
    assert len(one) == 120 and [(g[:2], g[-1]) for g in one] == [(g[:2], g[-1]) for g in other] and np.allclose([g[2:6] for g in one], [g[2:6] for g in other], atol=2e-4)
    monkeypatch.setattr(flow, "GROUP", 120)
    monkeypatch.setattr(flow, "_by_rounds", None)
    assert found() == one


def test_knn_approx_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    data = [(0, i, (centres[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(400)]
    left, right = (spark.createDataFrame([d for d in data if d[1] % 2 == s], "k int, kp_id int, descr array<double>") for s in (0, 1))
    got = {(r.kp_id, r.match_id) for r in matching.knn_approx(left, right, ["k"], 3, width=1.0).collect()}
    v = np.array([d[2] for d in data])
    want = {(i, int(j)) for i in range(0, 400, 2) for j in sorted(range(1, 400, 2), key=lambda j: np.linalg.norm(v[i] - v[j]))[:3]}
    assert len(got & want) >= 0.9 * len(want)


def test_bootstrap_checks_and_storage(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, (rng.normal(size=3) * [3, 2, 1]).tolist()) for i in range(300)], "id int, v array<double>")
    got = stats.pca_bootstrap(rows, "v", "id").collect()
    assert len(got) == 10 and all(abs(sum(r.ratios) - 1) < 1e-9 and 9 < r.energy < 20 for r in got)
    assert got == stats.pca_bootstrap(rows.repartition(5), "v", "id").collect()
    model = stats.pca_fit(rows, "v")
    checks = stats.pca_checks(rows, "v", model)
    assert abs(checks["determinant"] - 1) < 1e-9 and abs(checks["accuracy"] - 1) < 1e-9
    stats.pca_save(spark, model, str(tmp_path / "m"))
    again = stats.pca_load(spark, str(tmp_path / "m"))
    assert all(np.allclose(model[k], again[k]) for k in model)
    with pytest.raises(ValueError):
        stats.pca_bootstrap(rows, "v", "id", replicates=3)


SEGMENT = "k int, line_id long, ax double, ay double, bx double, by double"


def segments(rng, n):
    a = rng.uniform(0, 100, (n, 2))
    t = rng.uniform(-np.pi, np.pi, n)
    return np.c_[a, a + rng.uniform(10, 40, n)[:, None] * np.c_[np.cos(t), np.sin(t)]]


def test_candidates_equal_brute_force(spark):
    rng = np.random.default_rng(17)
    left, right = segments(rng, 60), segments(rng, 60)
    right[:30] = left[:30] + rng.normal(size=(30, 4))

    def square(p, q):
        theta = np.arctan2(q[3] - q[1], q[2] - q[0])
        rho = -q[0] * np.sin(theta) + q[1] * np.cos(theta)
        return sum((-x * np.sin(theta) + y * np.cos(theta) - rho) ** 2 for x, y in (p[:2], p[2:]))

    def centre(p):
        return (p[:2] + p[2:]) / 2

    want = {(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if square(p, q) + square(q, p) <= 10.35**2 and np.linalg.norm(centre(p) - centre(q)) <= 50}
    one, two = (spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(s)], SEGMENT) for s in (left, right))
    got = line_matching.candidates(one, two, ["k"]).collect()
    assert {(r.left_id, r.right_id) for r in got} == want and len(got) == len(want) >= 30
    assert sorted(r.node for r in got) == list(range(1, len(got) + 1))


@pytest.mark.parametrize("most", [4000, 0])
def test_spectral_match_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(line_matching, "NODES", most)
    rng = np.random.default_rng(11)
    left = segments(rng, 14)
    turn = np.array([[0.8, -0.6], [0.6, 0.8]])
    right = np.c_[left[:, :2] @ turn.T + 5, left[:, 2:] @ turn.T + 5] + 0.1 * rng.normal(size=left.shape)
    nodes = [(i, j) for i in range(14) for j in {i, int(rng.integers(14)), int(rng.integers(14))}]

    def form(s):
        theta = np.arctan2(s[3] - s[1], s[2] - s[0])
        return theta, -s[0] * np.sin(theta) + s[1] * np.cos(theta)

    def apart(a, b):
        out = 0.0
        for p, q in ((a, b), (b, a)):
            theta, rho = form(q)
            out += sum((-x * np.sin(theta) + y * np.cos(theta) - rho) ** 2 for x, y in (p[:2], p[2:]))
        return np.sqrt(out)

    m = np.zeros((len(nodes),) * 2)
    for u, (i, j) in enumerate(nodes):
        for v, (i2, j2) in enumerate(nodes):
            c = (left[i][:2] + left[i][2:] - left[i2][:2] - left[i2][2:]) / 2
            d = abs(apart(left[i], left[i2]) - apart(right[j], right[j2]))
            if i != i2 and j != j2 and c @ c <= 60**2 and d < 9:
                m[u, v] = 4.5 - d * d / 18
    values, vectors = np.linalg.eigh(m)
    score = np.abs(vectors[:, -1])
    used = [u for u in range(len(nodes)) if m[u].any()]
    want, seen = set(), (set(), set())
    for u in sorted(used, key=lambda u: -score[u]):
        i, j = nodes[u]
        if score[u] >= 0.1 * score[used].mean() and i not in seen[0] and j not in seen[1]:
            want.add((i, j))
            seen[0].add(i)
            seen[1].add(j)

    def side(s, name):
        t = lines.polar(spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(s)], SEGMENT))
        return t.select(F.col("line_id").alias(f"{name}_id"), F.struct("ax", "ay", "bx", "by", "theta", "rho").alias(name[0]))

    pairs = spark.createDataFrame([(0, u, i, j) for u, (i, j) in enumerate(nodes)], "k int, node long, left_id long, right_id long")
    table = pairs.join(side(left, "left"), "left_id").join(side(right, "right"), "right_id")
    got = line_matching.spectral_match(table, ["k"], reach=60.0, rounds=200).collect()
    assert {(r.left_id, r.right_id) for r in got} == want and {(i, i) for i in range(14)} <= want
    at = {(i, j): u for u, (i, j) in enumerate(nodes)}
    assert all(abs(r.score - score[at[r.left_id, r.right_id]]) < 1e-3 for r in got)
    assert line_matching.spectral_match(table.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_em_finds_the_planted_map(spark, monkeypatch, most):
    monkeypatch.setattr(line_matching, "PAIRS", most)
    rng = np.random.default_rng(12)
    left = segments(rng, 25)
    planted = np.array([3.0, 1.02, -0.05, -2.0, 0.04, 0.97])

    def moved(xy):
        return np.c_[planted[0] + xy @ planted[1:3], planted[3] + xy @ planted[4:6]]

    right = np.c_[moved(left[:, :2]), moved(left[:, 2:])]
    right[20:] = segments(rng, 5)  # no partners
    one, two = (spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(s)], SEGMENT) for s in (left, right))
    start = spark.createDataFrame([(0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 9.0)], "k int, p0 double, p1 double, p2 double, p3 double, p4 double, p5 double, delta2 double")
    model, found = line_matching.em_line_registration(one, two, start, ["k"], reach=200.0, rounds=40)
    got = model.first()
    assert np.allclose([got[f"p{i}"] for i in range(6)], planted, atol=[0.5, 0.02, 0.02] * 2)
    assert {(i, i) for i in range(20)} <= {(r.left_id, r.right_id) for r in found.collect()}


def test_sparse_icp_ignores_outliers(spark):
    rng = np.random.default_rng(13)
    cloud = rng.uniform(0, 10, (80, 3))
    c, s = np.cos(0.02), np.sin(0.02)
    turn, shift = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]), np.array([0.05, -0.04, 0.03])
    points = (cloud - shift) @ turn
    points[70:] += 0.4
    one, two = (spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "id int, x double, y double, z double") for p in (points, cloud))
    sparse = registration.icp_sparse(one, two, 1.5, rounds=4, outer=12)
    plain = registration.icp(one, two, 1.5, weight=registration.uniform, rounds=30)
    off = [np.abs(points[:70] @ t[:3, :3].T + t[:3, 3] - cloud[:70]).max() for t in (sparse, plain)]
    assert off[0] < 0.02 < off[1]


def test_sparse_icp_query_runs_all_rounds(spark, monkeypatch):
    """The query searches and steps until nothing moves, within the operator's own bounds of rounds."""
    import inspect

    from quadrille.plans import catalogue

    full, asked = inspect.signature(registration.icp_sparse), []
    monkeypatch.setattr(registration, "icp_sparse", lambda *a, **k: asked.append(full.bind(*a, **k)) or np.eye(4))
    catalogue.QUERIES["icp_sparse"](spark, "/root/testdata/sf0.001")
    asked[0].apply_defaults()
    assert all(asked[0].arguments[c] == full.parameters[c].default for c in ("rounds", "outer", "tolerance"))


def test_sparse_icp_to_planes(spark):
    rng = np.random.default_rng(15)
    cloud, normal = rng.uniform(0, 10, (90, 3)), np.eye(3)[np.arange(90) % 3]
    c, s = np.cos(0.02), np.sin(0.02)
    turn, shift = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]), np.array([0.05, -0.04, 0.03])
    points = (cloud - shift) @ turn
    points[80:] += 0.4
    one = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(points)], "id int, x double, y double, z double")
    two = spark.createDataFrame([(i, *map(float, r), *map(float, n)) for i, (r, n) in enumerate(zip(cloud, normal))], "id int, x double, y double, z double, nx double, ny double, nz double")
    sparse = registration.icp_sparse(one, two, 1.5, rounds=4, outer=12, planes=True)
    plain = registration.icp(one, two, 1.5, weight=registration.uniform, planes=True, rounds=20)
    off = [np.abs(points[:80] @ t[:3, :3].T + t[:3, 3] - cloud[:80]).max() for t in (sparse, plain)]
    assert off[0] < 0.02 < off[1]


def test_ransac_needs_its_minimal_sample(spark):
    few = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0)], "pair_id int, pt long, x double, y double, x2 double, y2 double")
    for find in (fitting.ransac_line, fitting.ransac_homography):
        assert find(few).count() == 0


def test_spectral_match_of_a_thousand_nodes_is_a_product():
    """2,560 nodes of 300 lines: every line meets itself, far from the origin too; sides are prepared once."""
    import pandas as pd

    r = np.random.default_rng(1)
    a, b = (r.uniform(0, 1, (300, 2)) * [100, 50] + 5000 for _ in "ab")
    theta = np.arctan2(b[:, 1] - a[:, 1], b[:, 0] - a[:, 0])
    rho = -a[:, 0] * np.sin(theta) + a[:, 1] * np.cos(theta)
    i, j = np.nonzero((r.uniform(size=(300, 300)) < 0.025) | np.eye(300, dtype=bool))
    nodes = {"k": 0, "node": np.arange(len(i)), "left_id": i, "right_id": j}
    for p, at in (("l", i), ("r", j)):
        nodes |= {f"{p}_{n}": v[at] for n, v in zip(("ax", "ay", "bx", "by", "theta", "rho"), (*a.T, *b.T, theta, rho), strict=True)}
    work, trig = line_matching._matched(["k"], 3.0, 50.0, 200, 1e-6, 0.1), []
    sin = np.sin
    try:
        np.sin = lambda x: trig.append(1) or sin(x)
        got = work(pd.DataFrame(nodes))
    finally:
        np.sin = sin
    assert (got.left_id == got.right_id).all() and len(got) == 300
    assert len(trig) == 2  # once a side, and not for each block of rows


def test_late_rounds_of_line_registration_weigh_few_pairs(monkeypatch):
    r = np.random.default_rng(5)
    n = 200
    ends = r.uniform(0, 100, (n, 4))
    moved = ends * 0.9 + np.tile([5.0, -3.0], 2) + r.uniform(-0.3, 0.3, (n, 4))
    one, two = (pd.DataFrame(e, columns=["ax", "ay", "bx", "by"]).assign(k=1, line_id=np.arange(n)) for e in (ends, moved))
    one = one.assign(p0=5.3, p1=0.9, p2=0.0, p3=-2.8, p4=0.0, p5=0.9, delta2=4.0)
    weighed, exp = [], np.exp
    monkeypatch.setattr(line_matching.np, "exp", lambda x, **out: weighed.append(x.size) or exp(x, **out))
    got = line_matching._registered(["k"], 100.0, 50, 1e-9)(one, two)
    assert min(weighed) < n * n / 5 and sum(weighed) < len(weighed) * n * n / 2
    assert len(got) > 0.8 * n and (got.left_id == got.right_id)[1:].mean() > 0.9
    assert np.allclose(got.iloc[0][line_matching.AFFINE6].astype(float), [5, 0.9, 0, -3, 0, 0.9], atol=0.1)


def test_rounds_of_block_adjust_leave_points_where_they_are(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, float(x), float(y), 2 + x + i * 0.1 * y + 1e-3 * x * y, y - i) for i in range(3) for x, y in r.uniform(0, 20, (30, 2)).tolist()]
    points = spark.createDataFrame(rows, "image_id int, x double, y double, x2 double, y2 double")
    plans, kept = [], adjustment.cut
    monkeypatch.setattr(adjustment, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))

    def predict(p):
        return p["a"] + F.col("x") + p["b"] * F.col("y") + p["k"] * F.col("x") * F.col("y"), F.col("y") + p["c"]

    images, shared, before, after = adjustment.block_adjust(points, adjustment.Sensor({"a": 0.0, "b": 0.0, "c": 0.0}, {"k": 0.0}, predict))
    got = {x.image_id: (x.a, x.b, x.c) for x in images.collect()}
    assert before > 1 and after < 1e-6 and abs(shared["k"] - 1e-3) < 1e-6
    assert all(np.allclose(got[i], (2, i * 0.1, -i), atol=1e-4) for i in range(3))
    # what shuffles are rows of images: each plan that reads the points has no exchange above their scan
    read = [p for p in plans if "Bucketed: true" in p]
    assert len(read) > 2 and all(p.count("Exchange") == 1 for p in read[1:])
