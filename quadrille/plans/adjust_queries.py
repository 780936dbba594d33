"""Queries of registration and joint adjustment: planted motions and parameters are found again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrille.operators import adjustment, ephemeris, registration
from quadrille.plans.registry import query, table
from quadrille.plans.views import A0, A1, A2, A3, TIE_SQL, tie_points

CLOUD_SQL = "SELECT vec_id AS id, " + ", ".join(f"round(10 * CAST(embedding[{i + 1}] AS DOUBLE), 4) + 0.0 AS {c}" for i, c in enumerate("xyz")) + " FROM embeddings"


def _cloud(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *[(10.0 * F.col("embedding")[i].cast("double")).alias(c) for i, c in enumerate("xyz")])


def _turned(cloud):
    c, s = 0.99995000041666, 0.00999983333417
    return cloud.select("id", (c * F.col("x") - s * F.col("y") + 0.01).alias("x"), (s * F.col("x") + c * F.col("y") - 0.02).alias("y"), (F.col("z") + 0.01).alias("z"))


def _registered(spark, sf, planes):
    cloud = _cloud(spark, sf)
    master = cloud
    if planes:
        master = cloud.withColumns({"nx": F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.0), "ny": F.when(F.col("id") % 3 == 1, 1.0).otherwise(0.0), "nz": F.when(F.col("id") % 3 == 2, 1.0).otherwise(0.0)})
    points = _turned(cloud)
    motion = registration.icp(points, master, 0.5, planes=planes, rounds=60)
    return registration.moved(points, motion).select("id", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


@query("icp_point_to_point", CLOUD_SQL)
def icp_point_to_point(spark, sf):
    return _registered(spark, sf, False)


@query("icp_point_to_plane", CLOUD_SQL)
def icp_point_to_plane(spark, sf):
    return _registered(spark, sf, True)


@query("icp_sparse", CLOUD_SQL)
def icp_sparse(spark, sf):
    cloud = _cloud(spark, sf)
    points = _turned(cloud)
    motion = registration.icp_sparse(points, cloud, 0.5)
    return registration.moved(points, motion).select("id", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


def _affine(p):
    x, y = F.col("x"), F.col("y")
    bend = p["k"] * 1e-6 * (x * x + y * y) if "k" in p else F.lit(0.0)
    return p["m0"] + p["m1"] * x + p["m2"] * y + bend * x, p["m3"] + p["m4"] * x + p["m5"] * y + bend * y


START = {"m0": 0.0, "m1": 1.0, "m2": 0.0, "m3": 0.0, "m4": 0.0, "m5": 1.0}
PLANTED = ", ".join(f"{v} + 0.0::DOUBLE AS {m}" for m, v in zip(START, (A2, A0, A1, A3, -A1, A0), strict=True))


def _observed(spark, sf, bend):
    t = tie_points(spark, sf).filter(F.abs(F.col("x2") - A0 * F.col("x") - A1 * F.col("y") - A2) < 1)
    r = bend * 1e-6 * (F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return t.select(F.col("pair_id").alias("image_id"), "x", "y", (F.col("x2") + r * F.col("x")).alias("x2"), (F.col("y2") + r * F.col("y")).alias("y2"))


@query("block_adjust", f"WITH {TIE_SQL} SELECT DISTINCT pair_id AS image_id, {PLANTED} FROM tie")
def block_adjust(spark, sf):
    images, _, _, _ = adjustment.block_adjust(_observed(spark, sf, 0.0), adjustment.Sensor(START, {}, _affine))
    return images.select("image_id", *[(F.round(p, 4) + 0.0).alias(p) for p in START])


@query("self_calibrate", f"WITH {TIE_SQL} SELECT DISTINCT pair_id AS image_id, {PLANTED}, 3.0 + 0.0::DOUBLE AS k, 0.0::DOUBLE AS rmse FROM tie")
def self_calibrate(spark, sf):
    images, shared, _, after = adjustment.block_adjust(_observed(spark, sf, 3.0), adjustment.Sensor(START, {"k": 0.0}, _affine))
    return images.select("image_id", *[(F.round(p, 4) + 0.0).alias(p) for p in START], F.lit(round(shared["k"], 3)).alias("k"), F.lit(round(after, 4)).alias("rmse"))


@query("refine_gcps", f"WITH {TIE_SQL} SELECT pair_id, pt FROM tie WHERE abs(x2 - {A0}*x - {A1}*y - {A2}) < 1")
def refine_gcps(spark, sf):
    t = tie_points(spark, sf).select("pair_id", "pt", "x", "y", "x2", "y2")
    return adjustment.refine_gcps(t, ["pair_id"], 1.0, 10).select("pair_id", "pt")


#: Planted angles of an ephemeris row, in hundredths: (image * M + row * K) % 11 - 5.
ANGLES = {"roll": (7, 3), "pitch": (5, 4), "yaw": (3, 2)}
EVERY = 10.0


def _swath(p):
    x, y = F.col("x"), F.col("y")
    return x + 50 * p["roll"] + y * p["yaw"] + p["k"] * 1e-4 * x * y, y + 50 * p["pitch"] - x * p["yaw"] + p["k"] * 1e-4 * x * x


@query(
    "ephemeris_adjust",
    f"WITH r AS (SELECT DISTINCT l_suppkey AS image_id, CAST(floor(l_quantity / {EVERY}) AS BIGINT) AS e FROM lineitem), u AS (SELECT image_id, e AS row FROM r UNION SELECT image_id, e + 1 FROM r WHERE (image_id, e) IN (SELECT l_suppkey, CAST(floor(l_quantity / {EVERY}) AS BIGINT) FROM lineitem WHERE l_quantity % 10 <> 0)) SELECT image_id, row, "
    + ", ".join(f"round(((image_id * {m} + row * {k}) % 11 - 5) / 100.0::DOUBLE, 4) + 0.0 AS {a}" for a, (m, k) in ANGLES.items())
    + ", 2.0::DOUBLE AS k, 0.0::DOUBLE AS rmse FROM u",
)
def ephemeris_adjust(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").cast("double").alias("y"))
    row = F.floor(F.col("y") / EVERY)
    w = F.col("y") / EVERY - row
    angle = lambda m, k, at: ((F.col("image_id") * m + at * k) % 11 - 5) / 100.0
    seen = _swath({a: angle(m, k, row) * (1 - w) + angle(m, k, row + 1) * w for a, (m, k) in ANGLES.items()} | {"k": F.lit(2.0)})
    points = li.select("image_id", F.col("y").alias("t"), "x", "y", seen[0].alias("x2"), seen[1].alias("y2"))
    rows, shared, _, after = ephemeris.ephemeris_adjust(points, adjustment.Sensor(dict.fromkeys(ANGLES, 0.0), {"k": 0.0}, _swath), EVERY)
    # a last row on which no point has any weight keeps its start value
    hit = points.select("image_id", F.explode(F.array(F.floor(F.col("t") / EVERY), F.ceil(F.col("t") / EVERY))).alias("row")).distinct()
    return rows.join(hit, ["image_id", "row"]).select("image_id", "row", *[(F.round(a, 4) + 0.0).alias(a) for a in ANGLES], F.lit(round(shared["k"], 3)).alias("k"), F.lit(round(after, 4)).alias("rmse"))
