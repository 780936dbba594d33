"""Map projections as column expressions: geographic, transverse Mercator and Lambert conformal conic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a projection table beside its key; angles in degrees. kind: ll, tm or lcc; any other counts as ll.
PARAMETERS = ("kind", "lon0", "lat0", "lat1", "lat2", "k0", "fe", "fn")
#: WGS 84.
A, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)


def _series(angle: Column, *weights: float) -> Column:
    """Sum of weights times sin 2 angle, sin 4 angle and so on."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + w * F.sin(2 * (i + 1) * angle)
    return total


#: Mean factor of the meridian arc, and the amplitudes of its sines.
ARC = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
ARC_SINES = (-(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024), 15 * E2**2 / 256 + 45 * E2**3 / 1024, -35 * E2**3 / 3072)
_E1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
FOOT_SINES = (3 * _E1 / 2 - 27 * _E1**3 / 32, 21 * _E1**2 / 16 - 55 * _E1**4 / 32, 151 * _E1**3 / 96, 1097 * _E1**4 / 512)
#: From conformal to geodetic latitude.
CONFORMAL_SINES = (E2 / 2 + 5 * E2**2 / 24 + E2**3 / 12 + 13 * E2**4 / 360, 7 * E2**2 / 48 + 29 * E2**3 / 240 + 811 * E2**4 / 11520, 7 * E2**3 / 120 + 81 * E2**4 / 1120, 4279 * E2**4 / 161280)


def _arc(lat: Column) -> Column:
    return A * (ARC * lat + _series(lat, *ARC_SINES))


def _tm(lon: Column, lat: Column, p: dict[str, Column]) -> tuple[Column, Column]:
    n = A / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    t, c = F.tan(lat) * F.tan(lat), EP2 * F.cos(lat) * F.cos(lat)
    a = (lon - p["lon0"]) * F.cos(lat)
    x = p["k0"] * n * a * (1 + a * a / 6 * ((1 - t + c) + a * a / 20 * (5 - 18 * t + t * t + 72 * c - 58 * EP2)))
    rise = a * a / 2 * (1 + a * a / 12 * ((5 - t + 9 * c + 4 * c * c) + a * a / 30 * (61 - 58 * t + t * t + 600 * c - 330 * EP2)))
    return x + p["fe"], p["k0"] * (_arc(lat) - _arc(p["lat0"]) + n * F.tan(lat) * rise) + p["fn"]


def _tm_back(x: Column, y: Column, p: dict[str, Column]) -> tuple[Column, Column]:
    mu = (_arc(p["lat0"]) + (y - p["fn"]) / p["k0"]) / (A * ARC)
    foot = mu + _series(mu, *FOOT_SINES)
    w = 1 - E2 * F.sin(foot) * F.sin(foot)
    n, r = A / F.sqrt(w), A * (1 - E2) / (w * F.sqrt(w))
    t, c = F.tan(foot) * F.tan(foot), EP2 * F.cos(foot) * F.cos(foot)
    d = (x - p["fe"]) / (n * p["k0"])
    fall = d * d / 2 * (1 - d * d / 12 * ((5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) - d * d / 30 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c)))
    turn = d * (1 - d * d / 6 * ((1 + 2 * t + c) - d * d / 20 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t)))
    return p["lon0"] + turn / F.cos(foot), foot - n * F.tan(foot) / r * fall


def _cone(p: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Cone constant, scale of the radius, and the radius of the origin."""
    m1, m2 = (F.cos(p[k]) / F.sqrt(1 - E2 * F.sin(p[k]) * F.sin(p[k])) for k in ("lat1", "lat2"))
    t1, t2 = _conformal(p["lat1"]), _conformal(p["lat2"])
    n = F.when(F.abs(p["lat1"] - p["lat2"]) < 1e-10, F.sin(p["lat1"])).otherwise((F.log(m1) - F.log(m2)) / (F.log(t1) - F.log(t2)))
    scale = A * p["k0"] * m1 / (n * F.pow(t1, n))
    return n, scale, scale * F.pow(_conformal(p["lat0"]), n)


def _conformal(lat: Column) -> Column:
    s = E2**0.5 * F.sin(lat)
    return F.tan(F.lit(0.7853981633974483) - lat / 2) / F.pow((1 - s) / (1 + s), F.lit(E2**0.5 / 2))


def _lcc(lon: Column, lat: Column, p: dict[str, Column]) -> tuple[Column, Column]:
    n, scale, origin = _cone(p)
    r, turn = scale * F.pow(_conformal(lat), n), n * (lon - p["lon0"])
    return p["fe"] + r * F.sin(turn), p["fn"] + origin - r * F.cos(turn)


def _lcc_back(x: Column, y: Column, p: dict[str, Column]) -> tuple[Column, Column]:
    n, scale, origin = _cone(p)
    e, s = (x - p["fe"]) * F.signum(n), (origin - (y - p["fn"])) * F.signum(n)
    t = F.pow(F.sqrt(e * e + s * s) / F.abs(scale), 1 / n)
    chi = F.lit(1.5707963267948966) - 2 * F.atan(t)
    return p["lon0"] + F.atan2(e, s) / n, chi + _series(chi, *CONFORMAL_SINES)


def _joined(points: DataFrame, projections: DataFrame, key: str) -> tuple[DataFrame, dict[str, Column]]:
    renamed = projections.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in PARAMETERS])
    at = points.join(renamed, points[key] == F.col("__k"), "left")
    p = {c: F.radians(f"__{c}") if c.startswith("l") else F.col(f"__{c}") for c in PARAMETERS}
    return at, p


def project(points: DataFrame, projections: DataFrame, key: str) -> DataFrame:
    """Points with lon, lat (degrees) as x, y of the projection of their key; none, or an unknown kind: degrees."""
    at, p = _joined(points, projections, key)
    tm, lcc = (f(F.radians("lon"), F.radians("lat"), p) for f in (_tm, _lcc))
    x, y = (F.when(p["kind"] == "tm", tm[i]).when(p["kind"] == "lcc", lcc[i]).otherwise(F.col(c)) for i, c in enumerate(("lon", "lat")))
    return at.select(*[c for c in points.columns if c not in ("lon", "lat", "x", "y")], x.alias("x"), y.alias("y"))


def unproject(points: DataFrame, projections: DataFrame, key: str) -> DataFrame:
    """The way back: points with x, y as lon, lat in degrees."""
    at, p = _joined(points, projections, key)
    tm, lcc = (f(F.col("x"), F.col("y"), p) for f in (_tm_back, _lcc_back))
    lon, lat = (F.when(p["kind"] == "tm", F.degrees(tm[i])).when(p["kind"] == "lcc", F.degrees(lcc[i])).otherwise(F.col(c)) for i, c in enumerate("xy"))
    return at.select(*[c for c in points.columns if c not in ("lon", "lat", "x", "y")], lon.alias("lon"), lat.alias("lat"))


def reproject(points: DataFrame, source: DataFrame, target: DataFrame | None, key: str) -> DataFrame:
    """Points x, y from the projection of their key to that in target; without a target, lon and lat as x and y."""
    geographic = unproject(points, source, key)
    return geographic.withColumnsRenamed({"lon": "x", "lat": "y"}) if target is None else project(geographic, target, key)
