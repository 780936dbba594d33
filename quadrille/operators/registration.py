"""Rigid registration of 3-D points: nearest partners in tiles that are placed once, one aggregation, a 3 by 3 or 6 by 6 solve."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.normal import matrices, normal_sums
from quadrille.operators.steps import cut

XYZ = ("x", "y", "z")


def tukey(r: Column) -> Column:
    return F.when(r >= 1, 0.0).otherwise((1 - r * r) * (1 - r * r))


def uniform(r: Column) -> Column:
    return F.lit(1.0)


def nearest_3d(points: DataFrame, master: DataFrame, radius: float) -> DataFrame:
    """points with d and the columns, as m_..., of the nearest master point within radius; others are left out.

    Ties go to the lower coordinates. Cells are as wide as the radius; master points go to their 27 cells.
    """
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / radius)

    around = F.array(*[F.struct(*[(cell(c) + s).alias(f"__c{c}") for c, s in zip(XYZ, step, strict=True)]) for step in product((-1, 0, 1), repeat=3)])
    extra = [c for c in master.columns if c not in ("id", *XYZ)]
    right = master.select(F.struct(*XYZ, *extra).alias("__m"), F.inline(around))
    left = points.withColumns({f"__c{c}": cell(c) for c in XYZ} | {"__row": F.monotonically_increasing_id()})  # equal points stay apart
    square = sum((F.col(c) - F.col(f"__m.{c}")) * (F.col(c) - F.col(f"__m.{c}")) for c in XYZ)
    met = left.join(right, [f"__c{c}" for c in XYZ]).withColumn("d", F.sqrt(square)).filter(F.col("d") <= radius)
    best = met.groupBy("__row", *points.columns).agg(F.min(F.struct("d", "__m")).alias("b"))
    return best.select(*points.columns, F.col("b.d").alias("d"), *[F.col(f"b.__m.{c}").alias(f"m_{c}") for c in (*XYZ, *extra)])


def moved(points: DataFrame, t: np.ndarray) -> DataFrame:
    """points with x, y, z mapped by a 4 by 4 transform."""
    new = [sum((float(t[i, j]) * F.col(c) for j, c in enumerate(XYZ)), F.lit(float(t[i, 3]))) for i in range(3)]
    return points.withColumns(dict(zip(XYZ, new, strict=True)))


#: Points and master points that meet in one task at most, and pairs whose distances it holds at once.
POINTS, MASTER, PAIRS = 50_000, 400_000, 1_000_000
#: Parts of the radius: the width of a tile, and how far points may move before they are placed again.
WIDTH, SLACK = 2.0, 0.5
TILE = ("tx", "ty", "tz")
#: Steps of sparse ICP whose rows are worked out again rather than written.
STEPS = 4


def _finite(rows: DataFrame) -> DataFrame:
    return rows.filter(" and ".join(f"abs({c}) < double('infinity')" for c in XYZ))


def different(points: DataFrame) -> DataFrame:
    """x, y, z and times: equal points are one row; those with a null or no finite coordinate, which meet nothing, are left out."""
    return cut(_finite(points).groupBy(*XYZ).agg(F.count(F.lit(1)).cast("double").alias("times")))


def placed(points: DataFrame, master: DataFrame, radius: float, at: np.ndarray) -> DataFrame:
    """TILE, share, parts, points, master: what meets in a search, packed as float64 bytes and kept in the shared folder.

    A point (x, y, z, times) lies in the tile to which `at` moves it. A master point goes to all tiles within radius,
    and SLACK of it more. Of a tile beyond POINTS or MASTER each share of the points and each part of the master
    points make a row. Of master points at one place the one of the least other columns stays.
    """
    side, reach = WIDTH * radius, (1 + SLACK) * radius
    extra = [c for c in master.columns if c not in ("id", *XYZ)]
    near = _finite(master).groupBy(*XYZ).agg(F.min(F.struct(F.lit(0).alias("__none"), *extra)).alias("e")).select(*XYZ, *[F.col(f"e.{c}").alias(c) for c in extra])
    for c, t in zip(XYZ, TILE, strict=True):
        near = near.withColumn(t, F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))))
    to = moved(points.select("*", *[F.col(c).alias(f"__{c}") for c in XYZ]), at)
    here = to.select(*[F.floor(F.col(c) / side).alias(t) for c, t in zip(XYZ, TILE, strict=True)], *[F.col(f"__{c}").alias(c) for c in XYZ], "times")
    counts = [rows.groupBy(*TILE).agg(F.ceil(F.count(F.lit(1)) / most).alias(n)) for rows, most, n in ((here, POINTS, "shares"), (near, MASTER, "parts"))]
    sizes = cut(counts[0].join(counts[1], list(TILE)))
    dealt = F.pmod(F.xxhash64(*XYZ), F.col("n"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = here.join(sizes, list(TILE)).withColumn("n", F.col("shares")).withColumn("share", dealt).withColumn("part", every("parts"))
    right = near.join(sizes, list(TILE)).withColumn("n", F.col("parts")).withColumn("part", dealt).withColumn("share", every("shares"))
    keys = [*TILE, "share", "part"]

    def pack(p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if p.empty or m.empty:
            return pd.DataFrame([], columns=[*TILE, "share", "parts", "points", "master"])
        m = m.sort_values([*XYZ, *extra])  # so the first of the nearest is the one of the lower coordinates
        p = p.sort_values(list(XYZ))  # the same order in every part
        both = [t.to_numpy(np.float64).tobytes() for t in (p[[*XYZ, "times"]], m[[*XYZ, *extra]])]
        return pd.DataFrame([(*p[[*TILE, "share"]].iloc[0], p["parts"].iloc[0], *both)], columns=[*TILE, "share", "parts", "points", "master"])

    left, right = left.select(*keys, "parts", *XYZ, "times"), right.select(*keys, *XYZ, *extra)
    return cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pack, ", ".join([f"{c} long" for c in (*TILE, "share", "parts")] + ["points binary", "master binary"])))


def nearest_of(p: np.ndarray, m: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The place in m of each point's nearest, -1 for none within radius, and the distance; ties go to the first.

    Cells start as wide as hold a few of m. What is found in the 27 cells around a point no farther than a cell's
    width is the nearest; points without it look again in cells twice as wide, up to the radius.
    """
    best, dist = np.full(len(p), -1), np.full(len(p), np.inf)
    lo, hi = m.min(0), m.max(0)
    halvings = int(np.clip(np.ceil(np.log2(radius / max(float((hi - lo).max()), 1e-300) * len(m) ** (1 / 3))), 0, 10))
    left = np.arange(len(p))
    steps = np.array([(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for k in range(halvings, -1, -1):
        width = radius * (1 + 1e-9) / 2**k
        cells = np.floor((m - lo) / width).astype(np.int64)
        nx, ny, nz = cells.max(0) + 1
        key = (cells[:, 0] * ny + cells[:, 1]) * nz + cells[:, 2]
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.clip(np.floor((p[left] - lo) / width), -3, np.array([nx, ny, nz]) + 2).astype(np.int64)
        x, y = (at[:, None, i] + steps[None, :, i] for i in (0, 1))
        z0, z1 = np.maximum(at[:, 2] - 1, 0)[:, None], np.minimum(at[:, 2] + 1, nz - 1)[:, None]
        inside = (x >= 0) & (x < nx) & (y >= 0) & (y < ny) & (z0 <= z1)
        base = np.where(inside, (x * ny + y) * nz, 0)
        first = np.searchsorted(key, base + z0)
        count = np.where(inside, np.searchsorted(key, base + z1, "right") - first, 0)
        ends, start = count.sum(1).cumsum(), 0
        while start < len(left):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
            n, f, who = count[start:stop].ravel(), first[start:stop].ravel(), left[start:stop]
            total = count[start:stop].sum(1)
            runs = np.repeat(f - np.r_[0, n.cumsum()[:-1]], n) + np.arange(n.sum())
            found, row = order[runs], np.repeat(who, total)
            gap = p[row] - m[found]
            d = np.sqrt(gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2])
            some = total > 0
            if some.any():
                heads = np.r_[0, total[some].cumsum()[:-1]]
                least = np.minimum.reduceat(d, heads)
                dist[who[some]] = least
                best[who[some]] = np.minimum.reduceat(np.where(d == np.repeat(least, total[some]), found, len(m)), heads)
            start = stop
        if k:
            left = left[~(dist[left] < radius / 2**k)]
    far = ~(dist <= radius)
    best[far], dist[far] = -1, np.inf
    return best, dist


def partners(tiles: DataFrame, at: np.ndarray, radius: float, extra: list[str], split: bool) -> DataFrame:
    """x, y, z as `at` moves them, times, d and the columns, as m_..., of the nearest master point within radius.

    Nothing moves between tasks but what tiles of several parts (split: whether there are any) find in each.
    """
    ours, theirs = [*XYZ, "times", "d"], [f"m_{c}" for c in (*XYZ, *extra)]
    turn = at[:3, :3].T.tolist()

    def search(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                p, m = np.frombuffer(row.points).reshape(-1, 4), np.frombuffer(row.master).reshape(-1, 3 + len(extra))
                # summed in the order of the columns' sums, so that both ways give the same coordinates
                xyz = np.stack([0.0 + turn[0][i] * p[:, 0] + turn[1][i] * p[:, 1] + turn[2][i] * p[:, 2] + at[i, 3] for i in range(3)], 1)
                best, d = nearest_of(xyz, np.ascontiguousarray(m[:, :3]), radius)
                has = np.flatnonzero(best >= 0)
                out = pd.DataFrame(np.c_[xyz[has], p[has, 3], d[has], m[best[has]]], columns=[*ours, *theirs])
                for c in (*TILE, "share", "parts"):
                    out[c] = getattr(row, c)
                out["place"] = has
                yield out

    found = tiles.mapInPandas(search, ", ".join([f"{c} double" for c in (*ours, *theirs)] + [f"{c} long" for c in (*TILE, "share", "parts", "place")]))
    if not split:
        return found.select(*ours, *theirs)
    several = found.groupBy(*TILE, "share", "place", *XYZ, "times").agg(F.min(F.struct("d", *theirs)).alias("b"))
    return several.select(*XYZ, "times", "b.*")


class Search:
    """Partners of points that a motion moves: tiles are placed once, and again when a point may have left their reach."""

    def __init__(self, points: DataFrame, master: DataFrame, radius: float) -> None:
        self.points, self.master, self.radius, self.at = different(points), master, radius, None
        self.extra = [c for c in master.columns if c not in ("id", *XYZ)]

    def farthest(self, step: np.ndarray) -> float:
        """The longest way of a point between two motions of difference `step`."""
        size = sum((sum((float(step[i, j]) * F.col(c) for j, c in enumerate(XYZ)), F.lit(float(step[i, 3])))) ** 2 for i in range(3))
        return self.points.agg(F.max(F.sqrt(size))).first()[0] or 0.0

    def partners(self, at: np.ndarray) -> DataFrame:
        # a little less than the slack, for what sums are rounded by
        if self.at is None or self.farthest(at - self.at) > 0.999 * SLACK * self.radius:
            self.at, self.tiles = at, placed(self.points, self.master, self.radius, at)
            self.split = not self.tiles.filter("parts > 1").isEmpty()
        return partners(self.tiles, at, self.radius, self.extra, self.split)


def _to_points(pairs: DataFrame) -> np.ndarray | None:
    """The rigid motion that brings x, y, z onto m_x, m_y, m_z with weight w: weighted sums, then one SVD."""
    w = F.col("w")
    sums = [F.sum(w), *[F.sum(w * F.col(c)) for c in XYZ], *[F.sum(w * F.col(f"m_{c}")) for c in XYZ], *[F.sum(w * F.col(a) * F.col(f"m_{b}")) for a in XYZ for b in XYZ]]
    s = pairs.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums)]).first()
    if not s[0]:
        return None
    v = np.array(s, float)
    a, b = v[1:4] / v[0], v[4:7] / v[0]
    u, _, vt = np.linalg.svd(v[7:].reshape(3, 3) - v[0] * np.outer(a, b))
    flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    out = np.eye(4)
    out[:3, :3] = vt.T @ flip @ u.T
    out[:3, 3] = b - out[:3, :3] @ a
    return out


def _to_planes(pairs: DataFrame) -> np.ndarray | None:
    """As _to_points towards the planes of normal m_nx, m_ny, m_nz: six unknowns of a small turn and a shift."""
    n = [F.col(f"m_n{c}") for c in XYZ]
    x, y, z = (F.col(c) for c in XYZ)
    turn = [y * n[2] - z * n[1], z * n[0] - x * n[2], x * n[1] - y * n[0]]
    gap = sum((F.col(f"m_{c}") - F.col(c)) * n[i] for i, c in enumerate(XYZ))
    row = normal_sums(pairs, [], [([*turn, *n], gap)], F.col("w")).first()
    if not row["n"]:
        return None
    a, b = matrices(pd.DataFrame([row.asDict()]), 6)
    r = np.linalg.lstsq(a[0], b[0], rcond=1e-12)[0]
    out = np.eye(4)
    for axis, angle in zip(((1, 2), (2, 0), (0, 1)), r[:3], strict=True):
        m = np.eye(4)
        i, j = axis
        m[i, i] = m[j, j] = np.cos(angle)
        m[i, j], m[j, i] = -np.sin(angle), np.sin(angle)
        out = out @ m
    out[:3, 3] = r[3:]
    return out


def icp(points: DataFrame, master: DataFrame, radius: float, weight: Callable[[Column], Column] = tukey, planes: bool = False, rounds: int = 100, tolerance: float = 1e-5) -> np.ndarray:
    """The 4 by 4 transform that moves points (id, x, y, z) onto master (id, x, y, z; for planes nx, ny, nz too).

    Each round finds the nearest partners, weighs them by distance over radius, sums, and solves on the driver a
    3 by 3 or 6 by 6 system. It stops once no point moved more than `tolerance`, after `rounds`, or without any
    partner. Points and master points are packed by tiles once; then only sums move, unless points move by SLACK of the radius.
    """
    at = last = np.eye(4)
    search = Search(points, master, radius)
    for k in range(rounds):
        if k and search.farthest(at - last) < tolerance:
            break
        pairs = search.partners(at).withColumn("w", weight(F.col("d") / radius) * F.col("times"))
        motion = (_to_planes if planes else _to_points)(pairs)
        if motion is None:
            break
        last, at = at, motion @ at
    return at


def shrunk(n: Column, mu: float, p: float, steps: int = 3) -> Column:
    """The factor by which a residual of length n shrinks under the penalty |z|^p + mu / 2 |z - residual|^2.

    0 up to the threshold of the p-norm (1 / mu for p = 1), else `steps` fixed-point steps from the middle.
    """
    base = (2 / mu * (1 - p)) ** (1 / (2 - p))
    threshold = base + p / mu * base ** (p - 1)
    s = (base / n + 1) / 2
    for _ in range(steps):
        s = 1 - p / mu * F.pow(n, F.lit(p - 2)) * F.pow(s, F.lit(p - 1))
    return F.when(n > threshold, s).otherwise(0.0)


def icp_sparse(points: DataFrame, master: DataFrame, radius: float, p: float = 1.0, mu: float = 10.0, alpha: float = 1.2, most_mu: float = 1e5, rounds: int = 100, outer: int = 100, penalty: bool = False, tolerance: float = 1e-5, planes: bool = False) -> np.ndarray:
    """As icp, in the p-norm of the residuals (p <= 1), so that outliers hardly count.

    Residuals are the gaps to the partners; with planes, the gaps along their normals (nx, ny, nz of master), kept as
    the parts of a vector along the normal.

    After each search for partners, steps of the alternating direction method run: residuals shrink, one weighted
    sum gives the motion, and multipliers (cx, cy, cz, kept as columns of each point) take up the rest; penalty
    leaves them at 0. mu grows by alpha up to most_mu. One step in STEPS writes its rows to the shared folder; those
    between are worked out again from it.
    """
    at = np.eye(4)
    search = Search(points, master, radius)

    def norm(cols: list[Column]) -> Column:
        return F.sqrt(sum((c * c for c in cols[1:]), cols[0] * cols[0]))

    def apart(at: tuple[str, ...]) -> list[Column]:
        gaps = [F.col(c) - F.col(f"q{c}") for c in at]
        if not planes:
            return gaps
        along = sum((g * F.col(f"m_n{c}") for c, g in zip(at, gaps, strict=True)), F.lit(0.0))
        return [along * F.col(f"m_n{c}") for c in at]

    for _ in range(rounds):
        before, now = at, mu
        near = search.partners(at)
        normals = [f"m_n{c}" for c in XYZ] if planes else []
        state = cut(near.select(*XYZ, "times", *normals, *[F.col(f"m_{c}").alias(f"q{c}") for c in XYZ], *[F.lit(0.0).alias(f"c{c}") for c in XYZ]))
        for k in range(outer):
            gap = [g + F.col(f"c{c}") / now for c, g in zip(XYZ, apart(XYZ), strict=True)]
            pairs = state.withColumn("__s", shrunk(norm(gap), now, p)).withColumns({f"z{c}": F.coalesce("__s", F.lit(0.0)) * g for c, g in zip(XYZ, gap, strict=True)})
            pairs = pairs.withColumns({"w": F.col("times"), **{f"m_{c}": F.col(f"q{c}") + F.col(f"z{c}") - F.col(f"c{c}") / now for c in XYZ}})
            motion = (_to_planes if planes else _to_points)(pairs)
            if motion is None:
                return at
            old = pairs.select("*", *[F.col(c).alias(f"o{c}") for c in XYZ])
            left = moved(old, motion).withColumns({f"r{c}": g - F.col(f"z{c}") for c, g in zip(XYZ, apart(XYZ), strict=True)})
            primal, dual = norm([F.col(f"r{c}") for c in XYZ]), norm([F.col(c) - F.col(f"o{c}") for c in XYZ])
            kept = [F.col(f"c{c}") if penalty else (F.col(f"c{c}") + now * F.col(f"r{c}")).alias(f"c{c}") for c in XYZ]
            state = left.select(*XYZ, "times", *normals, *[f"q{c}" for c in XYZ], *kept, primal.alias("primal"), dual.alias("dual"))
            state = cut(state) if k % STEPS == STEPS - 1 else state
            at, now = motion @ at, now * alpha if now < most_mu else now
            off = state.agg(F.max("primal"), F.max("dual")).first()
            if max(off) < tolerance:
                break
        if np.abs(at - before).max() < tolerance:
            break
    return at
