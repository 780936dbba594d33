"""Joint adjustment with parameters at ephemeris rows: each point touches two rows, the sparse system is solved in Spark.

Unknowns are the parameters of every ephemeris row of every image, which a point between two rows takes in proportion,
and the parameters that all share. Their normal equations are blocks keyed by row and neighbour row, packed into chunks
of rows. An image of one chunk is eliminated exactly; conjugate gradients solve the others, with the chunks' own
block-tridiagonal solutions as preconditioner. The driver
holds the shared parameters and a few sums only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.adjustment import Sensor
from quadrille.operators.normal import normal_sums
from quadrille.operators.steps import cut, dealt

#: Ephemeris rows of a chunk, which one task solves.
CHUNK = 512


def interpolated(name: str, weight: Column) -> Column:
    """A parameter between the rows before and behind a point."""
    return F.col(f"{name}_0") * (1 - weight) + F.col(f"{name}_1") * weight


def _equations(sensor: Sensor, step: float) -> list[tuple[list[Column | None], Column]]:
    w = F.col("w")
    at = {**{p: interpolated(p, w) for p in sensor.own}, **{p: F.col(p) for p in sensor.shared}}
    here = sensor.predict(at)
    slopes = []
    for p in at:
        plus, minus = sensor.predict({**at, p: at[p] + step}), sensor.predict({**at, p: at[p] - step})
        slopes.append([(a - b) * (0.5 / step) for a, b in zip(plus, minus, strict=True)])
    own = slopes[: len(sensor.own)]
    return [([s[k] * (1 - w) for s in own] + [s[k] * w for s in own] + [s[k] for s in slopes[len(own) :]], F.col(c) - here[k]) for k, c in enumerate(("x2", "y2"))]


def _normal(points: DataFrame, rows: DataFrame, sensor: Sensor, step: float) -> tuple[DataFrame, float, int, np.ndarray, np.ndarray]:
    """The interval sums (image_id, e, a_i_j, b_i), the squared error, the points, and the shared block and right side."""
    own, few = list(sensor.own), len(sensor.shared)
    before = rows.select("image_id", F.col("row").alias("e"), *sensor.shared, *[F.col(p).alias(f"{p}_0") for p in own])
    behind = rows.select("image_id", (F.col("row") - 1).alias("e"), *[F.col(p).alias(f"{p}_1") for p in own])
    met = points.join(before.join(behind, ["image_id", "e"]).hint("shuffle_hash"), ["image_id", "e"])
    equations = _equations(sensor, step)
    square = [(residual, residual) for _, residual in equations]
    # the residuals ride along as one more unknown, so that their square is summed in the same pass
    sums = cut(normal_sums(met, ["image_id", "e"], [([*c, r], r) for (c, _), (r, _) in zip(equations, square, strict=True)]))
    size, last = 2 * len(own), 2 * len(own) + few
    wanted = [F.sum(f"a_{last}_{last}"), F.sum("n")] + [F.sum(f"a_{i}_{j}") for i in range(size, last) for j in range(i, last)] + [F.sum(f"b_{i}") for i in range(size, last)]
    got = sums.agg(*wanted).first()
    block, right, at = np.zeros((few, few)), np.zeros(few), 2
    for i in range(few):
        for j in range(i, few):
            block[i, j] = block[j, i] = got[at] or 0.0
            at += 1
    right[:] = [got[at + i] or 0.0 for i in range(few)]
    return sums, got[0] or 0.0, got[1] or 0, block, right


def _blocks(sums: DataFrame, own: int, few: int) -> DataFrame:
    """image_id, chunk, m, rows, diagonal, upper, couple, right (float64 bytes): the equations of a chunk of rows.

    An interval adds to the diagonal blocks of its two rows and to the block between them; rows are keyed, so what
    two intervals add to one row is a grouped sum.
    """
    pick = lambda i, j: F.col(f"a_{min(i, j)}_{max(i, j)}")
    sides = []
    for side in (0, 1):
        lo = side * own
        d = [pick(lo + i, lo + j).alias(f"d_{i}_{j}") for i in range(own) for j in range(own)]
        u = [(pick(i, own + j) if side == 0 else F.lit(0.0)).alias(f"u_{i}_{j}") for i in range(own) for j in range(own)]
        c = [pick(lo + i, 2 * own + j).alias(f"c_{i}_{j}") for i in range(own) for j in range(few)]
        b = [F.col(f"b_{lo + i}").alias(f"r_{i}") for i in range(own)]
        sides.append(sums.select("image_id", (F.col("e") + side).alias("row"), *d, *u, *c, *b))
    names = [c for c in sides[0].columns if c not in ("image_id", "row")]
    rows = sides[0].union(sides[1]).groupBy("image_id", "row").agg(*[F.sum(c).alias(c) for c in names]).withColumn("chunk", F.floor(F.col("row") / CHUNK))
    groups = {"diagonal": "d_", "upper": "u_", "couple": "c_", "right": "r_"}

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        out = {"image_id": [pdf["image_id"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "m": [len(pdf)], "rows": [pdf["row"].to_numpy(np.int64).tobytes()]}
        return pd.DataFrame(out | {k: [pdf[[c for c in names if c.startswith(p)]].to_numpy(np.float64).tobytes()] for k, p in groups.items()})

    schema = T.StructType([sums.schema["image_id"], T.StructField("chunk", T.LongType()), T.StructField("m", T.LongType()), T.StructField("rows", T.BinaryType()), *[T.StructField(k, T.BinaryType()) for k in groups]])
    return cut(rows.groupBy("image_id", "chunk").applyInPandas(pack, schema))


class _Chunk:
    """A packed chunk as arrays: rows, diagonal and upper (m x own x own), couple (m x own x few), right (m x own).

    The diagonal carries the damping. linked: whether the next row is the next place in the chunk.
    """

    def __init__(self, row, own: int, few: int, damp: float) -> None:
        m = int(row.m)
        take = lambda name, *shape: np.frombuffer(getattr(row, name), np.float64).reshape(m, *shape)
        self.rows = np.frombuffer(row.rows, np.int64)
        self.d, self.u, self.c, self.b = take("diagonal", own, own).copy(), take("upper", own, own), take("couple", own, few), take("right", own)
        k = np.arange(own)
        scale = self.d[:, k, k]
        self.d[:, k, k] += damp * scale + np.where(scale > 0, 0, 1.0)
        self.linked = np.r_[self.rows[1:] == self.rows[:-1] + 1, False]

    def times(self, p: np.ndarray, before: np.ndarray | None, behind: np.ndarray | None, s: np.ndarray) -> np.ndarray:
        """The product with p; before, behind: what the neighbour chunks add at the ends."""
        q = np.einsum("mij,mj->mi", self.d, p) + self.c @ s
        up = np.where(self.linked[:, None, None], self.u, 0)[:-1]
        q[:-1] += np.einsum("mij,mj->mi", up, p[1:])
        q[1:] += np.einsum("mji,mj->mi", up, p[:-1])
        if behind is not None:
            q[-1] += self.u[-1] @ behind
        if before is not None:
            q[0] += before
        return q

    def solved(self, r: np.ndarray) -> np.ndarray:
        """Block elimination along the chunk's rows."""
        m = len(r)
        d, z = self.d.copy(), r.copy()
        for i in range(1, m):
            if self.linked[i - 1]:
                f = np.linalg.solve(d[i - 1], self.u[i - 1]).T
                d[i] -= f @ self.u[i - 1]
                z[i] -= f @ z[i - 1]
        for i in range(m - 1, -1, -1):
            z[i] = np.linalg.solve(d[i], z[i] - (self.u[i] @ z[i + 1] if self.linked[i] else 0))
        return z


def _eliminated(own: int, few: int, damp: float, s: np.ndarray | None) -> Callable:
    """Of chunks that hold a whole image each: without s what they take from the shared equations, with it their steps.

    Chunks of equally many rows that follow each other are stacked, so that block elimination runs over all at once.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for m, group in pdf.groupby("m", sort=False):
                take = lambda name, *shape: np.frombuffer(b"".join(group[name]), np.float64).reshape(len(group), m, *shape)  # noqa: B023, E731
                rows = np.frombuffer(b"".join(group["rows"]), np.int64).reshape(len(group), m)
                d, c, b = take("diagonal", own, own).copy(), take("couple", own, few), take("right", own)
                u = np.where((rows[:, 1:] == rows[:, :-1] + 1)[:, :, None, None], take("upper", own, own)[:, :-1], 0)
                k = np.arange(own)
                scale = d[:, :, k, k]
                d[:, :, k, k] += damp * scale + np.where(scale > 0, 0, 1.0)
                z = np.concatenate([c, b[..., None]], 3) if s is None else (b - c @ s)[..., None]
                z = z.copy()
                for i in range(1, m):
                    f = np.linalg.solve(d[:, i - 1], u[:, i - 1]).swapaxes(1, 2)
                    d[:, i] -= f @ u[:, i - 1]
                    z[:, i] -= f @ z[:, i - 1]
                for i in range(m - 1, -1, -1):
                    z[:, i] = np.linalg.solve(d[:, i], z[:, i] - (u[:, i] @ z[:, i + 1] if i < m - 1 else 0))
                if s is None:
                    out.append(np.einsum("gmif,gmiz->fz", c, z).ravel())
                    continue
                x = z[..., 0]
                gain = (x * (damp * scale * x + b)).sum((1, 2))
                yield pd.DataFrame({"image_id": group["image_id"].to_numpy(), "rows": group["rows"].to_numpy(), "x": [v.tobytes() for v in x], "gain": gain})
            if out:
                yield pd.DataFrame([sum(out)], columns=[f"s_{i}" for i in range(few * (few + 1))])

    return run


def solve(blocks: DataFrame, own: int, shared_block: np.ndarray, shared_right: np.ndarray, damp: float, tolerance: float = 1e-12, most: int = 100) -> tuple[DataFrame, np.ndarray, float]:
    """(image_id, rows, x), the shared part, and the gain x (damp diag x + right) of the damped equations.

    Images that stand in one chunk touch others only through the shared part, so they are eliminated exactly in their
    tasks, and the driver adds up what they take from it. Conjugate gradients solve for the others.
    """
    few = len(shared_right)
    chunks = blocks.groupBy("image_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("image_id")
    chunks = cut(chunks)
    long = not chunks.isEmpty()
    whole = blocks.join(chunks, "image_id", "left_anti") if long else blocks
    corner = shared_block + damp * np.diag(np.diag(shared_block)) + np.diag((np.diag(shared_block) <= 0).astype(float))
    right = shared_right.astype(float)
    if few:
        names = [f"s_{i}" for i in range(few * (few + 1))]
        taken = whole.mapInPandas(_eliminated(own, few, damp, None), ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c) for c in names]).first()
        taken = np.array([v or 0.0 for v in taken]).reshape(few, few + 1)
        corner, right = corner - taken[:, :few], right - taken[:, few]
    kind = T.StructType([blocks.schema["image_id"], T.StructField("rows", T.BinaryType()), T.StructField("x", T.BinaryType()), T.StructField("gain", T.DoubleType())])
    if long:
        done, s = _by_gradients(blocks.join(chunks, "image_id", "left_semi"), own, corner, right, damp, kind, tolerance, most)
    else:
        done, s = None, np.linalg.solve(corner, right) if few else right
    steps = whole.mapInPandas(_eliminated(own, few, damp, s), kind)
    steps = cut(steps if done is None else steps.unionByName(done))
    total = (steps.agg(F.sum("gain")).first()[0] or 0.0) + float(s @ (damp * np.diag(shared_block) * s + shared_right))
    return steps, s, total


def _by_gradients(blocks: DataFrame, own: int, corner: np.ndarray, right: np.ndarray, damp: float, kind: T.StructType, tolerance: float, most: int) -> tuple[DataFrame, np.ndarray]:
    """Conjugate gradients: (image_id, rows, x, gain) and the shared part; corner, right: the shared equations, damped.

    A round is one pass over the chunks for the product, in which neighbour chunks meet by the rows at their ends,
    and one for the step and the preconditioner; besides the shared part the driver adds up two sums. tolerance: of the squared residual.
    """
    few = len(right)
    fields = T.StructType([blocks.schema["image_id"], blocks.schema["chunk"], *[T.StructField(c, T.BinaryType()) for c in ("x", "r", "z", "p", "first", "last")], T.StructField("rz", T.DoubleType()), T.StructField("rr", T.DoubleType()), T.StructField("t", T.ArrayType(T.DoubleType()))])

    def per_chunk(work: Callable) -> Callable:
        def run(batches):
            for pdf in batches:
                out = [work(row, _Chunk(row, own, few, damp)) for row in pdf.itertuples(index=False)]
                yield pd.DataFrame(out, columns=fields.names)

        return run

    read = lambda b: np.frombuffer(b, np.float64).reshape(-1, own)

    def row_of(row, c, x, r, z, p):
        """A chunk's state: of z and p also what the neighbour chunks and the shared part need of them."""
        first, last = np.stack([z[0], p[0]]), np.stack([c.u[-1].T @ z[-1], c.u[-1].T @ p[-1]])
        t = [float(v) for y in (z, p) for v in np.einsum("mif,mi->f", c.c, y)]
        return (row.image_id, row.chunk, *[y.tobytes() for y in (x, r, z, p, first, last)], float((r * z).sum()), float((r * r).sum()), t)

    def begin(row, c):
        return row_of(row, c, np.zeros_like(c.b), c.b, c.solved(c.b), np.zeros_like(c.b))

    def totals(df):
        got = df.agg(F.sum("rz"), F.sum("rr"), *[F.sum(F.col("t")[k]) for k in range(2 * few)]).first()
        return got[0] or 0.0, got[1] or 0.0, np.array([v or 0.0 for v in got[2:]]).reshape(2, few)

    state = cut(blocks.mapInPandas(per_chunk(begin), fields))
    xs, rs, ps, beta = np.zeros(few), right.astype(float), np.zeros(few), 0.0
    zs = np.linalg.solve(corner, rs) if few else rs
    rz, rr, couple = totals(state)
    rz, first = rz + float(rs @ zs), rr + float(rs @ rs)
    rr = first
    for _ in range(most):
        if rr <= tolerance * first or rz <= 0:
            break
        by = Window.partitionBy("image_id").orderBy("chunk")  # one row for CHUNK ephemeris rows
        near = state.withColumns({"pc": F.lag("chunk").over(by), "nc": F.lead("chunk").over(by), "pl": F.lag("last").over(by), "nf": F.lead("first").over(by)})
        near = near.withColumns({"before": F.when(F.col("pc") == F.col("chunk") - 1, F.col("pl")), "behind": F.when(F.col("nc") == F.col("chunk") + 1, F.col("nf"))}).drop("pc", "nc", "pl", "nf")
        ps = zs + beta * ps

        def product(row, c, s=ps, beta=beta):
            p = read(row.z) + beta * read(row.p)
            ends = [None if x is None else np.array([1.0, beta]) @ np.frombuffer(x, np.float64).reshape(2, own) for x in (row.before, row.behind)]
            q = c.times(p, ends[0] if c.rows[0] % CHUNK == 0 else None, ends[1] if c.rows[-1] % CHUNK == CHUNK - 1 else None, s)
            # q travels in place of z, p q in place of r z
            return (row.image_id, row.chunk, row.x, row.r, q.tobytes(), p.tobytes(), row.first, row.last, float((p * q).sum()), 0.0, list(row.t))

        applied = cut(near.join(blocks, ["image_id", "chunk"]).mapInPandas(per_chunk(product), fields))
        qs = corner @ ps + couple[0] + beta * couple[1]
        alpha = rz / (totals(applied)[0] + float(ps @ qs))
        xs, rs = xs + alpha * ps, rs - alpha * qs
        zs = np.linalg.solve(corner, rs) if few else rs

        def step(row, c, alpha=alpha):
            x, r = read(row.x) + alpha * read(row.p), read(row.r) - alpha * read(row.z)
            return row_of(row, c, x, r, c.solved(r), read(row.p))

        state = cut(applied.join(blocks, ["image_id", "chunk"]).mapInPandas(per_chunk(step), fields))
        new, rr, couple = totals(state)
        new, rr = new + float(rs @ zs), rr + float(rs @ rs)
        beta, rz = new / rz, new

    def gain(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                c, x = _Chunk(row, own, few, 0.0), read(row.x)
                k = np.arange(own)
                out.append((row.image_id, row.rows, row.x, float((x * (damp * c.d[:, k, k] * x + c.b)).sum())))
            yield pd.DataFrame(out, columns=["image_id", "rows", "x", "gain"])

    return state.join(blocks, ["image_id", "chunk"]).mapInPandas(gain, kind), xs


def _moved(rows: DataFrame, steps: DataFrame, own: list[str], shared: dict[str, float]) -> DataFrame:
    """The rows' parameters plus their steps; rows that no point touches stay. Shared ones are written beside them, so that
    they are no part of the plan, whose code stays the same in all rounds."""

    def unpack(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                at, x = np.frombuffer(row.rows, np.int64), np.frombuffer(row.x, np.float64).reshape(-1, len(own))
                yield pd.DataFrame({"image_id": [row.image_id] * len(at), "row": at} | {f"d_{p}": x[:, i] for i, p in enumerate(own)})

    each = steps.mapInPandas(unpack, T.StructType([steps.schema["image_id"], T.StructField("row", T.LongType()), *[T.StructField(f"d_{p}", T.DoubleType()) for p in own]]))
    return cut(rows.join(each, ["image_id", "row"], "left").select("image_id", "row", *[(F.col(p) + F.coalesce(F.col(f"d_{p}"), F.lit(0.0))).alias(p) for p in own], *[F.lit(v).alias(p) for p, v in shared.items()]))


def ephemeris_adjust(points: DataFrame, sensor: Sensor, every: float, rounds: int = 200, tolerance: float = 1e-10, step: float = 1e-3) -> tuple[DataFrame, dict[str, float], float, float]:
    """Ephemeris rows (image_id, row, own parameters), the shared parameters, and the RMSE before and after.

    points: image_id, t, x, y, x2, y2; ephemeris row k stands at t = k every. Levenberg-Marquardt: damping is a
    share of each diagonal entry, from 1e-3; it shrinks by max(1/3, 1 - (2 rho - 1)^3) on a gain and grows 2, 4, 8
    times on a loss. A parameter that no point moves keeps its start value. No points: no rows, 0.
    """
    own, shared = list(sensor.own), dict(sensor.shared)
    place = F.col("t") / every
    points = dealt(points.withColumn("e", F.floor(place)).withColumn("w", place - F.floor(place)), ["image_id", "e"])  # so that rounds move sums only
    touched = points.select("image_id", "e").distinct()
    rows = cut(touched.select("image_id", F.explode(F.array("e", F.col("e") + 1)).alias("row")).distinct().select("image_id", "row", *[F.lit(float(v)).alias(p) for p, v in (sensor.own | sensor.shared).items()]))
    sums, cost, n, corner, right = _normal(points, rows, sensor, step)
    start, damp, grow = cost, 1e-3, 2.0
    for _ in range(rounds if n else 0):
        steps, delta, gain = solve(_blocks(sums, len(own), len(shared)), len(own), corner, right, damp)
        named = dict(zip(shared, (float(v + d) for v, d in zip(shared.values(), delta, strict=True)), strict=True))
        tried = _moved(rows, steps, own, named)
        now = _normal(points, tried, sensor, step)
        rho = (cost - now[1]) / gain if gain > 0 else 0.0
        if rho > 0:
            small = cost - now[1] <= tolerance * max(start, tolerance)
            rows, shared, (sums, cost, n, corner, right) = tried, named, now
            damp, grow = damp * max(1 / 3, 1 - (2 * rho - 1) ** 3), 2.0
            if small:
                break
        else:
            damp, grow = damp * grow, grow * 2
            if gain <= tolerance * max(start, tolerance) or grow > 1e12:
                break
    return rows.select("image_id", "row", *own), shared, (start / n) ** 0.5 if n else 0.0, (cost / n) ** 0.5 if n else 0.0
