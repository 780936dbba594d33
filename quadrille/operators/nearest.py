"""The k nearest points without a radius: matrices of small groups; of large ones all queries descend a quadtree together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.steps import cut

#: Cells with more points than CAPACITY are split, DEPTH times at most; tables of cells are broadcast up to SMALL rows.
CAPACITY, DEPTH, SMALL = 32, 16, 100_000
#: Points of both sides that share their keys and may meet in one task, and distances that it computes at once.
GROUP, CHUNK = 8192, 1_000_000


def _box(points: DataFrame) -> tuple[float, float, float]:
    """The least corner of a square around all points, and its side."""
    r = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if r[0] is None:
        return 0.0, 0.0, 1.0
    side = max(r[2] - r[0], r[3] - r[1])
    return float(r[0]), float(r[1]), float(side) * (1 + 1e-9) or 1.0


def quadtree(points: DataFrame, keys: list[str], corner: tuple[float, float], side: float) -> tuple[DataFrame, DataFrame]:
    """(keys, level, cx, cy, n, leaf) of the cells that hold points, and the points (keys, id, x, y) with their leaf's level, cx, cy.

    Level l has 2^l cells a side. A cell is a leaf if it holds CAPACITY points or fewer, or at DEPTH. Counts are summed
    in each task before they move, so a dense cell is one more row.
    """
    at = [F.least(F.floor((F.col(c) - lo) / side * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)) for c, lo in zip("xy", corner, strict=True)]
    placed = points.select(*keys, "id", "x", "y", at[0].alias("px"), at[1].alias("py"), F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level"))
    shift = F.pow(F.lit(2.0), DEPTH - F.col("level"))
    placed = placed.withColumns({"cx": F.floor(F.col("px") / shift), "cy": F.floor(F.col("py") / shift)}).drop("px", "py")
    spot = [*keys, "level", "cx", "cy"]
    counts = cut(placed.groupBy(*spot).agg(F.count(F.lit(1)).alias("n")))
    above = counts.filter(F.col("n") > CAPACITY).select(*keys, (F.col("level") + 1).alias("level"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    inner = counts.withColumns({"ax": F.floor(F.col("cx") / 2), "ay": F.floor(F.col("cy") / 2)}).join(above, [*keys, "level", "ax", "ay"], "left_semi")
    leaf = (F.col("n") <= CAPACITY) | (F.col("level") == DEPTH)
    cells = cut(counts.filter("level = 0").select(*spot, "n").unionByName(inner.select(*spot, "n")).withColumn("leaf", leaf))
    return cells, placed.join(cells.filter("leaf").select(*spot), spot)


def _between(norm: int, dx: Column, dy: Column) -> Column:
    return dx + dy if norm == 1 else F.sqrt(dx * dx + dy * dy)


def _in_groups(left: DataFrame, right: DataFrame, keys: list[str], k: int, norm: int) -> DataFrame:
    """k_nearest of groups that one task holds: the distances of its queries to all its points, a chunk at a time."""
    schema = T.StructType([*[left.schema[c] for c in keys], T.StructField("left_id", left.schema["id"].dataType), T.StructField("rank", T.LongType()), T.StructField("right_id", right.schema["id"].dataType), T.StructField("d", T.DoubleType())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")  # ties go to the lower place
        (x, y), (u, v) = ([t.column(c).to_numpy() for c in "xy"] for t in (a, b))
        few, found = min(k, len(u)), [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        step = max(1, CHUNK // max(1, len(u)))
        for since in range(0, len(x) if few else 0, step):
            dx, dy = np.abs(x[since : since + step, None] - u), np.abs(y[since : since + step, None] - v)
            d = dx + dy if norm == 1 else np.sqrt(dx * dx + dy * dy)
            at, to = np.nonzero(d <= np.partition(d, few - 1, axis=1)[:, few - 1 : few])
            order = np.lexsort((to, d[at, to], at))
            at, to = at[order], to[order]
            rank = np.arange(len(at)) - np.searchsorted(at, at)
            at, to, rank = (c[rank < few] for c in (at, to, rank))
            found.append((at + since, to, rank + 1, d[at, to]))
        at, to, rank, d = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.Table.from_arrays([*[a.column(c).take(pa.array(at)) for c in keys], a.column("id").take(pa.array(at)), pa.array(rank), b.column("id").take(pa.array(to)), pa.array(d)], names=schema.names)

    # fresh columns: both sides may stem from one table
    left, right = (p.select(*[F.col(c).alias(c) for c in p.columns]) for p in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def k_nearest(left: DataFrame, right: DataFrame, keys: list[str], k: int, norm: int = 2) -> DataFrame:
    """keys, left_id, rank, right_id, d: the k right points (keys, id, x, y) nearest to each left one in the same keys.

    norm 2 is Euclidean, 1 the sum of the differences. Ties go to the lower right_id; a left point whose keys hold
    fewer than k right points gets them all. Points with a null coordinate take no part. Groups of up to GROUP points
    are each one task's matrices, so their points move once; larger ones descend a quadtree.
    """
    left, right = (p.select(*keys, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y", *keys]) for p in (left, right))
    if not keys:
        return _by_quadtree(left, right, keys, k, norm)
    left, right = cut(left), cut(right)
    sizes = left.select(*keys).unionByName(right.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    large = cut(sizes.filter(F.col("__size") > GROUP).select(*keys))
    if large.isEmpty():
        return _in_groups(left, right, keys, k, norm)
    small = [p.join(large, keys, "left_anti") for p in (left, right)]
    return _in_groups(*small, keys, k, norm).unionByName(_by_quadtree(*[p.join(large, keys, "left_semi") for p in (left, right)], keys, k, norm))


def _by_quadtree(left: DataFrame, right: DataFrame, keys: list[str], k: int, norm: int) -> DataFrame:
    """k_nearest of groups of any size and distribution: from the root down each query keeps, of the
    cells it looks at, those not farther than the k nearest points can be by the cells' counts and far corners,
    and meets points only in the leaves that are left. Of points in one place only the k lowest ids are looked at,
    and queries from one place are one query.
    """
    place = [*keys, "x", "y"]
    right = cut(right.withColumn("__r", F.row_number().over(Window.partitionBy(*place).orderBy("id"))).filter(F.col("__r") <= k).drop("__r"))
    left = cut(left)
    lx, ly, side = _box(left.select("x", "y").union(right.select("x", "y")))
    cells, placed = quadtree(right, keys, (lx, ly), side)
    spot = [*keys, "level", "cx", "cy"]
    size = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    slack = side * 1e-9
    near, far = [], []
    for c, cell, lo in (("x", "cx", lx), ("y", "cy", ly)):
        a = lo + F.col(cell) * size
        near.append(F.greatest(a - slack - F.col(c), F.col(c) - (a + size + slack), F.lit(0.0)))
        far.append(F.greatest(F.col(c) - a, a + size - F.col(c)) + slack)
    bounds = F.struct(_between(norm, *far).alias("far"), _between(norm, *near).alias("near"), "level", "cx", "cy", "n", "leaf")
    asked = left.select(*place).distinct()
    state = cut(asked.join(cells.filter("level = 0"), keys) if keys else asked.join(F.broadcast(cells.filter("level = 0"))))
    level = 0
    while not state.filter("not leaf").isEmpty():
        level += 1
        children = cells.filter(F.col("level") == level).withColumns({"ax": F.floor(F.col("cx") / 2), "ay": F.floor(F.col("cy") / 2)})
        children = F.broadcast(children) if children.count() <= SMALL else children
        open_ = state.filter("not leaf").select(*place, F.col("cx").alias("ax"), F.col("cy").alias("ay")).join(children, [*keys, "ax", "ay"])
        looked = open_.select(*place, *spot[len(keys) :], "n", "leaf").unionByName(state.filter("leaf").select(*place, *spot[len(keys) :], "n", "leaf"))
        c = F.sort_array(F.collect_list(bounds))  # a query looks at few cells at once
        held = looked.groupBy(*place).agg(c.alias("c"))
        reach = F.aggregate("c", F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("d")), lambda s, b: F.struct((s["n"] + b["n"]).alias("n"), F.when((s["n"] < k) & (s["n"] + b["n"] >= k), b["far"]).otherwise(s["d"]).alias("d")))["d"]
        kept = held.withColumn("reach", reach).select(*place, F.inline(F.filter("c", lambda b: b["near"] <= F.col("reach"))))
        state = cut(kept.select(*place, *spot[len(keys) :], "n", "leaf"))
    d = _between(norm, F.abs(F.col("x") - F.col("rx")), F.abs(F.col("y") - F.col("ry")))
    right = placed.select(*spot, F.col("id").alias("right_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    met = state.join(right, spot).select(*place, "right_id", d.alias("d"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy("d", "right_id")).cast("long")
    best = met.withColumn("rank", rank).filter(F.col("rank") <= k)
    return left.withColumnRenamed("id", "left_id").join(best, place).select(*keys, "left_id", "rank", "right_id", "d")
