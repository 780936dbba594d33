"""Range joins on grids: every pair meets in a shared cell and is kept in exactly one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.steps import cut, fresh_folder

BOX = ("xmin", "ymin", "xmax", "ymax")


#: Levels of the grid that boxes are placed on, each of cells twice as wide as the one before.
LEVELS = 60


def _levelled(boxes: DataFrame, size: float, side: str) -> DataFrame:
    """Boxes as (side_id, side_xmin ..., own): own is the least level whose cells are as wide as the box."""
    wide = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    own = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(wide / size)))).cast("int")
    return boxes.select(F.col("id").alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in BOX], F.when(wide > size, own).otherwise(0).alias("own"))


def _placed(boxes: DataFrame, size: float, side: str, levels: Column) -> DataFrame:
    """Boxes with each of `levels` and the cells that they meet there, four at most at levels from their own on."""
    at = boxes.withColumn("level", F.explode(levels))
    cell = F.pow(F.lit(2.0), F.col("level")) * size

    def run(axis: str) -> Column:
        return F.sequence(F.floor(F.col(f"{side}_{axis}min") / cell), F.floor(F.col(f"{side}_{axis}max") / cell))

    return at.withColumn("cx", F.explode(run("x"))).withColumn("cy", F.explode(run("y"))).drop("own")


#: Boxes of a side that a share of a cell holds, about; pairs that a partition looks at; and partitions at most.
SHARE, PAIRS, PARTS = 5_000, 20_000_000, 4096


def _met(x: DataFrame, y: DataFrame) -> DataFrame:
    """The pairs of placed boxes in one cell. Full cells are cut to shares of both sides, and each pair of shares is
    a key of its own; there are as many partitions as the pairs need, since few boxes may have very many of them."""
    cell = ["level", "cx", "cy"]
    sizes = cut(x.groupBy(*cell).agg(F.count(F.lit(1)).alias("na")).join(y.groupBy(*cell).agg(F.count(F.lit(1)).alias("nb")), cell))
    pairs = sizes.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).first()[0] or 0.0
    parts = int(min(PARTS, 1 + pairs // PAIRS))
    shares = sizes.select(*cell, F.ceil(F.col("na") / SHARE).alias("na"), F.ceil(F.col("nb") / SHARE).alias("nb"))

    def dealt(t: DataFrame, side: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64(*[c for c in t.columns if c.startswith(f"{side}_")]), F.col(f"n{side}")).alias(f"s{side}")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{other}") - 1)).alias(f"s{other}")
        return t.join(shares, cell).select(*t.columns, own, every).repartition(parts, *cell, "sa", "sb")

    return dealt(x, "a", "b").join(dealt(y, "b", "a"), [*cell, "sa", "sb"]).drop("sa", "sb")


def footprint_join(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """left_id, right_id and the intersection of boxes (id, xmin, ymin, xmax, ymax) that overlap or touch.

    A box stands on the grid level of its own width, so it meets four cells at most, however large. The smaller box of
    a pair also goes to the coarser levels on which the other side has boxes of their own; boxes that both came up
    from finer levels never meet there. A pair counts in the cell that holds the lower corner of its overlap, so no
    pair is seen twice. `size` is the finest cell; boxes with a null edge, or upside down, meet nothing.
    """
    whole = [b.dropna(subset=list(BOX)).filter("xmin <= xmax and ymin <= ymax") for b in (left, right)]
    a, b = (_levelled(t, size, side) for t, side in zip(whole, ("a", "b"), strict=True))
    # the levels in use, 61 numbers at most
    used = {side: sorted(r.own for r in t.select("own").distinct().collect()) for side, t in (("a", a), ("b", b))}
    own = F.array("own")

    def upward(other: str, least: int) -> Column:
        return F.filter(F.array(*map(F.lit, used[other])).cast("array<int>"), lambda x: x >= F.col("own") + least)

    pairs = [(_placed(a, size, "a", own), _placed(b, size, "b", upward("a", 0))), (_placed(a, size, "a", upward("b", 1)), _placed(b, size, "b", own))]
    met = [_met(x, y) for x, y in pairs]
    cell = F.pow(F.lit(2.0), F.col("level")) * size
    names = [F.col("a_id").alias("left_id"), F.col("b_id").alias("right_id"), *[F.greatest(f"a_{c}", f"b_{c}").alias(c) for c in BOX[:2]], *[F.least(f"a_{c}", f"b_{c}").alias(c) for c in BOX[2:]]]
    both = met[0].unionByName(met[1]).select(*names, "cx", "cy", cell.alias("cell"))
    here = (F.floor(F.col("xmin") / F.col("cell")) == F.col("cx")) & (F.floor(F.col("ymin") / F.col("cell")) == F.col("cy"))
    return both.filter((F.col("xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("ymax")) & here).drop("cx", "cy", "cell")


def radius_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """keys, left_id, right_id, d of points (id, x, y) within `radius`: right points go to their 3 by 3 cells."""
    cell = {"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)}
    a = left.withColumns(cell).select(*keys, "cx", "cy", F.col("id").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    around = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.withColumns(cell).select(*keys, F.col("id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by"), F.inline(around))
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return a.join(b, [*keys, "cx", "cy"]).withColumn("d", d).filter(F.col("d") <= radius).select(*keys, "left_id", "right_id", "d")


def lookup_elevation(points: DataFrame, dem: DataFrame, default: float) -> DataFrame:
    """Set hgt of points (x, y) to the height (row, col, value) of their cell, or to the default outside."""
    at = points.drop("hgt").withColumns({"row": F.floor("y"), "col": F.floor("x")})
    return at.join(dem.select("row", "col", F.col("value").alias("hgt")), ["row", "col"], "left").withColumn("hgt", F.coalesce("hgt", F.lit(default))).drop("row", "col")


def interpolate_elevation(points: DataFrame, keys: list[str], dem: DataFrame, default: float) -> DataFrame:
    """keys, hgt of points (x, y): the four heights around weighted by nearness, missing ones left out; else the default."""
    fx, fy = F.col("x") - F.floor("x"), F.col("y") - F.floor("y")
    cells = [F.struct((F.floor("y") + j).alias("row"), (F.floor("x") + i).alias("col"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)]
    met = points.select(*keys, F.inline(F.array(*cells))).join(dem.select("row", "col", "value"), ["row", "col"], "left")
    weight = F.sum(F.when(F.col("value").isNotNull(), F.col("w")))
    return met.groupBy(*keys).agg(F.coalesce(F.sum(F.col("w") * F.col("value")) / F.nullif(weight, F.lit(0.0)), F.lit(default)).alias("hgt"))


def control_grid(scenes: DataFrame, levels: int, lines: int, samples: int) -> DataFrame:
    """Lattice of each scene (scene_id, ulx, uly, w, h, zmin, zmax): scene_id, level, line, sample, x, y, z."""
    def norm(i, n):
        return F.col(i) / (n - 1) if n > 1 else F.lit(0.0)

    g = scenes
    for name, n in (("level", levels), ("line", lines), ("sample", samples)):
        g = g.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    z = F.col("zmin") + F.col("level") * (F.col("zmax") - F.col("zmin")) / max(1, levels - 1)
    x = ((F.col("w") - 1) * norm("sample", samples) + F.col("ulx")).cast("int")
    y = ((F.col("h") - 1) * norm("line", lines) + F.col("uly")).cast("int")
    return g.select("scene_id", "level", "line", "sample", x.alias("x"), y.alias("y"), z.alias("z"))


def _nearest_centre(centres: list) -> Column:
    """The k of the centre (k, cx, cy) nearest to x, y; ties go to the lower k."""
    d = [F.struct(((F.col("x") - float(c[1])) * (F.col("x") - float(c[1])) + (F.col("y") - float(c[2])) * (F.col("y") - float(c[2]))).alias("d"), F.lit(c[0]).cast("long").alias("k")) for c in centres]
    return F.array_min(F.array(*d))["k"]


def _few(centres: DataFrame, most: int) -> list:
    rows = centres.select("k", "cx", "cy").orderBy("k").limit(most + 1).collect()
    if not rows or len(rows) > most:
        raise ValueError(f"k-means needs 1 to {most} centres")
    return rows


def kmeans_step(points: DataFrame, centres: DataFrame, most: int = 1000) -> DataFrame:
    """One Lloyd step: k, n, and the means of x, y, dx, dy of the points (x, y, dx, dy) nearest to centre k.

    The centres (k, cx, cy), `most` at most, are constants of the plan: no join is needed.
    """
    near = points.withColumn("k", _nearest_centre(_few(centres, most)))
    return near.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "dx", "dy")])


def kmeans_points(points: DataFrame, k: int, rounds: int = 100, most: int = 1000) -> tuple[DataFrame, DataFrame, bool]:
    """Points (id, x, y, dx, dy) with their cluster k; the clusters (k, n, x, y, dx, dy); whether no point moved at last.

    Starts from the k points of least hash of their id; a cluster that loses all points is dropped. The driver holds
    the centres only.
    """
    points = cut(points)
    start = points.orderBy(F.xxhash64("id"), "id").limit(min(k, most + 1)).select(F.col("x").alias("cx"), F.col("y").alias("cy")).collect()
    if not 0 < len(start) <= most:
        raise ValueError(f"k-means needs 1 to {most} centres")
    centres, seen, still = [(i, *r) for i, r in enumerate(start)], None, False
    packed = _packed(points)
    for _ in range(rounds):
        means = _lloyd(packed, centres, seen).orderBy("k").collect()
        still = seen is not None and not sum(r.moved for r in means)
        if still:
            break
        seen, centres = centres, [(r.k, r.x, r.y) for r in means]
    at = points.withColumn("k", _nearest_centre(seen or centres))
    return at, at.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("x", "y", "dx", "dy")]), still


def _packed(points: DataFrame) -> DataFrame:
    """xy: the coordinates of a batch of points as float64 bytes, first all x; null is NaN. Written once to the shared folder.

    Rounds then read bytes as they are and no rows.
    """
    def run(batches):
        for b in batches:
            if b.num_rows:
                xy = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y")])
                yield pa.RecordBatch.from_arrays([pa.array([xy.tobytes()], pa.binary())], names=["xy"])

    path = fresh_folder(points.sparkSession)
    points.select(F.col("x").cast("double"), F.col("y").cast("double")).mapInArrow(run, "xy binary").write.parquet(path)
    return points.sparkSession.read.schema("xy binary").parquet(path)


def _lloyd(packed: DataFrame, centres: list, before: list | None) -> DataFrame:
    """k, x, y, moved: the mean of the points nearest to each centre, and how many had another k by the centres before.

    packed: batches of points as _packed writes them. Distances are the matrices of a batch by the centres; a task gives one row of sums for each centre.
    """
    def nearest(xy: np.ndarray, at: list) -> np.ndarray:
        c, out = np.array([r[1:3] for r in at], float), np.empty(len(xy), int)
        step = max(1, 1_000_000 // len(c))
        for i in range(0, len(xy), step):
            b = xy[i : i + step]
            out[i : i + step] = ((b[:, 0] - c[:, :1]) ** 2 + (b[:, 1] - c[:, 1:]) ** 2).argmin(0)
        return np.array([r[0] for r in at])[out]

    ks = np.array([c[0] for c in centres])

    def run(batches):
        sums = np.zeros((6, len(ks)))  # rows, sums and counts of x and y, moved
        for value in (v for b in batches for v in b.column("xy")):
            xy = np.frombuffer(value.as_buffer()).reshape(2, -1).T
            k = nearest(xy, centres)
            at = np.searchsorted(ks, k)
            went = k != nearest(xy, before) if before else np.ones(len(k))
            there = ~np.isnan(xy)
            for i, w in enumerate((None, np.where(there[:, 0], xy[:, 0], 0), there[:, 0], np.where(there[:, 1], xy[:, 1], 0), there[:, 1], went)):
                sums[i] += np.bincount(at, w, len(ks))
        yield pa.RecordBatch.from_arrays([pa.array(ks), *[pa.array(x) for x in sums]], names=["k", "n", "sx", "nx", "sy", "ny", "moved"])

    parts = packed.mapInArrow(run, "k long, n double, sx double, nx double, sy double, ny double, moved double")
    total = parts.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "nx", "sy", "ny", "moved")]).filter("n > 0")
    return total.select("k", *[F.try_divide(f"s{c}", f"n{c}").alias(c) for c in "xy"], "moved")


def datum_shift(points: DataFrame, dx: float, dy: float, dz: float, a: float = 6378137.0, f: float = 1 / 298.257223563) -> DataFrame:
    """Points (lon, lat in degrees, hgt) moved by a geocentric shift: to XYZ, add, and back by Bowring's formula."""
    e2, b = f * (2 - f), a * (1 - f)
    lon, lat = F.radians("lon"), F.radians("lat")
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    x, y, z = (n + F.col("hgt")) * F.cos(lat) * F.cos(lon) + dx, (n + F.col("hgt")) * F.cos(lat) * F.sin(lon) + dy, (n * (1 - e2) + F.col("hgt")) * F.sin(lat) + dz
    at = points.withColumns({"__x": x, "__y": y, "__z": z})
    x, y, z = F.col("__x"), F.col("__y"), F.col("__z")
    p = F.sqrt(x * x + y * y)
    t = F.atan2(z * a, p * b)
    up = F.atan2(z + (e2 / (1 - e2)) * b * F.pow(F.sin(t), F.lit(3.0)), p - e2 * a * F.pow(F.cos(t), F.lit(3.0)))
    m = a / F.sqrt(1 - e2 * F.sin(up) * F.sin(up))
    return at.withColumns({"hgt": p / F.cos(up) - m, "lat": F.degrees(up), "lon": F.degrees(F.atan2(y, x))}).drop("__x", "__y", "__z")


def target_extent(boxes: DataFrame, step: float) -> DataFrame:
    """The union of boxes, its edges moved outward to multiples of step."""
    g = boxes.agg(*[(F.min if "min" in c else F.max)(c).alias(c) for c in BOX])
    return g.select(*[((F.floor if "min" in c else F.ceil)(F.col(c) / step) * step).alias(c) for c in BOX])


def target_grid(boxes: DataFrame, te: tuple[float, float, float, float] | None = None, tr: float | None = None, ts: tuple[int, int] | None = None, align: bool = False) -> DataFrame:
    """xmin, ymin, xmax, ymax, step_x, step_y, cols, rows of the target raster of boxes in target coordinates.

    te sets the extent (else it is the union of the boxes); tr the size of a cell, ts the number of columns and rows;
    align moves the edges outward to multiples of tr. Of tr the extent grows to whole cells to the right and down.
    """
    if (tr is None) == (ts is None) or (align and tr is None):
        raise ValueError("give either tr or ts, and tr with align")
    g = boxes.agg(*[(F.min if "min" in c else F.max)(c).alias(c) for c in BOX])
    if te is not None:
        g = g.select(*[F.lit(float(v)).alias(c) for v, c in zip(te, BOX, strict=True)])
    if ts is not None:
        return g.select(*BOX, ((F.col("xmax") - F.col("xmin")) / ts[0]).alias("step_x"), ((F.col("ymax") - F.col("ymin")) / ts[1]).alias("step_y"), F.lit(ts[0]).cast("long").alias("cols"), F.lit(ts[1]).cast("long").alias("rows"))
    if align:
        g = g.select(*[((F.floor if "min" in c else F.ceil)(F.col(c) / tr) * tr).alias(c) for c in BOX])
    cols, rows = (F.greatest(F.lit(1).cast("long"), F.ceil((F.col(b) - F.col(a)) / tr - 1e-9).cast("long")) for a, b in (("xmin", "xmax"), ("ymin", "ymax")))
    g = g.withColumns({"cols": cols, "rows": rows})
    return g.select("xmin", (F.col("ymax") - F.col("rows") * tr).alias("ymin"), (F.col("xmin") + F.col("cols") * tr).alias("xmax"), "ymax", F.lit(float(tr)).alias("step_x"), F.lit(float(tr)).alias("step_y"), "cols", "rows")


def knn_spatial(left: DataFrame, right: DataFrame, keys: list[str], radius: float, k: int) -> DataFrame:
    """keys, left_id, rank, right_id, d: the k nearest within radius; ties go to the lower id."""
    rank = F.row_number().over(Window.partitionBy(*keys, "left_id").orderBy("d", "right_id")).cast("long")
    return radius_join(left, right, keys, radius).withColumn("rank", rank).filter(F.col("rank") <= k)
