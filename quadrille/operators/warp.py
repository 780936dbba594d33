"""Resampling, clipping and segment geometry as joins on cells and edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a row whose cells inside a cutline are the bits of one number, so 64.
TILE = 64


def warp_nearest(px: DataFrame, target: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """target (image_id, band, row, col) with the value of the source cell nearest to (sx, sy); null outside."""
    at = target.withColumns({"srow": F.floor(sy + 0.5), "scol": F.floor(sx + 0.5)})
    src = px.select("image_id", "band", F.col("row").alias("srow"), F.col("col").alias("scol"), "value")
    return at.join(src, ["image_id", "band", "srow", "scol"], "left").drop("srow", "scol")


def warp_bilinear(px: DataFrame, target: DataFrame, sx: Column, sy: Column) -> DataFrame:
    """As warp_nearest, with the four cells around weighted by nearness; null and missing ones are left out."""
    fx, fy = sx - F.floor(sx), sy - F.floor(sy)
    cells = [F.struct((F.floor(sy) + j).alias("srow"), (F.floor(sx) + i).alias("scol"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)]
    at = target.select("image_id", "band", "row", "col", F.inline(F.array(*cells)))
    src = px.filter("value is not null").select("image_id", "band", F.col("row").alias("srow"), F.col("col").alias("scol"), "value")
    met = at.join(src, ["image_id", "band", "srow", "scol"], "left")
    total = F.sum(F.when(F.col("value").isNotNull(), F.col("w")))
    return met.groupBy("image_id", "band", "row", "col").agg((F.sum(F.col("w") * F.col("value")) / F.nullif(total, F.lit(0.0))).alias("value"))


def cubic(t: np.ndarray) -> np.ndarray:
    """The cubic kernel of a = -0.5, of reach 2."""
    t = np.abs(t)
    return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))


def lanczos(t: np.ndarray) -> np.ndarray:
    """The sinc of t, windowed by the sinc of t / 3, of reach 3."""
    return np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)


#: kernel and reach in cells.
KERNELS = {"cubic": (cubic, 2), "lanczos": (lanczos, 3)}
#: Source cells of a tile, and target cells of a block, in each direction.
SOURCE, TARGET = 256, 512


def warp_kernel(px: DataFrame, target: DataFrame, sx: Column, sy: Column, kernel: str = "cubic", source: int = SOURCE, block: int = TARGET) -> DataFrame:
    """As warp_nearest, by a kernel over the cells around: cubic (4 x 4) or lanczos (6 x 6).

    Null and missing cells are left out and the weights of the others made up to 1; where these come to nothing, or
    (sx, sy) is null, the value is null. Targets meet the source tile they fall into, which travels with a margin as
    wide as the kernel, as arrays: no cell is copied for each tap. Targets of one tile are dealt by blocks, so strong
    enlargement spreads too.
    """
    weigh, reach = KERNELS[kernel]
    keys, spot = ["image_id", "band"], ["trow", "tcol", "brow", "bcol"]
    at = target.withColumns({"__x": sx.cast("double"), "__y": sy.cast("double")})
    at = at.select(*keys, "row", "col", "__x", "__y", F.coalesce(F.floor(F.col("__y") / source), F.lit(0)).alias("trow"), F.coalesce(F.floor(F.col("__x") / source), F.lit(0)).alias("tcol"), F.floor(F.col("row") / block).alias("brow"), F.floor(F.col("col") / block).alias("bcol"))
    spots = at.select(*keys, *spot).distinct()

    def near(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - reach) / source), F.floor((F.col(c) + reach) / source)))

    cells = px.filter("value is not null").select(*keys, F.col("row").alias("srow"), F.col("col").alias("scol"), F.col("value").cast("double").alias("value"))
    cells = cells.withColumn("trow", near("srow")).withColumn("tcol", near("scol")).join(spots, [*keys, "trow", "tcol"])

    def run(key: tuple, t: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = t[[*keys, "row", "col"]].copy()
        out["value"] = None
        if not len(t) or not len(c):
            return out
        # the tile with its margin; a cell that is missing has no weight
        top, left = key[2] * source - reach, key[3] * source - reach
        side = source + 2 * reach + 1
        values, there = np.zeros((side, side)), np.zeros((side, side))
        r, k = c["srow"].to_numpy() - top, c["scol"].to_numpy() - left
        values[r, k], there[r, k] = c["value"].to_numpy(), 1.0
        ok = t["__x"].notna().to_numpy() & t["__y"].notna().to_numpy()
        x, y = t["__x"].to_numpy(float)[ok], t["__y"].to_numpy(float)[ok]
        taps = np.arange(1 - reach, reach + 1)
        cx, cy = np.floor(x)[:, None] + taps, np.floor(y)[:, None] + taps
        wx, wy = weigh(x[:, None] - cx), weigh(y[:, None] - cy)
        rows, cols = (cy - top).astype(int), (cx - left).astype(int)
        w = wy[:, :, None] * wx[:, None] * there[rows[:, :, None], cols[:, None]]
        total = w.sum((1, 2))
        got = np.divide((w * values[rows[:, :, None], cols[:, None]]).sum((1, 2)), total, out=np.full(len(total), np.nan), where=np.abs(total) > 1e-9)
        full = np.full(len(t), np.nan)
        full[ok] = got
        out["value"] = pd.Series(full, index=out.index).astype(object).where(~np.isnan(full), None)
        return out

    kinds = ", ".join(f"{c} {target.schema[c].dataType.simpleString()}" for c in (*keys, "row", "col"))
    # fresh columns: both sides may stem from one table
    at, cells = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (at, cells))
    return at.groupBy(*keys, *spot).cogroup(cells.groupBy(*keys, *spot)).applyInPandas(run, f"{kinds}, value double")


def warp_average(px: DataFrame, trow: Column, tcol: Column) -> DataFrame:
    """Means of the source cells that fall into each target cell (floor of trow, tcol); nulls are left out."""
    at = px.filter("value is not null").select("image_id", "band", F.floor(trow).alias("trow"), F.floor(tcol).alias("tcol"), "value")
    return at.groupBy("image_id", "band", F.col("trow").alias("row"), F.col("tcol").alias("col")).agg(F.avg("value").alias("value"))


def warp_mode(px: DataFrame, trow: Column, tcol: Column) -> DataFrame:
    """As warp_average, with the most frequent value; the lower one on a tie."""
    at = px.filter("value is not null").select("image_id", "band", F.floor(trow).alias("row"), F.floor(tcol).alias("col"), "value")
    counts = at.groupBy("image_id", "band", "row", "col", "value").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("image_id", "band", "row", "col").agg(F.min(F.struct((-F.col("c")).alias("c"), "value"))["value"].alias("value"))


def cutline_clip(px: DataFrame, polygons: DataFrame) -> DataFrame:
    """Cells whose centre (col, row) is inside any polygon (poly_id, points array of x, y), by even-odd crossings.

    A polygon's crossings of a row, in order, are the ends of its stretches there. The stretches of TILE columns of a row
    become the bits of one number before they move, whatever their number. A cell meets the number of its row and of
    its columns; row and col are whole numbers.
    """
    n = F.size("points")
    edges = polygons.select("poly_id", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col("points")[i].alias("p"), F.col("points")[(i + 1) % n].alias("q")))).alias("e"))
    low, high = F.least("e.p.y", "e.q.y"), F.greatest("e.p.y", "e.q.y")
    rows = edges.filter(F.ceil(low) < high).select("poly_id", "e", F.explode(F.sequence(F.ceil(low), F.ceil(high) - 1)).alias("row"))
    x = F.col("e.p.x") + (F.col("row") - F.col("e.p.y")) / (F.col("e.q.y") - F.col("e.p.y")) * (F.col("e.q.x") - F.col("e.p.x"))
    crossings = rows.select("poly_id", "row", x.alias("x")).groupBy("row", "poly_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    ends = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.col("xs")[i].alias("x0"), F.col("xs")[i + 1].alias("x1")))
    stretches = crossings.filter(F.size("xs") > 1).select("row", F.inline(ends)).filter("x0 < x1")
    first, last = F.ceil("x0"), F.ceil("x1") - 1
    tile = F.sequence(F.floor(first / TILE), F.floor(last / TILE))
    spread = stretches.select(F.col("row").alias("__row"), first.alias("a"), last.alias("b"), F.explode(F.when(first <= last, tile)).alias("__tile"))
    at = F.col("__tile") * TILE
    low, high = F.greatest(F.col("a") - at, F.lit(0)).cast("int"), F.least(F.col("b") - at, F.lit(TILE - 1)).cast("int")
    bits = F.expr("shiftleft(-1L, __low) & shiftrightunsigned(-1L, 63 - __high)")
    masks = spread.select("__row", "__tile", low.alias("__low"), high.alias("__high")).groupBy("__row", "__tile").agg(F.bit_or(bits).alias("__bits"))
    met = (F.col("row") == F.col("__row")) & (F.floor(F.col("col") / TILE) == F.col("__tile")) & (F.expr("shiftrightunsigned(__bits, cast(pmod(col, 64) AS int)) & 1") == 1)
    return px.join(masks.hint("merge"), met, "left_semi")


def cutline(px: DataFrame, features: DataFrame, where: str | None = None, crop: bool = False) -> DataFrame:
    """px with value null outside the cutline: the features (poly_id, type, points, ...) that `where` (SQL) picks.

    No such feature, or one that is no polygon, is an error. crop: only cells within the cutline's bounds are left.
    """
    chosen = features.filter(where) if where else features
    corner = F.explode("points").alias("c")
    kinds = chosen.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.lower("type") != "polygon") | (F.size("points") < 3)).alias("bad")).first()
    if not kinds.n:
        raise ValueError("the cutline has no feature")
    if kinds.bad:
        raise ValueError("the cutline has a feature that is no polygon")
    inside = cutline_clip(px.select("image_id", "band", "row", "col"), chosen).distinct().withColumn("__in", F.lit(True))
    out = px.join(inside, ["image_id", "band", "row", "col"], "left").withColumn("value", F.when(F.col("__in"), F.col("value"))).drop("__in")
    if crop:
        b = chosen.select(corner).agg(F.min("c.x").alias("x0"), F.min("c.y").alias("y0"), F.max("c.x").alias("x1"), F.max("c.y").alias("y1")).first()
        out = out.filter(F.col("col").between(b.x0, b.x1) & F.col("row").between(b.y0, b.y1))
    return out


def segment_distance(pairs: DataFrame) -> DataFrame:
    """Add d to pairs of segments (ax, ay, bx, by) and (cx, cy, dx, dy): the mean of the four distances from an end
    point of one to the other's line -x sin(theta) + y cos(theta) = rho. A segment of no length gives null."""

    def off(x, y, px, py, qx, qy):
        length = F.sqrt((F.col(qx) - F.col(px)) * (F.col(qx) - F.col(px)) + (F.col(qy) - F.col(py)) * (F.col(qy) - F.col(py)))
        sin, cos = (F.col(qy) - F.col(py)) / F.nullif(length, F.lit(0.0)), (F.col(qx) - F.col(px)) / F.nullif(length, F.lit(0.0))
        return F.abs(-(F.col(x) - F.col(px)) * sin + (F.col(y) - F.col(py)) * cos)

    one, two = ("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy")
    return pairs.withColumn("d", (off("ax", "ay", *two) + off("bx", "by", *two) + off("cx", "cy", *one) + off("dx", "dy", *one)) / 4)
