"""Tile operators: each task gets the pixels of one tile (with its margin) or of one pair of tiles as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.steps import cut


def filters(octave: int) -> tuple[int, ...]:
    """Sides of the four box filters of an octave, 1 and on, evenly spaced: 9 15 21 27, then 15 27 39 51, and so on."""
    return tuple(3 * (2**octave * k + 1) for k in range(1, 5))



def _grid(pdf: pd.DataFrame, fill: float = 0.0) -> np.ndarray:
    """The pixels as an array from their least row and column on."""
    r, c = pdf["row"].to_numpy() - pdf["row"].min(), pdf["col"].to_numpy() - pdf["col"].min()
    out = np.full((r.max() + 1, c.max() + 1), fill)
    out[r, c] = pdf["value"].to_numpy(float)
    return np.nan_to_num(out, nan=fill)


def correlation(template: np.ndarray, search: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every place where the template lies inside the search tile, by FFT.

    A window whose deviation is at most 1e-13 scores 0.
    """
    h, w = template.shape
    shape = [search.shape[0] + h - 1, search.shape[1] + w - 1]
    centred = template - template.mean()
    product = np.fft.irfft2(np.fft.rfft2(search, shape) * np.fft.rfft2(centred[::-1, ::-1], shape), shape)[h - 1 : search.shape[0], w - 1 : search.shape[1]]

    def windows(a: np.ndarray) -> np.ndarray:
        s = np.pad(a, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return (s[h:, w:] - s[:-h, w:] - s[h:, :-w] + s[:-h, :-w]) / (h * w)

    mean = windows(search)
    dev = np.sqrt(np.maximum(0, windows(search * search) - mean * mean)) * template.std()
    return np.divide(product / (h * w), dev, out=np.zeros_like(product), where=dev > 1e-13)


#: Offsets of a search tile in each direction, and templates that meet a tile in one task.
TILE, TEMPLATES = 256, 256


def ncc_match(templates: DataFrame, searches: DataFrame, key: str, template: str | None = None, size: int = TILE) -> DataFrame:
    """key, (template,) row, col, score: where each template fits best in the search image of its key.

    Both are pixel tables (key, row, col, value); templates with a column `template` if a key has several. row and
    col of the result are the search pixel under the template's first one. Ties go to the first row and column.
    Templates that don't fit into the image are left out; a null or missing pixel within an image counts 0.

    The image is cut into tiles of size by size offsets, which travel with a margin of the largest template. A tile
    and up to TEMPLATES templates are one task's work, whose best places are merged by a partial maximum.
    """
    tid = [F.lit(0).alias("__t") if template is None else F.col(template).alias("__t")]
    left = templates.select(F.col(key).alias("__k"), *tid, "row", "col", "value")
    right = searches.select(F.col(key).alias("__k"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "value")
    ends = [f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("row", "col")]
    shapes = cut(left.groupBy("__k", "__t").agg(*ends))
    edges = cut(right.groupBy("__k").agg(*ends))
    most = shapes.agg(F.max(F.col("hi_row") - F.col("lo_row")), F.max(F.col("hi_col") - F.col("lo_col"))).first()
    high, wide = (int(m or 0) for m in most)

    def reach(c: str, margin: int):
        return F.sequence(F.floor(F.greatest(F.col(c) - margin, F.col(f"lo_{c}")) / size), F.floor(F.col(c) / size))

    parts = shapes.groupBy("__k").agg(F.ceil(F.count(F.lit(1)) / TEMPLATES).alias("parts"))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    bounds = edges.join(parts, "__k")
    spread = right.join(bounds, "__k").withColumn("tr", F.explode(reach("row", high))).withColumn("tc", F.explode(reach("col", wide))).withColumn("part", F.explode(every))
    lattice = [F.sequence(F.floor(F.col(f"lo_{c}") / size), F.floor(F.col(f"hi_{c}") / size)) for c in ("row", "col")]
    spots = bounds.select("__k", "parts", F.explode(lattice[0]).alias("tr"), "lo_col", "hi_col").select("__k", "parts", "tr", F.explode(lattice[1]).alias("tc"))
    sent = left.join(spots, "__k").withColumn("part", F.pmod(F.xxhash64("__t"), F.col("parts")))
    kinds = {c: left.schema[c].dataType.simpleString() for c in ("__k", "__t")}

    def run(t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        names, found = ["__k", "__t", "row", "col", "score"], []
        if len(t) and len(s):
            one = s.iloc[0]
            top, left_ = max(int(one["tr"]) * size, int(one["lo_row"])), max(int(one["tc"]) * size, int(one["lo_col"]))
            rows, cols = (min(int(one[n]) * size + size + m, int(one[f"hi_{c}"]) + 1) - lo for n, c, m, lo in (("tr", "row", high, top), ("tc", "col", wide, left_)))
            area = np.zeros((rows, cols))
            area[s["row"].to_numpy() - top, s["col"].to_numpy() - left_] = np.nan_to_num(s["value"].to_numpy(float))
            for tid, pixels in t.groupby("__t", sort=True):
                a = _grid(pixels)
                # offsets of this tile only, and none whose window leaves the image
                r, c = min(rows, size + a.shape[0] - 1), min(cols, size + a.shape[1] - 1)
                if a.shape[0] > r or a.shape[1] > c:
                    continue
                score = correlation(a, area[:r, :c])
                i, j = np.unravel_index(np.argmax(np.round(score, 12)), score.shape)
                found.append((one["__k"], tid, i + top, j + left_, score[i, j]))
        return pd.DataFrame(found, columns=names)

    where = ["__k", "tr", "tc", "part"]
    # fresh columns: both sides may stem from one table
    sent, spread = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (sent, spread))
    met = sent.groupBy(*where).cogroup(spread.groupBy(*where)).applyInPandas(run, f"__k {kinds['__k']}, __t {kinds['__t']}, row long, col long, score double")
    best = met.groupBy("__k", "__t").agg(F.max(F.struct(F.round("score", 12).alias("s"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"), "score")).alias("b"))
    given = [F.col("__k").alias(key), *([] if template is None else [F.col("__t").alias(template)])]
    return best.select(*given, (-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col"), F.col("b.score").alias("score"))


def tiled(px: DataFrame, size: int, margin: int) -> DataFrame:
    """px with trow, tcol: each pixel goes to its tile and to all others within margin of it."""

    def reach(c: str):
        return F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - margin) / size)), F.floor((F.col(c) + margin) / size))

    return px.withColumn("trow", F.explode(reach("row"))).withColumn("tcol", F.explode(reach("col")))


def hessian(a: np.ndarray, side: int) -> np.ndarray:
    """Determinant of the box-filter Hessian, Dxx Dyy - 0.81 Dxy^2, at every pixel; outside counts 0."""
    lobe, half = side // 3, side // 2
    pad = side + 1
    s = np.pad(np.pad(a, pad), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    h, w = a.shape

    def box(r: int, c: int, rows: int, cols: int) -> np.ndarray:
        top, left = r + pad, c + pad
        return s[top + rows : top + rows + h, left + cols : left + cols + w] - s[top : top + h, left + cols : left + cols + w] - s[top + rows : top + rows + h, left : left + w] + s[top : top + h, left : left + w]

    wide = 2 * lobe - 1
    dxx = box(1 - lobe, -half, wide, side) - 3 * box(1 - lobe, -(lobe // 2), wide, lobe)
    dyy = box(-half, 1 - lobe, side, wide) - 3 * box(-(lobe // 2), 1 - lobe, lobe, wide)
    dxy = box(-lobe, 1, lobe, lobe) + box(1, -lobe, lobe, lobe) - box(-lobe, -lobe, lobe, lobe) - box(1, 1, lobe, lobe)
    return (dxx * dyy - 0.81 * dxy * dxy) / side**4


def _refined(cube: np.ndarray) -> np.ndarray | None:
    """Offset (scale, row, col) of the top of a parabola through a 3 by 3 by 3 block; None where there is none."""
    at = cube[1, 1, 1]
    grad, hess = np.zeros(3), np.zeros((3, 3))
    unit = np.eye(3, dtype=int)
    for i in range(3):
        plus, minus = cube[tuple(1 + unit[i])], cube[tuple(1 - unit[i])]
        grad[i], hess[i, i] = (plus - minus) / 2, plus + minus - 2 * at
        for j in range(i):
            hess[i, j] = hess[j, i] = (cube[tuple(1 + unit[i] + unit[j])] - cube[tuple(1 + unit[i] - unit[j])] - cube[tuple(1 - unit[i] + unit[j])] + cube[tuple(1 - unit[i] - unit[j])]) / 4
    return -np.linalg.pinv(hess) @ grad


def blobs(a: np.ndarray, threshold: float, octaves: int = 1) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(row, col, y, x, scale, response) of the peaks over place and filter side, in the array's own coordinates.

    A peak stands out among its neighbours in three filters in a row of one octave. Every pixel counts in every octave.
    """
    layers = {side: hessian(a, side) for side in sorted({s for o in range(1, octaves + 1) for s in filters(o)})}
    for low, mid, high in (filters(o)[k : k + 3] for o in range(1, octaves + 1) for k in (0, 1)):
        border = (high + 1) // 2
        middle, stack = layers[mid], [layers[s] for s in (low, mid, high)]
        if middle.shape[0] <= 2 * border + 1 or middle.shape[1] <= 2 * border + 1:
            continue
        inner = (slice(border + 1, middle.shape[0] - border), slice(border + 1, middle.shape[1] - border))
        peak = middle[inner] >= threshold
        for layer in stack:
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    if layer is not middle or dr or dc:
                        peak &= layer[inner[0].start + dr : inner[0].stop + dr, inner[1].start + dc : inner[1].stop + dc] < middle[inner]
        for r, c in np.argwhere(peak) + border + 1:
            off = _refined(np.stack([layer[r - 1 : r + 2, c - 1 : c + 2] for layer in stack]))
            if (np.abs(off) < 0.5).all():
                yield int(r), int(c), r + off[1], c + off[2], 0.1333 * (mid + off[0] * (high - mid)), float(middle[r, c])


def hessian_blobs(px: DataFrame, threshold: float, size: int = 512, octaves: int = 1) -> DataFrame:
    """image_id, band, row, col, y, x, scale, response of blob key points: peaks of the Hessian over three filters.

    Octave o has the filters of `filters(o)`; a peak that two octaves share comes once for each.

    Tiles of size by size pixels travel with a margin that covers the largest filter, so a point found in a
    tile's own area is the one the whole image would give. Pixels nearer to the image's edge than the largest
    filter of a stack give none; a null or missing pixel counts 0.
    """
    margin = filters(octaves)[-1] + 2
    edges = px.groupBy("image_id", "band").agg(F.max("row").alias("__mr"), F.max("col").alias("__mc"))
    given = tiled(px, size, margin).join(edges, ["image_id", "band"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, band, trow, tcol = key
        top, left, last_r, last_c = pdf["row"].min(), pdf["col"].min(), pdf["__mr"].iloc[0], pdf["__mc"].iloc[0]
        found = []
        for r, c, y, x, scale, response in blobs(_grid(pdf), threshold, octaves):
            gr, gc = r + top, c + left
            if gr // size == trow and gc // size == tcol and gr <= last_r and gc <= last_c:
                found.append((image, band, gr, gc, y + top, x + left, scale, response))
        return pd.DataFrame(found, columns=["image_id", "band", "row", "col", "y", "x", "scale", "response"])

    kind = px.schema["image_id"].dataType.simpleString()
    return given.groupBy("image_id", "band", "trow", "tcol").applyInPandas(run, f"image_id {kind}, band int, row long, col long, y double, x double, scale double, response double")
