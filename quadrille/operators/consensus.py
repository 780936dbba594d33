"""Scoring of many models over the points of a pair: packed blocks of points, a matrix of models, counts of inliers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.steps import dealt

#: Points of a block, blocks of a run, and points that are scored before models that can't win are left out.
BLOCK, RUN, CHUNK = 4096, 64, 1024


def point_blocks(points: DataFrame, axes: list[str]) -> DataFrame:
    """pair_id, block, run, n, axes (arrays by pt): the points of each pair, BLOCK to a row, written once to the shared folder, in buckets of pair_id and run.

    Joins by exactly these two leave the points where they are. A pair of any size spreads over many rows and runs. A coordinate that is null is NaN. pt must count 0..n-1 in each pair.
    """
    row = F.struct("pt", *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in axes])
    packed = points.groupBy("pair_id", F.floor(F.col("pt") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(row)).alias("p"))
    return dealt(packed.select("pair_id", "block", F.floor(F.col("block") / RUN).alias("run"), F.size("p").alias("n"), *[F.col(f"p.{c}").alias(c) for c in axes]), ["pair_id", "run"])


def each_run(models: DataFrame) -> DataFrame:
    """models (pair_id, np, ...) once for each run of their pair's blocks, which they meet by pair_id and run."""
    runs = F.greatest(F.floor((F.col("np") - 1) / (BLOCK * RUN)), F.lit(0))
    return models.select("*", F.explode(F.sequence(F.lit(0).cast("long"), runs)).alias("run"))


def block_sizes(blocks: DataFrame) -> DataFrame:
    """pair_id, np: the points of each pair."""
    return blocks.groupBy("pair_id").agg(F.sum("n").alias("np"))


def block_points(blocks: DataFrame, axes: list[str], more: list[str] | None = None) -> DataFrame:
    """pair_id, pt, axes: the points again, with `more` columns of their blocks."""
    more = more or []
    rows = blocks.select("pair_id", "block", *more, F.posexplode(F.arrays_zip(*axes)).alias("at", "p"))
    return rows.select("pair_id", (F.col("block") * BLOCK + F.col("at")).alias("pt"), *[F.col(f"p.{c}").alias(c) for c in axes], *more)


def points_at(blocks: DataFrame, places: DataFrame, axes: list[str]) -> DataFrame:
    """The rows of places (pair_id, pt, ...) with the axes of their points."""
    spots = places.withColumn("run", F.floor(F.col("pt") / (BLOCK * RUN)))
    since = F.col("block") * BLOCK
    # a range, no equation of blocks: so the join stays one by the buckets' keys
    met = blocks.join(spots.hint("shuffle_hash"), ["pair_id", "run"]).filter((F.col("pt") >= since) & (F.col("pt") < since + BLOCK))
    at = (F.col("pt") % BLOCK).cast("int")
    return met.select(*places.columns, *[F.get(c, at).alias(c) for c in axes])


def inlier_counts(blocks: DataFrame, models: DataFrame, axes: list[str], names: tuple[str, ...], errors: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: float, unit: int = 1) -> DataFrame:
    """pair_id, h, inliers: the points of the pair with an error below limit, for each model that may still have the most.

    models: pair_id, np (points of the pair), known (inliers that some model is known to have), h and names. errors:
    (models x parameters, axes x points) -> models x points. A task holds the models of one pair as a matrix and
    counts block by block. A model that would not have the most even if all points that the task hasn't seen were
    inliers is dropped; what is left of its counts elsewhere can't win either. unit: if over 1, an inlier counts for so
    much without an error, and for less in proportion to it, down to 0 at the limit.
    """
    packed = models.groupBy("pair_id").agg(F.first("np").alias("np"), F.first("known").alias("known"), F.collect_list(F.struct("h", *[F.col(c).cast("double").alias(c) for c in names])).alias("m"))
    packed = each_run(packed.select("pair_id", "np", "known", F.col("m.h").alias("h"), *[F.col(f"m.{c}").alias(f"m_{c}") for c in names]))
    met = blocks.join(packed, ["pair_id", "run"])
    kind = pa.schema([("h", pa.int64()), ("inliers", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pair, h, m, n, total, known, seen = None, None, None, None, None, 0, 0, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pair] * len(h)) if len(h) else pair.slice(0, 0), pa.array(h), pa.array(n)], names=["pair_id", *kind.names])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                col = lambda c: row.column(c).values.slice(row.column(c).offsets[0].as_py(), len(row.column(c)[0]))  # noqa: B023, E731
                own = (row.column("pair_id")[0].as_py(), row.column("run")[0].as_py())
                if own != at:
                    if at is not None:
                        yield done()
                    at, pair, seen = own, row.column("pair_id"), 0
                    h = np.asarray(col("h"))
                    m = np.stack([np.asarray(col(f"m_{c}")) for c in names], 1)
                    n, total, known = np.zeros(len(h), np.int64), row.column("np")[0].as_py(), row.column("known")[0].as_py()
                xy = np.stack([np.asarray(col(c)) for c in axes])
                for since in range(0, xy.shape[1], CHUNK):
                    part = xy[:, since : since + CHUNK]
                    with np.errstate(all="ignore"):
                        e = errors(m, part)
                        n += ((e < limit) if unit == 1 else np.where(e < limit, unit - unit * e / limit, 0).astype(np.int64)).sum(1)
                    seen += part.shape[1]
                    may = n + unit * (total - seen) >= max(known, n.max(initial=0))
                    if not may.all():
                        h, m, n = h[may], m[may], n[may]
        if at is not None:
            yield done()

    schema = T.StructType([models.schema["pair_id"], T.StructField("h", T.LongType()), T.StructField("inliers", T.LongType())])
    return met.mapInArrow(count, schema).groupBy("pair_id", "h").agg(F.sum("inliers").alias("inliers"))


def similarity_errors(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    x, y, x2, y2 = p
    one = np.stack([x, y, np.ones_like(x)])
    return np.hypot(m[:, [0, 1, 2]] @ one - x2, m[:, [1, 0, 3]] * [-1, 1, 1] @ one - y2)


def affine_errors(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    x, y, x2, y2 = p
    one = np.stack([np.ones_like(x), x, y])
    return np.hypot(m[:, :3] @ one - x2, m[:, 3:] @ one - y2)


def line_errors(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.abs(m[:, :2] @ p - (m[:, 0] * m[:, 2] + m[:, 1] * m[:, 3])[:, None])


def homography_errors(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    x, y, x2, y2 = p
    one = np.stack([x, y, np.ones_like(x)])
    den = m[:, 6:8] @ one[:2] + 1
    return np.hypot(m[:, :3] @ one / den - x2, m[:, 3:6] @ one / den - y2)
