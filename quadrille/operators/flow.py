"""Groups of points that move alike: mean shift over place and displacement."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators.steps import cut

#: Weights of the squared differences of x, y, x - x2 and y - y2.
WEIGHTS = (1.0, 1.0, 10.0, 10.0)
SPOT = ("x", "y", "u", "v")
#: Points that share their keys and may climb in one task, and pairs of them that it looks at at once.
GROUP, CHUNK = 8192, 1_000_000
#: A mode whose mean is nearer than so many units of the last digit rests there. Any longer step brings it more points or nearer ones, whatever
#: is rounded (9 > 22 / 4, by WEIGHTS), so none comes back to where it was and all settle.
REST = 3.5
#: Rounds whose settled points are kept apart before they are written together.
APART = 16


def _square(a: str, b: str) -> Column:
    return sum(w * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for w, c in zip(WEIGHTS, SPOT, strict=True))


def _near(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of a.p and b.q (structs of SPOT) within the bandwidth: cells of x and y, b to its 3 by 3."""
    def cell(s: str, c: str) -> Column:
        return F.floor(F.col(f"{s}.{c}") / width)

    left = a.withColumns({"__cx": cell("p", "x"), "__cy": cell("p", "y")})
    around = F.array(*[F.struct((cell("q", "x") + i).alias("__cx"), (cell("q", "y") + j).alias("__cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.select(*b.columns, F.inline(around))
    return left.join(right, [*keys, "__cx", "__cy"]).filter(_square("p", "q") <= width * width).drop("__cx", "__cy")


def flow_groups(points: DataFrame, keys: list[str], width: float, rounds: int | None = None, digits: int = 6) -> DataFrame:
    """keys, id, cx, cy, cu, cv, settled: the centre of each point's group, by a flat kernel of bandwidth `width`.

    points: keys, id, x, y, x2, y2. Every point climbs to the mean of the points within the bandwidth, rounded to
    `digits`, until none moves by REST units of the last digit; with `rounds`, for so many at most: points then still
    climbing are not settled. Points at one place climb as one. Modes within the bandwidth of each other are one
    group: each follows the most climbed of its neighbours (the greater coordinates on a tie) until all stay.
    Groups of keys of up to GROUP points climb in one task each, so they move once; larger ones by joins, round by round.
    """
    spot = [F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("x") - F.col("x2")).cast("double").alias("u"), (F.col("y") - F.col("y2")).cast("double").alias("v")]
    if not keys:
        return _by_rounds(points.select("id", F.struct(*spot).alias("q")), keys, width, rounds, digits)
    given = cut(points.select(*keys, "id", *spot).dropna(subset=[*keys, *SPOT]))
    large = cut(given.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select(*keys))
    schema = T.StructType([*[given.schema[c] for c in (*keys, "id")], *[T.StructField(f"c{c}", T.DoubleType()) for c in SPOT], T.StructField("settled", T.BooleanType())])
    climb = _climbed(keys, width, rounds, digits)
    if large.isEmpty():
        return given.groupBy(*keys).applyInArrow(climb, schema)
    rest = given.join(large, keys, "left_semi").select(*keys, "id", F.struct(*SPOT).alias("q"))
    return given.join(large, keys, "left_anti").groupBy(*keys).applyInArrow(climb, schema).unionByName(_by_rounds(rest, keys, width, rounds, digits))


def _climbed(keys: list[str], width: float, rounds: int | None, digits: int):
    """flow_groups of one group of keys."""

    root = np.sqrt(WEIGHTS)

    def near(p: np.ndarray, q: np.ndarray):
        """Some rows of p at a time, and which rows of q are within the bandwidth of each.

        A matrix product tells; where its rounding might matter, the differences do.
        """
        a, b = p * root, q * root
        one, two = np.c_[-2 * a, (a * a).sum(1), np.ones(len(a))], np.c_[b, np.ones(len(b)), (b * b).sum(1)].T
        slack = 1e-12 * (1 + one[:, 4].max(initial=0) + two[5].max(initial=0))
        step = max(1, CHUNK // len(q))
        for since in range(0, len(p), step):
            square = one[since : since + step] @ two
            met = square <= width * width + slack
            i, j = np.nonzero(met & (square >= width * width - slack))
            met[i, j] = sum(w * (d := p[since + i, c] - q[j, c]) * d for c, w in enumerate(WEIGHTS)) <= width * width
            yield slice(since, since + len(met)), met

    def run(t: pa.Table) -> pa.Table:
        q, place, n = np.unique(np.stack([t.column(c).to_numpy() for c in SPOT], 1), axis=0, return_inverse=True, return_counts=True)
        sums = np.c_[q, np.ones(len(q))] * n[:, None]
        place, modes, of, went = place.ravel(), q, np.arange(len(q)), np.ones(len(q), bool)
        still = went
        for _ in count() if rounds is None else range(rounds):
            to = modes.copy()
            moving = np.flatnonzero(went)  # a mode that stayed once stays
            for rows, met in near(modes[moving], q):
                total = met.astype(float) @ sums
                some = total[:, 4] > 0
                to[moving[rows][some]] = np.round(total[some, :4] / total[some, 4:], digits) + 0.0
            rests = (np.abs(to - modes) < REST * 10.0**-digits).all(1)
            to[rests] = modes[rests]
            went = (to != modes).any(1)
            modes, inverse = np.unique(to, axis=0, return_inverse=True)
            of, still = inverse.ravel()[of], went[of]
            went = np.bincount(inverse.ravel(), went, len(modes)) > 0
            if not went.any():
                break
        m = np.bincount(of, n, len(modes))
        best = np.empty(len(modes), int)
        rank = np.argsort(np.lexsort((np.arange(len(modes)), m)))  # modes are in order of their coordinates
        for rows, met in near(modes, modes):
            best[rows] = np.where(met, rank, -1).argmax(1)
        while (further := best[best]).tolist() != best.tolist():
            best = further
        ends = modes[best[of]][place]
        return pa.Table.from_arrays([*[t.column(c) for c in (*keys, "id")], *[pa.array(ends[:, i].copy()) for i in range(4)], pa.array(~still[place])], names=[*keys, "id", *[f"c{c}" for c in SPOT], "settled"])

    return run


def _by_rounds(given: DataFrame, keys: list[str], width: float, rounds: int | None, digits: int) -> DataFrame:
    """flow_groups of keys, id, q (a struct of SPOT), of groups of any size."""
    given = cut(given)
    places = given.groupBy(*keys, "q").agg(F.count(F.lit(1)).alias("n"))
    path = cut(places.select(*keys, F.col("q").alias("start"), F.col("q").alias("p"), F.lit(True).alias("went")))
    means = [F.round(F.sum(F.col("n") * F.col(f"q.{c}")) / F.sum("n"), digits).alias(c) for c in SPOT]
    rests = reduce(Column.__and__, [F.abs(F.col(f"to.{c}") - F.col(f"p.{c}")) < REST * 10.0**-digits for c in SPOT])
    settled = []
    for _ in count() if rounds is None else range(rounds):
        modes = path.select(*keys, "p").distinct()
        up = _near(modes, places, keys, width).groupBy(*keys, "p").agg(F.struct(*means).alias("to")).select(*keys, "p", F.when(rests, F.col("p")).otherwise(F.col("to")).alias("to"))
        moved = cut(path.join(up, [*keys, "p"]).select(*keys, "start", F.col("to").alias("p"), (F.col("to") != F.col("p")).alias("went")))
        path = moved.filter("went")  # a mode that stayed once stays
        settled.append(moved.filter("not went"))
        if len(settled) == APART:
            settled = [cut(reduce(DataFrame.unionByName, settled).repartition(moved.rdd.getNumPartitions()))]
        if path.isEmpty():
            break
    path = cut(reduce(DataFrame.unionByName, settled, path)).select(*keys, "start", "p", (~F.col("went")).alias("settled"))
    modes = cut(path.join(places.withColumnRenamed("q", "start"), [*keys, "start"]).groupBy(*keys, "p").agg(F.sum("n").alias("n")))
    best = F.max(F.struct("m", "q"))["q"]
    follows = _near(modes.select(*keys, "p"), modes.select(*keys, F.col("p").alias("q"), F.col("n").alias("m")), keys, width)
    top = cut(follows.groupBy(*keys, "p").agg(best.alias("to")))
    while True:
        further = cut(top.join(top.select(*keys, F.col("p").alias("to"), F.col("to").alias("end")), [*keys, "to"]).select(*keys, "p", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("went")))
        moving = not further.filter("went").isEmpty()
        top = further.drop("went")
        if not moving:
            break
    ends = path.join(top, [*keys, "p"]).select(*keys, F.col("start").alias("q"), "to", "settled")
    return given.join(ends, [*keys, "q"]).select(*keys, "id", *[F.col(f"to.{c}").alias(f"c{c}") for c in SPOT], "settled")
