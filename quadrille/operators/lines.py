"""Line segments of two images: polar form, the rotation between the images, and the pairs that may match."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators.matching import distance

#: Width of a bin of directions, in degrees.
BIN = 20
#: A rotation is accepted if the histograms differ by less than this, by count and by length.
COUNT_LIMIT, LENGTH_LIMIT = 0.49, 0.4


def polar(segments: DataFrame) -> DataFrame:
    """Add theta, rho and length to segments (ax, ay, bx, by): the line is -x sin(theta) + y cos(theta) = rho."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    theta = F.atan2(dy, dx)
    return segments.withColumns({"theta": theta, "rho": -F.col("ax") * F.sin(theta) + F.col("ay") * F.cos(theta), "length": F.sqrt(dx * dx + dy * dy)})


def global_rotation(lines: DataFrame, keys: list[str], side: str = "side", bins: int = 360 // BIN) -> DataFrame:
    """keys, shift, count_diff, length_diff, rotation of the lines (theta, length) of side 0 against those of side 1.

    Histograms of direction by count and by length, each of norm 1, are compared under every circular shift; the
    least difference (the lower shift on a tie) gives the rotation, folded to at most 90 degrees either way, or
    2 pi where the limits don't hold or a side has no lines. One aggregation; a pair's histograms are 4 arrays.
    """
    turn = F.col("theta") + math.pi + math.pi / bins
    turn = F.when(turn < 2 * math.pi, turn).otherwise(turn - 2 * math.pi)
    at = lines.withColumn("__bin", F.floor(turn * bins / (2 * math.pi)))

    def histogram(k: int, of: Column) -> Column:
        return F.array(*[F.sum(F.when((F.col(side) == k) & (F.col("__bin") == b), of).otherwise(0.0)) for b in range(bins)])

    h = at.groupBy(*keys).agg(histogram(0, F.lit(1.0)).alias("c0"), histogram(1, F.lit(1.0)).alias("c1"), histogram(0, F.col("length")).alias("l0"), histogram(1, F.col("length")).alias("l1"))

    def norm(a: Column) -> Column:
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))

    def differences(left: str, right: str) -> Column:
        a, b = F.col(left), F.col(right)
        scale = F.nullif(norm(a) * norm(b), F.lit(0.0))

        def one(s: Column) -> Column:
            dot = F.aggregate(F.sequence(F.lit(0), F.lit(bins - 1)), F.lit(0.0), lambda t, j: t + a[j] * b[(j + s) % bins])
            return F.struct(F.sqrt(F.greatest(F.lit(0.0), F.round(2 - 2 * dot / scale, 9))).alias("d"), s.alias("s"))

        return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), one))

    d = h.withColumns({"c": differences("c0", "c1"), "l": differences("l0", "l1")})
    degrees = F.col("c.s") * (360.0 / bins)
    folded = F.when((degrees > 90) & (360 - degrees > 90), degrees - 180).otherwise(degrees)
    good = (F.col("c.d") < COUNT_LIMIT) & (F.col("l.d") < LENGTH_LIMIT)
    return d.select(*keys, F.col("c.s").alias("shift"), F.col("c.d").alias("count_diff"), F.col("l.d").alias("length_diff"), F.when(good, F.radians(folded)).otherwise(2 * math.pi).alias("rotation"))


def candidate_line_pairs(left: DataFrame, right: DataFrame, keys: list[str], descriptor: float = 0.35, length: float = 4.0, angle: float = 0.7854) -> DataFrame:
    """keys, left_id, right_id, d of lines (line_id, theta, length, descr; left with rotation) that may match.

    They must be near in descriptor, in length relative to the shorter one, and, where the pair has a rotation
    (below 2 pi), in direction after it. Directions meet by bins at least `angle` wide, each with its neighbours;
    left lines of pairs without a rotation go to every bin of their own width.
    """
    bins = max(1, math.floor(2 * math.pi / angle))

    def sector(theta: Column) -> Column:
        return F.least(F.lit(bins - 1), F.floor(F.pmod(theta, F.lit(2 * math.pi)) * bins / (2 * math.pi)).cast("int"))

    turned = F.col("rotation") < 2 * math.pi
    here = sector(F.col("theta") + F.col("rotation"))
    near = F.array_distinct(F.array(*[(here + bins + i) % bins for i in (-1, 0, 1)]))
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    a = left.select(*keys, F.col("line_id").alias("left_id"), F.col("theta").alias("lt"), F.col("length").alias("ll"), F.col("descr").alias("ld"), "rotation", F.explode(F.when(turned, near).otherwise(every)).alias("__bin"))
    b = right.select(*keys, F.col("line_id").alias("right_id"), F.col("theta").alias("rt"), F.col("length").alias("rl"), F.col("descr").alias("rd"), sector(F.col("theta")).alias("__bin"))
    off = F.abs(F.col("lt") + F.col("rotation") - F.col("rt"))
    aligned = ~turned | (F.abs(2 * math.pi - off) <= angle) | (off <= angle)
    sized = F.abs(F.col("ll") - F.col("rl")) <= length * F.least("ll", "rl")
    met = a.join(b, [*keys, "__bin"]).filter(sized & aligned).withColumn("d", distance(F.col("ld"), F.col("rd")))
    return met.filter(F.col("d") <= descriptor).select(*keys, "left_id", "right_id", "d")
