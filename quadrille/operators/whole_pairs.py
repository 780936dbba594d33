"""RANSAC of pairs of bounded size, each in one task: the samples, counts and rounds of fitting.ransac without anything between them."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.operators import consensus

#: Points of a pair that one task takes; not more than a run of blocks holds. Points that are scored at a time.
LOCAL, PART = 100_000, 32
#: What an inlier without an error counts for where errors count too.
UNIT = 1_000_000


class Whole(NamedTuple):
    """What a task needs of a model: the models (k x parameters) of samples (n x size x axes) with the sample of each, how
    many a sample gives at most, the parameters of many points (axes x n; None if degenerate), and the type of n."""

    solve: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
    roots: int
    fit: Callable[[np.ndarray], np.ndarray | None]
    n: T.DataType


def _xxhash64(value: np.ndarray, then: int) -> np.ndarray:
    """F.xxhash64 of a long and an int."""
    one, two, three, four, five = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * two
        x = (x ^ (x >> np.uint64(29))) * three
        return x ^ (x >> np.uint64(32))

    with np.errstate(over="ignore"):
        first = (np.uint64(42) + five + np.uint64(8)) ^ (turned(value.astype(np.int64).view(np.uint64) * two, 31) * one)
        seed = mixed(turned(first, 27) * one + four)
        return mixed(turned((seed + five + np.uint64(4)) ^ (np.uint64(then) * one), 23) * two + three).view(np.int64)


def picked_points(h: np.ndarray, n: int, rounds: int, size: int) -> np.ndarray:
    """fitting.picked_points: the places (rounds x size) of rounds h in a pair of n points."""
    taken = np.empty((len(h), 0), np.int64)
    if size > 4:
        for k in range(size):
            at = _xxhash64(h, k) % (n - k)
            for t in np.sort(taken, 1).T:
                at = np.where(t <= at, at + 1, at)
            taken = np.c_[taken, at]
        return taken
    for times, plus in ((7919, 13), (104729, 71), (15485863, 29), (32452843, 53))[:size]:
        at = np.where(h < rounds, (h * times + plus) % n, _xxhash64(h, times) % n)
        for _ in range(taken.shape[1]):
            at = np.where((taken == at[:, None]).any(1), (at + 1) % n, at)
        taken = np.c_[taken, at]
    return taken


def sampled(p: np.ndarray, whole: Whole, h: np.ndarray, rounds: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and the models of rounds h, without those that are degenerate. Points of a sample are in order of their axes."""
    s = p.T[picked_points(h, p.shape[1], rounds, size)]
    h, s = h[good := np.isfinite(s).all((1, 2))], s[good]
    if not len(s):
        return h, np.zeros((0, 0))
    s = np.take_along_axis(s, np.lexsort(np.moveaxis(s, 2, 0)[::-1], axis=-1)[:, :, None], 1)
    m, of = whole.solve(s)
    root = np.arange(len(of)) - np.searchsorted(of, of)
    good = np.isfinite(m).all(1)
    return (whole.roots * h[of] + root)[good], m[good]


def best_of(p: np.ndarray, h: np.ndarray, m: np.ndarray, errors: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: float, known: int, unit: int = 1) -> tuple[int, int, np.ndarray] | None:
    """Inliers, -h and the model that has most, the lowest h on a tie, as consensus.inlier_counts counts; None if known is more."""
    n = np.zeros(len(h), np.int64)
    for since in range(0, p.shape[1], PART):
        part = p[:, since : since + PART]
        with np.errstate(all="ignore"):
            e = errors(m, part)
            n += (e < limit).sum(1) if unit == 1 else np.where(e < limit, unit - unit * e / limit, 0).astype(np.int64).sum(1)
        may = n + unit * (p.shape[1] - since - part.shape[1]) >= max(known, n.max(initial=0))
        if not may.all():
            h, m, n = h[may], m[may], n[may]
    if not len(h):
        return None
    at = np.lexsort((h, -n))[0]
    return int(n[at]), -int(h[at]), m[at]


def in_tasks(blocks: DataFrame, sizes: DataFrame, model, rounds: int, limit: float, confidence: float, most: int, inner: int) -> DataFrame:
    """np, pair_id, h, inliers, n and the model, as fitting.ransac finds them, of the pairs of sizes of up to LOCAL points.

    Points stay in their buckets; a row for each pair leaves them.
    """
    whole, size, names, axes = model.whole, model.size, model.names, model.axes
    met = blocks.join(consensus.each_run(sizes.filter(F.col("np").between(size, LOCAL))), ["pair_id", "run"])
    schema = T.StructType([T.StructField("np", T.LongType()), blocks.schema["pair_id"], T.StructField("h", T.LongType()), T.StructField("inliers", T.LongType()), T.StructField("n", whole.n), *[T.StructField(c, T.DoubleType()) for c in names]])
    kinds = {"np": pa.int64(), "h": pa.int64(), "inliers": pa.int64(), "n": pa.float64() if whole.n == T.DoubleType() else pa.int64()}

    def search(p: np.ndarray) -> tuple[int, int, np.ndarray] | None:
        best, since, until = None, 0, rounds
        while since < until:
            h, m = sampled(p, whole, np.arange(since, until), rounds, size)
            found = best_of(p, h, m, model.errors, limit, best[0] if best else 0) if len(h) else None
            best = max((b for b in (best, found) if b), key=lambda b: b[:2], default=None)
            clean = min(1 - 1e-12, ((best[0] if best else 0) / p.shape[1]) ** size)
            odds = math.log(1 - clean)
            need = math.ceil(math.log(1 - confidence) / odds) if odds else most
            since, until = until, min(need, most, 4 * until)
        if best is None or not inner:
            return best
        number, m = size * most, best[2][None]
        best = active = best_of(p, np.array([-best[1]]), m, model.errors, limit, 0, UNIT)
        while active:
            with np.errstate(all="ignore"):
                own = p[:, model.errors(active[2][None], p)[0] < limit]
            h, m = sampled(own, whole, np.arange(inner), inner, size) if own.shape[1] >= size else ((), ())
            active = best_of(p, h + number, m, model.errors, limit, best[0], UNIT) if len(h) else None
            active = active if active and active[0] > best[0] else None
            best, number = active or best, number + size * inner
        return (*best_of(p, np.array([-best[1]]), best[2][None], model.errors, limit, 0)[:2], best[2])

    def run(t: pa.Table) -> pa.Table:
        rows = np.argsort(t.column("block").to_numpy())
        lists = {c: t.column(c).combine_chunks() for c in axes}
        p = np.stack([np.concatenate([lists[c][int(i)].values.to_numpy(zero_copy_only=False) for i in rows]) for c in axes])
        best, out = search(p), {c: [] for c in ("np", "h", "inliers", "n", *names)}
        if best:
            with np.errstate(all="ignore"):
                kept = p[:, model.errors(best[2][None], p)[0] < limit]
            if kept.shape[1]:
                fit = whole.fit(kept)
                one = (p.shape[1], -best[1], best[0], kept.shape[1], *(fit.tolist() if fit is not None else [None] * len(names)))
                out = {c: [v] for c, v in zip(out, one, strict=True)}
        pair = t.column("pair_id").combine_chunks().slice(0, len(out["h"]))
        return pa.table({"np": pa.array(out["np"], kinds["np"]), "pair_id": pair, **{c: pa.array(v, kinds.get(c, pa.float64())) for c, v in out.items() if c != "np"}})

    return met.select("pair_id", "run", "block", *axes).groupBy("pair_id", "run").applyInArrow(run, schema)
