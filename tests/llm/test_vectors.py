"""Top-k search and hard negatives against brute force, with nulls, ties, repeated rows, odd vectors and empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.llm import negatives, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, score int, rank int, dims int, h int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    centre = [[r.gauss(0, 0.4) for _ in range(12)] for _ in range(4)]
    out = [(i, [round(c + r.gauss(0, 0.15), 2) for c in centre[i % 4]], r.choice((0, 0, 0, 1, 2, None)), "x", 1, 1, 1, 1) for i in range(400)]
    out += [(400 + i, out[0][1], 0, "x", 1, 1, 1, 1) for i in range(20)]  # equal vectors, ties
    out += [out[50], out[100], (None, out[3][1], 1, "x", 1, 1, 1, 1), (None, out[4][1], 0, None, None, None, None, None)]
    out += [(500, None, 0, "x", 1, 1, 1, 1), (600, [1.0, None, 2.0], 0, "x", 1, 1, 1, 1), (700, [math.inf] * 12, 1, "x", 1, 1, 1, 1), (800, [math.nan] * 12, 1, "x", 1, 1, 1, 1)]
    out += [(900, [0.5, 0.25], 0, "x", 1, 1, 1, 1), (901, [0.5, 0.5], 1, "x", 1, 1, 1, 1), (902, [-0.5, 0.25], 0, "x", 1, 1, 1, 1), (1000, [], 0, "x", 1, 1, 1, 1), (1001, [], 0, "x", 1, 1, 1, 1)]
    return [*out, (-100, out[9][1], 2, "x", 1, 1, 1, 1), (1100, [0.0] * 12, 0, "x", 1, 1, 1, 1)]


def scored(rows):
    """(query row, other row, score) of the rows that take part; both as (place, id, label)."""
    f = np.float32
    kept = [(k, x[0], x[2], [math.floor(256 * float(f(c))) for c in x[1]]) for k, x in enumerate(rows) if x[1] is not None and all(c is not None and math.isfinite(c) for c in x[1])]
    for q in kept:
        for o in kept:
            if q[0] != o[0] and len(q[3]) == len(o[3]):
                yield q[:3], o[:3], sum(a * b for a, b in zip(q[3], o[3], strict=True))


def order(found):
    return sorted(found, key=lambda x: (-x[1], x[0][1] is None, x[0][1] or 0, x[0][0]))


def test_top_k(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 64)
    monkeypatch.setattr(vectors, "AIM", 50)
    monkeypatch.setattr(vectors, "QUERIES", 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = {}
    for q, o, s in scored(rows):
        if q[1] is not None and q[1] % 50 == 0:
            want.setdefault(q, []).append((o, s))
    want = sorted(str((q[1], k + 1, o[1], s)) for q, found in want.items() for k, (o, s) in enumerate(order(found)[:5]))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(str(tuple(x)) for x in got.collect()) == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") == 1000).collect() == [(1000, 1, 1001, 0)]  # fewer than k others


def test_large_components(spark):
    rows = [(i, [1e9 * (i - 3), 3e8, float(i)]) for i in range(8)] + [(8, [1e300, 1.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 2).collect()
    whole = [[math.floor(256 * c) for c in v] for _, v in rows[:8]]
    limit = (1 << 63) - 1
    want = sorted(((max(-limit, min(limit, sum(a * b for a, b in zip(whole[0], w, strict=True)))), k) for k, w in enumerate(whole) if k), key=lambda x: (-x[0], x[1]))[:2]
    assert [(x.score, x.vec_id) for x in got] == want


def test_threshold_stops_early():
    """Few large components: the lists' heads hold the answer, so most rows are never scored."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.pareto(1.2, (3000, 6)) / 20)
    row = {"n": 3000, "dims": 6, "keys": np.arange(3000).tobytes(), "ids": np.arange(3000).tobytes(), "flags": bytes(3000), "labels": bytes(24000), "extra": topk.sorted_lists(x).tobytes(), "matrix": x.tobytes()}
    shard = vectors.Block(row)
    asked = shard.part(np.arange(0, 3000, 100))
    best = vectors.Best(asked.n, 5)
    scored_ = topk.threshold_search(asked, shard, best)
    full = x[::100] @ x.T
    full[np.arange(30), np.arange(0, 3000, 100)] = -1
    assert (best.score == -np.sort(-full, axis=1)[:, :5]).all() and scored_ < 30 * 3000 / 10


def test_segment_bounds_hold():
    rng = np.random.default_rng(4)
    for dims in (1, 3, 16, 37):
        x = np.floor(rng.normal(2, 40, (50, dims)))
        for mean, dev in negatives.summaries(x):
            off = dev @ dev.T + 1e-6
            assert (np.abs(mean @ mean.T - x @ x.T) <= off).all()


def test_hard_negatives(spark, rows, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 64)
    monkeypatch.setattr(vectors, "AIM", 50)
    monkeypatch.setattr(vectors, "QUERIES", 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    by = {}
    for q, o, s in scored([x if x[2] is not None else (x[0], None, *x[2:]) for x in rows]):
        if q[1] is not None and q[1] % 20 == 0:
            by.setdefault(q, []).append((o, s))
    want = []
    for q, found in by.items():
        for p, ps in order([x for x in found if x[0][2] == q[2]])[:5]:
            band = [x for x in found if x[0][2] != q[2] and 80 * ps <= 100 * x[1] <= 100 * ps]
            want += [str((q[1], p[1], k + 1, o[1], ps, s)) for k, (o, s) in enumerate(order(band)[:5])]
    got = negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, F.col("label"))
    assert sorted(str(tuple(x)) for x in got.collect()) == sorted(want) and len(want) > 100
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 20 == 0, F.col("label")).count() == 0
