"""Hard-negative mining: segment summaries bound the scores, level by level, before survivors are scored exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import cut
from quadrille.llm.topk import WHOLE_SQL
from quadrille.llm.vectors import AT_ONCE, FOUND, NONE, Best, Block, products, query_blocks, ranked, shards, tiles, whole_vectors

#: Segments that a vector is cut into at each level, coarse to fine.
LEVELS = (1, 4, 16)


def summaries(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the mean and the deviation (root of the summed squares about it) of each row's segments.

    Means carry the root of the segment's length, so the product of two rows' segments is the product of their means,
    plus or minus the product of their deviations at most.
    """
    out, x = [], x.astype(np.float64)
    for parts in LEVELS:
        cuts = np.linspace(0, x.shape[1], min(parts, max(1, x.shape[1])) + 1).astype(int)
        mean, dev = (np.zeros((len(x), len(cuts) - 1)) for _ in range(2))
        for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                m = x[:, a:b].mean(1)
                mean[:, j], dev[:, j] = m * np.sqrt(b - a), np.sqrt(((x[:, a:b] - m[:, None]) ** 2).sum(1))
        out.append((mean, dev))
    return out


def stored_summaries(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.concatenate(level, 1) for level in summaries(x)], 1)


def read_summaries(shard: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    flat, at, out = np.frombuffer(shard.extra, np.float64).reshape(shard.n, -1), 0, []
    for parts in LEVELS:
        w = min(parts, max(1, shard.dims))
        out.append((flat[:, at : at + w], flat[:, at + w : at + 2 * w]))
        at += 2 * w
    return out


def survivors(anchors: list, rows: list, a: np.ndarray, r: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors and rows of which some pair may score between least and most (one of each for an anchor).

    anchors, rows: their summaries by level; a, r: the places to start from. Each finer level looks only at what the
    coarser one left, as whole anchors and whole rows, so each level is two small matrix products.
    """
    for (am, ad), (rm, rd) in zip(anchors, rows, strict=True):
        if not len(a) or not len(r):
            break
        mid, dev = am[a] @ rm[r].T, ad[a] @ rd[r].T
        size = np.sqrt((am[a] ** 2).sum(1) + (ad[a] ** 2).sum(1))[:, None] * np.sqrt((rm[r] ** 2).sum(1) + (rd[r] ** 2).sum(1)).max(initial=0)
        dev += 1e-9 * size + 1e-6  # rounding
        may = (mid + dev >= least[a][:, None]) & (mid - dev <= most[a][:, None])
        a, r = a[may.any(1)], r[may.any(0)]
    return a, r


class Mined:
    """What a task knows of a block of anchors: their summaries, and the best rows of each of `width` score bands."""

    def __init__(self, block: Block, k: int, width: int) -> None:
        self.levels, self.best = summaries(block.x), [Best(block.n, k) for _ in range(width)]


def meet_positives(state: Mined, anchors: Block, shard: Block) -> None:
    best, levels, top = state.best[0], read_summaries(shard), np.full(anchors.n, np.inf)
    for label in np.intersect1d(anchors.labels, shard.labels):
        r = np.flatnonzero(shard.labels == label)
        for a in np.split(of := np.flatnonzero(anchors.labels == label), range(AT_ONCE, len(of), AT_ONCE)):
            a, left = survivors(state.levels, levels, a, r, best.floor().astype(np.float64), top)
            if len(a) and len(left):
                score = products(anchors.x[a], shard.x[left], anchors.most, shard.most)
                best.put(a, score, anchors.keys[a][:, None] != shard.keys[left], shard, left)


def meet_negatives(state: Mined, anchors: Block, shard: Block, low: int, high: int) -> None:
    """Bands of a positive p: from low p to high p, in hundredths; each anchor's largest band floor bounds what it looks at."""
    p = np.frombuffer(anchors.extra, np.float64).reshape(anchors.n, -1)
    known = np.isfinite(p)
    whole = np.where(known, p, 0).astype(np.int64)
    first = np.where(known, -(-low * whole // 100), np.iinfo(np.int64).max)
    last = np.where(known, high * whole // 100, NONE)
    levels, every = read_summaries(shard), np.arange(shard.n)
    for since in range(0, anchors.n, AT_ONCE):
        a = np.arange(since, min(since + AT_ONCE, anchors.n))
        floors = np.stack([np.maximum(first[:, j], b.floor()) for j, b in enumerate(state.best)], 1)
        least, most = np.where(known, floors, np.inf).min(1), np.where(known, last, -np.inf).max(1)
        a, r = survivors(state.levels, levels, a, every, least, most)
        if not len(a) or not len(r):
            continue
        score = products(anchors.x[a], shard.x[r], anchors.most, shard.most)
        other = anchors.labels[a][:, None] != shard.labels[r]
        for j, best in enumerate(state.best):
            best.put(a, score, other & (score >= first[a, j][:, None]) & (score <= last[a, j][:, None]), shard, r)


def hard_negatives(df: DataFrame, asks: Column, label: Column, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows that ask; their positives are the `positives` other rows of the same label with the largest
    scores, the integer inner products of floor(256 x). The negatives of a positive are the k rows of other labels
    with the largest scores among low % to high % of the positive's.

    Larger scores come first, ties by smaller id (null last), then by the earlier row; rows that repeat an id or a
    vector each count. Rows without a label or whose vector is null, or holds a null or non-finite component, take
    no part; vectors meet only those of equal length. A positive with a score below 0 has no negatives (its band is
    empty), one of score 0 those of score 0. Scores saturate at 2^53 in bands. Other columns are not looked at. An
    empty table gives an empty one.
    """
    rows = whole_vectors(df.filter(label.isNotNull()), asks, id_col, vector_col, label)
    index = shards(rows, rows.count(), stored_summaries)
    anchors = cut(rows.filter("asks"))
    alike = tiles(query_blocks(anchors), index, lambda b: Mined(b, positives, 1), meet_positives, lambda s, b: [s.best[0].rows(b)], FOUND)
    found = cut(ranked(alike, ["query_key"], positives))
    scores = found.groupBy("query_key").agg(F.sort_array(F.collect_list(F.struct("rank", F.col("score").cast("double").alias("score")))).alias("p"))  # `positives` at most
    known = F.col("p.score")
    filled = F.concat(known, F.array_repeat(F.lit(float("nan")), F.lit(positives) - F.size(known)))
    asked = cut(anchors.join(scores, anchors["key"] == scores["query_key"]).select("key", "id", "asks", "label", "v", filled.alias("extra")))

    def end(state: Mined, block: Block):
        for j, best in enumerate(state.best):
            yield best.rows(block, {"at": np.full(block.n, j + 1, np.int32)})

    bands = tiles(query_blocks(asked), index, lambda b: Mined(b, k, positives), lambda s, b, x: meet_negatives(s, b, x, low, high), end, FOUND + ", at int")
    mined = ranked(bands, ["query_key", "at"], k).select("query_key", "at", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = found.select("query_key", F.col("rank").alias("at"), F.col("query").alias("anchor_id"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(named, ["query_key", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(e, F.col("vec_id") % 100 == 0, label)


QUERIES = {"op13_segment_negatives": op13_segment_negatives}
ORACLES = {
    "op13_segment_negatives": f"""
WITH e AS (SELECT vec_id, row_number() OVER () AS key, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {WHOLE_SQL} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, a.key, c.vec_id, c.key AS other, a.label = c.label AS alike, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.key <> c.key WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id, other) AS k FROM s WHERE alike),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.key, p.k ORDER BY s.score DESC, s.vec_id, s.other) AS INTEGER) AS rank
  FROM p JOIN s ON s.key = p.key AND NOT s.alike AND 80 * p.score <= 100 * s.score AND s.score <= p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
}
