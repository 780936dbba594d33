"""Exact top-k search: Fagin's threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import cut
from quadrille.llm.vectors import AT_ONCE, FOUND, NONE, Best, Block, products, query_blocks, ranked, shards, tiles, whole_vectors

#: Entries that are first read from each end of each list; every next step reads on to four times as deep.
STEP = 4


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """For each dimension the places of a shard's rows in ascending order of their component."""
    return np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)


def threshold_search(queries: Block, shard: Block, best: Best) -> int:
    """Merge a shard's best rows into `best`; returns how many scores were computed.

    A query reads a dimension's list from its upper end if its component there is positive, else from its lower
    end; rows that come up for the first time are scored at once, all components together. No row that has not
    come up exceeds the threshold, the query's product with the next unread entries. Once that is below the kth
    score, which may come from an earlier shard, the query stops; at equality it reads on, as the smaller id wins.
    """
    order, n, dims, scored = np.frombuffer(shard.extra, np.uint16).reshape(shard.dims, shard.n), shard.n, np.arange(shard.dims), 0
    slack = queries.most * shard.most * queries.dims
    slack = slack * 1e-12 if slack >= 1 << 53 else 0
    for since in range(0, queries.n, AT_ONCE):
        at = np.arange(since, min(since + AT_ONCE, queries.n))
        q = queries.x[at].astype(np.float64)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        seen, depth = np.zeros(n, bool), 0
        while not seen.all():
            high, low = (shard.x[order[:, k], dims].astype(np.float64) for k in (n - 1 - depth, depth))
            goes_on = up @ high + down @ low + slack >= best.floor()[at]
            at, up, down = at[goes_on], up[goes_on], down[goes_on]
            if not len(at):
                break
            to = min(n, max(STEP, 4 * depth))
            came = np.zeros(n, bool)
            came[order[up.any(0), n - to : n - depth]] = True
            came[order[down.any(0), depth:to]] = True
            if 2 * to >= n:
                came[:] = True  # both ends have met
            rows = np.flatnonzero(came & ~seen)
            seen |= came
            depth = min(to, n - 1)
            if len(rows):
                score = products(queries.x[at], shard.x[rows], queries.most, shard.most)
                scored += score.size
                best.put(at, score, queries.keys[at][:, None] != shard.keys[rows], shard, rows)
    return scored


def top_k(df: DataFrame, asks: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of df that asks, the k other rows of the largest inner product.

    Products are of floor(256 x) and exact. The sorted lists are cut by rows into shards. Each query first searches
    the shard it stands in, and takes the kth score found there along to all other shards, as what their thresholds
    have to beat.

    Ties go to the smaller id, null ids last, then to the earlier row. Rows that repeat an id are rows of their
    own, as are equal vectors. Vectors that are null, or hold a null or non-finite component, take no part; vectors
    meet only those of equal length. A query with fewer than k others gets them all. Scores saturate at 63 bits.
    Other columns are not looked at. An empty table gives an empty one.
    """
    rows = whole_vectors(df, asks, id_col, vector_col)
    lists = shards(rows, rows.count(), sorted_lists)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Block(batch.slice(i, 1).to_pylist()[0])
                asked = shard.part(np.flatnonzero(shard.asks))
                best = Best(asked.n, k)
                threshold_search(asked, shard, best)
                floor = best.floor().astype(np.float64)
                cols = [pa.array(asked.keys), pa.array(asked.ids, mask=asked.null), pa.array(np.ones(asked.n, bool)), pa.array(asked.labels), pa.array(asked.x.astype(np.float64).tolist(), pa.list_(pa.float64())), pa.array(floor[:, None].tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "id", "asks", "label", "v", "extra"])

    queries = query_blocks(cut(lists.mapInArrow(own, "key long, id long, asks boolean, label long, v array<double>, extra array<double>")))

    def begin(block: Block) -> Best:
        best = Best(block.n, k)
        floor = np.frombuffer(block.extra, np.float64)  # beyond 53 bits it may be rounded up, so it gives way
        best.least = np.where(np.abs(floor) < 1 << 53, floor, np.maximum(floor - np.abs(floor) * 1e-15, float(NONE))).astype(np.int64)
        return best

    found = tiles(queries, lists, begin, lambda best, block, shard: threshold_search(block, shard, best), lambda best, block: [best.rows(block)], FOUND)
    return ranked(found, ["query_key"], k).select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def op11_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


#: Vectors with whole, finite components only.
WHOLE_SQL = """[floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0"""
QUERIES = {"op11_threshold_topk": op11_threshold_topk}
ORACLES = {
    "op11_threshold_topk": f"""
WITH e AS (SELECT vec_id, row_number() OVER () AS key, {WHOLE_SQL}),
s AS (SELECT q.vec_id AS query_id, q.key, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score, c.key AS other
  FROM e q JOIN e c ON q.key <> c.key WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id, other) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
