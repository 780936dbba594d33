"""Blocks of vectors: shards of bounded size, tiles of query blocks and shards, and the exact best of whole-number products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import cut, stored

#: Rows of a shard at most, and about the rows that a shard is made for; queries of a block; shards of a run.
SHARD, AIM, QUERIES, RUN = 4096, 3000, 2048, 32
#: Queries that are scored at once.
AT_ONCE = 512
BLOCK = "block long, dims int, n int, keys binary, ids binary, flags binary, labels binary, extra binary, matrix binary"
#: Flags of a row: its id is null; it asks.
NULL, ASKS = 1, 2
NONE = np.iinfo(np.int64).min


def whole_vectors(df: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(key, id, asks, label, v), written to the shared folder: v is floor(256 x) of each component, as double.

    key numbers the rows, so rows that repeat an id stay apart. Vectors that are null or hold a null or non-finite
    component are left out; components saturate at 63 bits. asks: a condition over the columns of df.
    """
    v = F.col(vector_col)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    kept = df.filter(v.isNotNull() & whole)
    floor = F.transform(v, lambda x: F.floor(256 * x.cast("double")).cast("double"))
    return stored(kept.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), (F.lit(0) if label is None else label).cast("long").alias("label"), floor.alias("v")))


def _row(block: int, dims: int, t: pa.Table, extra: Callable[[np.ndarray], np.ndarray] | None) -> dict:
    flat = pa.concat_arrays([c.flatten() for c in t.column("v").chunks]) if t.num_rows else pa.array([], pa.float64())
    x = np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(t.num_rows, dims)
    ids = t.column("id")
    flags = NULL * np.asarray(ids.is_null()).astype(np.uint8) + ASKS * np.asarray(t.column("asks")).astype(np.uint8)
    kind = np.float32 if np.abs(x).max(initial=0) < 1 << 24 else np.float64
    more = extra(x).tobytes() if extra else np.array(t.column("extra").to_pylist(), dtype=np.float64).tobytes() if "extra" in t.column_names else b""
    whole = lambda c: np.asarray(t.column(c).fill_null(0), dtype=np.int64).tobytes()
    return {"block": block, "dims": dims, "n": t.num_rows, "keys": whole("key"), "ids": whole("id"), "flags": flags.astype(np.uint8).tobytes(), "labels": whole("label"), "extra": more, "matrix": x.astype(kind).tobytes()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
    names = [c.split()[0] for c in BLOCK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds, strict=True)], names=names)


def shards(rows: DataFrame, n: int, extra: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows of BLOCK: up to SHARD rows of equal length each, ordered by label, with what `extra` makes of their matrix.

    Rows are ranged by length, label and a hash, so a hot label or vector spreads evenly over the shards.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seq, part = [], 0, 0, TaskContext.get().partitionId() << 20

        def flush(all_of_it: bool):
            nonlocal held, count, seq
            t = pa.Table.from_batches(held).combine_chunks()
            dims = np.asarray(t.column("dims"))
            at = 0
            while at < len(dims):
                to = min(at + SHARD, int(np.searchsorted(dims, dims[at], "right")))
                if to == len(dims) and to - at < SHARD and not all_of_it:
                    break
                yield _batch([_row(part + seq, int(dims[at]), t.slice(at, to - at), extra)])
                seq, at = seq + 1, to
            held = t.slice(at).to_batches()
            count = len(dims) - at

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count > SHARD:
                yield from flush(False)
        if count:
            yield from flush(True)

    keyed = rows.withColumns({"dims": F.size("v"), "h": F.xxhash64("key")})
    dealt = keyed.repartitionByRange(max(1, -(-n // AIM)), "dims", "label", "h").sortWithinPartitions("dims", "label", "h")
    return stored(dealt.mapInArrow(pack, BLOCK))


def query_blocks(queries: DataFrame) -> DataFrame:
    """Rows of BLOCK: queries (key, id, asks, label, v, maybe extra: equally long arrays of double) in even blocks."""
    n = queries.count()
    parts = max(1, -(-n // QUERIES))

    def pack(t: pa.Table) -> pa.Table:
        dims = np.asarray(pc.list_value_length(t.column("v")))
        rows = [_row(int(t.column("block")[0].as_py()), int(d), t.take(np.flatnonzero(dims == d)), None) for d in np.unique(dims)]
        return pa.Table.from_batches([_batch(rows)])

    return cut(queries.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("block").applyInArrow(pack, BLOCK))


class Block:
    """A block's arrays, as a task holds them."""

    def __init__(self, row: dict) -> None:
        self.n, self.dims, self.extra = row["n"], row["dims"], row["extra"]
        self.keys, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("keys", "ids", "labels"))
        flags = np.frombuffer(row["flags"], np.uint8)
        self.null, self.asks = flags & NULL > 0, flags & ASKS > 0
        size = len(row["matrix"]) // max(1, self.n * self.dims)
        self.x = np.frombuffer(row["matrix"], np.float32 if size == 4 else np.float64).reshape(self.n, self.dims)
        self.most = float(np.abs(self.x).max(initial=0))
        #: Place of each row in the order of ids (null last), then of keys.
        self.rank = np.empty(self.n, np.int64)
        self.rank[np.lexsort((self.keys, self.ids, self.null))] = np.arange(self.n)

    def part(self, rows: np.ndarray) -> "Block":
        out = object.__new__(Block)
        out.__dict__ |= self.__dict__ | {c: getattr(self, c)[rows] for c in ("keys", "ids", "labels", "null", "asks", "x", "rank")} | {"n": len(rows)}
        return out


def products(a: np.ndarray, b: np.ndarray, most_a: float, most_b: float) -> np.ndarray:
    """Exact inner products of whole numbers as int64; beyond 63 bits they saturate."""
    bound = most_a * most_b * max(1, a.shape[1])
    if bound < 1 << 24:
        return (a.astype(np.float32, copy=False) @ b.T.astype(np.float32, copy=False)).astype(np.int64)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    whole = [[int(v) for v in r] for r in b.tolist()]
    limit = (1 << 63) - 1
    return np.array([[max(-limit, min(limit, sum(x * y for x, y in zip(q, r, strict=True)))) for r in whole] for q in ([int(v) for v in r] for r in a.tolist())], np.int64).reshape(len(a), len(b))


class Best:
    """The k best rows of each of m queries so far: larger scores first, then smaller ids, null ids last."""

    def __init__(self, m: int, k: int) -> None:
        self.k = k
        self.score, self.id, self.key = (np.full((m, k), NONE, np.int64) for _ in range(3))
        self.null = np.ones((m, k), bool)
        #: A score that k rows are known to reach.
        self.least = np.full(m, NONE, np.int64)

    def floor(self) -> np.ndarray:
        """What a row's score must reach to be among the best."""
        return np.maximum(self.score[:, -1], self.least)

    def put(self, queries: np.ndarray, score: np.ndarray, ok: np.ndarray, shard: Block, rows: np.ndarray) -> None:
        """Merge the scores (queries x rows) that are ok. rows: places in the shard."""
        hit = (ok & (score >= self.floor()[queries][:, None])).any(1)
        if not hit.any():
            return
        queries, score, ok = queries[hit], score[hit], ok[hit]
        rank, n, k = shard.rank[rows], int(shard.rank.max(initial=0)) + 1, min(self.k, len(rows))
        if np.abs(score).max() < (1 << 62) // n:
            order = np.where(ok, score * n + (n - 1 - rank), NONE)
            at = np.argpartition(order, len(rows) - k, axis=1)[:, len(rows) - k :]
        else:
            at = np.array([np.lexsort((rank, -s, ~o))[:k] for s, o in zip(score, ok, strict=True)])
        good = np.take_along_axis(ok, at, 1)
        place = rows[at]
        new = [np.where(good, np.take_along_axis(score, at, 1), NONE), np.where(good, shard.null[place], True), np.where(good, shard.ids[place], NONE), np.where(good, shard.keys[place], NONE)]
        both = [np.concatenate([old[queries], x], 1) for old, x in zip((self.score, self.null, self.id, self.key), new, strict=True)]
        by = np.lexsort((both[3], both[2], both[1], -np.maximum(both[0], NONE + 1), both[3] == NONE), axis=1)[:, : self.k]
        for old, x in zip((self.score, self.null, self.id, self.key), both, strict=True):
            old[queries] = np.take_along_axis(x, by, 1)

    def rows(self, queries: Block, more: dict[str, np.ndarray] | None = None) -> pa.RecordBatch:
        """query_key, query, id, key, score and the columns of more, one row for each query and find."""
        q, j = np.nonzero(self.key != NONE)
        ids = pa.array(self.id[q, j], mask=self.null[q, j])
        asked = pa.array(queries.ids[q], mask=queries.null[q])
        cols = {"query_key": pa.array(queries.keys[q]), "query": asked, "id": ids, "key": pa.array(self.key[q, j]), "score": pa.array(self.score[q, j])} | {c: pa.array(x[q]) for c, x in (more or {}).items()}
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


FOUND = "query_key long, query long, id long, key long, score long"


def tiles(queries: DataFrame, shard_rows: DataFrame, begin: Callable, meet: Callable, end: Callable, schema: str) -> DataFrame:
    """Every block of queries meets every shard once, in tiles of one block and a run of shards.

    A tile is one sorted run of rows, the block first, so a task holds one block, its state and one shard. The state
    goes from shard to shard of the run. begin(block) -> state; meet(state, block, shard) changes it; end(state,
    block) -> record batches of schema. What moves is blocks x runs and shards x blocks, not pairs of rows.
    """
    parts = (shard_rows.agg(F.max(F.shiftright("block", 20))).first()[0] or 0) + 1
    blocks = (queries.agg(F.max("block")).first()[0] or 0) + 1
    length = max(1, min(RUN, int(parts) // 64))
    runs = -(-int(parts) // length)
    rest = [c.split()[0] for c in BLOCK.split(", ")[1:]]
    asks = queries.select(F.col("block").alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("block"), *rest)
    held = shard_rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("tile"), F.floor(F.shiftright("block", 20) / length).cast("int").alias("run"), F.lit(1).alias("side"), "block", *rest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, open_ = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if tile != (row["tile"], row["run"]):
                    for block, state in open_:
                        yield from end(state, block)
                    tile, open_ = (row["tile"], row["run"]), []
                one = Block(row)
                if row["side"] == 0:
                    open_.append((one, begin(one)))
                else:
                    for block, state in open_:
                        if block.dims == one.dims:
                            meet(state, block, one)
        for block, state in open_:
            yield from end(state, block)

    both = asks.union(held).repartition(min(100_000, blocks * runs), "tile", "run").sortWithinPartitions("tile", "run", "side", "block")
    return both.mapInArrow(work, schema)


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of each group of keys, with rank from 1; every task picks its own k before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
