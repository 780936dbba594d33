"""What several operators share: the shared folder, Bloom bitmaps, joins that survive hot keys, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A bitmap of Spark's bitmap functions has so many bits; a Bloom filter is a table of such blocks.
BLOCK_BITS = 32768
#: Bloom filters stop growing here: 2^30 bits are 32,768 blocks of 4 KB, 128 MB once broadcast.
MAX_BITS = 1 << 30


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a local one only for a local master that sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="spark-")
        shared_dir.own = found
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute now, keep the rows in the shared folder and forget how they were made."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As cut, for large tables: Parquet in the shared folder, so later reads take only their columns."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bloom_bits(n: int) -> int:
    """16 bits for each of n keys, as a power of two between one block and MAX_BITS."""
    return min(MAX_BITS, max(BLOCK_BITS, 1 << max(0, (16 * n - 1).bit_length())))


def _cells(h: Column, bits: int) -> tuple[Column, Column, Column]:
    """The block of a 64-bit hash and its two cells there."""
    block = F.pmod(F.shiftrightunsigned(h, 34), F.lit(bits // BLOCK_BITS)).cast("int")
    return block, h.bitwiseAND(BLOCK_BITS - 1), F.shiftrightunsigned(h, 15).bitwiseAND(BLOCK_BITS - 1)


def bloom(df: DataFrame, h: str, bits: int, repeated: bool = False) -> DataFrame:
    """A blocked Bloom filter of column h as a table (__block, __bitmap) of at most bits / 32768 rows.

    repeated: only cells that at least two rows set are kept, so that what passes is possibly repeated.
    """
    block, one, two = _cells(F.col(h), bits)
    cells = df.select(block.alias("__block"), F.explode(F.array_distinct(F.array(one, two))).alias("cell"))
    if repeated:
        cells = cells.groupBy("__block", "cell").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return cells.groupBy("__block").agg(F.bitmap_construct_agg("cell").alias("__bitmap"))


def probe(df: DataFrame, h: str, filter_: DataFrame, bits: int, out: str) -> DataFrame:
    """Add boolean `out`: whether h may be in the filter. The filter's size is bounded by bits <= MAX_BITS."""
    assert bits <= MAX_BITS
    block, one, two = _cells(F.col(h), bits)

    def is_set(cell: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("__bitmap"), (F.shiftright(cell, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.bit_get(byte, cell.bitwiseAND(7).cast("int")) == 1

    return (
        df.withColumn("__block", block)
        .join(F.broadcast(filter_), "__block", "left")
        .withColumn(out, F.coalesce(is_set(one) & is_set(two), F.lit(False)))
        .drop("__block", "__bitmap")
    )


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns, nulls included; equal for equal rows only."""
    return F.xxhash64(*[x for c in df.columns for x in (F.col(c).isNull(), F.col(c))])


def plain_names(df: DataFrame, *cols: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """df with columns c0, c1, ... that clash with no name of ours, what `cols` are called there, and the way back."""
    names = df.columns
    return df.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(c)}" for c in cols], lambda out: out.toDF(*names)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """Inner join of rows with their group (one row for each key), where a few groups may hold most rows.

    Groups of more than n / 1000 rows number fewer than 1000, so they are broadcast and their rows don't move.
    """
    least = max(1000, n // 1000)
    hot = F.broadcast(groups.filter(F.col(size) > least))
    return rows.join(hot, key).unionByName(
        rows.join(F.broadcast(groups.filter(F.col(size) > least).select(key)), key, "left_anti").join(groups.filter(F.col(size) <= least), key)
    )


#: Links in a partition while components are joined (16 bytes each).
EDGES = 100_000
#: Odd multiplier of rolling hashes over words.
MULTIPLIER = 0x9E3779B97F4A7C15


class WordHash(dict):
    """XXH64 of words (bytes), remembered; forgets all at 250,000 words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pieces(batches, chars: int = 2_000_000, column: str | int = "text"):
    """Cut record batches so that each piece holds about `chars` bytes of the text in column (a name or place), or one row."""
    for batch in batches:
        text = batch.column(column)
        sizes = np.nan_to_num(np.asarray(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=float))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chars, "right")))
            yield batch.slice(at, to - at)
            at = to


def encoded(text: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null as empty."""
    return [x or b"" for x in text.cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Forest(dict):
    """Disjoint groups of numbers: joins tells which of the given pairs join two groups not yet joined."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def joins(self, a, b):
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.find(x), self.find(y)
            if p != q:
                self[max(p, q)] = min(p, q)
                yield x, y

    def labels(self, x: np.ndarray) -> np.ndarray:
        some, inverse = np.unique(x, return_inverse=True)
        return np.fromiter(map(self.find, some.tolist()), np.int64, len(some))[inverse]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have links, root the least node reachable: alternating large and small stars.

    edges: (u, v) of any order. Fewer than EDGES links are joined at once by a forest in one task. More stay
    distributed, EDGES to a partition, and each round is cut to the shared folder.
    """

    def joined(batches):
        groups, ends = Forest(), []
        for b in batches:
            u, v = (b.column(c).to_numpy() for c in ("u", "v"))
            ends.append(np.unique(np.concatenate([u, v])))
            for _ in groups.joins(u, v):
                pass
        if ends:
            node = np.unique(np.concatenate(ends))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(groups.labels(node))], names=["node", "root"])

    def sym(e: DataFrame) -> DataFrame:
        return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = sym(e)
        if large:
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            down = both.filter("v < u")
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return moved.filter("u <> v").coalesce(parts).distinct().coalesce(parts)

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    at = cut(edges.filter("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")))
    parts = at.count() // EDGES + 1
    at = at.coalesce(parts)
    if parts == 1:
        return at.mapInArrow(joined, "node long, root long")
    seen = mark(at)
    while True:
        at = cut(star(star(at, True), False))
        now = mark(at)
        if now == seen:
            break
        seen = now
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
