"""SimHash near-dedup: fingerprints of word shingles, and a self-join of their binary trie under a Hamming budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import components, cut, encoded, join_groups, pieces

#: The fingerprint's bits are cut so; of 3 parts, 2 differing bits leave one alike. Each part in turn leads the trie.
PARTS = (22, 21, 21)
#: A node at the end of the leading part with more fingerprints than this is cut further, by so many bits.
HOT_NODE, HOT_BITS = 20_000, 6


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is set if it is set in over half the XXH64 (seed 42) of the shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    return majority(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(shingle)), strict=False)), np.uint64, len(words) - shingle + 1))


def majority(h: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: a bit is set if it is set in over half of them."""
    ones = sum(np.unpackbits(h[i : i + 65536, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for i in range(0, len(h), 65536))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp as a signed long."""

    def run(batches):
        for b in pieces(batches, 8_000_000):
            fps = np.array([fingerprint(t, shingle) for t in encoded(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, fp long")


def trie_links(values: np.ndarray, starts: list[tuple[int, int, int, int, int, int]], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs in `values` within `budget` bits, below the given node pairs.

    values: unsigned 64-bit, sorted within each node; a node is a range of positions whose values share their
    first `depth` bits. starts: (depth, lo, hi, lo2, hi2, differing bits so far). Level by level, all node pairs
    step down together: alike children keep the count, unlike ones add a bit, and pairs over budget or with an
    empty side are dropped. A node paired with itself yields each of its pairs once.
    """
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    given = np.array(starts, np.int64)
    at = np.empty((0, 5), np.int64)
    for depth in range(int(given[:, 0].min()), 64):
        at = np.concatenate([at, given[given[:, 0] == depth, 1:]])
        if not len(at):
            continue
        ones = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        lo, hi, lo2, hi2, diff = at.T
        mid, mid2 = hi - (ones[hi] - ones[lo]), hi2 - (ones[hi2] - ones[lo2])
        own = lo == lo2
        steps = [
            np.stack([lo, mid, lo2, mid2, diff], 1),
            np.stack([mid, hi, mid2, hi2, diff], 1),
            np.stack([lo, mid, mid2, hi2, diff + 1], 1),
            np.stack([mid, hi, lo2, mid2, diff + 1], 1)[~own],
        ]
        at = np.concatenate(steps)
        lo, hi, lo2, hi2, diff = at.T
        at = at[(hi > lo) & (hi2 > lo2) & (diff <= budget) & ~((lo == lo2) & (hi - lo == 1))]
    return at[:, 0], at[:, 2]


def _forest(a: np.ndarray, b: np.ndarray):
    """Those of the links that join two groups not yet joined."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            yield x, y


def _rotated(fp, part: int):
    by = sum(PARTS[:part])
    return fp if not by else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by))


def links(fps: DataFrame, n: int, budget: int = 2) -> DataFrame:
    """(u, v): links that join all of `fps` (distinct fp) within `budget` <= 2 bits into their groups.

    The trie is dealt to tasks at the end of its leading part, once with each part in the lead, since of three
    parts one must be alike. Nodes with more than HOT_NODE fingerprints (and than a thousandth of all) are cut
    HOT_BITS deeper; a fingerprint then joins each pair of such nodes within budget that its own is one of.
    Each task traverses the node pairs it got and passes on a spanning forest of the links found, never all pairs.
    """
    assert budget < len(PARTS)
    legs = [
        F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(_rotated(F.col("fp"), i), 64 - w).alias("node"), _rotated(F.col("fp"), i).alias("value"))
        for i, w in enumerate(PARTS)
    ]
    dealt = fps.select(F.inline(F.array(*legs)))
    sizes = dealt.groupBy("part", "node").agg(F.count(F.lit(1)).alias("c"))
    least = max(HOT_NODE, n // 1000)  # so there are at most 3000 hot nodes
    hot = cut(sizes.filter(F.col("c") > least).select("part", "node", F.lit(True).alias("hot")))
    marked = dealt.join(F.broadcast(hot), ["part", "node"], "left")
    masks = [m for m in range(1 << HOT_BITS) if bin(m).count("1") <= budget]
    width = F.element_at(F.array(*[F.lit(w) for w in PARTS]), F.col("part") + 1)
    below = F.shiftrightunsigned(F.call_function("shiftleft", F.col("value"), width), 64 - HOT_BITS)
    pairs = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.struct(F.least(below, below.bitwiseXOR(m)).alias("a"), F.greatest(below, below.bitwiseXOR(m)).alias("b")))
    whole = F.array(F.struct(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b")))
    met = marked.select("part", "node", "value", F.inline(F.when(F.col("hot"), pairs).otherwise(whole))) if hot.count() else marked.select("part", "node", "value", F.inline(whole))

    def run(batches):
        held: list[pa.RecordBatch] = []
        count = 0

        def flush(t):
            keys = [t.column(c).to_numpy() for c in ("part", "node", "a", "b")]
            values = t.column("value").to_numpy().view(np.uint64)
            new = np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
            ends = np.r_[new[1:], len(values)]
            starts = []
            for lo, hi in zip(new[ends - new > 1].tolist(), ends[ends - new > 1].tolist(), strict=True):
                part, a, b = int(keys[0][lo]), int(keys[2][lo]), int(keys[3][lo])
                if a < 0:
                    starts.append((PARTS[part], lo, hi, lo, hi, 0))
                elif a == b:
                    starts.append((PARTS[part] + HOT_BITS, lo, hi, lo, hi, 0))
                else:
                    side = (values[lo:hi] >> np.uint64(64 - PARTS[part] - HOT_BITS)) & np.uint64((1 << HOT_BITS) - 1)
                    mid = lo + int((side == a).sum())
                    if lo < mid < hi:
                        starts.append((PARTS[part] + HOT_BITS, lo, mid, mid, hi, bin(a ^ b).count("1")))
            x, y = trie_links(values, starts, budget)
            for part in range(len(PARTS)):
                own = keys[0][x] == part
                by = np.uint64(sum(PARTS[:part]))
                back = (values >> by) | (values << (np.uint64(64) - by)) if by else values
                found = list(_forest(back[x[own]], back[y[own]]))
                if found:
                    u, v = (np.array(c, np.uint64).view(np.int64) for c in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:  # sorted by node: whole nodes are joined as soon as enough rows are here
            held.append(batch)
            count += batch.num_rows
            if count < 100_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            last = t.num_rows - 1
            keys = [t.column(c).to_numpy() for c in ("part", "node", "a", "b")]
            differs = np.flatnonzero(np.logical_or.reduce([k != k[last] for k in keys]))
            to = int(differs[-1]) + 1 if len(differs) else 0
            if to:
                yield from flush(t.slice(0, to).combine_chunks())
            held = t.slice(to).to_batches()
            count = t.num_rows - to
        if held and count:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    # unsigned order of `value` within a node: its leading bits are the node's, so only the rest is compared
    tail = F.shiftrightunsigned(F.shiftleft("value", min(PARTS)), min(PARTS))
    keys = ["part", "node", "a", "b"]
    return met.repartition(*keys).sortWithinPartitions(*keys, tail).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, fp, component_id (the least doc_id reachable over links).

    Null and empty texts have fingerprint 0 and so form one group, linked like any other. Equal fingerprints are
    one node of the trie, so copies never make pairs. Null ids count as larger than any. Rows that repeat an id
    stay. Other columns are not looked at. An empty table gives an empty one.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    n = rows.count()
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("size")))
    roots = components(links(fps.select("fp"), n, budget))
    linked = cut(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", "size", "root"))
    inside = linked.filter("root is not null")
    tops = cut(inside.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    met = join_groups(inside, tops, "root", "members", n).select("fp", "size", "component_id")
    classes = cut(met.union(linked.filter("root is null").select("fp", "size", F.col("least").alias("component_id"))))
    return join_groups(rows, classes, "fp", "size", n).select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op6_simhash": op6_simhash}
