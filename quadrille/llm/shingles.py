"""Near-dedup by word shingles: SimHash joins what its budget reaches, an exact prefix-filter join all others.

Links are pairs of texts whose sets of shingles have a Jaccard similarity of 0.8 or more, always by their whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm import simhash
from quadrille.llm.common import Forest, WordHash, bloom, bloom_bits, components, cut, encoded, join_groups, pieces, plain_names, probe, row_hash, stored
from quadrille.llm.decontaminate import seed_hashes

#: Texts are alike if the sets of their runs of SHINGLE words have a Jaccard similarity of 4/5 or more.
SHINGLE = 5
#: Common shingles are looked for in so many documents. They go last in every prefix; which ones are found changes no result.
SAMPLE, SEEN, COMMON = 10_000, 3, 200_000
#: A list of rows is broadcast up to so many (about 30 bytes each); a shuffle join takes it beyond.
SMALL = 1_000_000
#: A shingle that more texts share is dealt to pairs of blocks.
BLOCK = 2000
#: Bits of a sketch: each tells whether an odd number of a text's shingles fall to it.
SKETCH = 512


def shingles(text: bytes, known: WordHash) -> np.ndarray:
    """The set of hashes of all runs of SHINGLE words, sorted; a shorter text is one shingle, also if it is empty."""
    words = text.lower().split()
    if not words:
        return np.zeros(1, np.uint64)
    return np.unique(seed_hashes(known.array(words), min(SHINGLE, len(words))))


def common_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in SEEN or more of about SAMPLE documents, at most COMMON, sorted, with their counts."""

    def run(batches):
        known = WordHash()
        for b in pieces(batches):
            for t in encoded(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, known).view(np.int64))], names=["g"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0)
    found = some.mapInArrow(run, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= SEEN)
    rows = found.orderBy(F.desc("c"), "g").limit(COMMON).collect()
    g, c = np.array([r.g for r in rows], np.int64).view(np.uint64), np.array([r.c for r in rows], np.int64)
    order = np.argsort(g)
    return g[order], c[order]


def _least(n, k):
    """The first n - ceil(0.8 n) + k shingles of a text hold at least k of those it shares with any alike text."""
    return n - (4 * n + 4) // 5 + k


def prefixes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, row, n, same, prefix): the set's size and hash, and its first n - ceil(0.8 n) + max(1, n / 10) shingles.

    All sets are in one order, the rarest first as far as `common` tells, so the first max(1, n / 10) shingles that two
    alike texts share (n of the shorter one) stand in both prefixes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        (g, c), known = sent.value, WordHash()
        for b in pieces(batches):
            n, same, first = [], [], []
            for t in encoded(b.column("text")):
                s = shingles(t, known)
                at = np.minimum(np.searchsorted(g, s), max(0, len(g) - 1))
                count = np.where(g[at] == s, c[at], 0) if len(g) else np.zeros(len(s), np.int64)
                n.append(len(s))
                same.append(xxhash.xxh64_intdigest(s.tobytes()))
                first.append(s[np.argsort(count, kind="stable")[: _least(len(s), max(1, len(s) // 10))]].view(np.int64))
            offsets = pa.array(np.r_[0, np.cumsum([len(f) for f in first])].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(first)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n, pa.int32()), pa.array(np.array(same, np.uint64).view(np.int64)), lists], names=["doc_id", "row", "n", "same", "prefix"])

    return docs.mapInArrow(run, "doc_id long, row long, n int, same long, prefix array<long>")


def supported(heads: DataFrame) -> DataFrame:
    """Those of `heads` (n, prefix, at, ...) that can have an alike text: enough of their prefix stands in other prefixes.

    Shingles are counted with partial sums; a Bloom filter of those of two texts or more lets few others move again.
    """
    entries = heads.select("at", F.explode("prefix").alias("g"))
    total = heads.agg(F.sum(F.size("prefix"))).first()[0] or 0
    repeated = cut(entries.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    bits = bloom_bits(repeated.count())
    maybe = probe(entries, "g", cut(bloom(repeated, "g", bits)), bits, "maybe").filter("maybe").select("at", "g")
    shared = join_groups(maybe, repeated, "g", "c", total).groupBy("at").agg(F.count(F.lit(1)).alias("m"))
    least = F.greatest(F.lit(1), F.floor(F.floor((4 * F.col("n") + 4) / 5) / 10))
    return heads.join(shared, "at").filter(F.col("m") >= least).drop("m")


def _entries(heads: DataFrame) -> DataFrame:
    """(g, c, at, n, p, sketch): the places of the prefix shingles that two texts of `heads` or more have."""
    short = F.slice("prefix", 1, F.col("n") - F.floor((4 * F.col("n") + 4) / 5).cast("int") + 1)
    entries = heads.select("at", "n", "sketch", F.posexplode(short).alias("p", "g"))
    met = cut(entries.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    return join_groups(entries, met, "g", "c", met.agg(F.sum("c")).first()[0] or 0)


def _whole(batches, keys: list[str], rows: int):
    """Tables of whole keys, `rows` rows or more each, from batches sorted by keys."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        differs = np.flatnonzero(np.logical_or.reduce([(c := t.column(k).to_numpy()) != c[-1] for k in keys]))
        to = int(differs[-1]) + 1 if len(differs) else 0
        if to:
            yield t.slice(0, to).combine_chunks()
        held = t.slice(to).to_batches()
        count = t.num_rows - to
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _dealt(rows: DataFrame, parts: Column, mine: Column) -> DataFrame:
    """rows once for each pair (a, b) of the `parts` blocks of their key that has their own block `mine`; side: whether it is a."""
    k = F.sequence(F.lit(0), parts - 1)
    return rows.select("*", F.inline(F.transform(k, lambda k: F.struct(F.least(mine, k).alias("a"), F.greatest(mine, k).alias("b"), (mine <= k).alias("side")))))


def clusters(heads: DataFrame) -> DataFrame:
    """(node, root): those of `heads` (at, n, prefix, sketch) that may be alike to others, by clusters; texts of different
    clusters, or that aren't here, are not alike.

    Texts that share a prefix shingle at places p and q can't share more than min(p, q) before it and the shorter
    rest from there on; and they differ in as many shingles, at least, as their sketches in bits. Tasks pass on
    forests of what these bounds let stand, never pairs. A shingle of more than BLOCK texts is dealt by blocks.
    """

    def run(batches):
        groups = Forest()
        for t in _whole(batches, ["g", "a", "b"], 50_000):
            g, a, b, side, n, p, text = (t.column(c).to_numpy(zero_copy_only=False) for c in ("g", "a", "b", "side", "n", "p", "at"))
            n, p = n.astype(np.int64), p.astype(np.int64)
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(g), -1)
            at, found = groups.labels(text), []
            i, d = np.arange(len(g)), 0
            while len(i):
                d += 1
                i = i[i + d < len(g)]
                i = i[(g[i] == g[i + d]) & (a[i] == a[i + d]) & (b[i] == b[i + d]) & (5 * n[i] >= 4 * n[i + d])]  # by size within a shingle: what fails once fails from here on
                x = i[(at[i] != at[i + d]) & ((a[i] == b[i]) | (side[i] != side[i + d]))]
                x = x[9 * (np.minimum(p[x], p[x + d]) + np.minimum(n[x] - p[x], n[x + d] - p[x + d])) >= 4 * (n[x] + n[x + d])]
                x = x[9 * np.bitwise_count(sketch[x] ^ sketch[x + d]).sum(1, dtype=np.int64) <= n[x] + n[x + d]]
                if len(x):
                    found += groups.joins(text[x], text[x + d])
                    if d < 8 or d % 16 == 0:
                        at = groups.labels(text)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    entries = _entries(heads)
    parts = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = _dealt(entries, parts, F.pmod(F.xxhash64("at"), parts).cast("int")).select("g", "a", "b", "side", "n", "p", "at", "sketch")
    return components(dealt.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "n").mapInArrow(run, "u long, v long"))


def joined(sets: list[np.ndarray], block: np.ndarray | None, group: np.ndarray | None = None):
    """Places (i, j) of links of 0.8 or more that join all such pairs of `sets` (by size) of different blocks, if given.

    group: sets of one group are joined already, and are not compared.
    """
    size = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(ids.max() + 1, np.int64)
    rank[np.argsort(np.bincount(ids), kind="stable")] = np.arange(len(rank))
    sets = [np.sort(x) for x in np.split(rank[ids], np.cumsum(size)[:-1])]
    short = size - (4 * size + 4) // 5 + 1
    owner, first = np.repeat(np.arange(len(sets)), short), np.concatenate([s[:k] for s, k in zip(sets, short, strict=True)])
    order = np.argsort(first, kind="stable")
    owner, lists = owner[order], np.searchsorted(first[order], np.arange(len(rank) + 1))
    mark, at = np.zeros(len(rank), bool), np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]
    for j, s in enumerate(sets):
        met = np.unique(np.concatenate([owner[lists[r] : lists[r + 1]] for r in s[: short[j]].tolist()]))
        met = met[(met < j) & (at[met] != at[j]) & (5 * size[met] >= 4 * size[j])]
        if block is not None:
            met = met[block[met] != block[j]]
        if not len(met):
            continue
        mark[s] = True
        both = np.add.reduceat(mark[np.concatenate([sets[i] for i in met.tolist()])], np.r_[0, np.cumsum(size[met])[:-1]], dtype=np.int64)
        mark[s] = False
        for i in met[9 * both >= 4 * (size[met] + size[j])].tolist():
            if at[i] != at[j]:
                yield i, j
                at[at == at[i]] = at[j]


def completed(sets: DataFrame, roots: DataFrame, groups: DataFrame) -> DataFrame:
    """(u, v): links of 0.8 or more that join all of `sets` (at, n, s) that are alike, within their clusters.

    groups: (node, root) of those that links have joined before. They are not compared again, and clusters of a single
    group don't move.

    A cluster's sets meet in one task; one of more than BLOCK / 4 texts or a million shingles is dealt to pairs of
    blocks, each of which joins what is alike across it. Tasks pass on forests, never all pairs.
    """

    def run(batches):
        for t in _whole(batches, ["cluster", "a", "b"], 1):
            keys = np.stack([t.column(c).to_numpy() for c in ("cluster", "a", "b")])
            new = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, t.num_rows].tolist()
            for lo, hi in zip(new, new[1:], strict=False):
                part = t.slice(lo, hi - lo)
                at, side = (part.column(c).to_numpy(zero_copy_only=False) for c in ("at", "side"))
                lists = [x.values.to_numpy() for x in part.column("s").combine_chunks()]
                found = list(joined(lists, None if keys[1, lo] == keys[2, lo] else side, part.column("group").to_numpy()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(at[list(c)]) for c in zip(*found, strict=True)], names=["u", "v"])

    inside = sets.select("at", "n").join(roots.select(F.col("node").alias("at"), F.col("root").alias("cluster")), "at")
    inside = cut(inside.join(groups.select(F.col("node").alias("at"), F.col("root").alias("group")), "at", "left").withColumn("group", F.coalesce("group", "at")))
    sizes = cut(inside.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) * 4 / BLOCK), F.ceil(F.sum("n") / 1e6)).cast("int").alias("parts"), F.count(F.lit(1)).alias("c"), (F.min("group") < F.max("group")).alias("apart")).filter("apart").drop("apart"))
    rows = join_groups(inside, sizes, "cluster", "c", sizes.agg(F.sum("c")).first()[0] or 0).join(sets.select("at", "s"), "at")
    dealt = _dealt(rows, F.col("parts"), F.pmod(F.xxhash64("at"), "parts").cast("int")).select("cluster", "a", "b", "side", "at", "n", "group", "s")
    keys = ["cluster", "a", "b"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "n", "at").mapInArrow(run, "u long, v long")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (u, v) whose whole sets (at, s) have a similarity of 0.8 or more."""
    both = pairs.join(sets.select(F.col("at").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("at").alias("v"), F.col("s").alias("b")), "v")
    return both.filter(9 * F.size(F.array_intersect("a", "b")) >= 4 * (F.size("a") + F.size("b"))).select("u", "v")


def near_fingerprints(sets: DataFrame, n: int) -> DataFrame:
    """(u, v): texts whose SimHash of the same shingles is equal, as a star, or linked by the trie self-join."""

    def run(batches):
        for b in batches:
            fps = [simhash.majority(np.asarray(s, np.int64).view(np.uint64)) for s in b.column("s").to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["at", "fp"])

    rows = cut(sets.mapInArrow(run, "at long, fp long"))
    least = cut(rows.groupBy("fp").agg(F.min("at").alias("u")))
    equal = rows.join(least, "fp").select("u", F.col("at").alias("v"))
    near = simhash.links(least.select("fp"), n).select("u", "v")
    for k in "uv":
        near = near.join(least.select(F.col("fp").alias(k), F.col("u").alias(f"at_{k}")), k)
    near = near.select(F.least("at_u", "at_v").alias("u"), F.greatest("at_u", "at_v").alias("v"))
    return equal.filter("u <> v").union(near).distinct()


def links(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(u, v): links that join all of `heads` (doc_id, row, at, n, prefix) with a similarity of 0.8 or more into their groups.

    SimHash links come first, each checked by the whole sets. No bit budget reaches all pairs of 0.8, so exact
    bounds deal the texts to clusters, and tasks join the groups that SimHash has left apart in each cluster, by their
    whole sets; all pairs of a group are never made.
    """
    heads = stored(supported(heads))
    few = heads.count()
    ids = heads.select(F.col("doc_id").alias("id"), F.col("row").alias("r"), "at")
    ids = F.broadcast(ids) if few <= SMALL else ids

    def run(batches):
        known = WordHash()
        for b in pieces(batches):
            sets = [shingles(t, known) for t in encoded(b.column("text"))]
            sketches = [np.packbits(np.bincount((s >> np.uint64(40)) % np.uint64(SKETCH), minlength=SKETCH) & 1).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("at"), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["at", "n", "s", "sketch"])

    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]) & (docs["row"] == ids["r"])).select("at", "text")
    sets = stored(texts.mapInArrow(run, "at long, n int, s array<long>, sketch binary"))
    if sets.count() > few:  # equal rows have one head
        sets = stored(sets.dropDuplicates(["at"]))
    near = cut(alike(near_fingerprints(sets, few), sets))
    return near.union(completed(sets, clusters(heads.join(sets.select("at", "sketch"), "at")), components(near)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the least id, null last, then the least row hash.

    Rows are alike if their texts' sets of 5-word shingles (ASCII letters in lower case) have a Jaccard similarity
    of 0.8 or more; groups are what links reach. Texts without words are alike. Rows that repeat an id are told
    apart by a hash of all columns, so one of them may go and another stay; of equal rows one stays. Columns of any
    name are kept. An empty table gives an empty one.
    """
    docs, (id_col, text_col), given = plain_names(docs, id_col, text_col)
    keyed = docs.withColumn("__row", row_hash(docs))
    chosen = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("row"), F.col(text_col).alias("text"))
    rows = stored(prefixes(chosen, common_shingles(chosen, docs.count())).withColumn("at", F.monotonically_increasing_id()))
    mine = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row", "at")
    classes = cut(rows.groupBy("same", "n").agg(F.min(mine).alias("head"), F.count(F.lit(1)).alias("c")))
    copies = cut(rows.select("same", "n", "doc_id", "row", "at").join(classes.filter("c > 1"), ["same", "n"]).select("at", "doc_id", "row", F.col("head.at").alias("head")))
    extra = cut(copies.filter("at <> head").select("at"))
    heads = rows.join(F.broadcast(extra) if extra.count() <= SMALL else extra, "at", "left_anti")
    roots = components(links(chosen, heads))
    inside = cut(heads.select("at", "doc_id", "row").join(roots, F.col("at") == F.col("node")))
    kept = inside.groupBy("root").agg(F.min(mine)["at"].alias("at"))
    key = ("at", F.col("doc_id").alias("__id"), F.col("row").alias("__r"))
    gone = cut(inside.join(kept, "at", "left_anti").select(*key).union(copies.filter("at <> head").select(*key)))
    # a key that is gone and stays is one of equal rows
    stay = copies.filter("at = head").join(gone.select("at"), "at", "left_anti")
    gone = cut(gone.drop("at").distinct())
    twice = cut(gone.join(stay, gone["__id"].eqNullSafe(stay["doc_id"]) & (gone["__r"] == stay["row"]), "left_semi"))

    def held(df: DataFrame, by: DataFrame, how: str) -> DataFrame:
        by = F.broadcast(by) if by.count() <= SMALL else by
        return df.join(by, df[id_col].eqNullSafe(by["__id"]) & (df["__row"] == by["__r"]), how)

    left = held(keyed, gone, "left_anti")
    if twice.count():
        left = left.union(held(keyed, twice, "left_semi").dropDuplicates([id_col, "__row"]))
    return given(left.drop("__row"))
