"""Merkle dataset manifest: aligned builders append a tree's nodes in postorder; closed-form positions give the proofs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import cut, stored

#: Children of a node, levels that one builder adds, and so the leaves of an aligned builder.
FANOUT, LEVELS = 16, 3
ALIGNED = FANOUT**LEVELS
#: Offsets of sorted parts are broadcast up to so many rows.
SMALL = 100_000


def sizes(leaves: int, height: int) -> list[int]:
    """Nodes of each level of a tree over so many leaves."""
    out = [leaves]
    for _ in range(height):
        out.append(-(-out[-1] // FANOUT))
    return out


def position(level: int, j: int, count: list[int]) -> int:
    """Where postorder puts node j of a level: behind all that is complete by then, level by level.

    Below, these are the node's own and earlier subtrees, FANOUT^k nodes each but for the ragged end; from its own
    level up, the nodes whose whole subtrees ended before.
    """
    below = sum(min(count[m], (j + 1) * FANOUT ** (level - m)) for m in range(level))
    return below + sum(j // FANOUT ** (m - level) for m in range(level, len(count)))


def appended(leaves: list[bytes], height: int) -> tuple[bytes, bytes]:
    """The log of one builder, nodes in the order in which they are complete, and its top node."""
    log, open_ = bytearray(), [[] for _ in range(height + 1)]

    def add(level: int, node: bytes) -> None:
        log.extend(node)
        open_[level].append(node)
        if level < height and len(open_[level]) == FANOUT:
            close(level)

    def close(level: int) -> None:
        run, open_[level] = open_[level], []
        add(level + 1, hashlib.sha256("".join([x.hex() for x in run]).encode()).digest())

    for leaf in leaves:
        add(0, leaf)
    for level in range(height):
        if open_[level]:
            close(level)
    return bytes(log), open_[height][0]


def steps(log: bytes, leaves: int, height: int) -> Iterator[tuple[list[str], list[str]]]:
    """For each leaf of a builder the hex siblings before and behind it, by level, read from their positions."""
    count = sizes(leaves, height)
    nodes = [[log[32 * (p := position(level, j, count)) : 32 * p + 32].hex() for j in range(count[level])] for level in range(height)]
    sides: list[list[tuple[str, str]]] = []
    for level in nodes:
        runs = [level[r : r + FANOUT] for r in range(0, len(level), FANOUT)]
        sides.append([("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))])
    for i in range(leaves):
        path = [side[i // FANOUT**level] for level, side in enumerate(sides)]
        yield [x for x, _ in path], [x for _, x in path]


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add `at`, a row's place in its group g by `order` from 0, and `n`, the group's rows.

    Rows are ranged by group and order, so a hot group spreads over many tasks; each task counts on from what the
    parts before it hold, and those counts are summed as a small table.
    """

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").dictionary_encode()
            index = np.asarray(g.indices)
            new = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
            first = np.repeat(new, np.diff(np.r_[new, len(index)]))
            place = np.arange(len(index)) - first
            if batch.column("g")[0].as_py() == last:
                place[first == 0] += at
            last, at = batch.column("g")[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(index), part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])

    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    kept = stored(dealt.mapInArrow(count_on, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", part int, place long"))
    counts = kept.groupBy("g", "part").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as parts hold the group
    starts = cut(counts.select("g", "part", before.alias("before"), F.sum("c").over(whole).alias("n")))
    met = kept.join(F.broadcast(starts) if starts.count() <= SMALL else starts, ["g", "part"])
    return met.select(*rows.columns, (F.col("before") + F.col("place")).alias("at"), "n")


LOG = "g string, builder long, first long, alone boolean, leaves int, height int, log binary, top binary, ids array<long>, others array<binary>"


def forest(nodes: DataFrame) -> list[DataFrame]:
    """The logs of each group's tree, lowest round first, over nodes (g, at, n, hash, id, other).

    A builder takes ALIGNED nodes from a multiple of ALIGNED on and adds LEVELS levels; the only builder of a group goes
    on until one node is left. The builders' top nodes are the next round's leaves. Rows: LOG; ids and others
    are those of the leaves.
    """

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        n, leaves = t.column("n")[0].as_py(), t.column("hash").to_pylist()
        alone, height = n <= ALIGNED, LEVELS
        if alone:
            height = 0
            while sizes(n, height)[-1] > 1:
                height += 1
        log, top = appended(leaves, height)
        first = t.column("at")[0].as_py()
        row = {"g": t.column("g")[0].as_py(), "builder": first // ALIGNED, "first": first, "alone": alone, "leaves": len(leaves), "height": height, "log": log, "top": top, "ids": t.column("id").to_pylist(), "others": t.column("other").to_pylist()}
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
        return pa.table({c: pa.array([x], k) for (c, x), k in zip(row.items(), kinds, strict=True)})

    logs = []
    while True:
        logs.append(stored(nodes.withColumn("builder", F.floor(F.col("at") / ALIGNED)).groupBy("g", "builder").applyInArrow(build, LOG)))
        up = logs[-1].filter("not alone")
        if up.isEmpty():
            return logs
        n = F.count(F.lit(1)).over(Window.partitionBy("g"))  # one row for ALIGNED of the round before
        nodes = up.select("g", F.col("builder").alias("at"), n.alias("n"), F.col("top").alias("hash"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("other"))


def tops(logs: list[DataFrame]) -> DataFrame:
    """(g, top) of every group."""
    out = logs[0].filter("alone").select("g", "top")
    for log in logs[1:]:
        out = out.union(log.filter("alone").select("g", "top"))
    return out


def paths(logs: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """For each leaf of the lowest round (g, at, id, leaf, other, lefts, rights, subroot), its siblings up to the root.

    above: (g, lefts, rights, subroot), what follows above each group's top; nothing if left out. From the highest
    round down, a log meets what stands above its builders and passes on what stands above its leaves.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = [(a + row["lefts"], b + row["rights"]) for a, b in steps(row["log"], row["leaves"], row["height"])]
                count = sizes(row["leaves"], row["height"])
                leaf = [row["log"][32 * (p := position(0, j, count)) : 32 * p + 32] for j in range(row["leaves"])]
                for lo in range(0, len(own), 512):
                    part, hi = own[lo : lo + 512], min(lo + 512, len(own))
                    texts = pa.list_(pa.string())
                    cols = [pa.array([row["g"]] * len(part)), pa.array(range(row["first"] + lo, row["first"] + hi), pa.int64()), pa.array(row["ids"][lo:hi], pa.int64()), pa.array(leaf[lo:hi], pa.binary()), pa.array(row["others"][lo:hi], pa.binary()), pa.array([a for a, _ in part], texts), pa.array([b for _, b in part], texts), pa.array([row["subroot"]] * len(part))]
                    yield pa.RecordBatch.from_arrays(cols, names=["g", "at", "id", "leaf", "other", "lefts", "rights", "subroot"])

    schema = "g string, at long, id long, leaf binary, other binary, lefts array<string>, rights array<string>, subroot string"
    found = None
    for log in reversed(logs):
        met = log.filter("alone")
        if above is None:
            met = met.withColumns({"lefts": F.array().cast("array<string>"), "rights": F.array().cast("array<string>"), "subroot": F.lit("")})
        else:
            met = met.join(above, "g")
        if found is not None:
            met = met.unionByName(log.filter("not alone").join(found.select("g", F.col("at").alias("builder"), "lefts", "rights", "subroot"), ["g", "builder"]))
        found = met.mapInArrow(extract, schema)
        if log is not logs[0]:
            found = stored(found)
    return found


def h(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    return F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))


class Manifest(NamedTuple):
    """The append logs: those of the sources' trees, those of the tree over the sources, and its root (null if empty)."""

    logs: list[DataFrame]
    root_logs: list[DataFrame]
    root: str | None


def manifest(docs: DataFrame, group: str, id_col: str, fields: list[str], other: Column | None = None) -> Manifest:
    """Build the manifest of docs: a tree for each value of `group`, and one over their roots.

    Leaves hash `fields`; in a tree they ascend by id (null first), rows of one id by their leaf. Groups stand in
    bytewise order, null first. other: a digest that travels beside each leaf. Only digests and ids move, not the
    rows. Repeated rows are leaves of their own. Other columns are not looked at. An empty table has no root.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # so null comes first
    leaf = F.unhex(h(*[field(F.col(c)) for c in fields]))
    rows = docs.select(g.alias("g"), F.col(id_col).cast("long").alias("id"), leaf.alias("hash"), (F.lit(None) if other is None else other).cast("binary").alias("other"))
    logs = forest(numbered(rows, ["id", "hash", "other"]))
    subroots = tops(logs).select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("top").alias("hash"), F.lit(None).cast("long").alias("id"))
    root_logs = forest(numbered(subroots, ["of"]).withColumn("other", F.encode("of", "UTF-8")))
    root = tops(root_logs).first()
    return Manifest(logs, root_logs, root and root["top"].hex())


def proofs(m: Manifest) -> DataFrame:
    """g, at, id, leaf, other, lefts, rights, subroot of every document: the siblings before and behind its path, by level."""
    upper = paths(m.root_logs)
    above = stored(upper.select(F.decode("other", "UTF-8").alias("g"), "lefts", "rights", F.lower(F.hex("leaf")).alias("subroot")))
    return paths(m.logs, above)


def folded(leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of a proof."""
    return F.aggregate(F.arrays_zip("lefts", "rights"), leaf, lambda at, s: h(s["lefts"], at, s["rights"]))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = [field(F.translate("text", upper, upper.lower()) if c == "text" else F.col(c)) for c in FIELDS]
    other = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.unhex(h(*tampered)))
    m = manifest(docs, "source", "doc_id", FIELDS, other)
    text = lambda c: F.lower(F.hex(c))
    found = proofs(m).select(
        F.col("id").alias("doc_id"), text("leaf").alias("leaf"), "subroot", F.lit(m.root).cast("string").alias("root"),
        h(F.array_join(F.transform(F.arrays_zip("lefts", "rights"), lambda s: F.concat(s["lefts"], s["rights"])), "")).alias("proof_sha256"), folded(text(F.coalesce("other", "leaf"))).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op12_postorder_manifest": op12_postorder_manifest}


def _oracle(levels: int, upper: int) -> str:
    """SQL of the manifest for up to 16^levels documents a source and 16^upper sources."""
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "text"]
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda f: "sha256(concat(" + ", ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in f) + "))"
    byte = "list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(ch) AS BIGINT) for ch in string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b: {byte}), 4294967295)"
    ctes = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS s, {leaf(fields)} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf([*fields[:4], low])} END AS other FROM documents)",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos, '' AS proof, coalesce(other, leaf) AS fold FROM d)",
    ]

    def tree(name: str, start: str, depth: int) -> str:
        """Node levels name0.. of trees (s, i, h), with what stands before and behind a node in its run."""
        side = "coalesce(string_agg(h, '') OVER (PARTITION BY s, i // 16 ORDER BY i ROWS BETWEEN {}), '')"
        before, behind = side.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), side.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
        ctes.append(f"{name}h0 AS ({start})")
        for k in range(depth):
            ctes.append(f"{name}{k} AS (SELECT s, i, h, count(*) OVER (PARTITION BY s) AS n, {before} AS l, {behind} AS r FROM {name}h{k})")
            ctes.append(f"{name}h{k + 1} AS (SELECT s, i // 16 AS i, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY s, i // 16)")
        return f"{name}h{depth}"

    top = tree("a", "SELECT s, pos AS i, leaf AS h FROM p0", levels)
    ctes.append(f"src AS (SELECT s, h, row_number() OVER (ORDER BY s) - 1 AS pos FROM {top})")
    root = tree("b", "SELECT 0 AS s, pos AS i, h FROM src", upper)
    at = 0
    for name, depth, on, place in (("a", levels, "t.s = p.s", "p.pos"), ("b", upper, "true", "src.pos")):
        for k in range(depth):
            ctes.append(f"p{at + 1} AS (SELECT p.doc_id, p.s, p.leaf, p.pos, p.proof || CASE WHEN t.n > 1 THEN t.l || t.r ELSE '' END AS proof, CASE WHEN t.n > 1 THEN sha256(t.l || p.fold || t.r) ELSE p.fold END AS fold FROM p{at} p JOIN src ON src.s = p.s JOIN {name}{k} t ON {on} AND t.i = {place} // {16**k})")
            at += 1
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, src.h AS subroot, {root}.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = {root}.h AS verified FROM p{at} p JOIN src ON src.s = p.s, {root}"


ORACLES = {"op12_postorder_manifest": _oracle(4, 2)}
