"""Benchmark decontamination by greedy string tiling of documents with test items."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import MULTIPLIER, WordHash, bloom, bloom_bits, cut, encoded, mixed, pieces, plain_names, probe, row_hash, stored

#: A tile has so many tokens at least; items whose tokens are covered by this share or more are leaked.
MIN_TILE, MIN_COVERAGE = 5, 0.5
#: The test items travel to all tasks up to so many tokens (16 bytes for each seed, 8 for each token, and the words); beyond, seeds are joined by a shuffle.
MAX_TOKENS = 1_000_000
TOKEN = re.compile(r"\w+")
FOUND = "doc_id long, item_id long, item_tokens int, covered int, tiles int, coverage double"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def seed_hashes(h: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `least` words, rolled over the whole array."""
    n = len(h) - least + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(least):
        out = out * np.uint64(MULTIPLIER) + h[j : j + n]
    return mixed(out)


def _grams(h: np.ndarray, length: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `length` words, from one pass of prefix sums."""
    up, down = powers
    sums = np.r_[np.uint64(0), np.cumsum(h * up[: len(h)])]
    return (sums[length:] - sums[:-length]) * down[: len(h) - length + 1]


def _free(used: np.ndarray, length: int) -> np.ndarray:
    """The places from which `length` words are unmarked."""
    marks = np.r_[0, np.cumsum(used)]
    return np.flatnonzero(marks[length:] == marks[:-length])


def tile(doc, item, least: int = MIN_TILE, need: float = 0) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of the longest common runs, none overlapping.

    Round by round the longest unmarked matches of at least `least` tokens are marked, so order doesn't matter.
    Ties go to the first place in the item, then in the document. doc and item: tokens, or arrays of their hashes.
    The longest match is found by halving over Karp-Rabin hashes of all runs of a length, and its places by lookup;
    a round costs (doc + item) * log, also in texts that repeat one word, and what is marked is compared in full.
    If the item's tokens that stand in common runs are fewer than `need`, there are no tiles.
    """
    if not isinstance(doc, np.ndarray):
        known = WordHash()
        doc, item = (known.array([str(t).encode() for t in x]) for x in (doc, item))
    if min(len(doc), len(item)) < least:
        return []
    a, b = seed_hashes(doc, least), seed_hashes(item, least)
    in_doc, in_item = np.isin(a, b), np.isin(b, a)

    def spread(hit: np.ndarray, n: int) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        edge[: len(hit)] += hit
        edge[least : least + len(hit)] -= hit
        return np.cumsum(edge[:-1]) > 0

    used_i = ~spread(in_item, len(item))
    if len(item) - used_i.sum() < max(need, 1):
        return []
    # only the document's words in common runs are looked at, runs kept apart by a marked word
    common = spread(in_doc, len(doc))
    place = np.flatnonzero(common | np.r_[False, common[:-1]])
    used_d, doc = ~common[place], doc[place]
    n = max(len(doc), len(item))
    k = MULTIPLIER
    powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (k, pow(k, -1, 1 << 64)))
    tiles: list[tuple[int, int, int]] = []
    most = min(len(doc), len(item))
    while most >= least:
        low, high, best = least, most, None
        while low <= high:
            length = (low + high + 1) // 2
            i, j = _free(used_d, length), _free(used_i, length)
            x, y = _grams(doc, length, powers)[i], _grams(item, length, powers)[j]
            met = np.isin(x, y)
            if met.any():
                best, low = (length, i[met], x[met], j, y), length + 1
            else:
                high = length - 1
        if best is None:
            break
        length, i, x, j, y = best
        order = np.argsort(x, kind="stable")
        i, x = i[order], x[order]
        begins = dict(zip(*(v.tolist() for v in np.unique(x, return_index=True)), strict=True))
        nexts, ends = dict(begins), dict(zip(x.tolist(), range(1, len(x) + 1), strict=True))
        for q, h in zip(j.tolist(), y.tolist(), strict=True):
            if h not in begins or used_i[q : q + length].any():
                continue
            at = nexts[h]
            while at < ends[h]:
                p = int(i[at])
                taken = np.flatnonzero(used_d[p : p + length])
                if len(taken):
                    at += max(1, int(np.searchsorted(i[at : ends[h]], p + int(taken[-1]), "right")))
                elif not np.array_equal(doc[p : p + length], item[q : q + length]):
                    at += 1
                else:
                    used_d[p : p + length] = used_i[q : q + length] = True
                    tiles.append((int(place[p]), q, length))
                    break
            nexts[h] = at
        most = length - 1
    return tiles


def judged(doc: np.ndarray, items: dict[int, np.ndarray], which, least: int, share: float):
    """(item, tokens, covered, tiles, coverage) of those items that the document covers to `share`."""
    for item in which:
        want = items[item]
        got = tile(doc, want, least, share * len(want))
        covered = sum(t[2] for t in got)
        if got and covered >= share * len(want):
            yield item, len(want), covered, len(got), covered / len(want)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
    cols = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "item_id", "item_tokens", "covered", "tiles", "coverage"])


class Suite:
    """A bounded set of test items, as each task holds it: ids and tokens by place, and sorted seeds with their places."""

    def __init__(self, ids: list[int | None], items: dict[int, list[str]], least: int):
        self.ids, self.least, self.known = ids, least, WordHash()
        self.items = {k: self.array(words) for k, words in items.items()}
        each = [np.unique(seed_hashes(words, least)) for words in self.items.values()]
        seeds = np.concatenate([np.empty(0, np.uint64), *each])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.places = seeds[order], np.repeat(np.array(list(self.items), np.int64), [len(s) for s in each])[order]
        self.quick = np.zeros(1 << 22, bool)
        self.quick[(seeds & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def array(self, words: list[str]) -> np.ndarray:
        return self.known.array([w.encode() for w in words])

    def hits(self, docs: list[np.ndarray]) -> dict[int, set[int]]:
        """Documents that share a seed with items: position -> items."""
        lengths = np.array([len(d) for d in docs], np.int64)
        h = seed_hashes(np.concatenate(docs) if docs else np.empty(0, np.uint64), self.least)
        out: dict[int, set[int]] = {}
        if not len(h):
            return out
        ends = np.cumsum(lengths)
        near = np.flatnonzero(self.quick[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        doc = np.searchsorted(ends, near, "right")
        near, doc = (x[near + self.least <= ends[doc]] for x in (near, doc))
        low, high = (np.searchsorted(self.seeds, h[near], side) for side in ("left", "right"))
        met = low < high
        for d, a, b in zip(doc[met].tolist(), low[met].tolist(), high[met].tolist(), strict=True):
            out.setdefault(d, set()).update(self.places[a:b].tolist())
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, item_text), a row for each different pair of id, null or not, and text; item tells them apart."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item_text")).distinct()
    return rows.withColumn("item", row_hash(rows))


def small_suite(benchmark: DataFrame, least: int = MIN_TILE, most: int = MAX_TOKENS) -> Suite | None:
    """The test items for all tasks, or None if they hold more than `most` words (or characters / 2; a row counts as 2)."""
    if (benchmark.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 2)).first()[0] or 0) > 2 * most:
        return None
    rows = sorted(_items(benchmark).collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.item))
    return Suite([r.item_id for r in rows], {k: tokens(r.item_text) for k, r in enumerate(rows)}, least)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_TILE, share: float = MIN_COVERAGE, most: int = MAX_TOKENS) -> DataFrame:
    """(doc_id, item_id, item_tokens, covered, tiles, coverage) of each test item that a document covers to `share`.

    Tokens are runs of letters, digits and underscores in lower case. A document and an item meet if they share
    `least` tokens in a row; greedy string tiling then counts the item's tokens covered by non-overlapping common
    runs, in any order. Items of fewer than `least` tokens, null or empty texts cover nothing. Rows that repeat an
    id give a row each; rows of null id give null. Items of one id, or of null id, are searched each by its own text;
    equal items are one. Extra columns are not looked at. Small suites travel to all tasks, after a check of
    their size; larger ones meet the documents' seeds in a shuffle join.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    suite = small_suite(benchmark, least, most)
    if suite is None:
        return _joined(texts, benchmark, least, share).drop("th")
    sent = docs.sparkSession.sparkContext.broadcast(suite)

    def run(batches):
        suite = sent.value
        for b in pieces(batches):
            split = [suite.array(tokens(t)) for t in b.column("text").to_pylist()]
            ids = b.column("doc_id").to_pylist()
            hits = suite.hits(split)
            yield _batch([(ids[d], suite.ids[k], *r) for d in sorted(hits) for k, *r in judged(split[d], suite.items, sorted(hits[d]), least, share)])

    return texts.mapInArrow(run, FOUND)


def _joined(texts: DataFrame, benchmark: DataFrame, least: int, share: float) -> DataFrame:
    """As leaks, with a hash of the document's row, for suites of any size: a hash join of seeds finds the pairs to tile."""

    def seeds(key: str, text: str):
        def run(batches):
            known = WordHash()
            for b in batches:
                for i, t in zip(b.column(key).to_pylist(), b.column(text).to_pylist(), strict=True):
                    words = tokens(t)
                    h, c = np.unique(seed_hashes(known.array([w.encode() for w in words]), least).view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([i] * len(h), h, c, [len(words)] * len(h))], names=[key, "seed", "c", "n"])

        return run

    rows = texts.withColumn("th", row_hash(texts))
    items = _items(benchmark)
    right = stored(items.mapInArrow(seeds("item", "item_text"), "item long, seed long, c long, n long"))
    bits = bloom_bits(right.count())
    left = rows.select("th", "text").mapInArrow(seeds("th", "text"), "th long, seed long, c long, n long").select("th", "seed").distinct()
    left = probe(left, "seed", cut(bloom(right, "seed", bits)), bits, "maybe").filter("maybe").select("th", "seed")
    # a tile of t tokens holds t - least + 1 seeds of the item, t / least of them at least
    enough = F.sum("c") * least >= share * F.first("n")
    pairs = left.join(right, "seed").groupBy("th", "item").agg(enough.alias("enough")).filter("enough").select("th", "item")

    def run(batches):
        known = WordHash()
        for b in batches:
            out, rows = [], []
            for doc, th, text, item, want in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "text", "item_id", "item_text")), strict=True):
                one, two = (known.array([w.encode() for w in tokens(t)]) for t in (text, want))
                met = [(doc, item, *r[1:]) for r in judged(one, {0: two}, [0], least, share)]
                out += met
                rows += [th] * len(met)
            yield _batch(out).append_column("th", pa.array(rows, pa.int64()))

    return pairs.join(rows, "th").join(items, "item").select("doc_id", "th", "text", "item_id", "item_text").mapInArrow(run, f"{FOUND}, th long")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_TILE, share: float = MIN_COVERAGE, most: int = MAX_TOKENS) -> DataFrame:
    """The rows of docs that leak no test item, with all their columns.

    With a small suite each task judges its own rows and nothing is shuffled; else leaking rows are joined away
    by id, null or not, and text.
    """
    suite = small_suite(benchmark, least, most)
    if suite is None:
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        docs, (id_col, text_col), given = plain_names(docs, id_col, text_col)
        bad = _joined(texts, benchmark, least, share).select(F.col("doc_id").alias("__id"), F.col("th").alias("__h")).distinct()
        keyed = docs.withColumn("__th", F.xxhash64(*[x for c in (F.col(id_col).cast("long"), F.col(text_col)) for x in (c.isNull(), c)]))
        return keyed.join(bad, keyed[id_col].cast("long").eqNullSafe(bad["__id"]) & (keyed["__th"] == bad["__h"]), "left_anti").select(*docs.columns).transform(given)
    sent = docs.sparkSession.sparkContext.broadcast(suite)

    def run(batches):
        suite = sent.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for b in pieces([batch], column=at):
                split = [suite.array(tokens(t)) for t in b.column(at).to_pylist()]
                bad = {d for d, which in suite.hits(split).items() if next(judged(split[d], suite.items, sorted(which), least, share), None)}
                yield b.filter(pa.array([d not in bad for d in range(b.num_rows)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op7_string_tiling": op7_string_tiling}
