"""Substring dedup: windows of 50 words that repeat across documents, met by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from array import array
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import MULTIPLIER, WordHash, bloom, bloom_bits, cut, encoded, mixed, pieces, probe, stored

WINDOW, GRAM = 50, 12
#: A super-k-mer ends after so many windows, so that text of one word repeated makes no giant.
LONGEST = 64
#: A minimiser with more different super-k-mers than this is hot: its windows are dealt to several buckets.
HOT = 20_000
#: Windows of one bucket are sorted so many bytes at a time, about.
PASS = 64_000_000
#: A table of hot minimisers is broadcast up to so many rows (16 bytes each); a shuffle join takes it beyond.
SMALL = 100_000
#: Odd multipliers of the rolling hashes.
MULTIPLIERS = (MULTIPLIER, 0xC2B2AE3D27D4EB4F)
RUN = "doc_id long, th long, start int, n int, mini long, x1 long, x2 long"


def minimisers(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each position the least scrambled hash of the word `gram`s inside the window that starts there."""
    m = min(gram, window)
    n = len(h) - m + 1
    if n <= 0 or len(h) < window:
        return np.empty(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(m):
        grams = grams * np.uint64(MULTIPLIERS[0]) + h[j : j + n]
    least, span, wide = mixed(grams), 1, window - m + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(least) - (wide - span)], least[wide - span :])


def super_kmers(h: np.ndarray, lengths: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Runs of consecutive windows of one text that share a minimiser: arrays (text, first word, windows, minimiser)."""
    ends = np.cumsum(lengths)
    least = minimisers(h, window, gram)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(np.arange(len(least)) + window <= ends[text[: len(least)]]) if len(least) else np.empty(0, np.int64)
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    mini = least[at]
    new = np.flatnonzero(np.r_[True, (mini[1:] != mini[:-1]) | (at[1:] != at[:-1] + 1)])
    size = np.diff(np.r_[new, len(at)])
    cuts = (size + LONGEST - 1) // LONGEST
    first = np.repeat(new, cuts) + LONGEST * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    n = np.minimum(LONGEST, np.repeat(new + size, cuts) - first)
    return text[at[first]], at[first], n, mini[first]


def _digests(h: np.ndarray, start: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Two rolling hashes of the word sequences h[start : start + words]."""
    out = []
    for k in MULTIPLIERS:
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(h), k, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(len(h), pow(k, -1, 1 << 64), np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(mixed(h ^ np.uint64(k)) * up[:-1])]
        out.append(mixed((sums[start + words] - sums[start]) * down[start] + words.astype(np.uint64)).view(np.int64))
    return out


def _runs(batches, pack: bool, window: int, gram: int):
    """Of each piece of text the super-k-mers; pack: those of a task that are equal once, with their words."""
    known = WordHash()
    seen: dict[tuple[int, int], list] = {}

    def flush():
        if seen:
            keys, rows = list(seen), list(seen.values())
            cols = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64())]
            cols += [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            seen.clear()
            yield pa.RecordBatch.from_arrays(cols, names=["x1", "x2", "mini", "least", "most", "words"])

    for b in pieces(batches):
        split = [t.split() for t in encoded(b.column("text"))]
        words = [w for t in split for w in t]
        h = known.array(words)
        text, start, n, mini = super_kmers(h, np.array([len(t) for t in split], np.int64), window, gram)
        if not len(start):
            continue
        x1, x2 = _digests(h, start, n + window - 1)
        ids = b.column("doc_id").to_numpy(zero_copy_only=False)[text].astype(np.int64)
        mini = mini.view(np.int64)
        if not pack:
            origin = np.cumsum([0, *(len(t) for t in split)])[text]
            th = b.column("th").to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, th, (start - origin).astype(np.int32), n.astype(np.int32), mini, x1, x2)], names=["doc_id", "th", "start", "n", "mini", "x1", "x2"])
            continue
        for d, s, k, m, a, c in zip(ids.tolist(), start.tolist(), (n + window - 1).tolist(), mini.tolist(), x1.tolist(), x2.tolist(), strict=True):
            if (got := seen.get((a, c))) is None:
                seen[a, c] = [m, d, d, b" ".join(words[s : s + k])]
            elif d < got[1]:
                got[1] = d
            elif d > got[2]:
                got[2] = d
        if len(seen) > 20_000:
            yield from flush()
    yield from flush()


def bucket_rows(kmers: dict[tuple[int, int, int], list], window: int = WINDOW, most_bytes: int = PASS):
    """One bucket's super-k-mers, (x1, x2, first) -> [least id, most id, words], words from window `first` of it on:
    sort all their windows, so that equal ones meet; yield (x1, x2, offset, windows, least id) for each stretch of
    windows that more than one id holds. Windows of more than `most_bytes` in all are sorted in passes, each by their hash."""
    if len(kmers) == 1 and next(iter(kmers.values()))[0] == next(iter(kmers.values()))[1]:
        return
    begins = [array("i", accumulate((len(w) + 1 for w in words.split(b" ")), initial=0)) for _, _, words in kmers.values()]
    places = list(accumulate((len(b) - window for b in begins), initial=0))
    passes = 1 + sum(len(k[2]) * window * (len(b) - window) // len(b) for k, b in zip(kmers.values(), begins, strict=True)) // most_bytes
    first = [0] * places[-1]
    for part in range(passes):
        windows = []
        for (least, _, words), b, at in zip(kmers.values(), begins, places, strict=False):
            cuts = ((words[b[j] : b[j + window] - 1], least, at + j) for j in range(len(b) - window))
            windows.extend(cuts if passes == 1 else (w for w in cuts if xxhash.xxh64_intdigest(w[0]) % passes == part))
        windows.sort()
        at = None
        for w, least, place in windows:
            if w != at:
                at, holder = w, least
            first[place] = holder
    for ((a, c, off), (_, most, _)), start, end in zip(kmers.items(), places, places[1:], strict=False):
        for holder, same in groupby(range(start, end), first.__getitem__):
            if holder < most:
                same = list(same)
                yield a, c, off + same[0] - start, len(same), holder


def dealt_windows(travels: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """Rows of the minimisers in `parts` become one row for each window, in a bucket that its hash picks."""
    words = F.split(F.col("words").cast("string"), " ")
    kind = "struct<bucket:bigint,first:int,words:binary>"

    def one(j: Column) -> Column:
        w = F.array_join(F.slice(words, j + 1, window), " ")
        return F.struct(F.pmod(F.xxhash64(w), "parts").alias("bucket"), j.cast("int").alias("first"), w.cast("binary").alias("words")).cast(kind)

    whole = F.array(F.struct(F.lit(0).alias("bucket"), F.lit(0).alias("first"), "words").cast(kind))
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - window), one)
    return travels.join(parts, "mini", "left").select("mini", "x1", "x2", "least", "most", F.inline(F.when(F.col("parts").isNull(), whole).otherwise(windows)))


def _buckets(batches, window: int):
    """Rows come sorted by minimiser and bucket; equal super-k-mers merge as they come, and a bucket is worked off as it ends."""
    held: dict[tuple[int, int, int], list] = {}
    at, out = None, []

    def batch():
        cols = list(zip(*out, strict=True))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["x1", "x2", "off", "wins", "least"])
        out.clear()
        return done

    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("mini", "bucket", "x1", "x2", "first", "least", "most", "words")]
        for mini, bucket, x1, x2, first, least, most, words in zip(*cols, strict=True):
            if (mini, bucket) != at:
                out.extend(bucket_rows(held, window))
                held, at = {}, (mini, bucket)
            got = held.setdefault((x1, x2, first), [least, most, words])
            got[0], got[1] = min(got[0], least), max(got[1], most)
        if len(out) > 20_000:
            yield batch()
    out.extend(bucket_rows(held, window))
    if out:
        yield batch()


def hot_minimisers(runs: DataFrame, shared: DataFrame, hot: int) -> DataFrame | None:
    """(mini, parts) of those with more than `hot` different super-k-mers, with the buckets they need; None if none."""
    many = shared.filter(F.col("c") > hot).select("mini")
    few = many.count()
    if not few:
        return None
    different = runs.join(F.broadcast(many) if few <= SMALL else many, "mini").select("mini", "x1", "x2").distinct().groupBy("mini").agg(F.count(F.lit(1)).alias("d"))
    parts = cut(different.filter(F.col("d") > hot).select("mini", (F.ceil(F.col("d") / hot) * 8).cast("long").alias("parts")))
    few = parts.count()
    return (F.broadcast(parts) if few <= SMALL else parts) if few else None


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, th, ranges): the word ranges, ends exclusive, of windows that also start in a smaller doc_id.

    docs: doc_id long, text, th (a hash of the text, so that rows that repeat an id stay apart).
    1. Every text is cut to super-k-mers; only minimisers that more than one document has can hold a repeat, and
       a Bloom filter over them (of bounded size) lets just those super-k-mers travel.
    2. They go to their minimiser's bucket as one packed string each, equal ones of a task once, and are sorted.
       Of minimisers with more than `hot` different super-k-mers (say, of a huge group of near copies) the windows
       go each to one of several buckets by its hash: equal windows still meet, and no bucket outgrows a task.
    3. What the buckets find is joined to the places where each super-k-mer stands.
    """
    usable = docs.filter("doc_id is not null and text is not null")
    runs = stored(usable.mapInArrow(lambda it: _runs(it, False, window, gram), RUN))
    met = runs.groupBy("mini").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("c"))
    shared = cut(met.filter("a < b").select("mini", "c"))
    bits = bloom_bits(shared.count())
    filter_ = cut(bloom(shared, "mini", bits))
    packed = usable.select("doc_id", "text").mapInArrow(lambda it: _runs(it, True, window, gram), "x1 long, x2 long, mini long, least long, most long, words binary")
    travels = probe(packed, "mini", filter_, bits, "maybe").filter("maybe").drop("maybe")
    parts = hot_minimisers(runs, shared, hot)
    travels = travels.withColumns({"bucket": F.lit(0).cast("long"), "first": F.lit(0)}) if parts is None else dealt_windows(travels, parts, window)
    keys = ["mini", "bucket"]
    dealt = travels.repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.mapInArrow(lambda it: _buckets(it, window), "x1 long, x2 long, off int, wins int, least long")
    places = probe(runs, "mini", filter_, bits, "maybe").filter("maybe").select("doc_id", "th", "start", "x1", "x2")
    hits = places.join(found, ["x1", "x2"]).filter("doc_id > least")
    span = F.struct((F.col("start") + F.col("off")).alias("a"), (F.col("start") + F.col("off") + F.col("wins") + (window - 1)).alias("b"))
    return hits.select("doc_id", "th", span.alias("r")).groupBy("doc_id", "th").agg(F.collect_list("r").alias("ranges"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept (the words left, joined by a space), kept_sha256.

    A word goes if a window of `window` words that covers it has the same words as one that starts in a document
    with a smaller id; windows are judged on the texts as given. Null and empty texts have no words; texts
    shorter than a window lose none. Rows that repeat an id don't count against each other. A null id neither
    removes nor loses words. Other columns are not looked at. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = repeated_ranges(rows, window, gram, hot)

    def finish(batches):
        for b in pieces(batches, 8_000_000):
            n, gone, kept = [], [], []
            for t, spans in zip(encoded(b.column("text")), b.column("ranges").to_pylist(), strict=True):
                words = t.split()
                n.append(len(words))
                if spans:
                    drop = np.zeros(len(words) + 1, np.int32)
                    for s in spans:
                        drop[s["a"]] += 1
                        drop[s["b"]] -= 1
                    stays = np.cumsum(drop[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stays)]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    return rows.join(ranges, ["doc_id", "th"], "left").select("doc_id", "text", "ranges").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")


def op3_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {"op3_super_kmers": op3_super_kmers}
ORACLES = {
    "op3_super_kmers": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 49 <= len(w) THEN sha256(array_to_string(w[i:i + 49], ' ')) END AS key FROM p),
f AS (SELECT key, min(doc_id) AS least FROM k WHERE key IS NOT NULL GROUP BY key),
b AS (SELECT k.doc_id, i, word, coalesce(k.doc_id > f.least, false) AS bad FROM k LEFT JOIN f ON k.key = f.key),
g AS (SELECT doc_id, i, word, bool_or(bad) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM b),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""
}
