"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import WordHash, cut, encoded, pieces, stored

#: The classifier is fitted on at most so many labelled rows (those of the least hashes).
SAMPLE = 4000
#: Hash space of words; how many of them each of the two models may use, and how many standard deviations from
#: independence of the label they must be (the most out of 10,000 unrelated words reach about 4).
SPACE_BITS, CHOSEN, SIGNIFICANT = 20, 300, 4.5
#: A site table is broadcast up to so many rows; a shuffle join takes it beyond.
SMALL = 100_000
#: Documents whose combined probability is lower are rejected.
LEAST = 0.5

_LETTERS = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_KIND = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:?'\"()-", b"#$%&*!|@<>{}[]=\\/^~_+`")):
    _KIND[list(_set)] = _i + 1
_KIND[128:] = 7


def featurised(texts: list[bytes], known: WordHash) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text its distinct hashed words, and eight figures of its surface."""
    words, surface = [], np.zeros((len(texts), 8))
    for i, t in enumerate(texts):
        h, c = np.unique(known.array(t.translate(_LETTERS).lower().split()) & np.uint64((1 << SPACE_BITS) - 1), return_counts=True)
        words.append(h.astype(np.int64))
        if t:
            kinds = np.bincount(_KIND[np.frombuffer(t, np.uint8)], minlength=8)
            surface[i, :6] = kinds[[1, 2, 4, 5, 6, 7]] / len(t)
            surface[i, 6] = (c.max() - 1) / c.sum() if len(c) else 0.0
            surface[i, 7] = c.sum() / len(t)
    return words, surface


class Head:
    """A logistic model of hashed words and surface figures, fitted by Newton's method."""

    def __init__(self, words: list[np.ndarray], surface: np.ndarray, y: np.ndarray, best: np.ndarray):
        """words: of each text at least those of `best`, the sorted words that the model may use."""
        self.mean, self.scale = surface.mean(0), surface.std(0) + 1e-6
        self.words, self.weights, self.surface = np.empty(0, np.int64), np.empty(0), np.zeros(surface.shape[1])
        rate = (y.sum() + 0.5) / (len(y) + 1)
        self.bias = float(np.log(rate / (1 - rate)))
        if y.min() == y.max():
            return
        flat, doc = np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words])
        column = np.searchsorted(best, flat)
        use = column < len(best)
        use[use] = best[column[use]] == flat[use]
        x = np.zeros((len(y), len(best) + surface.shape[1] + 1))
        x[doc[use], column[use]] = 1
        x[:, len(best) : -1] = np.clip((surface - self.mean) / self.scale, -8, 8)
        x[:, -1] = 1
        w = np.zeros(x.shape[1])
        w[-1] = self.bias
        ridge = np.r_[np.full(x.shape[1] - 1, 0.2), 1e-3]
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(ridge), x.T @ (y - q) - ridge * w)
            w += step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        self.words, self.weights = best, w[: len(best)]
        self.surface, self.bias = w[len(best) : -1], float(w[-1])

    def logits(self, words: list[np.ndarray], surface: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << SPACE_BITS)
        table[self.words] = self.weights
        return np.array([table[w].sum() for w in words]) + np.clip((surface - self.mean) / self.scale, -8, 8) @ self.surface + self.bias


def _telling(counts: DataFrame, label: str, y: np.ndarray) -> np.ndarray:
    """Up to CHOSEN words that lie SIGNIFICANT deviations or more from independence of the label, sorted."""
    mean, n = float(y.mean()), F.col("n")
    z = (F.col(label) - n * mean) / F.sqrt(F.lit(mean * (1 - mean)) * n * (1 - n / len(y)) + 1e-9)
    far = counts.select("word", F.abs(z).alias("z")).filter(F.col("z") >= SIGNIFICANT).orderBy(F.desc("z"), "word").limit(CHOSEN)
    return np.sort(np.array([r.word for r in far.collect()], np.int64))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[Head, Head] | None:
    """Models of quality and of toxicity from at most `sample` labelled rows; None if there are none.

    labels: doc_id, quality, toxic (0 or 1). Rows with a null there are left out. Of several labels of one id
    all count; of documents that repeat an id the first `sample` rows by hash. Words are counted and chosen by grouped
    sums. What reaches the driver is, for each row of the sample, its surface and those of the chosen words that it
    holds, however long texts are.
    """
    chosen = labels.select("doc_id", "quality", "toxic").dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        known = WordHash()
        for b in pieces(batches):
            words, surface = featurised(encoded(b.column("text")), known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), b.column("toxic"), pa.array(words, pa.list_(pa.int64())), pa.array(surface.tolist(), pa.list_(pa.float64()))], names=["doc_id", "quality", "toxic", "words", "surface"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], rows.schema["quality"], rows.schema["toxic"], T.StructField("words", T.ArrayType(T.LongType())), T.StructField("surface", T.ArrayType(T.DoubleType()))]))
    found = stored(found.withColumns({"place": F.monotonically_increasing_id(), "h": F.xxhash64("words", "surface")}))
    first = found.select("place", "doc_id", "quality", "toxic", "h").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic", "h").limit(sample)
    taken = found.join(F.broadcast(cut(first.select("place"))), "place", "left_semi")
    got = taken.select("place", "doc_id", "quality", "toxic", "h", "surface").toArrow()
    if not got.num_rows:
        return None
    order = np.lexsort([got.column(c).to_numpy() for c in ("h", "toxic", "quality", "doc_id")])
    y = {c: got.column(c).to_numpy()[order].astype(float) for c in ("quality", "toxic")}
    each = taken.select("quality", "toxic", F.explode("words").alias("word"))
    counts = cut(each.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")).filter("n >= 3"))
    best = {c: _telling(counts, c, y[c]) for c in y}
    wanted = np.union1d(best["quality"], best["toxic"]).tolist()  # 2 * CHOSEN at most
    held = taken.select("place", F.filter("words", lambda w: w.isin(wanted)).alias("words")).toArrow()
    words = dict(zip(held.column("place").to_pylist(), held.column("words").to_pylist(), strict=True))
    words = [np.array(words[p], np.int64) for p in got.column("place").to_numpy()[order].tolist()]
    surface = np.array(got.column("surface").to_pylist())[order]
    return Head(words, surface, y["quality"], best["quality"]), Head(words, surface, y["toxic"], best["toxic"])


def scored(docs: DataFrame, models: tuple[Head, Head] | None, text_col: str, keep: bool, out: str) -> DataFrame:
    """docs with the probability `out` that a text is good and not toxic; keep: with text_col, else without."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)
    given = [*(n for n in docs.columns if keep or n != text_col), out]

    def run(batches):
        known, models = WordHash(), sent.value
        for batch in batches:
            for b in pieces([batch], column=at):
                p = np.ones(b.num_rows)
                if models:
                    words, surface = featurised(encoded(b.column(at)), known)
                    quality, toxic = (np.clip(m.logits(words, surface), -30, 30) for m in models)
                    p = 1 / (1 + np.exp(-quality)) / (1 + np.exp(toxic))
                cols = [b.column(i) for i in range(b.num_columns) if keep or i != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(p)], names=given)

    fields = [f for f in docs.schema if keep or f.name != text_col]
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.DoubleType())]))


def _precision(sites: DataFrame, centre: Column) -> float:
    """How many documents the level above is worth: a beta prior's size by the method of moments."""
    mean = F.col("s") / F.col("n")
    row = sites.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (mean - centre) ** 2).alias("v"), F.sum(F.col("n") * centre * (1 - centre)).alias("w")).first()
    if not row.k or row.k < 2 or not row.n or row.w <= 0:
        return 1e4
    within = row.w / row.n
    between = (row.v - row.k * within) / row.n
    return float(min(1e4, max(1.0, within / between - 1))) if between > 0 else 1e4


def site_posteriors(scores: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, s, host_p, k) and the global mean: sums of p by path and host, hosts shrunk to the mean.

    A host's posterior is (sum + K * mean) / (n + K); k is the weight that it has in turn for its paths. All sums
    are grouped aggregations, combined before the shuffle, so a host with a third of the rows is one more row.
    """
    paths = cut(scores.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")))
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = (total.s / total.n) if total.n else 1.0
    hosts = cut(paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    k = _precision(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_p"))
    joined = cut(paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h"))
    return joined.withColumn("k", F.lit(_precision(joined, F.col("host_p")))), mean


def _logit(p: Column) -> Column:
    q = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), p))
    return F.log(q / (1 - q))


def combined(rows: DataFrame, sites: DataFrame, mean: float) -> DataFrame:
    """Add path_p (the site's posterior without the row itself) and score (the document's odds times the site's)."""
    sites = sites.select(F.col("host").alias("__h"), F.col("path").alias("__p"), "s", "n", "k", "host_p")
    if sites.count() <= SMALL:
        sites = F.broadcast(sites)
    path_p = (F.col("s") - F.col("p") + F.col("k") * F.col("host_p")) / (F.col("n") - 1 + F.col("k"))
    logit = _logit(F.col("p")) + _logit(path_p) - _logit(F.lit(mean))
    return (
        rows.join(sites, rows["host"].eqNullSafe(sites["__h"]) & rows["path"].eqNullSafe(sites["__p"]), "left")
        .withColumn("path_p", path_p)
        .withColumn("score", 1 / (1 + F.exp(-logit)))
        .drop("__h", "__p", "s", "n", "k")
    )


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """One row for each row of docs: doc_id, host, path, p, host_p, path_p, score, keep.

    p is the document's own evidence (good and not toxic); hosts are shrunk to the mean of all rows and paths to
    their host, each by a weight fitted to the spread between sites; score multiplies the odds. keep: score is at
    least `least`. Null and empty texts have no words and a surface of zeros. Null hosts and paths are sites of
    their own. Without labels p is 1 and all rows stay. Extra columns, rows that repeat an id and ties change
    nothing. An empty table gives an empty one.
    """
    models = fit(docs, labels, id_col, text_col, sample)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = cut(scored(chosen, models, "text", False, "p"))
    sites, mean = site_posteriors(rows)
    return combined(rows, sites, mean).withColumn("keep", F.col("score") >= least)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """The rows of docs that judge keeps, with all their columns. Texts are scored once and kept beside their p.

    Null and empty texts, null hosts and paths, repeated rows and missing labels count as in judge: equal rows stay or
    go together, and without labels all stay. Columns may have any name, and an empty table stays empty.
    """
    models = fit(docs, labels, id_col, text_col, sample)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = stored(scored(docs.select(*[F.col(c).alias(names[c]) for c in docs.columns]), models, names[text_col], True, "p"))
    rows = rows.withColumns({"host": F.col(names[host_col]), "path": F.col(names[path_col])})
    sites, mean = site_posteriors(rows.select("host", "path", "p"))
    return combined(rows, sites, mean).filter(F.col("score") >= least).select(*[F.col(names[c]).alias(c) for c in docs.columns])


def op1_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op1_site_bayes": op1_site_bayes}
