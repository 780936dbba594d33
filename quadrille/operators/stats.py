"""Column statistics and principal components from one pass of sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.operators.steps import cut


def column_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, and sigma: the root mean square after centring, with divisor n - 1."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma"))


def normalised(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with value centred and divided by its column's sigma. A sigma of 0 is an error, raised before any row is made."""
    stats = cut(column_stats(rows, keys, value))
    if not stats.filter("sigma = 0").isEmpty():
        raise ValueError("a column whose values are all equal can't be normalised")
    return rows.join(stats.select(*keys, "mean", "sigma"), keys).withColumn(value, (F.col(value) - F.col("mean")) / F.col("sigma")).drop("mean", "sigma")


def _moments(rows: DataFrame, vector: str, d: int, shift: np.ndarray) -> np.ndarray:
    """The d + 1 by d + 1 matrix of sums of products of (1, vector - shift): each task sends the sum of its batches."""

    def sums(batches):
        total = np.zeros((d + 1, d + 1))
        for pdf in batches:
            if len(pdf):
                x = np.c_[np.ones(len(pdf)), np.stack(pdf["v"].to_numpy()) - shift]
                total += x.T @ x
        i, j = np.triu_indices(d + 1)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    whole = rows.select(F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())
    out = np.zeros((d + 1, d + 1))
    for r in whole.mapInPandas(sums, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def _covariance(rows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """The covariance matrix (divisor n - 1) and the mean; sums are taken about one of the rows, so that they stay exact."""
    some = rows.select(F.col(vector).cast("array<double>")).filter(F.col(vector).isNotNull()).first()
    if some is None:
        return np.zeros((0, 0)), np.zeros(0)
    shift = np.array(some[0], float)
    m = _moments(rows, vector, len(shift), shift)
    n, s = m[0, 0], m[0, 1:]
    cov = (m[1:, 1:] - np.outer(s, s) / n) / (n - 1) if n > 1 else np.full((len(s), len(s)), np.nan)
    return cov, shift + s / n


def covariance(rows: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov) for i <= j of the vectors' columns, with divisor n - 1 (one row: null). Null vectors don't count.

    Nothing runs before the result is asked for. A task sums one matrix of its rows about its own first vector, and
    these sums, d by d for each task whatever its rows, are brought together about their common mean.
    """
    whole = rows.select(F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = total = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("v").flatten()).reshape(b.num_rows, -1)
                if shift is None:
                    shift, total = x[0].copy(), np.zeros((x.shape[1] + 1, x.shape[1] + 1))
                x = np.c_[np.ones(len(x)), x - shift]
                total += x.T @ x
        if shift is not None:
            i, j = np.triu_indices(len(shift))
            n, s = total[0, 0], total[0, 1:]
            own = total[1:, 1:] - np.outer(s, s) / n
            mean = shift + s / n
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (i, j, np.full(len(i), n), mean[i], mean[j], own[i, j])], names=["i", "j", "n", "a", "b", "s"])

    tasks = whole.mapInArrow(sums, "i long, j long, n double, a double, b double, s double")
    # each task's sum about its mean, plus the weighted covariance of the tasks' means
    groups = tasks.groupBy("i", "j").agg(F.collect_list(F.struct("n", "a", "b", "s")).alias("g"))  # one for each task
    total = F.aggregate("g", F.lit(0.0), lambda t, g: t + g["n"])
    ma = F.aggregate("g", F.lit(0.0), lambda t, g: t + g["n"] * g["a"])
    mb = F.aggregate("g", F.lit(0.0), lambda t, g: t + g["n"] * g["b"])
    met = groups.withColumn("total", total).withColumns({"ma": ma / F.col("total"), "mb": mb / F.col("total")})
    cov = F.aggregate("g", F.lit(0.0), lambda t, g: t + g["s"] + g["n"] * (g["a"] - F.col("ma")) * (g["b"] - F.col("mb")))
    return met.select("i", "j", F.when(F.col("total") > 1, cov / (F.col("total") - 1)).alias("cov"))


def pca_fit(rows: DataFrame, vector: str, normalise: bool = False) -> dict[str, np.ndarray]:
    """values (ratios, falling), vectors (rows; the entry of largest absolute value is positive), mean, sigma, energy.

    normalise: columns are divided by their deviation (of n - 1) first; one without any is an error. sigma is 1 without.
    The driver holds one d by d matrix. Fewer than two columns or rows are an error.
    """
    d = rows.select(F.size(vector)).first()
    if d is None or d[0] < 2 or rows.limit(2).count() < 2:
        raise ValueError("principal components need two columns and two rows at least")
    cov, mean = _covariance(rows, vector)
    sigma = np.sqrt(np.diag(cov)) if normalise else np.ones(len(cov))
    if not (sigma > 0).all():
        raise ValueError("a column whose values are all equal can't be normalised")
    values, vectors = np.linalg.eigh(cov / np.outer(sigma, sigma))
    values, vectors = values[::-1], vectors.T[::-1]
    signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(1)])
    return {"values": values / values.sum(), "vectors": vectors * signs[:, None], "mean": mean, "sigma": sigma, "energy": float(values.sum())}


def pca_transform(rows: DataFrame, vector: str, model: dict, k: int) -> DataFrame:
    """Add principals: the centred (and, by the model, normalised) vector on the first k principal vectors."""
    parts = []
    for p in model["vectors"][:k] / model["sigma"]:
        terms = F.zip_with(F.zip_with(vector, F.array(*map(F.lit, model["mean"].tolist())), lambda a, m: a - m), F.array(*map(F.lit, p.tolist())), lambda a, w: a * w)
        parts.append(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))
    return rows.withColumn("principals", F.array(*parts))


def pca_inverse(rows: DataFrame, principals: str, model: dict) -> DataFrame:
    """Add restored: the vectors that the first principal values stand for."""
    vectors, mean = model["vectors"] * model["sigma"], model["mean"]

    @F.pandas_udf("array<double>")
    def back(p: pd.Series) -> pd.Series:
        m = np.stack(p.to_numpy()) if len(p) else np.zeros((0, len(vectors)))
        return pd.Series(list(m @ vectors[: m.shape[1]] + mean))

    return rows.withColumn("restored", back(principals))


def pca_checks(rows: DataFrame, vector: str, model: dict) -> dict[str, float]:
    """determinant: the vectors' absolute one (1 if orthogonal). accuracy: 1 - the mean absolute error of going there
    and back with all vectors."""
    both = pca_inverse(pca_transform(rows, vector, model, len(model["vectors"])), "principals", model)
    off = F.aggregate(F.zip_with(vector, "restored", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / len(model["mean"])
    return {"determinant": float(abs(np.linalg.det(model["vectors"]))), "accuracy": 1 - both.agg(F.avg(off)).first()[0]}


def pca_save(spark: SparkSession, model: dict, path: str) -> None:
    """The model as Parquet: one row for each principal vector."""
    d = [(k, float(v), [float(x) for x in p], [float(x) for x in model["mean"]], [float(x) for x in model["sigma"]], model["energy"]) for k, (v, p) in enumerate(zip(model["values"], model["vectors"], strict=True))]
    spark.createDataFrame(d, "k int, value double, vector array<double>, mean array<double>, sigma array<double>, energy double").coalesce(1).write.mode("overwrite").parquet(path)


def pca_load(spark: SparkSession, path: str) -> dict:
    d = spark.read.parquet(path).orderBy("k").collect()
    return {"values": np.array([r.value for r in d]), "vectors": np.array([r.vector for r in d]), "mean": np.array(d[0]["mean"]), "sigma": np.array(d[0]["sigma"]), "energy": d[0].energy}


def pca_bootstrap(rows: DataFrame, vector: str, order: str, replicates: int = 10, seed: int = 11) -> DataFrame:
    """replicate, energy, ratios (falling) of the principal values when each column is drawn anew with replacement.

    Rows are numbered by `order` (a sort; the counts of its partitions give each its start). The draw of replicate
    r, column c and row i is a hash of the three, so reruns agree. Draws join the values by column and number; each
    task then sums products of its rows, and the driver holds `replicates` matrices of d by d. Fewer than two
    columns or rows, or fewer than 10 replicates, are an error.
    """
    first = rows.select(F.size(vector)).first()
    n = rows.count()
    if first is None or first[0] < 2 or n < 2 or replicates < 10:
        raise ValueError("a bootstrap needs two columns, two rows and ten replicates at least")
    d = first[0]
    at = cut(rows.select(F.col(order).alias("__o"), F.col(vector).cast("array<double>").alias("v")).orderBy("__o").withColumn("__at", F.monotonically_increasing_id()))
    counts = at.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count(F.lit(1)).alias("c"))
    starts = counts.withColumn("start", F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("c")
    numbered = at.withColumn("part", F.shiftright("__at", 33)).join(starts, "part").select((F.coalesce("start", F.lit(0)) + F.col("__at").bitwiseAND((1 << 33) - 1)).alias("i"), "v")
    long = numbered.select("i", F.posexplode("v").alias("c", "value"))
    wanted = long.select("c", F.col("i").alias("to"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r")).withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "r", "c", "to"), F.lit(n)))
    drawn = wanted.join(long, ["c", "i"]).groupBy("r", "to").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "value"))), lambda s: s["value"]).alias("v"))

    def sums(batches):
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for r, g in pdf.groupby("r"):
                x = np.c_[np.ones(len(g)), np.stack(g["v"].to_numpy())]
                held[r] = held.get(r, 0) + x.T @ x
        for r, m in held.items():
            i, j = np.triu_indices(d + 1)
            yield pd.DataFrame({"r": r, "i": i, "j": j, "s": m[i, j]})

    total = drawn.mapInPandas(sums, "r int, i int, j int, s double").groupBy("r", "i", "j").agg(F.sum("s").alias("s")).collect()
    moments = np.zeros((replicates, d + 1, d + 1))
    for t in total:
        moments[t.r, t.i, t.j] = moments[t.r, t.j, t.i] = t.s
    out = []
    for r, m in enumerate(moments):
        values = np.linalg.eigvalsh((m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n) / (n - 1))[::-1]
        out.append((r, float(values.sum()), [float(v) for v in values / values.sum()]))
    return rows.sparkSession.createDataFrame(out, "replicate int, energy double, ratios array<double>")
