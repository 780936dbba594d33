"""URL filters: curated host and path rules, and rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import cut

#: verdict, host, path. A rule fits its host and all below it, and paths that start with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A mined rule holds for this share of the labelled URLs, so many of them at least, and is right this often.
SUPPORT, COUNT, CONFIDENCE = 0.001, 5, 0.8
#: Mined rules are broadcast up to so many; a shuffle join takes them beyond.
SMALL = 50_000


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(rest, r"(?s)^[^/]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.substring(rest, F.length(host) + 1, F.length(rest))


def tokens(url: Column) -> Column:
    """Distinct parts of a URL, each with its place: host labels (the last as t:), path words, query keys, fragment."""
    host, path = host_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    tops = F.transform(F.slice(labels, -1, 1), lambda x: F.concat(F.lit("t:"), x))
    names = F.transform(F.slice(labels, 1, F.greatest(F.lit(0), F.size(labels) - 1)), lambda x: F.concat(F.lit("h:"), x))
    steps = F.filter(F.split(path, r"[/._~-]+"), lambda x: x != "")
    steps = F.transform(steps, lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    fragment = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)#(.*)$", 1)
    end = F.when(fragment != "", F.array(F.concat(F.lit("f:"), fragment))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.when(F.size(labels) > 0, F.concat(names, tops)).otherwise(F.array().cast("array<string>")), steps, keys, end))


def alike_tokens(items: DataFrame) -> DataFrame:
    """(token, name, n): `items` (row, token, bad) by token, with the least token that stands in just the same rows.

    Tokens of the same rows (say, of one long path that is linked often) are one item to the miner, which else would
    count all their subsets. Rows are compared by their number and two sums of hashes.
    """
    sums = [F.sum(F.xxhash64("row", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    tokens = cut(items.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("b"), *sums))
    names = tokens.groupBy("n", "s0", "s1").agg(F.min("token").alias("name"))
    return cut(tokens.join(names, ["n", "s0", "s1"]).select("token", "name", "n", "b"))


def conditional(baskets: DataFrame, tokens: DataFrame, good: int, least: int) -> DataFrame:
    """items of bad URLs: for each anchor in a basket the commoner tokens beside it, each as JSON [anchor, token].

    Left are the tokens that stand in some, but not all, of the anchor's good URLs, beside it in at least `least` bad
    ones; and anchors that aren't in all good URLs. Dropping another from a rule would spare no good URL, and lose no
    bad one, so the shorter set is a rule too. Sets of one anchor never mix with those of others.
    """
    # each token stands in a share `support` of the urls, so there are as many as a url has on average, over support
    size = F.broadcast(tokens.select("token", F.struct("n", "token").alias("place")))
    ordered = baskets.select("row", "bad", F.explode("items").alias("token")).join(size, "token")
    whole = ordered.groupBy("row", "bad").agg(F.sort_array(F.collect_list("place")).alias("p"))
    beside = whole.select("row", "bad", F.posexplode("p").alias("at", "a"), "p").select("row", "bad", F.col("a.token").alias("anchor"), F.explode(F.slice("p", F.col("at") + 2, F.size("p"))).alias("t"))
    beside = beside.select("row", "bad", "anchor", F.col("t.token").alias("token"))
    own = ordered.filter("not bad").groupBy(F.col("token").alias("anchor")).agg(F.count(F.lit(1)).alias("g"))
    pairs = beside.groupBy("anchor", "token").agg(F.sum((~F.col("bad")).cast("long")).alias("both"), F.sum(F.col("bad").cast("long")).alias("b")).filter(F.col("b") >= least)
    free = pairs.join(own, "anchor").filter((F.col("both") < F.col("g")) & (F.col("g") < good)).select("anchor", "token")
    kept = beside.filter("bad").join(free, ["anchor", "token"])
    return kept.groupBy("row", "anchor").agg(F.collect_list(F.to_json(F.array("anchor", "token"))).alias("items")).select("items")


def mined_rules(labelled: DataFrame, support: float = SUPPORT, count: int = COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """(anchor, needs, confidence, hits): token combinations that foretell a bad URL, by Spark's FP-growth.

    labelled: tokens array, bad boolean. Of rules that hold, the shortest are kept: one that contains another is
    dropped. So tokens that are a rule by themselves are taken first and FP-growth combines only the others, of bad
    URLs; tokens that always go together are one item. anchor is the rarest of a rule's tokens, under which the
    inverted index finds it. Baskets are those of an anchor (conditional): what spares no good URL of the anchor can't
    be in a shortest rule with it, so a site's template words drop out before sets of them are listed.
    """
    rows = cut(labelled.select("tokens", "bad", F.monotonically_increasing_id().alias("row")))
    n = rows.count()
    empty = rows.sparkSession.createDataFrame([], "anchor string, needs array<string>, confidence double, hits long")
    least = max(count, math.ceil(support * n))
    if n < count or rows.filter("bad").count() < least:
        return empty
    items = rows.select("row", "bad", F.explode("tokens").alias("token"))
    tokens = alike_tokens(items).filter(F.col("b") >= least)
    single = tokens.filter(F.col("b") >= confidence * F.col("n"))
    alone = single.select(F.col("token").alias("anchor"), F.array("token").alias("needs"), (F.col("b") / F.col("n")).alias("confidence"), F.col("b").cast("long").alias("hits"))
    others = tokens.join(single.select("token"), "token", "left_anti")
    baskets = cut(items.join(F.broadcast(others.filter("token = name").select("token")), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("items")))
    bad = cut(conditional(baskets, others, rows.filter("not bad").count(), least))
    m = bad.count()
    if not m:
        return alone
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / m), minConfidence=1.0).fit(bad).freqItemsets.filter(F.col("freq") >= least)
    anchored = sets.select(F.transform("items", lambda x: F.from_json(x, "array<string>")).alias("p"), F.col("freq").alias("hits"))
    sets = cut(anchored.select(F.col("p")[0][0].alias("anchor"), F.array_sort(F.concat(F.array(F.col("p")[0][0]), F.transform("p", lambda x: x[1]))).alias("needs"), "hits"))
    good = baskets.filter("not bad").select(F.col("items").alias("has"), F.explode("items").alias("anchor")).join(sets, "anchor").filter(F.size(F.array_except("needs", "has")) == 0)
    sets = sets.join(good.groupBy("needs").agg(F.count(F.lit(1)).alias("g")), "needs", "left").withColumn("confidence", F.col("hits") / (F.col("hits") + F.coalesce("g", F.lit(0))))
    rules = cut(sets.filter(F.col("confidence") >= confidence).select("anchor", "needs", "confidence", "hits"))
    parts = rules.select(F.col("needs").alias("r"), F.explode("needs").alias("anchor"))
    wider = parts.join(rules.select("anchor", F.col("needs").alias("g")), "anchor").filter((F.size("g") < F.size("r")) & (F.size(F.array_except("g", "r")) == 0)).select(F.col("r").alias("needs")).distinct()
    return alone.union(rules.join(wider, "needs", "left_anti").select("anchor", "needs", "confidence", "hits"))


def filtered(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", support: float = SUPPORT, count: int = COUNT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, mined (the mined rule that fits, or null).

    The longest curated rule that fits decides; else a fitting mined rule blocks, and what none fits is allowed.
    Labels belong to the page of their id: bad is quality 0 or toxic 1; rows with null labels are left out. A
    null url, or one without ://, has empty host and path and no tokens. Rows that repeat an id are judged each.
    Extra columns change nothing; long urls of many parts are one basket each. Without labels nothing is mined; an
    empty table gives an empty one.
    """
    host, path = host_path(F.col(url_col))
    rows = cut(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), tokens(F.col(url_col)).alias("tokens"), F.monotonically_increasing_id().alias("row")))
    judged = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).dropna()
    mined = cut(mined_rules(rows.join(judged, "page_id").filter(F.size("tokens") > 0), support, count, confidence))
    index = F.broadcast(mined) if mined.count() <= SMALL else mined
    hits = rows.select("row", "tokens", F.explode("tokens").alias("anchor")).join(index, "anchor").filter(F.size(F.array_except("needs", "tokens")) == 0)
    best = hits.groupBy("row").agg(F.max(F.struct("confidence", "hits", F.array_join("needs", " ").alias("r")))["r"].alias("mined"))
    verdict = name = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        verdict, name = F.when(fits, v).otherwise(verdict), F.when(fits, h + p).otherwise(name)
    return (
        rows.join(best, "row", "left")
        .withColumns({"rule": name, "verdict": F.coalesce(verdict, F.when(F.col("mined").isNotNull(), "block"), F.lit("allow"))})
        .select("page_id", "host", "path", "rule", "verdict", "mined")
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op9_url_rules": op9_url_rules}
