"""Mixing sources to target weights: entropy balancing by Newton steps on the dual, then whole copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import WORD, cut

#: A table of sources is broadcast up to so many rows (about 100 bytes each); a shuffle join takes it beyond.
SMALL = 100_000
#: Documents of a source that are rounded together.
CHUNK = 256
#: Equal rows are written out again in blocks of so many.
EQUAL = 10_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add rank (from 0) by source in code point order, null last: a sort, then counts of its partitions."""
    ordered = cut(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    parts = ordered.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("c"))
    before = parts.withColumn("before", F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).drop("c")
    return (
        ordered.withColumn("part", F.shiftright("at", 33))
        .join(F.broadcast(before), "part")
        .select(*sources.columns, (F.coalesce("before", F.lit(0)) + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))
    )


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """Add target to (source, source_size, weight): weight's share of all sizes, at most `most` source sizes.

    What is over goes to the others by weight, again until none is above: level t solves
    sum(min(most * size, t * weight)) = sum(size). Each pass is one aggregation that returns three numbers.
    """
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, filled = 0.0, -1
    while True:
        above = cap <= level * F.col("weight") if filled >= 0 else F.lit(False)
        c, w, n = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))).first()
        if n == filled or not w:
            level = level if w else float("inf")
            break
        level, filled = (total - (c or 0.0)) / w, n
    goal = cap if level == float("inf") else F.least(cap, F.lit(level) * F.col("weight"))
    return sources.withColumn("target", goal.cast("double"))


def balanced(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """Entropy balancing: add rate = exp(sum of the multipliers) to cells (families..., size), closest to 1 in
    relative entropy among those whose tokens meet every goal.

    goals: family column -> (family, target). The dual sum(size * exp(lam)) - sum(lam * target) is convex; its
    Hessian within a family is diagonal, so each round takes one Newton step for each family in turn, with the
    tokens summed by Spark and the step bounded by 1. A goal of no tokens gives rate 0. Goals that can't all be met
    within `rounds` raise an error. One family alone parts the dual into one equation for each member; its documents
    then share one rate, since nothing else tells them apart.
    """
    parts = cells.count() // SMALL + 1  # rounds over few cells are few tasks
    at = cut(cells.withColumn("lam", F.lit(0.0))).coalesce(parts)
    goals = {family: goal.coalesce(goal.count() // SMALL + 1) for family, goal in goals.items()}
    for _ in range(rounds):
        worst = 0.0
        for family, goal in goals.items():
            met = at.groupBy(family).agg(F.sum(F.col("size") * F.exp("lam")).alias("m"))
            step = met.join(goal, met[family].eqNullSafe(goal[family])).select(
                met[family].alias("__f"), F.when(F.col("target") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("target") - F.col("m")) / F.col("m")))).otherwise(F.lit(-745.0)).alias("step"), F.when(F.col("target") > 0, F.abs(F.col("m") / F.col("target") - 1)).otherwise(0.0).alias("off"),
            )
            at = cut(at.join(step, at[family].eqNullSafe(step["__f"]), "left").withColumn("lam", F.col("lam") + F.coalesce("step", F.lit(0.0))).withColumn("off", F.coalesce("off", F.lit(0.0))).select(*cells.columns, "lam", "off")).coalesce(parts)
            worst = max(worst, at.agg(F.max("off")).first()[0] or 0.0)
            at = at.drop("off")
        if worst < tolerance:
            break
    else:
        raise ArithmeticError(f"the dual did not converge in {rounds} rounds: some goal is missed by a share of {worst:.3g}")
    return at.withColumn("rate", F.exp("lam")).drop("lam")


def whole_copies(docs: DataFrame, most: int = 3) -> DataFrame:
    """Add copies to (doc_id, source, size, rate, n and, if given, row): whole numbers next to rate, whose tokens follow the rate.

    A source's documents are dealt by a hash of their id to chunks of about CHUNK. There, from the longest down,
    each takes the whole number (rate rounded down or up) that keeps the chunk's tokens nearest to rate times
    size, so what one leaves over the next ones make up; where their sizes can't, beside a giant, any number from
    0 to `most` is open to them. The deal depends on ids alone: reruns agree. `row` orders documents of one id and
    size; equal ones are numbered, so that they too are dealt to chunks of CHUNK.
    """
    row = ["row"] if "row" in docs.columns else []
    one = ["source", "doc_id", "size", *row]
    equal = docs.groupBy(*one, "rate", "n").agg(F.count(F.lit(1)).alias("m"))
    many = F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / EQUAL))
    blocks = equal.filter(F.col("m") > EQUAL).select("*", F.explode(many).alias("b")).repartition(*one, "b")
    blocks = blocks.withColumn("m", F.least(F.lit(EQUAL).cast("long"), F.col("m") - F.col("b") * EQUAL))
    equal = equal.filter(F.col("m") <= EQUAL).withColumn("b", F.lit(0).cast("long")).unionByName(blocks)
    numbered = equal.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("k")).withColumn("k", F.col("k") + F.col("b") * EQUAL)
    chunk = F.pmod(F.xxhash64("doc_id", "size", *row, "k"), F.greatest(F.lit(1), F.ceil(F.col("n") / CHUNK))).alias("chunk")
    held = numbered.select(*one, "rate", "k", chunk).groupBy("source", "chunk", "rate").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", *row, "k")), asc=False).alias("d"))
    rate = F.least(F.col("rate"), F.lit(float(most)))
    low = F.floor(rate + 1e-6).cast("int")
    high = F.least(F.lit(most), F.ceil(rate - 1e-6).cast("int"))

    def take(acc: Column, d: Column) -> Column:
        size = d["size"]
        lack = acc["lack"] + rate * size
        near = F.when(lack > (low + high) / 2 * size, high).otherwise(low)
        rest = acc["rest"] - size
        after = lack - near * size
        fits = (after <= (high - rate) * rest + size) & (-after <= (rate - low) * rest + size)
        free = F.greatest(F.lit(0), F.least(F.lit(most), F.round(lack / F.greatest(F.lit(1), size)).cast("int")))
        copies = F.when(fits, near).otherwise(free)
        return F.struct((lack - copies * size).cast("double").alias("lack"), rest.cast("long").alias("rest"), F.concat(acc["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0.0).alias("lack"), F.aggregate("d", F.lit(0).cast("long"), lambda t, d: t + d["size"]).alias("rest"), F.array().cast("array<int>").alias("copies"))
    picked = held.withColumn("copies", F.aggregate("d", start, take)["copies"])
    return picked.select("source", F.inline(F.arrays_zip("d", "copies"))).select(F.col("d.doc_id").alias("doc_id"), "source", F.col("d.size").alias("size"), "copies", *[F.col("d.row").alias(c) for c in row])


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, row_col: str | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken.

    Sources in code point order, null as one last source of its own, weigh 1, 2, 3 and so on in turn. Null and
    empty texts have size 0, are taken 0 times at rate 0 and change no sum. If every text is empty, all targets
    are 0. Rows that repeat an id are rounded each on its own, also equal ones; texts of any length are counted whole. An empty table gives an empty one. row_col, a hash
    that tells rows of one id apart, is passed on as `row`.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), *row))
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    few = sums.count() // SMALL + 1
    sums = sums.coalesce(few)
    weighed = cut(targets(cut(ranked(sums)).coalesce(few).withColumn("weight", F.pmod("rank", F.lit(3)) + 1), most)).coalesce(few)
    rates = balanced(weighed.select("source", F.col("source_size").alias("size")).filter("size > 0"), {"source": weighed.select("source", "target")})
    rates = cut(rates.select(F.col("source").alias("s"), "rate"))
    known = cut(weighed.join(rates, weighed["source"].eqNullSafe(rates["s"]), "left").select(F.col("source").alias("s"), "source_size", "n", "target", F.coalesce("rate", F.lit(0.0)).alias("rate")))
    if known.count() <= SMALL:
        known = F.broadcast(known)
    copies = whole_copies(sized.join(known, sized["source"].eqNullSafe(known["s"])).select("doc_id", "source", "size", "rate", "n", *(["row"] if row else [])), most)
    return copies.join(known, copies["source"].eqNullSafe(known["s"])).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if row else [])
    )


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op2_entropy_mix": op2_entropy_mix}
