"""Null and repeated ids of rows and of test items: each counts by itself."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_operators import SCHEMA, words

import corpus_pipeline
from quadrille.llm import common, decontaminate, mixing, quality


def test_mixing_keeps_null_and_repeated_ids(spark):
    r = random.Random(8)
    rows = [(i, words(r, r.randint(5, 60)), "en", "abc"[i % 3], 1, 1, "x", 1, i) for i in range(40)]
    rows += [(None, words(r, 20 + k), "en", "b", 1, 1, "x", 1, k) for k in range(6)] + [(7, words(r, 25), "en", "c", 1, 1, "x", 1, k) for k in range(6)]
    rows += [(50, words(r, 11), "en", "c", 1, 1, "x", 1, 0)] * 3 + [(None, None, None, None, None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    mixed = mixing.mixture(docs.withColumn("__row", common.row_hash(docs)), row_col="__row").filter("copies > 0")
    want = docs.select("doc_id", common.row_hash(docs).alias("row"), "text").distinct()
    want = mixed.join(want, mixed["doc_id"].eqNullSafe(want["doc_id"]) & (mixed["row"] == want["row"])).select(mixed["doc_id"], "text", "copies")
    assert Counter((x.doc_id, x.text, x.copies) for x in got) == Counter((x.doc_id, x.text, x.copies) for x in want.collect())
    assert any(x.doc_id is None for x in got) and len({x.text for x in got if x.doc_id == 7}) > 1
    plain = mixing.mixture(docs).filter("copies > 0").agg(F.count("*"), F.sum("taken")).first()
    assert (len(got), sum(x.taken for x in got)) == tuple(plain)
    again = corpus_pipeline.mixing_stage(spark, docs.repartition(2), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_leaks_of_repeated_and_null_item_ids(spark):
    r = random.Random(9)
    items = [(1, words(r, 30)), (1, words(r, 30)), (None, words(r, 30)), (None, words(r, 30)), (2, words(r, 30)), (2, None)]
    items += [items[0]]
    rows = [(k, words(r, 6) + " " + t) for k, (_, t) in enumerate(items[:5])] + [(None, items[1][1]), (None, words(r, 40)), (3, words(r, 40)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    want = Counter([(0, 1), (1, 1), (2, None), (3, None), (4, 2), (None, 1)])
    for most in (decontaminate.MAX_TOKENS, 1):
        assert Counter((x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench, most=most).collect()) == want
        left = decontaminate.clean(docs, bench, most=most)
        assert left.columns == docs.columns and Counter(map(tuple, left.collect())) == Counter(rows[6:])


def test_quality_of_hostile_rows(spark):
    good, bad = "a calm and useful sentence about rivers.", "BUY!!! $$$ CLICK"
    texts = [good, bad] * 15 + [None, "", "word " * 200_000, good, good]
    rows = [(i if i < 33 else 33, None if i == 32 else "s0" if i > 32 else f"s{i % 2}", None if i == 31 else "en", t, 0.5, "h", "q") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, p double, host string, path string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 2)) for i in range(30)] + [(31, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.accepted(docs, labels)
    kept = [tuple(r) for r in got.collect()]
    judged = [r for r in quality.judge(docs, labels).collect()]
    assert got.columns == docs.columns and len(judged) == len(rows) and len(kept) == sum(r.keep for r in judged)
    assert {r[0] for r in kept} == {r.doc_id for r in judged if r.keep} and kept.count(rows[33]) in (0, 2)
    assert {r[0] for r in kept if r[0] < 30} == set(range(0, 30, 2))
    assert len({r.keep for r in judged if r.doc_id == 33}) == 1
    assert quality.accepted(docs, labels.limit(0)).count() == len(rows)
    assert quality.accepted(docs.limit(0), labels).count() == 0
