"""Inputs that crashed or stalled an operator: long digit runs, urls of one template, columns with an operator's names."""

import random
import time

from pyspark.sql import functions as F
from test_operators import SCHEMA, words

import corpus_pipeline
from quadrille.llm import decontaminate, extract, pii, shingles, urls


def test_long_digit_runs(spark):
    zeros = "0" * 5000
    texts = [zeros + ".1.1.1 x " + zeros + "7.8.9.10", zeros + "1234.1.1.1", "9" * 6000 + " +" + "1" * 6000]
    got = {r.doc_id: r.base for r in pii.spans_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in got[0]] == [("ip", 0, 5006), ("ip", 5009, 10017)] and not got[1] and not got[2]


def test_long_references():
    assert extract.decoded("a&#" + "9" * 5000 + ";b&#x" + "f" * 5000 + ";c") == "a�b�c"
    assert extract.decoded("&#" + "0" * 5000 + "65;&#x" + "0" * 5000 + "41;&amp;&eacute;&#128512;&#8364 &#;&#x;") == "AA&é😀€ &#;&#x;"
    page = "<html><body><article><p>" + "word " * 30 + "&#" + "1" * 5000 + ";</p></article></body></html>"
    assert [t for _, t in extract.blocks(page)] == ["word " * 30 + "�"]


def test_urls_of_one_template_that_vary(spark):
    n = 40
    rows = [(i, [f"p:w{k}" for k in range(n) if k != i], True) for i in range(n)] + [(n + i, [f"p:w{k}" for k in range(n)], False) for i in range(n // 2)]
    rows += [(200 + i, ["t:org", f"h:site{i % 3}", *[f"p:s{i % 3}w{k}" for k in range(n) if k != i], "q:spam"], True) for i in range(30)]
    rows += [(300 + i, ["t:org", f"h:site{i % 3}", *[f"p:s{i % 3}w{k}" for k in range(n)]] + (["q:spam"] if i > 25 else []), False) for i in range(30)]
    began = time.time()
    got = urls.mined_rules(spark.createDataFrame(rows, "row long, tokens array<string>, bad boolean").drop("row"), 0.001, 5, 0.8).collect()
    assert {tuple(x.needs) for x in got} == {("q:spam",)} and time.time() - began < 60


def test_columns_with_our_names(spark):
    r = random.Random(4)
    rows = [(i, words(r, 30), "en", "ab"[i % 2], 1, 1, "x", 1, i) for i in range(20)]
    rows += [(30, rows[0][1] + " more", "en", "a", 1, 1, "x", 1, 1), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["__row", "__th", "__id", "__r", "__k", "__rank", "at", "root", "copies", "taken", "target", "c0", "c5"]
    odd = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    bench = spark.createDataFrame([(1, rows[5][1]), (2, None)], "item_id long, text string")
    near = shingles.near_dedup(odd)
    assert near.columns == odd.columns and sorted(x.doc_id for x in near.collect()) == sorted(x.doc_id for x in shingles.near_dedup(docs).collect())
    assert near.select(*names).distinct().collect() == [tuple(range(len(names)))]
    for most in (decontaminate.MAX_TOKENS, 1):
        left = decontaminate.clean(odd, bench, most=most)
        assert left.columns == odd.columns and left.count() == len(rows) - 1 and left.select(*names).distinct().count() == 1
    mixed = corpus_pipeline.mixing_stage(spark, odd, "")
    plain = corpus_pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == [c for c in odd.columns if c not in ("copies", "taken", "target")] + ["copies", "taken", "target"]
    assert mixed.agg(F.sum("taken")).first() == plain.agg(F.sum("taken")).first() and mixed.select("__row", "at", "c5").distinct().count() == 1
