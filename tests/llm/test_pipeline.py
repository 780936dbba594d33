"""Each stage of the pipeline on its own input against a plain version."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadrille.llm import mixing, quality
from test_near_dedup import brute_kept

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at, out = docs.columns, docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, SF).write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        out.append({r.doc_id: r for r in at.collect()})
        assert at.columns[: len(columns)] == columns
    rows = {r.doc_id: r for r in docs.collect()}

    judged = quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(out[0]) == {r.doc_id for r in judged.filter("keep").collect()}
    good = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1 and toxic = 0")
    assert sum(r.doc_id in out[0] for r in good.collect()) >= 0.97 * good.count()

    best = {}
    for i, r in out[0].items():
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(r.text or ""), i))
    assert set(out[1]) == {i for _, i in best.values()}

    kept, near = brute_kept([(i, r.text) for i, r in out[1].items()])
    assert sorted(out[2]) == sorted(i for i, _ in kept) and near

    def toks(t):
        return re.findall(r"\w+", (t or "").lower())

    items = [toks(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in items]
    clean, leaked = set(), set()
    for i in out[2]:
        t = toks(out[2][i].text)
        seen = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
        if not any(seen & g for g in grams):
            clean.add(i)
        if any(" ".join(x) in " ".join(t) for x in items):
            leaked.add(i)
    assert clean <= set(out[3]) and not leaked & set(out[3])

    mix = {r.doc_id: r.copies for r in mixing.mixture(spark.read.parquet(f"{tmp_path}/3")).collect() if r.copies}
    assert {i: r.copies for i, r in out[4].items()} == mix
    assert all(out[4][i].text == rows[i].text for i in out[4])
    assert corpus_pipeline.run(spark, SF).select(F.count("*"), F.sum("copies")).first() == (len(mix), sum(mix.values()))
