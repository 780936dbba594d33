"""What bounds the memory of a task or of the driver changes no result."""

import random

import numpy as np
import pytest

from quadrille.llm import common, decontaminate, mixing, quality, substring
from quadrille.llm.common import WordHash


@pytest.mark.parametrize("most_bytes", [1, 300, 10**9])
def test_bucket_passes_equal_brute_force(most_bytes):
    draw = random.Random(5)
    line = [draw.choice("abcd") for _ in range(60)]
    kmers = {}
    for k in range(30):
        at = draw.randrange(40)
        words = line[at : at + draw.randrange(6, 20)] if k % 3 else [draw.choice("ab") for _ in range(9)]
        kmers[k, -k, draw.randrange(3)] = [draw.randrange(5), 5 + draw.randrange(5) if k % 4 else 0, " ".join(words).encode()]
    kmers = {k: [least, max(least, most), w] for k, (least, most, w) in kmers.items()}
    holders = {}
    for least, _, words in kmers.values():
        w = words.split()
        for j in range(len(w) - 5):
            holders[tuple(w[j : j + 6])] = min(least, holders.get(tuple(w[j : j + 6]), least))
    want = set()
    for (a, c, off), (_, most, words) in kmers.items():
        w = words.split()
        want |= {(a, c, off + j, holders[tuple(w[j : j + 6])]) for j in range(len(w) - 5) if holders[tuple(w[j : j + 6])] < most}
    got = [(a, c, off + j, least) for a, c, off, n, least in substring.bucket_rows(kmers, 6, most_bytes) for j in range(n)]
    assert want and set(got) == want and len(got) == len(want)


def test_buckets_merge_equal_rows_of_many_tasks():
    import pyarrow as pa

    words = " ".join("abcdefgh").encode()
    row = {"mini": 1, "bucket": 0, "x1": 3, "x2": 4, "first": 2, "words": words}
    rows = [row | {"least": d, "most": d} for d in (9, 4, 7)] + [row | {"mini": 2, "least": 5, "most": 5}]
    batches = [pa.RecordBatch.from_pylist([r]) for r in rows]
    got = [tuple(r.values()) for b in substring._buckets(iter(batches), 6) for r in b.to_pylist()]
    assert got == [(3, 4, 2, 3, 4)]


def _chosen(words, y):
    """The words that tell the label, counted at one place."""
    out = []
    for w in sorted({x for t in words for x in t}):
        n, pos = sum(w in t for t in words), sum(v for t, v in zip(words, y, strict=True) if w in t)
        if n >= 3:
            z = abs(pos - n * y.mean()) / np.sqrt(y.mean() * (1 - y.mean()) * n * (1 - n / len(y)) + 1e-9)
            out.append((-z, w))
    return sorted(w for z, w in sorted(out)[: quality.CHOSEN] if -z >= quality.SIGNIFICANT)


def test_fit_chooses_words_by_grouped_counts(spark):
    draw = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        good, toxic = i % 2, int(i % 5 == 0)
        text = [f"w{draw.randrange(400)}" for _ in range(20_000 if i == 7 else 30)] + ["fine"] * good + ["nasty"] * toxic + ["rare"] * (i < 2)
        rows.append((i, " ".join(text)))
        labels.append((i, good, toxic))
    rows += rows[:3]  # rows that repeat count again
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.fit(docs, marks)
    words, _ = quality.featurised([t.encode() for _, t in rows], WordHash())
    for model, c in zip(got, (1, 2), strict=True):
        y = np.array([labels[i][c] for i, _ in rows], float)
        assert model.words.tolist() == _chosen([set(w.tolist()) for w in words], y) and len(model.words)
        assert (model.weights > 0).any()
    few = quality.fit(docs, marks, sample=40)
    assert few is not None and quality.fit(docs.limit(0), marks) is None and quality.fit(docs, marks.limit(0)) is None
    same = quality.fit(docs.repartition(7), marks, sample=40)
    assert all(np.array_equal(a.words, b.words) and np.allclose(a.surface, b.surface) for a, b in zip(few, same, strict=True))


def test_suite_hits_equal_brute_force():
    draw = random.Random(3)
    items = {k: [draw.choice("abc") for _ in range(draw.randrange(0, 14))] for k in range(12)}
    docs = [[draw.choice("abcx") for _ in range(n)] for n in (0, 3, 5, 40, 0, 80, 4)]

    def grams(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    want = {d: {k for k, v in items.items() if grams(v) & grams(words)} for d, words in enumerate(docs)}
    suite = decontaminate.Suite(list(items), items, 5)
    assert suite.hits([suite.array(d) for d in docs]) == {d: v for d, v in want.items() if v} != {}
    assert decontaminate.Suite([], {}, 5).hits([suite.array(d) for d in docs]) == {}


def test_large_suites_keep_what_small_ones_find(spark):
    draw = random.Random(4)
    items = [(k, " ".join(draw.choice("abcdefgh") for _ in range(draw.randrange(5, 30)))) for k in range(25)]
    docs = [(d, " ".join([items[d % 25][1][: draw.randrange(9, 60)], *(draw.choice("abcdefgh") for _ in range(40)), items[d % 7][1]])) for d in range(60)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    small, large = ({tuple(r) for r in decontaminate.leaks(d, b, most=m).collect()} for m in (10**6, 0))
    assert small == large and len(small) > 20


def _tasks(spark, run):
    """What run() gives, its jobs, and the tasks of their stages, with 40 partitions in each shuffle."""
    sc, old = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    group = f"bounded-{random.random()}"
    try:
        for k, v in zip(old, ("40", "false"), strict=True):
            spark.conf.set(k, v)
        sc.setJobGroup(group, group)
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    track = sc.statusTracker()
    jobs = [track.getJobInfo(j) for j in track.getJobIdsForGroup(group)]
    stages = {i: track.getStageInfo(i) for j in jobs for i in j.stageIds}
    return out, len(jobs), sum(s.numCompletedTasks for s in stages.values() if s)


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    draw = random.Random(6)
    edges = [(i + 1, i) for i in range(300)] + [(-7, 900), (900, -7), (5, 5)] + [(draw.randrange(1000, 1300), draw.randrange(1000, 1300)) for _ in range(150)]
    want = common.Forest()
    for a, b in edges:
        list(want.joins(np.array([a]), np.array([b])))
    want = {x: want.find(x) for e in edges if e[0] != e[1] for x in e}
    table = spark.createDataFrame(edges, "u long, v long").repartition(4)
    got, jobs, _ = _tasks(spark, lambda: common.components(table).collect())
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    assert jobs <= 6  # the driver keeps what it knows of each job, and rounds of stars take some seven each
    assert common.components(table.limit(0)).count() == 0
    monkeypatch.setattr(common, "EDGES", 100)  # more links stay in several partitions, and stars join them
    got = common.components(table).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want


def test_rounds_over_few_sources_are_few_tasks(spark):
    docs = spark.createDataFrame([(i, "a word " * (1 + i % 9), None if i % 5 == 4 else f"s{i % 5}") for i in range(200)], "doc_id long, text string, source string")
    rows, jobs, tasks = _tasks(spark, lambda: mixing.mixture(docs).collect())
    assert len(rows) == 200
    assert tasks < 15 * jobs  # not all 40 partitions in each
