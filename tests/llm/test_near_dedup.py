"""The pipeline's near-dedup stage against brute-force Jaccard of 5-word shingles."""

import random

from test_operators import SCHEMA, brute_classes, words

import corpus_pipeline
from quadrille.llm import shingles


def brute_shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def brute_kept(rows):
    """(doc_id, text) of the rows that stay, where rows that tie on the least id have equal texts."""
    sets = [brute_shingles(r[1]) for r in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    best = {}
    for r, c in zip(rows, brute_classes(list(range(len(rows))), near), strict=True):
        key = (r[0] is None, r[0] or 0)
        if c not in best or key < best[c][0]:
            best[c] = (key, (r[0], r[1]))
    return sorted((x for _, x in best.values()), key=str), near


def test_near_dedup(spark, monkeypatch):
    r = random.Random(11)
    line = words(r, 12)
    texts = [words(r, r.randint(1, 150)) + (" " + line if k % 3 else "") for k in range(50)]
    for t in texts[:40]:
        for _ in range(r.randint(1, 3)):
            w = t.split()
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = "changed" + str(r.randint(0, 9))
            texts.append(" ".join(w))
    texts += [" ".join(f"w{i}" for i in range(a, a + 104)) for a in (0, 11, 12, 24)]  # 89 of 111 and 88 of 112 runs in common
    texts += [None, "", " \t", "One two", "one  TWO", "one two three"]
    rows = [(i, t, "en", "a", 1, 1, "x", 1, i) for i, t in enumerate(texts)]
    rows += [(3, "another text of an id that repeats", "en", "b", 1, 1, "x", 1, 1), (None, "a null id " + words(r, 30), None, None, 1, 1, "x", 1, 2)]
    rows += [rows[-1], (None, texts[7], "en", "a", 1, 1, "x", 1, 3), (5, texts[2], "en", "a", 1, 1, "x", 1, 3)]
    want, near = brute_kept(rows)
    fps = [corpus_bits(x[1]) for x in rows]
    assert sum((fps[a] ^ fps[b]).bit_count() > 2 for a, b in near) > 10  # pairs that 2 bits don't reach
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    for seen, block in ((shingles.SEEN, shingles.BLOCK), (1 << 30, 3)):  # with and without common and hot shingles
        monkeypatch.setattr(shingles, "SEEN", seen)
        monkeypatch.setattr(shingles, "BLOCK", block)
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == want
    assert stage(spark, docs.limit(0), "").count() == 0


def corpus_bits(t):
    from quadrille.llm.simhash import fingerprint

    return fingerprint((t or "").encode())


def test_simhash_groups_are_not_joined_again(spark, monkeypatch):
    """What SimHash has joined is left out of the exact join, which links its groups to the rest; alone a group doesn't move."""
    import numpy as np

    sets = [np.arange(k, 100 + k, dtype=np.int64) for k in (0, 1, 2, 3)] + [np.arange(1000, 1050 + k, dtype=np.int64) for k in (0, 1)]
    order = [0, 1, 2, 3]
    assert list(shingles.joined([sets[i] for i in order], None, np.array([7, 7, 7, 7]))) == []
    assert len(list(shingles.joined([sets[i] for i in order], None, np.array([7, 7, 2, 7])))) == 1
    table = spark.createDataFrame([(i, len(s), s.tolist()) for i, s in enumerate(sets)], "at long, n int, s array<long>")
    roots = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4)], "node long, root long")
    groups = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (4, 4), (5, 4)], "node long, root long")
    for block in (shingles.BLOCK, 4):
        monkeypatch.setattr(shingles, "BLOCK", block)
        got = {tuple(sorted(x)) for x in shingles.completed(table, roots, groups).collect()}
        assert got and all(3 in x and max(x) == 3 for x in got)
    # the whole stage hands SimHash's groups on
    given, made = [], shingles.completed
    monkeypatch.setattr(shingles, "completed", lambda s, r, g: given.append(g) or made(s, r, g))
    texts = [" ".join(f"w{i}" for i in range(300)), " ".join(f"w{i}" for i in range(299)) + " w7"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(shingles, "near_fingerprints", lambda sets, n: sets.sparkSession.createDataFrame([tuple(sorted(x.at for x in sets.select("at").collect()))], "u long, v long"))
    assert [x.doc_id for x in shingles.near_dedup(docs).collect()] == [0] and given[0].count() == 2
