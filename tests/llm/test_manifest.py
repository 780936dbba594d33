"""The manifest against a plain tree, its append log against a plain postorder, and its closed-form positions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quadrille.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(leaves):
    """Levels of a tree over hex leaves."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        r = i // 16 * 16
        yield level[r:i], level[i + 1 : r + 16]
        i //= 16


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 700])
@pytest.mark.parametrize("height", [1, 2, 3])
def test_positions(n, height):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    log, _ = manifest.appended(leaves, height)
    count = manifest.sizes(n, height)
    places = [manifest.position(level, j, count) for level in range(height) for j in range(count[level])]
    if count[-1] == 1:
        places.append(manifest.position(height, 0, count))
        assert sorted(places) == list(range(len(log) // 32))
    levels = [[x.hex() for x in leaves]]
    for _ in range(height):
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    for level in range(height):
        for j, want in enumerate(levels[level]):
            p = manifest.position(level, j, count)
            assert log[32 * p : 32 * p + 32].hex() == want


def expected(rows):
    as_leaf = lambda r, text: sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        leaf = as_leaf(r, r[4])
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf, as_leaf(r, r[4] and r[4].translate(lower)) if bad else leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain([x[2] for x in sorted(groups[s])]) for s in names]
    top = plain([t[-1][0] for t in trees])
    out = []
    for k, (s, t) in enumerate(zip(names, trees, strict=True)):
        for i, (known, doc, leaf, other) in enumerate(sorted(groups[s])):
            path = [*siblings(t, i), *siblings(top, k)]
            fold = other
            for a, b in path:
                fold = sha(*a, fold, *b)
            out.append((doc if known else None, leaf, t[-1][0], top[-1][0], sha(*[x for a, b in path for x in a + b]), fold, fold == top[-1][0]))
    return sorted(map(str, out))


@pytest.mark.parametrize("levels", [3, 1])
def test_manifest(spark, tmp_path, monkeypatch, levels):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "a", "a", "b", "é", "Z", "", None]), r.choice(["en", None]), r.choice([None, 7]), r.choice([None, "", "Some Text Ü", "x" * 50_000 + "ABC"]), i, "z") for i in range(700)]
    rows += [(None, None, None, None, None, 1, "z")] * 2 + [rows[5]] * 3 + [(5, rows[5][1], "de", 1, "UP", 1, "z"), (None, "only", None, None, "A", 1, "z")]
    rows += [(10_000 + i, f"s{i:03d}", None, None, None, 1, "z") for i in range(300)]
    if levels == 1:  # small builders, so that many rounds meet
        monkeypatch.setattr(manifest, "LEVELS", 1)
        monkeypatch.setattr(manifest, "ALIGNED", 16)
        rows = rows[:400:2]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string, at long, g string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = manifest.op12_postorder_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(x)) for x in got.collect()) == expected(rows)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert manifest.op12_postorder_manifest(spark, f"{tmp_path}/none").count() == 0


def test_numbered_spreads_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), ((F.col("id") * 7919) % 5003).alias("o"))
    got = manifest.numbered(rows, ["o"]).collect()
    for g in {x.g for x in got}:
        own = sorted((x.at, x.o) for x in got if x.g == g)
        assert [a for a, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for _, o in own) and {x.n for x in got if x.g == g} == {len(own)}
