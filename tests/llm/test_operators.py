"""Each operator against a plain version, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import common, decontaminate, exact, extract, mixing, pii, quality, simhash, substring, train_blocks, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, block string, n long, row long"


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sigma".split()) + str(r.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    passage = words(r, 70)
    texts = [words(r, r.randint(1, 120)) for _ in range(60)]
    texts += [None, "", " \t\n", None, texts[3], texts[3].replace(" ", "\n"), texts[4] + " ", texts[5].upper()]
    texts += [words(r, 20) + " " + passage + " " + words(r, 20) for _ in range(6)] + ["same " * 300, "same " * 300]
    texts += [texts[7] + " extra", words(r, 5000), "näive café ☃ 😀 text"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", "c", None)[i % 4], None, 1, "x", 2, 3) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[1], None, "a", None, 0, "", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact(docs, none, corpus):
    groups = {}
    for row in corpus:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", row[1] or ""), []).append((-len(row[1] or ""), row[0] is None, row[0] or 0))
    want = []
    for k, g in groups.items():
        keep = min(g)
        keep = None if keep[1] else keep[2]
        want += [(None if b else i, keep, len(g), hashlib.sha256(k.encode()).hexdigest()) for _, b, i in g]
    got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact.duplicate_groups(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    left = exact.dedup(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact.duplicate_groups(none).count() == exact.dedup(none).count() == 0


def test_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "a b", "s1", 1, 2), (2, "ab", "s2", 3, 4), (3, "c", "s3", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __sha string, h int, maybe int")
    left = exact.dedup(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [rows[0], rows[2]]


def test_bloom_lets_all_repeats_pass(spark):
    rows = spark.range(3000).select(F.xxhash64(F.when(F.col("id") < 400, F.col("id") % 200).otherwise(F.col("id"))).alias("h"), (F.col("id") < 400).alias("twice"))
    bits = common.bloom_bits(3000)
    got = common.probe(rows, "h", common.bloom(rows, "h", bits, repeated=True), bits, "maybe")
    assert got.filter("twice and not maybe").count() == 0
    assert got.filter("maybe and not twice").count() < 150


def test_mixing(docs, none, corpus):
    got = mixing.mixture(docs).collect()
    assert len(got) == len(corpus)
    size = {}
    for row in corpus:
        size[row[3]] = size.get(row[3], 0) + len(split(row[1]))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_, total = {}, set(order), sum(size.values())
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            open_.remove(s)
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(r["size"] for r in got) == total
    for s in order:
        assert abs(taken[s] - target[s]) < 0.06 * target[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs.repartition(5)).collect()))
    assert mixing.mixture(none).count() == 0


def test_mixing_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL", 700)
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 4 == 0, "s").otherwise("t").alias("source"))
    got = mixing.mixture(rows).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert {r.source: r.n for r in got} == {"s": 5000, "t": 15_000} and all(abs(r.taken - r.target) < 0.01 * r.target and r.most <= 3 for r in got)


def test_balancing_reports_goals_out_of_reach(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("b", "y", 100)], "f string, g string, size long")
    goals = {"f": spark.createDataFrame([("a", 50.0), ("b", 150.0)], "f string, target double"), "g": spark.createDataFrame([("x", 150.0), ("y", 50.0)], "g string, target double")}
    with pytest.raises(ArithmeticError):
        mixing.balanced(cells, goals, rounds=4)


def test_balancing_meets_two_families(spark):
    cells = spark.createDataFrame([("a", "x", 100), ("a", "y", 300), ("b", "x", 200), ("b", "y", 50)], "f string, g string, size long")
    goals = {"f": spark.createDataFrame([("a", 300.0), ("b", 350.0)], "f string, target double"), "g": spark.createDataFrame([("x", 250.0), ("y", 400.0)], "g string, target double")}
    out = mixing.balanced(cells, goals, rounds=15, tolerance=1e-3)
    for family, goal in goals.items():
        sums = {r[0]: r[1] for r in out.groupBy(family).agg(F.sum(F.col("size") * F.col("rate"))).collect()}
        for r in goal.collect():
            assert abs(sums[r[0]] - r.target) < 0.01 * r.target


def test_targets_stop_at_three_times(spark):
    t = spark.createDataFrame([("a", 10, 3), ("b", 1000, 1), ("c", 990, 2)], "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.targets(t).collect()}
    assert got["a"] == 30 and abs(got["b"] - 1970 / 3) < 1e-6 and abs(got["c"] - 2 * 1970 / 3) < 1e-6


def brute_repeats(corpus):
    first = {}
    for row in corpus:
        w = split(row[1])
        for k in range(len(w) - 49) if row[0] is not None else ():
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, row[0]), row[0])
    want = []
    for row in corpus:
        w = split(row[1])
        gone = [False] * len(w)
        for k in range(len(w) - 49) if row[0] is not None else ():
            if first[tuple(w[k : k + 50])] < row[0]:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((row[0], len(w), sum(gone), kept, hashlib.sha256(kept.encode()).hexdigest()))
    return want


def test_substring(docs, none, corpus):
    want = brute_repeats(corpus)
    got = [tuple(r) for r in substring.without_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(w[2] for w in want)
    assert substring.without_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [20_000, 3])
def test_substring_of_near_copies(spark, monkeypatch, hot):
    """One passage in many documents, each with a word of its own: its minimisers have many different runs."""
    r = random.Random(5)
    passage = [f"w{r.randrange(400)}" for _ in range(130)]
    rows = []
    for i in range(60):
        w = list(passage)
        w[r.randrange(130)] = f"own{r.randrange(20)}"
        rows.append((i, " ".join([f"a{i}"] * r.randrange(3) + w)))
    parts = []
    chosen = substring.hot_minimisers
    monkeypatch.setattr(substring, "hot_minimisers", lambda *a: parts.append(chosen(*a)) or parts[-1])
    got = [tuple(x) for x in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()]
    assert sorted(got) == sorted(brute_repeats(rows)) and sum(x[2] for x in got) > 2000
    assert (parts[0] is not None) == (hot == 3)


def brute_fingerprint(text):
    w = [x for x in (text or "").encode().lower().split()]
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(rows, links):
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(len(rows))]


def test_simhash(docs, none, corpus):
    fps = [brute_fingerprint(row[1]) for row in corpus]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    cls = brute_classes(corpus, links)
    least = {}
    for c, row in zip(cls, corpus):
        if row[0] is not None:
            least[c] = min(least.get(c, row[0]), row[0])
    want = [(row[0], fp, least[c]) for row, fp, c in zip(corpus, fps, cls)]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [20_000, 5])
def test_trie_finds_all_links(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_NODE", hot)
    r = random.Random(3)
    values = [r.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        values += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(4)]
    values += [values[0] ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(a)]
    values = sorted(set(values))
    links = [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 2]
    want = brute_classes(values, links)
    table = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    at = {v: i for i, v in enumerate(values)}
    got = brute_classes(values, [(at[x.u % (1 << 64)], at[x.v % (1 << 64)]) for x in simhash.links(table, 10).collect()])
    assert {(a == b) for a, b in zip(want, got)} and len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(r.randint(300, 500), r.randint(300, 500)) for _ in range(120)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    at = {n: i for i, n in enumerate(nodes)}
    cls = brute_classes(nodes, [(at[a], at[b]) for a, b in edges if a != b])
    least = {}
    for n, c in zip(nodes, cls):
        least[c] = min(least.get(c, n), n)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: least[c] for n, c in zip(nodes, cls)}


def test_tiling():
    item = list("abcdefghijklmnopqrst")
    doc = list("xx") + item[10:] + list("yyy") + item[:10] + list("z")
    assert sorted(t[2] for t in decontaminate.tile(doc, item)) == [10, 10]
    assert decontaminate.tile(list("abcd"), item) == []
    assert sum(t[2] for t in decontaminate.tile(item * 3, item)) == 20


def test_leaks(spark, none):
    r = random.Random(2)
    items = [(i, words(r, 40)) for i in range(5)] + [(8, "too short"), (9, None), (None, words(r, 40))]
    half = items[2][1].split()
    rows = [(0, words(r, 50)), (1, words(r, 9) + " " + items[1][1].upper() + "!"), (2, " ".join(half[20:]) + " x y " + " ".join(half[:20])), (3, " ".join(half[:8]) + words(r, 30)), (4, None), (5, ""), (1, items[1][1]), (None, items[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    small = sorted(map(str, decontaminate.leaks(docs, bench).collect()))
    assert [(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).orderBy("item_id").collect()] == [(1, 1), (1, 1), (2, 2), (None, 3)]
    assert small == sorted(map(str, decontaminate.leaks(docs, bench, most=1).collect()))
    assert sorted(x.doc_id for x in decontaminate.clean(docs, bench).collect()) == [0, 3, 4, 5]
    assert decontaminate.leaks(none, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_quality(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 7 == 0, i % 11 == 0
        t = words(r, 40)
        t = " ".join(w.upper() + "!!" for w in t.split()) if bad else t
        rows.append((i, t + (" vile nasty" if toxic else ""), "en", f"s{i % 5}", "e"))
        if i < 300:
            labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None, None, "e"), (901, "", "en", "s1", "e"), rows[5]]
    labels += [(5, None, 1), (None, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, p string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.judge(docs, lab).collect()}
    held = range(300, 400)
    assert sum(got[i].keep == (i % 7 != 0 and i % 11 != 0) for i in held) >= 97
    kept = quality.accepted(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(x.keep for x in quality.judge(docs, lab).collect())
    assert quality.judge(docs, lab.limit(0)).filter("keep").count() == len(rows)
    assert quality.judge(docs.limit(0), lab).count() == 0


def test_sites_shrink(spark):
    rows = [("big", "x", 0.9)] * 200 + [("bad", "x", 0.1)] * 100 + [("one", "x", 0.1)]
    table = spark.createDataFrame([(h, p, s) for h, p, s in rows], "host string, path string, p double")
    sites, mean = quality.site_posteriors(table)
    p = {x.host: x.host_p for x in sites.collect()}
    assert p["bad"] < 0.2 < p["one"] < mean < p["big"]


def test_pii(spark, none):
    rows = [
        (1, "mail a.b+c@ex-a.co.uk, ip 10.0.0.255 and 300.1.1.1, card 4111 1111 1111 1111 or 4111 1111 1111 1112"),
        (2, "call +49 (30) 1234-5678 now"), (3, None), (4, ""), (5, "é😀 x@y.de"), (5, "é😀 x@y.de"), (None, "1.2.3.4"),
    ]
    rows += [(10 + i, f"the secretword guy boss@corp.com said {'hello' if i % 2 else 'bye'}") for i in range(6)] + [(30 + i, f"plain hello bye the guy said {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("term", F.lit("x"))
    got = {}
    for r in pii.spans_of(docs).collect():
        got.setdefault(r.doc_id, []).append(([tuple(s) for s in r.base], [tuple(s) for s in r.terms]))
    t = rows[0][1]
    assert got[1][0][0] == [("email", 5, 5 + len("a.b+c@ex-a.co.uk")), ("ip", t.index("10.0"), t.index("10.0") + 10), ("card", t.index("4111"), t.index("4111") + 19)]
    assert got[2][0][0] == [("phone", 5, 23)] and got[3] == got[4] == [([], [])] and got[5] == [([("email", 3, 9)], [])] * 2
    assert got[None][0][0] == [("ip", 0, 7)]
    assert [s[0] for s in got[10][0][1]] == ["removed"] and rows[7][1][slice(*got[10][0][1][0][1:])] == "secretword"
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[10] == "the  guy [EMAIL] said bye" and clean[3] is None and clean[30] == rows[13][1]
    assert pii.spans_of(none).count() == 0
    six = docs.unionAll(docs).unionAll(docs)
    assert pii.spans_of(six.unionAll(six)).filter("size(terms) > 0").count() == 36


def test_secrets_by_disclosing_terms(spark):
    r = random.Random(4)
    hexed = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(8)]
    rows = [(i, f"{words(r, 20)} token = \"{h}\" {words(r, 20)}") for i, h in enumerate(hexed)]
    rows += [(100 + i, words(r, 40)) for i in range(80)] + [(200, "an id of build" + "er2" * 10)]
    got = {x.doc_id: [tuple(s) for s in x.terms] for x in pii.spans_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, h in enumerate(hexed):
        at = rows[i][1].index(h)
        assert ("secret", at, at + 40) in got[i] and ("removed", at - 9, at - 4) in got[i]
    assert not any(got[i] for i in got if i >= 100)


def test_context_against_brute_force():
    r = random.Random(8)
    for _ in range(300):
        text = "".join(r.choices(["ab", "é", " ", " ", "1", "@x.de", "a@b.cd", "zz zz ", "1.2.3.4"], k=30))
        spans, words_ = pii.base_spans(text), [m.span() for m in pii.LETTER_RUN.finditer(text)]
        free = [w for w in words_ if not any(w[0] < e and s < w[1] for _, s, e in spans)]
        want = []
        for kind, a, b in sorted(spans, key=lambda s: s[1:]):
            near = [w for w in free if w[0] < a][-3:] + [w for w in free if w[0] >= b][:3]
            want += [(k, text[x:y].lower(), x, y, kind, a, b) for k in pii.keys_of(kind, text[a:b]) for x, y in near]
        assert pii.context(text, spans, 3) == want
    assert [t[1] for t in pii.context("w" * 400 + " a@b.cd " + " " * 300 + "far", [("email", 401, 407)], 5)] == ["w" * 400, "far"] * 2
    began = time.time()
    text = "name a@b.cd " * 50_000
    assert len(pii.context(text, pii.base_spans(text), 5)) > 900_000 and time.time() - began < 30


def test_patterns_equal_sql(spark):
    """Cards and phones against plain scans of the contract's patterns."""
    r = random.Random(2)
    for _ in range(3000):
        t = "".join(r.choices("0123456789 -+().x", k=r.randint(0, 60)))
        want = [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert sorted(s for s in pii.base_spans(t) if s[0] in ("card", "phone")) == sorted(want)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_warc(spark):
    rows = [(i, f"http://a/{i}", "<p>" + "x" * (i % 50)) for i in range(2500)] + [(None, None, None)] * 3 + [(7, "u", "twice"), (None, "n", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"hash": F.lit(1), "at": F.lit(2)})
    a = warc.leaves(warc.records(pages))

    def audited(theirs):
        return {(r.record_id, r.status, r.ours, r.theirs) for r in warc.audit(a, warc.leaves(warc.records(theirs))).collect()}

    assert warc.audit(a, a).count() == 0
    change = F.when(F.col("page_id").isin(3, 1700), F.overlay("html", F.lit("?"), 1, 1)).otherwise(F.col("html"))
    assert audited(pages.withColumn("html", change)) == {(3, "changed", 1, 1), (1700, "changed", 1, 1)}
    lost = pages.filter("page_id is null or page_id not in (2, 1000, 2499)")
    gone = {(2, "missing", 1, 0), (1000, "missing", 1, 0), (2499, "missing", 1, 0)}
    assert audited(lost) == gone
    more = spark.createDataFrame([(7, "u", "again"), (2600, "v", ""), (None, "n", None)], "page_id long, url string, html string").withColumns({"hash": F.lit(1), "at": F.lit(2)})
    assert audited(lost.union(more)) == gone | {(7, "extra", 0, 1), (2600, "extra", 0, 1), (None, "extra", 0, 1)}
    assert audited(pages.filter("html <> 'twice' or html is null")) == {(7, "missing", 1, 0)}
    starts = {r.record_id: (r.start, r.length) for r in warc.audit(a, warc.leaves(warc.records(lost))).collect()}
    sizes = [len(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {u}\r\nContent-Length: {len(t)}\r\n\r\n{t}\r\n\r\n") for _, u, t in rows[:1000]]
    assert starts[2] == (sum(sizes[:2]), sizes[2]) and starts[1000][0] == 0
    assert warc.audit(a.limit(0), a.limit(0)).count() == 0 and warc.audit(a, a.limit(0)).agg(F.sum("ours")).first()[0] == 2505


def brute_tile(doc, item, least=5):
    """Every round looks at every pair of places."""
    used_d, used_i, tiles = set(), set(), []
    while True:
        best, matches = least - 1, []
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and i + k not in used_d and j + k not in used_i and doc[i + k] == item[j + k]:
                    k += 1
                if k > best:
                    best, matches = k, []
                if k == best and k >= least:
                    matches.append((j, i))
        if not matches:
            return tiles
        for j, i in matches:
            if not used_d & set(range(i, i + best)) and not used_i & set(range(j, j + best)):
                used_d |= set(range(i, i + best))
                used_i |= set(range(j, j + best))
                tiles.append((i, j, best))


def test_tiling_equals_brute_force():
    r = random.Random(6)
    for _ in range(300):
        doc, item = (r.choices("ab" if r.random() < 0.5 else "abcdefgh", k=r.randint(0, 40)) for _ in range(2))
        if r.random() < 0.5:
            cut = r.randint(0, len(item))
            doc = doc[:10] + item[cut:] + doc[10:] + item[:cut]
        assert decontaminate.tile(doc, item) == brute_tile(doc, item)


def test_tiling_of_one_word_is_bounded():
    began = time.time()
    assert sum(t[2] for t in decontaminate.tile(["w"] * 200_000, ["w"] * 500)) == 500
    assert sum(t[2] for t in decontaminate.tile(["w", "x"] * 50_000, ["x", "w", "w"] * 200)) == 0
    assert time.time() - began < 10


def test_clean_of_another_text_column(spark):
    r = random.Random(3)
    items = [(i, words(r, 40)) for i in range(4)]
    rows = [(i, items[i][1] if i < 2 else words(r, 40), "own", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (decontaminate.MAX_TOKENS, 1):
        left = decontaminate.clean(docs, bench, text_col="body", most=most)
        assert left.columns == docs.columns and {x.doc_id for x in left.collect()} == {2, 3, 4, 5}


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.com/en/x?q=1#f"), (2, "http://a.example.com/en/"), (3, "https://x.net/fr/a"), (4, None), (5, "no scheme"), (6, "http://b.org"), (7, "http://my.com?x=/en/"), (6, "http://b.org"), (8, "http://examplexcom/en/")]
    rows += [(100 + i, f"http://{'bad-shop' if i % 2 else f'h{i}'}.org/p/{i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("tokens", F.lit("clash"))
    labels = spark.createDataFrame([(100 + i, 1 - i % 2, 0) for i in range(40)] + [(1, None, 0)], "doc_id long, quality int, toxic int")
    got = urls.filtered(pages, labels).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (by[2].rule, by[2].verdict) == ("example.com/en/", "block") and by[3].rule == "net/fr/"
    assert (by[4].host, by[4].path, by[5].host, by[4].rule, by[6].path, by[7].path, by[7].rule, by[8].rule) == ("", "", "", None, "", "", None, None)
    assert by[159].verdict == "block" and by[158].verdict == "allow" and "h:bad-shop" in by[159].mined
    assert urls.filtered(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in urls.filtered(pages.filter("page_id > 99"), labels.limit(0)).collect()} == {"allow"}


def test_mined_rules_against_brute_force(spark):
    r = random.Random(7)
    rows = [(sorted(set(r.choices("abcdefgh", k=4))), False) for _ in range(120)]
    rows = [(t, {"a", "b"} <= set(t) or "c" in t and "d" in t and r.random() < 0.95 or "h" in t and r.random() < 0.9) for t, _ in rows]
    got = {tuple(x.needs): (x.hits, round(x.confidence, 6)) for x in urls.mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.001, 4, 0.8).collect()}
    hold = {}
    for k in range(1, 5):
        for c in combinations("abcdefgh", k):
            bad, every = sum(b for t, b in rows if set(c) <= set(t)), sum(set(c) <= set(t) for t, _ in rows)
            if bad >= 4 and bad >= 0.8 * every and not any(set(h) < set(c) for h in hold):
                hold[c] = (bad, round(bad / every, 6))
    assert got == hold and len(hold) > 2


def test_long_urls_are_mined_in_time(spark):
    r = random.Random(9)
    long = "/".join(f"word{i}" for i in range(40))
    rows = [(i, f"http://h{i % 7}.org/{long}") for i in range(6)] + [(50 + i, f"http://g{i}.org/{r.randint(0, 99)}") for i in range(60)]
    labels = spark.createDataFrame([(i, 0, 0) for i in range(6)] + [(50 + i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    began = time.time()
    got = urls.filtered(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {x.page_id for x in got if x.verdict == "block"} == set(range(6)) and time.time() - began < 60


def test_extract(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div><article><h1>Head &amp; <i>tail</i></h1><p>One\n two <b>three<br><p>Four &lt;5&gt;.</p><div class="ad">Ad</div></article><footer>&copy; me</footer></body></html>'
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in extract.main_text(pages).collect()}
    assert got[1] == "Head & tail\nOne two three\nFour <5>." and got[2] == got[3] == "" and len(got) == 4
    assert extract.main_text(pages.limit(0)).count() == 0


def test_labeller_holds_out():
    assert train_blocks.accuracy(extract.Labeller.trained(), 200) > 0.97


def test_gradients_match_differences():
    draw, model = train_blocks.Pages(1), extract.Labeller.fresh(1)
    data = [draw.labelled() for _ in range(3)]
    x, there = extract._padded([p for p, _ in data])
    y = np.zeros(there.shape)
    for i, (_, t) in enumerate(data):
        y[: len(t), i] = t

    def loss():
        z = model.logits(x, there)[0].astype(float)
        return float((np.where(there, np.logaddexp(0, z) - y * z, 0)).sum() / there.sum())

    grads = model.gradients(x, there, y)
    for k in ("xf", "hb", "cf", "o"):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        old = model.w[k][at]
        model.w[k][at] = old + 0.01
        up = loss()
        model.w[k][at] = old - 0.01
        down = loss()
        model.w[k][at] = old
        assert abs((up - down) / 0.02 - grads[k][at]) < 0.02 * abs(grads[k][at]) + 1e-4


def test_emails_and_addresses_are_linear_and_equal_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    draw = random.Random(4)
    for _ in range(20_000):
        t = "".join(draw.choices("ab1.@_- é+", k=draw.randint(0, 30)))
        assert list(pii.emails(t)) == [m.span() for m in email.finditer(t)], t
        t = "".join(draw.choices("019. ", k=draw.randint(0, 30)))
        assert [m.span() for m in pii.IP.finditer(t)] == [m.span() for m in ip.finditer(t)], t
    began = time.time()
    for t in ("a" * 300_000 + " @", "9" * 300_000, "a@" * 150_000, "a.b" * 100_000 + "@"):
        pii.base_spans(t)
    assert time.time() - began < 20
