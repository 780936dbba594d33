"""The site model against plain sums, and extraction on pages written by hand."""

import math
import random
from collections import defaultdict

import pytest

from held_back import PAGES as HELD_BACK
from quadrille.llm import extract, quality


def plain(rows):
    """(host_p, path_p, score) of rows (host, path, p), by loops."""

    def precision(sites):
        n, k = sum(s[1] for s in sites), len(sites)
        w = sum(c * m * (1 - m) for _, c, m in sites)
        if k < 2 or w <= 0:
            return 1e4
        between = (sum(c * (s / c - m) ** 2 for s, c, m in sites) - k * w / n) / n
        return min(1e4, max(1.0, w / n / between - 1)) if between > 0 else 1e4

    def logit(p):
        p = min(1 - 1e-9, max(1e-9, p))
        return math.log(p / (1 - p))

    paths, hosts = defaultdict(lambda: [0.0, 0]), defaultdict(lambda: [0.0, 0])
    for h, q, p in rows:
        for site in (paths[h, q], hosts[h]):
            site[0] += p
            site[1] += 1
    mean = sum(p for *_, p in rows) / len(rows)
    k = precision([(s, n, mean) for s, n in hosts.values()])
    host_p = {h: (s + k * mean) / (n + k) for h, (s, n) in hosts.items()}
    k = precision([(s, n, host_p[h]) for (h, _), (s, n) in paths.items()])
    out = []
    for h, q, p in rows:
        s, n = paths[h, q]
        path_p = (s - p + k * host_p[h]) / (n - 1 + k)
        out.append((host_p[h], path_p, 1 / (1 + math.exp(-(logit(p) + logit(path_p) - logit(mean))))))
    return out


@pytest.mark.parametrize("hosts", [("a",), ("a", "b", "c", None)])
def test_sites_equal_plain_sums(spark, hosts):
    r = random.Random(len(hosts))
    skew = {h: r.uniform(0.2, 0.9) for h in hosts}
    rows = [(h, q, min(1.0, max(0.0, r.gauss(skew[h] + 0.1 * (q == "x"), 0.2)))) for h in hosts for q in ("x", "y", None) for _ in range(r.choice((1, 7, 90)))]
    rows += rows[:5]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i long, host string, path string, p double")
    sites, mean = quality.site_posteriors(table)
    at = {(s.host, s.path): s.host_p for s in sites.collect()}
    got = {x.i: (at[x.host, x.path], x.path_p, x.score) for x in quality.combined(table, sites, mean).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(plain(rows)):
        assert got[i] == pytest.approx(want, abs=1e-9)


#: Pages that the generator of training layouts cannot draw: (html, main text).
PAGES = [
    (
        "<!doctype html><html><body><table><tr><td><a href='/'>Home</a></td><td><a href='/news'>News</a></td><td><a href='/about'>About</a></td></tr></table>"
        "<article><h1>Rain on the coast</h1><p>Heavy rain fell on the coast during the night, and two roads were closed until noon.</p>"
        "<p>The council said that crews would clear the drains before the next storm arrives on Friday.</p></article>"
        "<footer>Copyright 2020 The Coast Paper. All rights reserved.</footer></body></html>",
        "Rain on the coast\nHeavy rain fell on the coast during the night, and two roads were closed until noon.\nThe council said that crews would clear the drains before the next storm arrives on Friday.",
    ),
    (
        "<html><body><header><a href='/'>Garden notes</a></header><main><article><h2>Pruning roses</h2>"
        "<p>Prune in late winter, when the buds begin to swell but before the leaves open.<p>Cut each stem just above a bud that faces outward."
        "<ul><li>Use sharp shears.<li>Burn diseased wood.</ul></article></main><aside>Read next: Ten shrubs for shade</aside></body></html>",
        "Pruning roses\nPrune in late winter, when the buds begin to swell but before the leaves open.\nCut each stem just above a bud that faces outward.\nUse sharp shears.\nBurn diseased wood.",
    ),
    (
        "<html><body><nav><ul><li><a href='/a'>Start</a></li><li><a href='/b'>Archive</a></li></ul></nav><article><h1>A short history of glass</h1>"
        "<p>Glass was made in the valleys long before it was used for windows.</p><blockquote>It held the light, they wrote, and let it go.</blockquote>"
        "<p>Later makers learned to blow it &amp; to colour it.</p></article><section class='comments'><h3>Comments</h3><p>Great read, thanks!</p></section></body></html>",
        "A short history of glass\nGlass was made in the valleys long before it was used for windows.\nIt held the light, they wrote, and let it go.\nLater makers learned to blow it & to colour it.",
    ),
    (
        "<html><body><div class='cookie-notice'>We use cookies to improve this site. <button>Accept</button></div><article><p>One plain paragraph, which is all that this page has to say about the matter.</p></article>"
        "<form><input name=q><button>Search</button></form></body></html>",
        "One plain paragraph, which is all that this page has to say about the matter.",
    ),
    ("<nav><a href=/1>One</a> <a href=/2>Two</a></nav><footer>Imprint</footer>", ""),
]


def test_link_marks():
    names = [p.way()[-1].names for p, _ in extract.blocks("<ul><li><a href=/x>a b</a> | <a href=/y>c</a><li>see <a href=/x>c</a></ul><p>***</p><p><a name=k>d</a>")]
    assert names == [("a",), ("li",), ("p",), ("p",)]


def test_pages_written_by_hand(spark):
    pages = [(html, text.split("\n") if text else []) for html, text in PAGES]
    for some, least in ((pages, 0.9), (HELD_BACK, 0.95)):
        table = spark.createDataFrame([(i, "u", html) for i, (html, _) in enumerate(some)], "page_id long, url string, html string")
        got = {r.page_id: [b for b in r.text.split("\n") if b] for r in extract.main_text(table).collect()}
        found = sum(b in want for i, (_, want) in enumerate(some) for b in got[i])
        kept, wanted = sum(map(len, got.values())), sum(len(want) for _, want in some)
        print("blocks: precision", found, "of", kept, "recall", found, "of", wanted)
        assert found >= least * kept and found >= least * wanted
