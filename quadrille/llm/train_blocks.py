"""Trains the block labeller on page layouts drawn at random: python -m quadrille.llm.train_blocks

No crawl is needed: layouts are built from the parts that pages have (menus, headers, sidebars, notices, adverts,
forms, comments, footers around an article), filled with invented words; the generator knows which blocks are main.
"""

from __future__ import annotations

import random

import numpy as np

from quadrille.llm.extract import WEIGHTS, Labeller, _padded, blocks, vectors

MAIN, REST = "\x01", "\x02"
MENU = ("nav", 'div class="menu"', 'div id="navigation"', 'ul class="navbar"', 'div class="breadcrumb"', 'div class="toolbar"', 'div role="navigation"', 'div class="pagination"', 'div class="toc"')
AROUND = ("aside", 'div class="sidebar"', 'div id="sidebar"', 'div class="related"', 'div class="widget"', 'section class="recommended"', 'div class="share social"', 'div class="newsletter"', 'div class="tags"', 'div class="author-bio"', 'div role="complementary"')
NOTICE = ('div class="cookie"', 'div class="notice"', 'div id="cookie-banner"', 'div class="consent"', 'div class="alert"', 'div role="alert"', 'div class="popup"', 'div class="modal"', 'dialog', 'div class="gdpr"', 'div class="disclaimer"')
ADVERT = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div class="banner"', 'ins class="adsbygoogle"', 'aside class="ad"', 'section class="ad"', 'p class="ad"')
COMMENT = ('div class="comments"', 'section id="comments"', 'div class="comment"', 'ol class="comment-list"', 'section class="discussion"', 'div class="replies"', 'ul class="comments"', 'div id="disqus"', 'section class="comments"')
HEAD = ("header", 'div class="header"', 'div id="masthead"', 'div id="header"', 'header class="site-header"', 'div role="banner"')
FOOT = ("footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"', 'div role="contentinfo"')
ARTICLE = ("article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="article"', 'section class="story"', 'div class="entry"', 'article class="post"', 'main id="main"', 'div role="main"', 'div class="article-body"')


class Pages:
    """Draws pages; words carry a mark of whether their block is main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.words = ["".join(self.r.choice("bcdfghklmnprstvwz") + self.r.choice("aeiouäéñ") for _ in range(self.r.randint(1, 4))) for _ in range(3000)]

    def text(self, mark: str, low: int, high: int) -> str:
        r = self.r
        words = r.choices(self.words, k=r.randint(low, high))
        style = r.random()
        if style < 0.1:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.2:
            words = [w + r.choice(("***", "$$$", "%%%", "###", "&amp;&amp;&amp;")) for w in words]
        elif style < 0.27:
            words = [r.choice(words)] * len(words)
        elif style < 0.33:
            words = " | ".join(words).split()
        if r.random() < 0.7:
            words[-1] += "."
        return mark + " ".join(words)

    def inside(self, tag: str, body: str) -> str:
        return f"<{tag}>{body}" + (f"</{tag.split()[0]}>")

    def named(self, tag: str) -> str:
        """The tag, or at times one of its kind whose class says nothing."""
        return f'{tag.split()[0]} class="{self.r.choice(self.words)}{self.r.randint(1, 9)}"' if self.r.random() < 0.3 else tag

    def anchors(self, low: int, high: int) -> list[str]:
        return [f'<a href="/x">{self.text(REST, 1, 3)}</a>' for _ in range(self.r.randint(low, high))]

    def links(self) -> str:
        """A menu that only its links and its place tell: a row or cell of a table, a plain list, a row of anchors."""
        r = self.r
        kind = r.randrange(5)
        items = self.anchors(1, 8)
        if kind == 0:
            return self.inside("table", self.inside("tr", "".join(self.inside("td", a) for a in items)))
        if kind == 1:
            return self.inside("table", self.inside("tr", self.inside("td", "<br>".join(items))))
        if kind == 2:
            return self.inside(r.choice(("ul", "ol")), "".join("<li>" + a for a in items))
        return self.inside(self.named(r.choice(("div", "p", "div"))), r.choice((" ", " | ", " &gt; ", "")).join(items))

    def menu(self) -> str:
        items = self.anchors(1, 8)
        if self.r.random() < 0.25:
            return self.inside(self.r.choice(MENU), self.r.choice((" ", " | ", "")).join(items))
        return self.inside(self.r.choice(MENU), "<ul>" + "".join(self.inside("li", a) for a in items) + "</ul>")

    def boxed(self, tags) -> str:
        r = self.r
        body = "".join(r.choice((lambda: f"<p>{self.text(REST, 2, 60)}</p>", lambda: self.text(REST, 1, 40), lambda: f"<h3>{self.text(REST, 1, 5)}</h3>", lambda: f"<ul><li>{self.text(REST, 1, 6)}</li><li>{self.text(REST, 1, 6)}</li></ul>", lambda: f"<div>{self.text(REST, 3, 40)}</div>"))() for _ in range(r.randint(1, 4)))
        return self.inside(r.choice(tags), body)

    def form(self) -> str:
        r = self.r
        return self.inside(r.choice(("form", 'form class="search"', 'form id="subscribe"', 'div class="login form"')), f"<p>{self.text(REST, 1, 20)}</p><label>{self.text(REST, 1, 4)}</label><input name=q><button>{self.text(REST, 1, 2)}</button>")

    def article(self) -> str:
        r = self.r
        if r.random() < 0.08:  # one paragraph is all
            return self.wrapped(f"<p>{self.text(MAIN, 1, 60)}</p>")
        parts = [f"<h1>{self.text(MAIN, 1, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 14)):
            parts.append(r.choices((lambda: f"<p>{self.text(MAIN, 1, 90)}</p>", lambda: f"<p>{self.text(MAIN, 1, 90)}", lambda: f"<p><b>{self.text(MAIN, 1, 40)}<br>", lambda: f"<h2>{self.text(MAIN, 1, 7)}</h2>", lambda: "<ul>" + "".join(f"<li>{self.text(MAIN, 1, 20)}</li>" for _ in range(3)) + "</ul>", lambda: "<ol>" + "".join(f"<li>{self.text(MAIN, 1, 20)}" for _ in range(r.randint(1, 6))) + "</ol>", lambda: f"<blockquote>{self.text(MAIN, 3, 40)}</blockquote>", lambda: f"<blockquote><p>{self.text(MAIN, 3, 40)}</p></blockquote>", lambda: f"<table><tr><td>{self.text(MAIN, 1, 4)}</td><td>{self.text(MAIN, 1, 4)}</td></tr></table>", lambda: f"<pre>{self.text(MAIN, 3, 30)}</pre>", lambda: f"<div>{self.text(MAIN, 3, 60)}</div>", lambda: f"<section><p>{self.text(MAIN, 3, 60)}</p></section>", lambda: f"<figure><figcaption>{self.text(MAIN, 2, 12)}</figcaption></figure>", self.table, self.terms, lambda: f"<h3>{self.text(MAIN, 1, 7)}</h3>", lambda: f'<p>{self.text(MAIN, 2, 20)} <a href="/x">{" ".join(r.choices(self.words, k=2))}</a> {" ".join(r.choices(self.words, k=r.randint(1, 20)))}', lambda: self.text(MAIN, 3, 60)), (40, 12, 8, 6, 3, 2, 2, 3, 2, 2, 3, 3, 1, 2, 2, 3, 3, 2))[0]())
            if r.random() < 0.12:
                parts.append(r.choice((lambda: self.boxed(ADVERT), self.form, lambda: self.boxed(AROUND), lambda: self.boxed(COMMENT), self.menu, lambda: self.boxed(NOTICE)))())
        if r.random() < 0.15:
            parts.append(self.boxed(COMMENT))
        return self.wrapped("".join(parts))

    def table(self) -> str:
        ends, wide = self.r.random() < 0.5, self.r.randint(1, 4)
        cells = [["".join(f"<{c}>{self.text(MAIN, 1, 5)}" + (f"</{c}>" if ends else "") for _ in range(wide)) for c in ("th" if not i else "td",)][0] for i in range(self.r.randint(1, 5))]
        return "<table>" + "".join("<tr>" + c + ("</tr>" if ends else "") for c in cells) + "</table>"

    def terms(self) -> str:
        ends = self.r.random() < 0.5
        return "<dl>" + "".join(f"<{k}>{self.text(MAIN, 1, n)}" + (f"</{k}>" if ends else "") for _ in range(self.r.randint(1, 5)) for k, n in (("dt", 3), ("dd", 20))) + "</dl>"

    def wrapped(self, body: str) -> str:
        """An article in its element, in a box that says nothing, in a cell of a layout table, or in none."""
        r = self.r
        if r.random() < 0.5:
            return self.inside(r.choice(ARTICLE), body)
        kind = r.randrange(6)
        if kind < 2:
            return body
        if kind < 4:
            return self.inside(self.named(r.choice(("div", "section", "div"))), body)
        if kind == 4:
            return self.inside(self.named("div"), self.inside(self.named("div"), body))
        side = self.inside("td", "<br>".join(self.anchors(1, 6))) if r.random() < 0.5 else ""
        return self.inside("table", self.inside("tr", side + self.inside("td", body)))

    def page(self) -> str:
        r = self.r
        if r.random() < 0.04:  # plain text, or paragraphs alone
            return self.text(MAIN, 1, 200) if r.random() < 0.5 else "".join(f"<p>{self.text(MAIN, 1, 60)}" for _ in range(r.randint(1, 5)))
        before = [x() for x in (self.menu, lambda: self.boxed(ADVERT), lambda: self.boxed(HEAD), lambda: self.boxed(NOTICE), self.form, lambda: self.boxed(AROUND)) if r.random() < 0.45]
        after = [x() for x in (lambda: self.boxed(COMMENT), lambda: self.boxed(AROUND), lambda: self.boxed(ADVERT), self.form, self.menu, lambda: self.boxed(NOTICE)) if r.random() < 0.35]
        if r.random() < 0.25:
            before.append(self.links())
        if r.random() < 0.1:
            after.append(self.links())
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.7:
            after.append(self.boxed(FOOT))
        some = r.random() > 0.03  # a few pages have no article
        body = "".join([*before, self.article() if some else "", *after])
        if r.random() < 0.3:
            body = self.inside(r.choice(("div", 'div class="wrapper"', 'div id="page"', 'div class="container"')), body)
        return f"<!DOCTYPE html><html><head><title>{self.text(REST, 2, 8)}</title></head><body>{body}</body></html>"

    def labelled(self) -> tuple[np.ndarray, np.ndarray]:
        found = blocks(self.page())
        return vectors([(n, t.strip(MAIN + REST) or "x") for n, t in found]), np.array([t[0] == MAIN for _, t in found])


def train(pages: int = 12000, rounds: int = 8, batch: int = 32, seed: int = 7, rate: float = 4e-3) -> Labeller:
    """Adam over shuffled batches of pages of like length."""
    draw, model, r = Pages(seed), Labeller.fresh(seed), np.random.default_rng(seed)
    data = sorted((p for p in (draw.labelled() for _ in range(pages)) if len(p[0])), key=lambda p: len(p[0]))
    batches = [data[i : i + batch] for i in range(0, len(data), batch)]
    m, v, k = {n: 0.0 for n in model.w}, {n: 0.0 for n in model.w}, 0
    for step in range(rounds):
        for b in r.permutation(len(batches)):
            x, there = _padded([p for p, _ in batches[b]])
            x = x * (r.random(x.shape) > 0.1)
            y = np.zeros(there.shape, np.float32)
            for i, (_, t) in enumerate(batches[b]):
                y[: len(t), i] = t
            k += 1
            for n, g in model.gradients(x.astype(np.float32), there, y).items():
                m[n], v[n] = 0.9 * m[n] + 0.1 * g, 0.999 * v[n] + 0.001 * g * g
                model.w[n] = (model.w[n] - rate * 0.5**step * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return model


def accuracy(model: Labeller, pages: int = 400, seed: int = 99) -> float:
    """Share of blocks labelled right on pages not trained on."""
    draw = Pages(seed)
    data = [draw.labelled() for _ in range(pages)]
    marks = model.main([x for x, _ in data])
    return float(np.concatenate([m == y for m, (_, y) in zip(marks, data, strict=True)]).mean())


if __name__ == "__main__":
    trained = train()
    print("held-out accuracy", accuracy(trained))
    np.savez_compressed(WEIGHTS, **trained.w)
