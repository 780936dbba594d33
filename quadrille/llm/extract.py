"""HTML extraction: a bidirectional LSTM labels the sequence of text blocks of a page as main text or not."""

from __future__ import annotations

import html
import os
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import pieces

#: Sizes of the hashed tag-path and word vectors, and of the figures of each block.
PATH, WORDS, STATS = 160, 16, 4
HIDDEN = 24
#: Pages of more blocks are labelled in stretches of so many, which hand on the network's state.
STRETCH = 20_000
WEIGHTS = os.path.join(os.path.dirname(__file__), "block_labeller.npz")

OPEN = re.compile(r"<(?:!|\?|(/?)([A-Za-z][A-Za-z0-9:-]*))")
EVENT = re.compile(r"[>\"']")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")
#: Elements whose content is no text: raw up to their end tag, or of elements, which their parent's end ends too.
RAW = frozenset("script style textarea title iframe".split())
OPAQUE = frozenset("noscript template svg object canvas select".split())
#: What a head holds; any other element, or text, ends it.
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: Elements that run inside a block.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the others.
CLOSES = {k: frozenset(v.split()) for k, v in {"li": "li p", "p": "p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "option": "option"}.items()}
BLOCK_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Tags:
    """Finds the tags of a page in order, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.known: dict[int, int] = {}  # opening quote -> end of the tag that goes on from it, or -1
        self.event = (0, -1)  # no >, " or ' stands from the first place to the second

    def _event(self, at: int) -> int:
        if not self.event[0] <= at <= self.event[1]:
            m = EVENT.search(self.page, at)
            self.event = (at, m.start() if m else len(self.page))
        return self.event[1]

    def end(self, at: int) -> int:
        """Behind the first > from `at` on that stands outside quotes; -1 if there is none."""
        passed, found = [], -1
        while at <= self.last:
            k = self._event(at)
            if k >= len(self.page):
                break
            if self.page[k] == ">":
                found = k + 1
                break
            if k in self.known:
                found = self.known[k]
                break
            passed.append(k)
            close = self.page.find(self.page[k], k + 1)
            if close < 0:
                break
            at = close + 1
        for k in passed:
            self.known[k] = found
        return found

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the first tag from `at` on; name is None for comments and the like."""
        page = self.page
        while m := OPEN.search(page, at):
            at = m.end()
            if m[2] is None:
                if page.startswith("!--", m.start() + 1):
                    close = page.find("-->", m.start() + 4)
                    return m.start(), close + 3 if close >= 0 else len(page), "", None, ""
                if at <= self.last:
                    return m.start(), page.index(">", at) + 1, "", None, ""
            elif (end := self.end(at)) >= 0:
                return m.start(), end, m[1], m[2].lower(), page[at : end - 1]
        return None


class Path:
    """The way to a block: an element's names (tag, then classes and ids with a dot) and its parent's way."""

    __slots__ = ("names", "parent", "vector")

    def __init__(self, parent: Path | None, names: tuple[str, ...]):
        self.parent, self.names, self.vector = parent, names, None

    def way(self) -> list[Path]:
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.parent
        return out[::-1]

    def __eq__(self, other):
        return isinstance(other, Path) and [p.names for p in self.way()] == [p.names for p in other.way()]

    def __hash__(self):
        return hash(self.names)

    def bits(self) -> np.ndarray:
        """The hashed names on the way, each computed once from its parent's."""
        todo, at = [], self
        while at is not None and at.vector is None:
            todo.append(at)
            at = at.parent
        v = np.zeros(PATH, bool) if at is None else at.vector
        for p in reversed(todo):
            v = v.copy()
            for n in p.names:
                v[_slot(n)] = True
            p.vector = v
        return v


ROOT = Path(None, ())


ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
BEYOND = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


def decoded(text: str) -> str:
    """Character references decoded; numbers of any length, beyond the code points as U+FFFD."""
    return html.unescape(BEYOND.sub("\ufffd", ZEROS.sub(r"&#\1", text)) if "&#" in text else text)


def blocks(page: str) -> list[tuple[Path, str]]:
    """The leaf texts of a page in order, each with its path; white space as one space.

    A block whose words all stand in links ends its path with an `a`.
    """
    found, stack, text = [], [], []  # stack: (name, path)
    link, linked, bare = False, False, False  # inside an a element; the block has words inside, and outside, of links
    at, hidden, tags = 0, None, Tags(page)  # hidden: the place in stack of the outermost opaque element
    opened: Counter = Counter()

    def end():
        nonlocal linked, bare
        if text:
            joined = " ".join(decoded("".join(text)).split())
            if joined:
                path = stack[-1][1] if stack else ROOT
                found.append((Path(path, ("a",)) if linked and not bare else path, joined))
            text.clear()
        linked = bare = False

    def pop(k: int):
        nonlocal hidden
        end()
        for name, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]
        if hidden is not None and hidden >= k:
            hidden = None

    def add(part: str):
        nonlocal linked, bare
        if hidden is None:
            if stack and stack[-1][0] == "head" and not part.isspace():
                pop(len(stack) - 1)
            text.append(part)
            if link:
                linked = linked or any(map(str.isalnum, part))
            else:
                bare = bare or any(map(str.isalnum, part))

    while tag := tags.next(at):
        start, to, closing, name, attributes = tag
        if start > at:
            add(page[at:start])
        at = to
        if name is None:
            continue
        if closing:
            if name in INLINE:
                link = link and name != "a"
                continue
            if opened[name]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            else:
                end()
            continue
        if name == "br":
            add("\n")
            continue
        if name in INLINE:
            link = link or name == "a" and "href" in attributes.lower()
            continue
        end()
        link = False
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            pop(len(stack) - 1)
        whole = not attributes.rstrip().endswith("/")
        if name in RAW and whole:
            at = _raw_end(page, name, at)
            continue
        if name in VOID:
            continue
        if name in BLOCK_ENDS_P and stack and stack[-1][0] == "p":
            pop(len(stack) - 1)
        shut = CLOSES.get(name)
        if shut and stack and stack[-1][0] in shut:
            last = len(stack) - 1
            pop(last - 1 if last and stack[last - 1][0] in shut and stack[last - 1][0] != name else last)
        if name == "select" and hidden is not None and stack[hidden][0] == "select":
            pop(hidden)
        if name in OPAQUE and whole and hidden is None:
            hidden = len(stack)
        given = [x for g in NAMES.findall(attributes) for x in PART.findall(" ".join(g).lower())] if attributes else []
        stack.append((name, Path(stack[-1][1] if stack else None, (name, *(f".{g}" for g in given)))))
        opened[name] += 1
    if at < len(page):
        add(page[at:])
    end()
    return found


def _raw_end(page: str, name: str, at: int) -> int:
    """Where a raw element ends. Without end tag a title or textarea ends at the next tag, others at the head's end or
    the body's start, or else with the page."""
    close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    if close:
        return close.end()
    other = re.compile("<" if name in ("title", "textarea") else r"</head\b|<body\b", re.I).search(page, at)
    return other.start() if other else len(page)


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % PATH


@lru_cache(500_000)
def _word(w: str) -> int:
    return zlib.crc32(w.encode()) % WORDS


def vectors(found: list[tuple[Path, str]]) -> np.ndarray:
    """A row for each block: its tag path, its hashed words, its length and share of end marks and digits."""
    out = np.zeros((len(found), PATH + WORDS + STATS), np.float32)
    for i, (path, text) in enumerate(found):
        words = text.split()
        out[i, :PATH] = path.bits()
        if path.names:
            out[i, _slot(f"leaf {path.names[0]}")] = 1
        out[i, PATH : PATH + WORDS] = np.sqrt(np.bincount([_word(w) for w in words], minlength=WORDS) / len(words))
        out[i, PATH + WORDS :] = np.log1p(len(words)) / 5, np.log1p(len(text)) / 8, text[-1] in ".!?…", sum(map(text.count, "©|»·")) > 0
    return out


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, pages))
    x = np.zeros((n, len(pages), PATH + WORDS + STATS), np.float32)
    there = np.zeros((n, len(pages)), bool)
    for i, p in enumerate(pages):
        x[: len(p), i], there[: len(p), i] = p, True
    return x, there


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: v.astype(np.float32) for k, v in weights.items()}

    @classmethod
    def fresh(cls, seed: int) -> Labeller:
        r, d = np.random.default_rng(seed), PATH + WORDS + STATS
        w = {}
        for s in "fb":
            w |= {f"x{s}": r.normal(0, d**-0.5, (d, 4 * HIDDEN)), f"h{s}": r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)), f"c{s}": np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
        return cls(w | {"o": r.normal(0, 0.2, 2 * HIDDEN), "ob": np.zeros(1), "skip": np.zeros(d)})

    @classmethod
    def trained(cls) -> Labeller:
        with np.load(WEIGHTS) as z:
            return cls(dict(z))

    def _run(self, x, there, s, keep=False, state=None):
        """One direction's states from `state` on, what it kept, and the state at its end; padding holds the state, so
        that both directions start at a page's own ends."""
        h, c = state or (np.zeros((x.shape[1], HIDDEN), np.float32),) * 2
        given = x @ self.w[f"x{s}"] + self.w[f"c{s}"]
        out, tape = np.zeros((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if s == "f" else range(len(x) - 1, -1, -1):
            z = given[t] + h @ self.w[f"h{s}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = there[t][:, None]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = h2, c2
            out[t] = h
        return out, tape, (h, c)

    def logits(self, x, there, keep=False):
        (hf, tf, _), (hb, tb, _) = self._run(x, there, "f", keep), self._run(x, there, "b", keep)
        both = np.concatenate([hf, hb], 2)
        return both @ self.w["o"] + x @ self.w["skip"] + self.w["ob"], both, tf, tb

    def gradients(self, x, there, y):
        """Of the mean cross-entropy over blocks, by backpropagation through both directions."""
        z, both, tf, tb = self.logits(x, there, True)
        dz = np.where(there, _sigmoid(z) - y, 0) / there.sum()
        grads = {"o": np.einsum("tb,tbh->h", dz, both), "ob": np.array([dz.sum()]), "skip": np.einsum("tb,tbd->d", dz, x)}
        for s, tape, part in (("f", tf, slice(0, HIDDEN)), ("b", tb, slice(HIDDEN, None))):
            dout = dz[:, :, None] * self.w["o"][part]
            gx, gh, gc = (np.zeros_like(self.w[f"{k}{s}"]) for k in "xhc")
            dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tc, m in reversed(tape):
                dh = dh + dout[t]
                dct = np.where(m, dc + dh * o * (1 - tc**2), dc)
                d = np.where(m, np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dh * tc * o * (1 - o), dct * i * (1 - g**2)], 1), 0)
                gx += x[t].T @ d
                gh += h.T @ d
                gc += d.sum(0)
                dh, dc = np.where(m, d @ self.w[f"h{s}"].T, dh), np.where(m, dct * f, dct)
            grads |= {f"x{s}": gx, f"h{s}": gh, f"c{s}": gc}
        return grads

    def long(self, found: list[tuple[Path, str]], stretch: int = STRETCH) -> np.ndarray:
        """Which blocks of one page of any length are main text, by the same network, a stretch of blocks at a time."""
        z, parts = np.zeros(len(found), np.float32), range(0, len(found), stretch)
        for s, w, order in (("f", self.w["o"][:HIDDEN], parts), ("b", self.w["o"][HIDDEN:], reversed(parts))):
            state = None
            for at in order:
                x = vectors(found[at : at + stretch])[:, None]
                out, _, state = self._run(x, np.ones(x.shape[:2], bool), s, state=state)
                z[at : at + stretch] += out[:, 0] @ w + (x[:, 0] @ self.w["skip"] + self.w["ob"] if s == "f" else 0)
        return z > 0

    def main(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page which of its blocks are main text. Pages of like length are labelled together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            some = order[at : at + 128]
            while len(some) > 1 and len(pages[some[-1]]) * len(some) > 20_000:
                some = some[: len(some) // 2]
            x, there = _padded([pages[i] for i in some])
            z = self.logits(x, there)[0] > 0
            for k, i in enumerate(some):
                out[i] = z[: len(pages[i]), k]
            at += len(some)
        return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text (main blocks in page order, joined by a line feed).

    Character references are decoded and white space inside a block is one space. Null and empty pages, and pages
    without a main block, give an empty text. Each row is worked on by itself: repeated ids and extra columns
    change nothing. Work and memory are linear in a page: a tag that never ends is text, deep nesting shares its paths,
    and a page of more than STRETCH blocks is labelled in stretches.
    """
    sent = pages.sparkSession.sparkContext.broadcast(Labeller.trained().w)

    def run(batches):
        model = Labeller(sent.value)
        for b in pieces(batches):
            found = [blocks(p or "") for p in b.column("text").to_pylist()]
            marks = model.main([vectors(f) if len(f) <= STRETCH else np.zeros((0, 0)) for f in found])
            marks = [m if len(f) <= STRETCH else model.long(f) for f, m in zip(found, marks, strict=True)]
            texts = ["\n".join(t for (_, t), k in zip(f, m, strict=True) if k) for f, m in zip(found, marks, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("text"))
    return chosen.mapInArrow(run, "page_id long, url string, text string")


def op10_block_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op10_block_lstm": op10_block_lstm}
