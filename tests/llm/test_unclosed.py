"""Pages without the end tags that HTML lets out, or that lack the end of an opaque element."""

import time

import numpy as np
import pytest

from quadrille.llm import extract


def texts(page):
    return [t for _, t in extract.blocks(page)]


def test_head_without_end_tag():
    closed = "<html><head><title>x</title><style>p {}</style></head><body><article><p>One.</p><p>Two.</p></article></body></html>"
    assert texts(closed) == ["One.", "Two."]
    assert extract.blocks(closed.replace("</head>", "")) == extract.blocks(closed)
    no_body = closed.replace("<body>", "").replace("</body>", "")
    assert extract.blocks(no_body.replace("</head>", "")) == extract.blocks(no_body)
    assert texts("<head><title>x</title>Bare text") == ["Bare text"]


@pytest.mark.parametrize("name", sorted(extract.OPAQUE))
def test_opaque_without_end_tag(name):
    page = f"<body><div><p>Before.</p><div><{name}><b>hidden</b></div><p>After.</p></div><div><{name}>no</{name}>Last.</div></body>"
    assert texts(page) == ["Before.", "After.", "Last."]
    assert texts(f"<p>A <{name}><i>x</i></{name}> b</p>") == ["A", "b"]


def test_raw_without_end_tag():
    assert texts("<head><title>T<body><p>One.</p>") == ["One."]
    assert texts("<head><script>x = 1; <body><p>One.</p>") == ["One."]
    assert texts("<p>A</p><textarea>b<p>C</p>") == ["A", "C"]


def test_odd_tags():
    assert texts('<p class="a>b">One</p>') == ["One"] and texts("<p>1 < 2 > 0 <3</p>") == ["1 < 2 > 0 <3"]
    assert texts("<p>A <!-- > --> b <? x > c <!x> d</p>") == ["A b c d"] and texts("<p>A<!-- b") == ["A"]
    assert texts("<p>A <b title=\"x>B</p>") == ["A <b title=\"x>B"] and texts("<div <p>A</p>") == ["A"]


@pytest.mark.parametrize("page", ["<a " * 300_000, "<a '" * 250_001, "<!" * 500_000, "<div>x" * 60_000, "</x>" * 10 + "<div>" * 50_000 + "</p>" * 100_000, "<a \"'>" * 150_000, "<p>x" * 100_000, "&" * 1_000_000])
def test_work_is_linear(page):
    began = time.time()
    found = extract.blocks(page)
    extract.vectors(found[:20_000])
    assert time.time() - began < 15


def test_stretches_agree():
    model = extract.Labeller.trained()
    found = extract.blocks("<nav>a b</nav><article>" + "".join(f"<p>word {i} here.</p><div class='ad'>x</div>" for i in range(60)) + "</article><footer>c</footer>")
    assert np.array_equal(model.long(found, 7), model.main([extract.vectors(found)])[0])
