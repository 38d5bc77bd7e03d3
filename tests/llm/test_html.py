"""HTML extraction: blocks, the recurrent model's gradients, and whole texts on the test pages."""

import html
import re

import numpy as np
import pytest

from panelkit.llm import html_text as h
from panelkit.llm.common import load

PAGE = """<!DOCTYPE html><html><head><title>Head &amp; title</title><style>p{}</style></head><body>
<header class="site-header"><h1>Site</h1><p>Slogan of the site.</p></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div>
<article><h1>A &lt;real&gt; title</h1><p>First   <b>bold</b>er&nbsp;text<br>next line.<p>Second &copy; 2024 &#x41;.<!-- hidden -->
<div class="ad">Buy now!</div><ul><li>item one</li><li>item two</li></ul><script>var x = "<p>no</p>";</script><p>Last one.</p></article>
<aside class="sidebar"><h3>Related</h3><p>Other story.</p></aside><form><label>Mail</label><input><p>Subscribe today.</p></form>
<section class="comments"><div class="comment"><p>Great article, thanks!</p></div></section><footer><p>&copy; Site</p></footer></body></html>"""
WANT = "A <real> title First bolder text next line. Second © 2024 A. item one item two Last one."


def test_blocks():
    texts = [b.text for b in h.blocks_of(PAGE)]
    assert texts[0] == "Head & title" and "First bolder text" in texts and "var x" not in " ".join(texts)
    assert [b.text for b in h.blocks_of("a < b <p>c<p>d</div></p><td>e <3")] == ["a < b", "c", "d", "e <3"]
    assert h.blocks_of(None) == h.blocks_of("") == h.blocks_of("<script>x") == h.blocks_of("<!-- x") == []
    assert [b.text for b in h.blocks_of('<p title="a>b">x</p><p class="q>y</p>')] == ["x", "y"]


def test_gradients():
    rng = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in h.new_model().items()}
    pages = [h._assembled(rng, ["some words here.", "more"]) for _ in range(3)]
    batch = h.Batch([b for b, _ in pages])
    y = np.array([v for _, ys in pages for v in ys])
    _, grads = h.gradients(batch, y, model)
    for name, g in grads.items():
        flat = int(np.abs(g).argmax())
        for sign, keep in ((1, []), ):
            at = np.unravel_index(flat, g.shape)
            old = model[name][at]
            losses = []
            for e in (1e-3, -1e-3):
                model[name][at] = old + e
                losses.append(h.gradients(batch, y, model)[0])
            model[name][at] = old
            assert (losses[0] - losses[1]) / 2e-3 == pytest.approx(g[at], rel=0.02, abs=1e-5), name


@pytest.fixture(scope="module")
def model(spark):
    return h.fit(load(spark, "/root/testdata/sf0.001", "pages"))


def test_test_pages(spark, model):
    pages = load(spark, "/root/testdata/sf0.01", "pages")
    out = h.extract(pages, model).join(pages.select("page_id", "html"), "page_id").collect()
    assert len(out) == pages.count()
    for r in out:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(h1|p|br)\b[^>]*>", " ", inner).replace("<b>", "")).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_unseen_markup(model):
    assert h.texts_of([PAGE], model) == [WANT]


def test_edges(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", PAGE), (3, "u", PAGE), (3, "u", PAGE), (4, "u", "<p>" + "word " * 50_000), (5, "u", "plain")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    out = h.extract(pages, model).collect()
    assert len(out) == len(rows)
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in out if r["page_id"] in (1, 2))
    assert [r["text"] for r in out if r["page_id"] == 3] == [WANT, WANT]
    assert h.extract(pages.limit(0)).count() == 0


def test_scripts_with_less_than_and_apostrophes(model):
    for code in ("for (i=0;i<n;i++) f(i);", "// don't\nfor (i=0;i<n;i++) {}", "if (a<b) s = '<p>';", "<!-- if (a<b) -->"):
        page = PAGE.replace('var x = "<p>no</p>";', code).replace("Last one.", "It's the last one.")
        texts = [b.text for b in h.blocks_of(page)]
        assert "It's the last one." in texts and not any("script" in t or "<n" in t for t in texts)
        assert h.texts_of([page], model) == [WANT.replace("Last one.", "It's the last one.")]
    styled = "<article><style>a<b{}</style><p>One's.</p><p>Two's.</p></article>"
    assert [b.text for b in h.blocks_of(styled)] == ["One's.", "Two's."]


def test_captions_formulas_and_drawings(model):
    figure = "<figure><img src=x><figcaption>A caption of the image.</figcaption></figure>"
    formula = ("<p>Energy is <math><semantics><mrow><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></mrow>"
               "<annotation encoding='application/x-tex'>E=mc^2</annotation></semantics></math> here.</p>")
    drawing = "<figure><svg viewBox='0 0 9 9'><g><path d='M0 0'/><text>Axis label</text></g></svg></figure>"
    page = PAGE.replace("<p>Last one.", figure + formula + drawing + "<p>Last one.")
    assert h.texts_of([page], model) == [WANT.replace("Last one.", "A caption of the image. Energy is E=mc2 here. Axis label Last one.")]
    away = PAGE.replace("</nav>", "<svg><path d='M0'/><text>Logo</text></svg></nav>").replace("Buy now!", "Buy <svg><text>now</text></svg>!")
    assert h.texts_of([away], model) == [WANT]
    blocks = h.blocks_of("<p>a <svg><g/><text>b</text></svg> c</p><svg><g><p>d</p>")
    assert [(b.text, "p" in b.names, "svg" in b.names) for b in blocks] == [
        ("a", True, False), ("b", True, True), ("c", True, False), ("d", True, False)]
    caption = h.blocks_of("<main><figure><figcaption>x</figcaption></figure></main>")[0]
    assert h.teacher(caption) == 1.0


def test_long_pages_in_pieces_equal_pages_side_by_side(monkeypatch):
    rng = np.random.default_rng(5)
    model = h.new_model()
    pages = [[b for _ in range(k) for b in h._assembled(rng, ["some words here.", "more", "Other text"])[0]] for k in (1, 7, 2, 30)] + [[]]
    batch = h.Batch(pages)
    want = h.probabilities(batch, model)
    for cells in (1, 7, 64):
        monkeypatch.setattr(h, "CELLS", cells)
        np.testing.assert_allclose(h.probabilities(batch, model), want, atol=2e-6)


def test_a_very_long_page_beside_short_ones(model):
    """One page of 60,000 blocks among 63 short pages takes memory for its blocks, not for 64 times as many."""
    import tracemalloc

    page = "<article>" + "".join(f"<p>word{i} is here.</p>" for i in range(60_000)) + "</article>"
    tracemalloc.start()
    out = h.texts_of([page] + ["<article><p>Short.</p></article>"] * 63, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 64 and len(out[0]) > 0 and peak < 400_000_000


def test_the_sample_counts_repeated_pages_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(h, "train", lambda pages: seen.append(pages) or h.new_model())
    monkeypatch.setattr(h, "SAMPLE_PAGES", 20)
    rows = [(1, "hot", PAGE)] * 500 + [(i, f"u{i}", f"<p>page {i}</p>") for i in range(300)] + [(9, "none", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    h.fit(pages)
    h.fit(pages.repartition(3))
    assert len(seen[0]) == len(set(seen[0])) == 20 and seen[0] == seen[1]
