"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks with the path of tags above them. A bidirectional LSTM reads the
sequence of blocks, each given by its hashed tag path, a hashed bag of its words and a few measures,
and labels every block in the light of the whole page; blocks labelled as content make the text.

The labeller is trained on at most SAMPLE_PAGES pages (the lowest hashes of their addresses, each up to
SAMPLE_CHARS characters), labelled by their own semantic tags, and on sequences put together from their
blocks under usual containers of content and of boilerplate. Every page is then labelled by the model alone.

Defined results: null and empty html, and pages without content blocks, give the empty text; unclosed
and unmatched tags are taken as browsers mostly do; repeated pages each get their own result; with no
page to learn from, the assembled sequences alone train the model; only the named columns are read.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import encoded, hash_bound
from panelkit.llm.near_dedup import hashed_words

SAMPLE_PAGES = 256
SAMPLE_CHARS = 60_000
PATH_WIDTH = 512
WORD_WIDTH = 32
MEASURES = 5
HIDDEN = 16
# Most padded blocks of the pages that are labelled side by side, and of a piece of one long page.
CELLS = 1 << 14
TRAIN_STEPS = 240
BATCH = 16

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
# Elements of text flow, which do not part blocks.
_INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub "
              "sup time tt u var wbr "
              # Formulas and text spans of drawings.
              "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts "
              "none mtable mtr mlabeledtr mtd mstyle mpadded mphantom menclose merror maction semantics tspan textpath".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Never shown; annotations repeat a formula in another notation.
_RAW = set("script style template annotation annotation-xml".split())
# Start tags that end an open drawing.
_LEAVES_SVG = set("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li menu ol p pre table ul".split())
_PLAIN = set("title textarea".split())
# A start tag of the first closes an open one of the second, up to the nearest of the third.
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
           "body": ({"head"}, set())}


class Block:
    """Text of a leaf block, hashed names on its path, and the share of its characters inside links."""

    __slots__ = ("names", "text", "linked")

    def __init__(self, names: tuple[str, ...], text: str, linked: float):
        self.names, self.text, self.linked = names, text, linked


def blocks_of(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked, links, at = 0, 0, 0

    def flush():
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                names = tuple(n for _, ns in stack for n in ns)
                out.append(Block((*names, "leaf " + (stack[-1][0] if stack else "")), text, min(1.0, linked / len(text))))
            held.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            held.append(text)
            if links:
                linked += len(text)

    # Searched from `at`, as a tag that seems to open inside a skipped script may reach past its end.
    while m := _TAG.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                links = 0 if close else 1
            continue
        flush()
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    links = 0
                    break
            continue
        if tag in _VOID:
            continue
        drawing = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ("svg", "foreignobject")), None)
        inside = drawing is not None and stack[drawing][0] == "svg"
        if inside and tag in _LEAVES_SVG:
            del stack[drawing:]
            inside = False
        if (inside or tag == "svg") and (attributes or "").rstrip().endswith("/"):
            continue
        if tag in _RAW or tag in _PLAIN:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if tag in _PLAIN:
                stack.append((tag, (tag,)))
                add(page[at:end.start() if end else len(page)])
                flush()
                stack.pop()
            at = end.start() if end else len(page)
            continue
        closed, within = _CLOSES.get(tag, ({"p"}, set()))
        for i in range(len(stack) - 1, -1, -1):
            if inside or tag == "svg" or stack[i][0] in within or stack[i][0] == "foreignobject":
                break
            if stack[i][0] in closed or stack[i][0] == "p":
                del stack[i:]
                break
        names = (tag, *(f".{w}" for v in _NAMES.findall(attributes or "") for w in _WORD.findall(v.lower())))
        stack.append((tag, names))
    add(page[at:])
    flush()
    return out


# --- features

def path_index(names: tuple[str, ...]) -> list[int]:
    """Hashed places of the names of a path, nearest names also under their own sign."""
    out = {zlib.crc32(n.encode()) % PATH_WIDTH for n in names}
    return sorted(out)


class Batch:
    """Features of the blocks of some pages: path places (flat, with starts), and dense columns."""

    def __init__(self, pages: list[list[Block]]):
        self.sizes = [len(p) for p in pages]
        flat = [b for p in pages for b in p]
        cached: dict = {}
        paths = []
        for b in flat:
            if b.names not in cached:
                cached[b.names] = path_index(b.names)
            paths.append(cached[b.names])
        self.flat = np.array([i for p in paths for i in p], np.int64)
        self.starts = np.concatenate(([0], np.cumsum([len(p) for p in paths])))[:-1].astype(np.int64) if paths else np.zeros(0, np.int64)
        raws = [encoded(b.text) for b in flat]
        edges = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws]))).astype(np.int64)
        places, hashes = hashed_words(b"\n".join(raws).lower())
        owner = np.searchsorted(edges, places, side="right") - 1
        n = len(flat)
        words = np.bincount(owner * WORD_WIDTH + (hashes % np.uint64(WORD_WIDTH)).astype(np.int64), minlength=n * WORD_WIDTH)
        words = words.reshape(n, WORD_WIDTH).astype(np.float32)
        count = words.sum(axis=1, keepdims=True)
        where = [(i + 1) / (s + 1) for s in self.sizes for i in range(s)]
        measures = np.array([[np.log1p(len(r)) / 8, b.linked, w, b.text.endswith((".", "!", "?")), 1.0]
                             for b, r, w in zip(flat, raws, where)], np.float32).reshape(n, MEASURES)
        self.dense = np.concatenate((words / np.sqrt(np.maximum(count, 1)), measures), axis=1)


# --- model

def new_model(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    model = {}
    for d in "fb":
        model[f"path_{d}"] = (rng.standard_normal((PATH_WIDTH, 4 * HIDDEN)) * 0.1).astype(np.float32)
        model[f"dense_{d}"] = (rng.standard_normal((WORD_WIDTH + MEASURES, 4 * HIDDEN)) * 0.1).astype(np.float32)
        model[f"back_{d}"] = (rng.standard_normal((HIDDEN, 4 * HIDDEN)) * 0.2).astype(np.float32)
    model["out"] = (rng.standard_normal(2 * HIDDEN) * 0.2).astype(np.float32)
    model["bias"] = np.zeros(1, np.float32)
    return model


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _inputs(batch: Batch, model, d: str, blocks: slice = slice(None)) -> np.ndarray:
    """Gate inputs of all blocks, or of a run of them."""
    starts = batch.starts[blocks]
    if not len(starts):
        return np.zeros((0, 4 * HIDDEN), np.float32)
    end = len(batch.flat) if blocks.stop is None or blocks.stop >= len(batch.starts) else batch.starts[blocks.stop]
    paths = np.add.reduceat(model[f"path_{d}"][batch.flat[starts[0]:end]], starts - starts[0], axis=0)
    return paths + batch.dense[blocks] @ model[f"dense_{d}"]


def _scan(x: np.ndarray, mask: np.ndarray, back: np.ndarray, keep: list | None, state=None) -> np.ndarray:
    """LSTM over x [time, page, 4 * HIDDEN]; a masked step leaves the state as it is. `state` (h, c) is carried on in place."""
    h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
    if state is not None:
        h, c = state
    out = np.zeros((x.shape[0], x.shape[1], HIDDEN), np.float32)
    for t in range(x.shape[0]):
        z = x[t] + h @ back
        i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN] + (1.0 if k == 1 else 0.0)) for k in range(3))
        g = np.tanh(z[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        c2 = f * c + i * g
        h2 = o * np.tanh(c2)
        if keep is not None:
            keep.append((h, c, i, f, o, g, c2, m))
        c, h = np.where(m, c2, c), np.where(m, h2, h)
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out


def _padded(batch: Batch, rows: np.ndarray):
    """Block numbers [time, page] and their mask."""
    first = np.concatenate(([0], np.cumsum(batch.sizes)))[:-1].astype(np.int64)
    sizes = np.array(batch.sizes, np.int64)[rows]
    steps = np.arange(int(sizes.max()))[:, None]
    mask = steps < sizes[None, :]
    return np.where(mask, first[rows][None, :] + steps, 0), mask


def probabilities(batch: Batch, model) -> np.ndarray:
    """Probability of content of every block.

    Pages of like length go side by side, at most 64 of them and CELLS padded blocks; a page of more blocks
    than that goes alone, in pieces that carry the state on.
    """
    out = np.zeros(sum(batch.sizes), np.float32)
    first = np.concatenate(([0], np.cumsum(batch.sizes))).astype(np.int64)
    short = [i for i in np.argsort(batch.sizes, kind="stable").tolist() if 0 < batch.sizes[i] <= CELLS]
    forward, backward = ((_inputs(batch, model, d) for d in "fb") if short else (None, None))
    i = 0
    while i < len(short):
        j = i + 1
        while j < len(short) and j - i < 64 and (j + 1 - i) * batch.sizes[short[j]] <= CELLS:
            j += 1
        at, mask = _padded(batch, np.array(short[i:j]))
        hf = _scan(forward[at], mask, model["back_f"], None)
        hb = _scan(backward[at][::-1], mask[::-1], model["back_b"], None)[::-1]
        p = _sigmoid(np.concatenate((hf, hb), axis=2) @ model["out"] + model["bias"])
        out[at[mask]] = p[mask]
        i = j
    for page in np.flatnonzero(np.array(batch.sizes) > CELLS).tolist():
        out[first[page]:first[page + 1]] = _long_page(batch, model, int(first[page]), int(first[page + 1]))
    return out


def _long_page(batch: Batch, model, start: int, end: int) -> np.ndarray:
    """Probabilities of one page's blocks, CELLS at a time in both directions."""
    logits = np.zeros(end - start, np.float32)
    cuts = list(range(start, end, CELLS))
    for d, pieces, step in (("f", cuts, 1), ("b", cuts[::-1], -1)):
        state = [np.zeros((1, HIDDEN), np.float32)] * 2
        part = model["out"][:HIDDEN] if d == "f" else model["out"][HIDDEN:]
        for at in pieces:
            x = _inputs(batch, model, d, slice(at, min(at + CELLS, end)))[::step][:, None, :]
            h = _scan(x, np.ones((len(x), 1), bool), model[f"back_{d}"], None, state)
            logits[at - start:at - start + len(x)] += (h[:, 0] @ part)[::step]
    return _sigmoid(logits + model["bias"])


def _scan_back(d_out, keep, back):
    """Gradients of inputs and of the recurrent weights."""
    steps = len(keep)
    dx = np.zeros((steps, d_out.shape[1], 4 * HIDDEN), np.float32)
    d_back = np.zeros_like(back)
    dh = dc = np.zeros(d_out.shape[1:], np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, c2, m = keep[t]
        dh = dh + d_out[t]
        th = np.tanh(c2)
        dh2, dc2 = dh * m, dc * m + dh * m * o * (1 - th * th)
        dz = np.concatenate((dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), dh2 * th * o * (1 - o), dc2 * i * (1 - g * g)), axis=1)
        dx[t] = dz
        d_back += h.T @ dz
        dh = dz @ back.T + dh * ~m
        dc = dc2 * f + dc * ~m
    return dx, d_back


def gradients(batch: Batch, labels: np.ndarray, model) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss of all blocks and its gradients."""
    rows = np.array([i for i, s in enumerate(batch.sizes) if s])
    at, mask = _padded(batch, rows)
    keeps: dict = {"f": [], "b": []}
    hidden = {
        "f": _scan(_inputs(batch, model, "f")[at], mask, model["back_f"], keeps["f"]),
        "b": _scan(_inputs(batch, model, "b")[at][::-1], mask[::-1], model["back_b"], keeps["b"])[::-1],
    }
    both = np.concatenate((hidden["f"], hidden["b"]), axis=2)
    p = _sigmoid(both @ model["out"] + model["bias"])
    y = labels[at]
    n = mask.sum()
    loss = -float((np.where(y > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / n)
    d = ((p - y) * mask / n).astype(np.float32)
    grads = {"out": np.tensordot(d, both, axes=([0, 1], [0, 1])), "bias": np.array([d.sum()])}
    for k, side in enumerate("fb"):
        d_hidden = d[:, :, None] * model["out"][k * HIDDEN:(k + 1) * HIDDEN]
        if side == "b":
            dx, grads["back_b"] = _scan_back(d_hidden[::-1], keeps["b"], model["back_b"])
            dx = dx[::-1]
        else:
            dx, grads["back_f"] = _scan_back(d_hidden, keeps["f"], model["back_f"])
        flat = np.zeros((len(batch.dense), 4 * HIDDEN), np.float32)
        flat[at[mask]] = dx[mask]
        grads[f"dense_{side}"] = batch.dense.T @ flat
        path = np.zeros_like(model[f"path_{side}"])
        np.add.at(path, batch.flat, np.repeat(flat, np.diff(np.concatenate((batch.starts, [len(batch.flat)]))), axis=0))
        grads[f"path_{side}"] = path
    return loss, grads


# --- training

# Names that mark boilerplate or content, for the training labels and the assembled sequences.
_NOT_CONTENT = set("nav header footer aside form button select .ad .ads .advert .advertisement .banner .cookie .consent .notice "
                   ".sidebar .menu .nav .navbar .navigation .breadcrumb .breadcrumbs .footer .header .comment .comments .reply .replies "
                   ".discussion .share .social .related .promo .sponsored .subscribe .newsletter .login .search .popup .modal .widget "
                   ".copyright .toolbar .pagination .alert .disclaimer title head".split())
_CONTENT = ["article", "main", "article main", "div .article", "div .content", "div .post", "div .entry", "section .story", "div .main"]
_CONTENT_LEAVES = ["p"] * 8 + ["h1", "h2", "h3", "blockquote", "pre", "div", "section", "article", "ul li", "ul li", "ol li",
                               "table tr td", "table tbody tr td", "blockquote p", "div p", "section p", "dl dd", "figure", "figure figcaption", "figure figcaption", "figure div figcaption p",
                               "figure svg text", "p svg g text"]
_OTHER_LEAVES = ["p", "li", "a", "div", "span", "h3", "h2", "td", "ul", "section", "nav", "footer", "aside", "header", "form"]


def teacher(block: Block) -> float | None:
    """Label by semantic tags; None where they do not tell."""
    names = set(block.names)
    if names & _NOT_CONTENT:
        return 0.0
    return 1.0 if names & {"article", "main"} else None


def _assembled(rng, pool: list[str]) -> tuple[list[Block], list[float]]:
    """A page of random blocks under usual containers."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    text = lambda: pick(pool) if pool else " ".join(["word"] * int(rng.integers(1, 40)))
    shell = ("html", "body", *pick([(), (), ("div",), ("div", ".wrapper"), ("div", ".page"), ("div", "div", ".container")]))
    body = pick(_CONTENT).split()
    bad = [n for n in sorted(_NOT_CONTENT) if n not in ("title", "head")]
    blocks, labels = [Block(("html", "head", "title", "leaf title"), text(), 0.0)], [0.0]

    def other(inside: bool):
        name = pick(bad)
        names = (*shell, *(body if inside else ()), *((pick(["div", "section", "ul", "p"]), name) if name[0] == "." else (name,)))
        for _ in range(int(rng.integers(1, 5))):
            leaf = pick(_OTHER_LEAVES)
            blocks.append(Block((*names, leaf, "leaf " + leaf), text(), float(rng.integers(2))))
            labels.append(0.0)

    for _ in range(int(rng.integers(0, 4))):
        other(False)
    for _ in range(int(rng.integers(1, 14))):
        if rng.random() < 0.12:
            other(True)
        leaf = pick(_CONTENT_LEAVES).split()
        for _ in range(int(rng.integers(1, 5)) if len(leaf) > 1 else 1):
            blocks.append(Block((*shell, *body, *(leaf if leaf != body[-1:] else ()), "leaf " + leaf[-1]), text(), 0.0))
            labels.append(1.0)
    for _ in range(int(rng.integers(0, 4))):
        other(False)
    return blocks, labels


def train(pages: list[str], steps: int = TRAIN_STEPS, seed: int = 11) -> dict[str, np.ndarray]:
    """Fit the labeller on the pages whose blocks the teacher can all label, and on assembled sequences."""
    rng = np.random.default_rng(seed)
    real, pool = [], []
    for page in pages:
        blocks = blocks_of(page)
        labels = [teacher(b) for b in blocks]
        pool += [b.text[:400] for b in blocks]
        if blocks and None not in labels:
            real.append((blocks, labels))
    model = new_model()
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    for step in range(1, steps + 1):
        chosen = [real[int(rng.integers(len(real)))] if real and k % 2 else _assembled(rng, pool) for k in range(BATCH)]
        _, grads = gradients(Batch([b for b, _ in chosen]), np.array([y for _, ys in chosen for y in ys], np.float32), model)
        rate = 0.02 * min(1.0, step / 10) * (0.1 if step > 0.8 * steps else 1.0)
        for k, g in grads.items():  # Adam
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] = (model[k] - rate * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return model


def fit(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> dict[str, np.ndarray]:
    """Train on a bounded sample of the pages."""
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # Repeated pages count once. Hashes alone are ordered, then the pages of the lowest ones are fetched.
    h = F.xxhash64("url", "html")
    rows = rows.where(F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    kinds = rows.select(h.alias("h")).distinct()
    lowest = [r["h"] for r in kinds.where(F.col("h") <= F.lit(hash_bound(kinds.count(), SAMPLE_PAGES))).orderBy("h").limit(SAMPLE_PAGES).collect()]
    sample = rows.where(h.isin(lowest)).groupBy(h.alias("h")).agg(F.first("html").alias("html")).orderBy("h").collect() if lowest else []
    return train([r["html"] for r in sample])


def texts_of(pages: list[str | None], model) -> list[str]:
    """Main text of each page."""
    cut = [blocks_of(p) for p in pages]
    p = probabilities(Batch(cut), model) if any(cut) else np.zeros(0)
    out, at = [], 0
    for blocks in cut:
        out.append(" ".join(b.text for b, x in zip(blocks, p[at:at + len(blocks)]) if x >= 0.5))
        at += len(blocks)
    return out


def extract(pages: DataFrame, model=None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text and n_chars."""
    model = fit(pages, url_col, html_col) if model is None else model
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            pages_of, texts, held, size = batch.column(2).to_pylist(), [], [], 0
            for page in pages_of:
                held.append(page)
                size += len(page or "")
                if size > 2_000_000:
                    texts += texts_of(held, shared.value)
                    held, size = [], 0
            texts += texts_of(held, shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
