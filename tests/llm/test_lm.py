"""LM scoring: exact counts and base scores, a proper distribution, and held-out gain over the base."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import lm
from panelkit.llm.common import load

SCHEMA = "doc_id long, text string, n_tokens int, score string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def brute(rows):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
    c = collections.Counter(w for (_, t), h in zip(rows, held) if not h for w in words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(rows, held):
        w = words(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), n, base))
    return out


@pytest.mark.parametrize("most", [200_000, 3])
def test_counts_and_base(spark, monkeypatch, most):
    monkeypatch.setattr(lm, "FREQUENT", most)
    texts = [None, "", "a b A", "the cat the dog", "É é \x1c x", "y" * 200 + " z", "the " * 5000, " \n\t", "the cat the dog"] * 4
    rows = [*enumerate(texts), (None, "the null"), (3, "the cat the dog")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    got = sorted(lm.score(docs).collect(), key=lambda r: (str(r["doc_id"]), r["base_score"]))
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[5]))
    for g, w in zip(got, want, strict=True):
        assert tuple(g)[:5] == w[:5] and math.isclose(g["base_score"], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(g["score"]) and g["score"] < 0


def test_no_training_rows(spark):
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    out = lm.score(spark.createDataFrame([(held, "a b", 1, "x")], SCHEMA)).collect()
    assert out[0]["train_tokens"] == 0 and out[0]["n_known"] == 0 and abs(out[0]["base_score"]) < 1e-9
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_distribution_and_gain(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)
    model, counts, course = lm.fit(rows, F.col("held"))
    assert course[-1] > course[0] and all(b > a - 1e-6 * abs(a) for a, b in zip(course, course[1:]))
    np.testing.assert_allclose((10.0 ** model.classes).sum(axis=1), 1, atol=1e-6)
    np.testing.assert_allclose((10.0 ** model.slots).sum(axis=1), 1, atol=1e-6)
    # Suffix classes: shares of all tokens outside the vocabulary and of one unseen kind add up to 1.
    vocabulary = {t for t, i in model.lexicon.index.items() if i < lm.VOCABULARY}
    share = np.full(lm.SUFFIX_CLASSES, 0.1)
    for r in counts.collect():
        t = bytes(r["token"])
        if t not in vocabulary:
            share[lm.suffix_class(t)] += r["n"] + 0.1
    np.testing.assert_allclose(share / 10.0 ** model.lexicon.log_suffix, 1, rtol=1e-6)
    out = lm.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (out[0] - out[1]) / out[2] > 0.05


def pairs_corpus():
    """300 words each with a follower of its own, in random order; endings tell nothing."""
    rng = np.random.default_rng(5)
    training = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    first, then = [f"w{i:03d}xx" for i in range(300)], [f"v{i:03d}yy" for i in range(300)]

    def text(of):
        return " ".join(f"{first[i]} {then[of(i)]}" for i in rng.permutation(300))

    rows = [(i, text(lambda i: i)) for i in training[:60]]
    return [*rows, (held[0], text(lambda i: i)), (held[1], text(lambda i: (i + 7) % 300))], held


def test_every_word_has_a_history(spark):
    rows, (right, wrong) = pairs_corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    got = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert got[right]["base_score"] == pytest.approx(got[wrong]["base_score"])
    # Half of the tokens are followers; after their own word they must be far more likely, each.
    assert (got[right]["score"] - got[wrong]["score"]) / 300 > 1.5


def test_repeated_documents_are_scored_apart(spark):
    rng = np.random.default_rng(6)
    training = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10]
    texts = [" ".join(f"t{x}zz" for x in rng.integers(0, 400, 200)) for _ in range(150)]
    rows = [*zip(training, texts), *zip(training[150:], texts[:30])]
    got = {}
    for r in lm.score(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)).collect():
        got.setdefault(r["doc_id"], r["score"] - r["base_score"])
    twice, once = [got[i] for i in training[:30]], [got[i] for i in training[30:150]]
    assert min(twice) > max(once)


def test_context_probabilities_add_up():
    rng = np.random.default_rng(7)
    n, codes = 4000, np.concatenate((np.arange(200), lm.RARE + rng.integers(0, 1 << 40, 40)))
    lexicon = lm.Lexicon([(b"\n", 900), *((f"t{i}".encode(), 3001 - i) for i in range(3000))], 9_600_000, 64_000, {r: (300_000, 2000) for r in range(32)})
    model = lm.Model(lexicon, rng.normal(0, 0.3, (lm.FEATURES, lm.CLASSES)).astype(np.float32))
    tables = lm.Tables(lexicon, model.classes, model.slots)
    prev, back = rng.choice(codes, n), rng.choice(codes[-30:], n)
    cls = rng.integers(0, lm.CLASSES, n)
    # Held-out events that ask for every class after some pairs, seen and unseen ones.
    asked = np.repeat(np.concatenate((prev[:20], prev[20:40])), lm.CLASSES), np.repeat(np.concatenate((back[:20], back[60:80])), lm.CLASSES)
    prev, back = np.concatenate((prev, asked[0])), np.concatenate((back, asked[1]))
    cls, training = np.concatenate((cls, np.tile(np.arange(lm.CLASSES), 40))), np.arange(n + 40 * lm.CLASSES) < n
    near, far = tables.history(prev, back)
    p = lm.previous_word(prev, near, far, cls, training, tables.classes)
    np.testing.assert_allclose(np.exp(p[n:]).reshape(40, -1).sum(axis=1), 1, rtol=1e-4)
    q = lm.sharpen(lm._mix(prev, back), cls, p, training, lm.CLASSES)
    np.testing.assert_allclose(np.exp(q[n:]).reshape(40, -1).sum(axis=1), 1, rtol=1e-4)
    assert q[:n].sum() > p[:n].sum() > np.log(tables.classes[near * lm.FAR + far, cls])[:n].sum()
    # One context by hand: the weights' fixed point, in the limit of many steps, is near.
    base = np.log(np.array([0.2, 0.2, 0.2, 0.1, 0.3], np.float32))
    got = np.exp(lm.sharpen(np.zeros(5, np.uint64), np.array([0, 0, 0, 1, 2]), base, np.array([1, 1, 1, 1, 0], bool), 64))
    w = np.zeros(2)
    for _ in range(2000):
        s = np.array([0.2, 0.1]) * np.exp(w)
        w += 0.05 * (np.array([3, 1]) - 4 * s / (0.7 + s.sum()) - lm.CONTEXT_PRIOR * w)
    s = np.array([0.2, 0.1]) * np.exp(w)
    np.testing.assert_allclose(got[[0, 3, 4]], np.append(s, 0.3) / (0.7 + s.sum()), rtol=0.02)


def test_events_are_packed_whole():
    rng = np.random.default_rng(8)
    columns = [rng.integers(0, 1 << 8 * w - 1, 999) for w in lm._WIDTHS]
    for a, b in zip(columns, lm.unpack(lm.pack(columns), 999), strict=True):
        np.testing.assert_array_equal(a, b)
