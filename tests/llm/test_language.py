"""Language ID: held-out accuracy, mixtures, defined results."""

import math

import numpy as np
import pytest

from panelkit.llm import language
from panelkit.llm.common import load

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = load(spark, FOLDER, "documents")
    out = language.predict(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_mixture_and_sets(spark):
    docs = load(spark, FOLDER, "documents")
    learned = language.fit(docs)
    by = {lang: " ".join(r["text"] for r in docs.where(docs["lang"] == lang).limit(5).collect()).split()[:400] for lang in learned[0]}
    mixed = " ".join(by["en"][:300] + by["de"][:100])
    share, n = language.infer([mixed, " ".join(by["fr"])], learned[1])
    found = dict(zip(learned[0], share[0]))
    assert n[0] > 300 and (share[0] > 0).sum() == 2 and 0.65 < found["en"] < 0.85 and 0.15 < found["de"] < 0.35
    assert (share[1] > 0).sum() == 1 and learned[0][int(share[1].argmax())] == "fr"
    np.testing.assert_allclose(share.sum(axis=1), 1)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, lang_pred string, held_out int"
    rows = [(i, t, g, "x", 1) for i, (t, g) in enumerate([
        (None, "en"), ("", "en"), ("12 34 !!", "de"), ("the cat and the dog", "en"), ("der hund und die katze", "de"),
        ("the cat " * 20_000, "en"), ("das haus und der garten", None), ("日本語", "ja"), ("the cat and the dog", "en")] * 3)]
    docs = spark.createDataFrame([*rows, (None, "the the", "en", None, None), (3, "the cat and the dog", "en", None, None)], schema)
    learned = language.fit(docs)
    out = language.predict(docs, learned).collect()
    assert len(out) == len(rows) + 2
    texts = {i: t for i, t, *_ in rows}
    for r in out:
        if r["doc_id"] is not None and not any(map(str.isalpha, texts[r["doc_id"]] or "")):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in learned[0] and 0 < r["score"] <= 1
    kept = language.keep_dominant(docs, learned)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    nothing = docs.limit(0)
    assert language.predict(nothing, language.fit(nothing)).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(nothing)).collect()} == {"und"}


def test_four_languages_in_one_text(spark):
    docs = load(spark, FOLDER, "documents")
    langs, model = language.fit(docs)
    by = {g: " ".join(r["text"] for r in docs.where(docs["lang"] == g).limit(8).collect()).split() for g in langs}
    parts = dict(zip(langs, (400, 200, 200, 200)))
    share, _ = language.infer([" ".join(w for g, n in parts.items() for w in by[g][:n])], model)
    assert len(langs) == 4 and (share[0] > 0).all() and share[0].max() < language.DOMINANT
    for g, s in zip(langs, share[0]):
        assert abs(s - parts[g] / 1000) < 0.1


def test_more_languages_than_a_block(spark):
    letters = "abcdefghijklm"
    rows = [(i, " ".join(letters[j % 13] + letters[(i + k) % 13] + letters[i // 13] * 3 + letters[i % 13] * 2 for k in range(40) for j in (i, i + k)), f"l{i:03}")
            for i in range(150) for _ in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = language.fit(docs, held_out=docs["doc_id"] < 0)
    assert len(langs) == 150 and [b.shape[2] for b in model] == [64, 64, 22]
    out = language.predict(docs, (langs, model)).collect()
    assert len(out) == 300 and all(r["lang_pred"] == f"l{r['doc_id']:03}" for r in out)
    assert language.keep_dominant(docs, (langs, model)).count() == 300


def plain_inference(text, model):
    """Proportions of a text by the same rules in plain Python: word likelihoods, mixtures, penalised sets."""
    raw = language.letters(text).encode("utf-8", "surrogatepass")
    data = list(raw) + [32] * 4
    tables = [np.concatenate([block[k] for block in model], axis=1) for k in range(len(language.ORDERS))]
    starts = [i for i in range(len(raw) - 1) if raw[i] == 32]
    words = []
    for a, b in zip(starts, starts[1:] + [len(raw)]):
        score = np.zeros(tables[0].shape[1])
        for k, order in enumerate(language.ORDERS):
            for i in range(a, b):
                x = 0
                for j in range(order):
                    x = (x + data[i + j] * language._MULTIPLIERS[j]) % 2**32
                x ^= x >> 15
                score += tables[k][(x * 0x2C1B3C6D % 2**32) >> 18]
        score /= len(language.ORDERS)
        words.append([max(math.exp(max(v, -30.0)), 1e-13) for v in score - score.max()])

    def mixture(langs):
        share = {x: 1 / len(langs) for x in langs}
        for _ in range(language.EM_STEPS):
            new = dict.fromkeys(langs, 0.0)
            for w in words:
                total = sum(w[x] * share[x] for x in langs)
                for x in langs:
                    new[x] += w[x] * share[x] / total / len(words)
            share = new
        return share, sum(math.log(sum(w[x] * share[x] for x in langs)) for w in words)

    every = list(range(tables[0].shape[1]))
    full, _ = mixture(every)
    order = sorted(every, key=lambda x: -full[x])
    best = None
    for size in range(1, len(every) + 1):
        if size > 1 and full[order[size - 1]] <= 0.5 / len(words):
            break
        share, fit = mixture(order[:size])
        value = fit - language.PENALTY * size * math.log(len(words) + 1)
        if best is None or value > best[0]:
            best = value, share
    return [best[1].get(x, 0.0) for x in every]


@pytest.mark.parametrize("slice_size", [language.SLICE, 5])
def test_proportions_and_sets_equal_plain_python(spark, monkeypatch, slice_size):
    monkeypatch.setattr(language, "SLICE", slice_size)
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    _, model = language.fit(docs)
    rows = docs.where("text is not null and length(text) < 600").orderBy("doc_id").limit(18).collect()
    texts = [r["text"] for r in rows] + [rows[0]["text"] + " " + rows[3]["text"] + " " + rows[7]["text"], "Donaudampfschifffahrt" * 9]
    texts = [t for t in texts if language.has_letter(t)]
    share, _ = language.infer(texts, model)
    for got, text in zip(share, texts, strict=True):
        np.testing.assert_allclose(got, plain_inference(text, model), atol=1e-6)
