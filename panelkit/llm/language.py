"""Language ID by mixture inference.

Learning counts hashed byte n-grams of lower-cased letters per language. For a new text each word's
log-likelihood under a language is the mean over the n-gram orders of its n-grams' log-probabilities,
and the text is a mixture of languages: expectation-maximisation over its words estimates the
proportions. Candidate sets are the likeliest one, two, three and more languages of that estimate, up
to the size from which no larger set can win; the set with the best log-likelihood less a penalty per
language and log of the words is taken, and the language with the largest proportion in it is the
prediction. The model is held in blocks of LANGUAGE_BLOCK languages, of any number.

Defined results: null text, and text without a letter, is `und` with score 0; so is everything when
no language was learned. Rows with null language or text teach nothing. Equal proportions go to the
smaller language name. Repeated rows each get their own result; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import bucket_of, store

ORDERS = (2, 3, 4)
BUCKETS = 1 << 14
SMOOTHING = 0.5
# Languages in one block of the model, and in the counts that a task holds at once.
LANGUAGE_BLOCK = 64
EM_STEPS = 8
# Words, and bytes, that are worked on at a time, so that a long text takes memory for its words only once.
SLICE = 1 << 15
# Penalty of one more language, times the log of the number of words.
PENALTY = 2.0
# Least proportion of the predicted language in a document that the pipeline keeps.
DOMINANT = 0.5

_NOT_LETTER = re.compile(r"[\W\d_]+")
# Fixed odd multipliers of the n-gram hash, one per byte place.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def letters(text: str) -> str:
    """Lower-cased runs of letters, with one space around each."""
    return " " + _NOT_LETTER.sub(" ", text.lower()).strip() + " "


def features(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Byte array of all texts, n-gram buckets per order, word starts, and each word's text number.

    A word runs from its leading space to the byte before the next one, so n-grams see word borders.
    """
    parts = [letters(t).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"".join(parts) + b"    ", np.uint8).astype(np.uint32)
    n = len(data) - 4
    grams = []
    for order in ORDERS:
        h = np.zeros(n, np.uint32)
        for j in range(order):
            h += data[j:n + j] * np.uint32(_MULTIPLIERS[j])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        grams.append((h >> np.uint32(32 - 14)).astype(np.int32))
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    space = data[:n] == 32
    space[ends - 1] = False  # the closing space of a text starts no word
    starts = np.flatnonzero(space)
    return data, grams, starts, np.searchsorted(ends, starts, side="right")


def fit(docs: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> tuple[list[str], list[np.ndarray]]:
    """Learned languages in order of name, and log-probabilities [order, bucket, language] in blocks of languages.

    Learns from all rows outside `held_out` (crc32 of the id modulo 4 is 2, unless given).
    """
    held_out = bucket_of(id_col, 4) == 2 if held_out is None else held_out
    rows = docs.where(~held_out).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())

    def counted(totals: dict[str, np.ndarray]):
        for lang, table in totals.items():
            k, b = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(table[k, b])],
                names=["lang", "k", "b", "n"])

    def count(batches: Iterator[pa.RecordBatch]):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for lang in sorted(set(langs.tolist())):
                if len(totals) >= LANGUAGE_BLOCK and lang not in totals:
                    yield from counted(totals)
                    totals.clear()
                table = totals.setdefault(lang, np.zeros((len(ORDERS), BUCKETS), np.int64))
                mine = [texts[i] for i in np.flatnonzero(langs == lang)]
                for run in _runs(mine):
                    _, grams, _, _ = features(run)
                    for k, g in enumerate(grams):
                        table[k] += np.bincount(g, minlength=BUCKETS)
        yield from counted(totals)

    counts = rows.mapInArrow(count, "lang string, k int, b int, n long")
    counts = counts.groupBy("lang", "k", "b").agg(F.sum("n").alias("n"))
    counts = store(counts, "languages")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    return langs, [_block(counts, langs[i:i + LANGUAGE_BLOCK]) for i in range(0, len(langs), LANGUAGE_BLOCK)]


def _block(counts: DataFrame, langs: list[str]) -> np.ndarray:
    """Log-probabilities [order, bucket, language] of some languages."""
    # At most LANGUAGE_BLOCK * orders * buckets numbers.
    found = counts.where(F.col("lang").isin(langs)).toPandas()
    table = np.zeros((len(langs), len(ORDERS), BUCKETS))
    where = {lang: i for i, lang in enumerate(langs)}
    table[found["lang"].map(where).to_numpy(int), found["k"].to_numpy(int), found["b"].to_numpy(int)] = found["n"].to_numpy()
    table += SMOOTHING
    table /= table.sum(axis=2, keepdims=True)
    return np.ascontiguousarray(np.log(table).transpose(1, 2, 0).astype(np.float32))


def _runs(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together; a text is never cut."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _per_text(value, likelihood: np.ndarray, share: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums by text of value(likelihood, share) over its words, SLICE words at a time; a text may go on in the next slice."""
    total = None
    for at in range(0, len(owner), SLICE):
        texts = owner[at:at + SLICE]
        part = value(likelihood[at:at + SLICE], share[texts])
        first = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1])))
        if total is None:
            total = np.zeros((len(share), *part.shape[1:]))
        total[texts[first]] += np.add.reduceat(part, first, axis=0)
    return total


def _expected(likelihood: np.ndarray, share: np.ndarray) -> np.ndarray:
    joint = likelihood * share
    joint /= joint.sum(axis=1, keepdims=True)
    return joint


def _log_mixed(likelihood: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.log((likelihood * share).sum(axis=1))


def _em(likelihood: np.ndarray, owner: np.ndarray, counts: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text; `allowed` marks the languages of its set."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(EM_STEPS):
        share = _per_text(_expected, likelihood, share, owner) / counts[:, None]
    return share, _per_text(_log_mixed, likelihood, share, owner)


def _most_likelihood(likelihood: np.ndarray, owner: np.ndarray, counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A bound that no mixture's log-likelihood of a text exceeds, as that is concave in the proportions."""
    slope = _per_text(lambda x, s: x / (x * s).sum(axis=1, keepdims=True), likelihood, share, owner).max(axis=1)
    return _per_text(_log_mixed, likelihood, share, owner) + slope - counts


def _word_sums(table: np.ndarray, grams: np.ndarray, starts: np.ndarray, out: np.ndarray) -> None:
    """Add to each word the log-probabilities of its n-grams, runs of words of about SLICE bytes at a time."""
    ends = np.append(starts[1:], len(grams))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, side="right")))
        if ends[b - 1] - starts[a] <= SLICE:
            out[a:b] += np.add.reduceat(table[grams[starts[a]:ends[b - 1]]], starts[a:b] - starts[a], axis=0)
        else:  # one word longer than a slice
            for at in range(starts[a], ends[a], SLICE):
                out[a] += table[grams[at:min(at + SLICE, ends[a])]].sum(axis=0)
        a = b


def infer(texts: list[str], model: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [text, language] in the selected set, all 0 for texts without letters."""
    n_lang = sum(block.shape[2] for block in model)
    out = np.zeros((len(texts), n_lang))
    _, grams, starts, owner = features(texts)
    if not len(starts) or not n_lang:
        return out, np.zeros(len(texts), np.int64)
    words = np.zeros((len(starts), n_lang))
    at = 0
    for block in model:
        for k, g in enumerate(grams):
            _word_sums(block[k], g, starts, words[:, at:at + block.shape[2]])
        at += block.shape[2]
    words /= len(grams)
    # Likelihoods relative to the best language of the word, floored so that no word decides alone.
    best = words.max(axis=1, keepdims=True)
    likelihood = words
    likelihood -= best
    np.exp(np.maximum(likelihood, -30.0, out=likelihood), out=likelihood)
    there, counts = np.unique(owner, return_counts=True)
    local = np.repeat(np.arange(len(there)), counts)
    every = np.ones((len(there), n_lang))
    share, _ = _em(likelihood, local, counts, every)
    order = np.argsort(-share, axis=1, kind="stable")
    chosen = np.zeros_like(share)
    value = np.full(len(there), -np.inf)
    floored = np.maximum(likelihood, 1e-13, out=likelihood)
    most = _most_likelihood(floored, local, counts, share)
    for size in range(1, n_lang + 1):
        # A larger set is tried only where the full mixture gives its last language some weight and the penalty lets it win.
        todo = np.arange(len(there)) if size == 1 else np.flatnonzero(
            (share[np.arange(len(there)), order[:, size - 1]] > 0.5 / counts) & (most - PENALTY * size * np.log(counts + 1) > value))
        if not len(todo):
            break
        allowed = np.zeros((len(todo), n_lang))
        np.put_along_axis(allowed, order[todo, :size], 1.0, axis=1)
        mask = np.zeros(len(there), bool)
        mask[todo] = True
        c = counts[todo]
        part, log_lik = _em(floored if mask.all() else floored[mask[local]], np.repeat(np.arange(len(todo)), c), c, allowed)
        score = log_lik - PENALTY * size * np.log(c + 1)
        better = score > value[todo]
        value[todo[better]] = score[better]
        chosen[todo[better]] = part[better]
    out[there] = chosen
    n_words = np.zeros(len(texts), np.int64)
    n_words[there] = counts
    return out, n_words


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict_texts(texts: list[str | None], langs: list[str], model: list[np.ndarray]) -> tuple[list[str], list[float], list[int]]:
    """Language, proportion and size of the selected set of each text."""
    names, scores, sizes = ["und"] * len(texts), [0.0] * len(texts), [0] * len(texts)
    real = [i for i, t in enumerate(texts) if has_letter(t)]
    at = 0
    for run in _runs([texts[i] for i in real], 300_000 * LANGUAGE_BLOCK // max(LANGUAGE_BLOCK, len(langs))):
        share, _ = infer(run, model)
        for row in share:
            i = real[at]
            at += 1
            if len(row) and row.max() > 0:
                best = int(row.argmax())
                names[i], scores[i], sizes[i] = langs[best], float(min(1.0, row[best])), int((row > 0).sum())
            elif langs:  # letters that are in no word of the model's alphabet
                names[i], scores[i], sizes[i] = langs[0], 1.0 / len(langs), len(langs)
    return names, scores, sizes


def predict(docs: DataFrame, learned: tuple[list[str], list[np.ndarray]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, predicted language, its proportion, and the number of languages in its set."""
    langs, model = learned
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in model]
    rows = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(id_col, 4) == 2).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            names, scores, sizes = predict_texts(batch.column(2).to_pylist(), langs, [block.value for block in shared])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())],
                names=["doc_id", "held_out", "lang_pred", "score", "n_langs"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_langs long")


def keep_dominant(docs: DataFrame, learned: tuple[list[str], list[np.ndarray]], text_col: str = "text", least: float = DOMINANT) -> DataFrame:
    """The rows whose predicted language is known and holds at least `least` of the words, all columns kept."""
    langs, model = learned
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in model]
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names, scores, _ = predict_texts(batch.column(at).to_pylist(), langs, [block.value for block in shared])
            yield batch.filter(pa.array([n != "und" and s >= least for n, s in zip(names, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
