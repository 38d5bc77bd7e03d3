"""LM scoring with a hashed maximum-entropy model over word classes.

p(token | history) = p(class | history) * p(token | class, history). The VOCABULARY most frequent
tokens form WORD_CLASSES classes of equal size; every other token belongs to one of SUFFIX_CLASSES
classes by the hash of its last two bytes. The class softmax has hashed features of the previous
token (2-gram), the one before it (skip) and both (3-gram); the softmax inside a word class has
hashed features of the class and of the previous token with the class. Inside a suffix class a
token's share is its smoothed count in the training corpus, so unseen tokens have probability too.

These broadcast tables give the OWN most frequent tokens values of their own; other tokens share them by
hash. On top of them every previous word and every pair of words of the training corpus has its own
features, as many as the corpus has: a row of class weights for each previous word outside OWN, a weight for
each class that followed a pair, and one for each FREQUENT token that followed a previous word (after
the OWN ones, a pair) within its class. They are fitted one upon the other, each with the ones before held fixed.

Training gathers counts of (history, class) and (previous token, class, token) over all training
documents, then makes STEPS gradient updates: each task computes the gradient of its share of the
histories, the driver adds them up. Then every token is sent, as an event with its history, to the shard of its
previous word, where the features of that word are fitted from the training events and all events are
scored. After an OWN word the pair decides the shard, and after two frequent ones the class too; these
pairs share their value with no other one, so the broadcast tables score their vocabulary tokens on the spot.

Token counts are exact. Only the FREQUENT most frequent tokens (of up to 64 bytes) are broadcast;
the other tokens of each document are joined with the stored counts.

Defined results: null text is empty, its only token is the end; a null id is held out as the hash of
an empty text; repeated rows each get their own result; with no training rows the counts are zero;
an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import bucket_of, encoded, store

END = b"\n"  # the end token; no word holds white space
FREQUENT = 200_000
VOCABULARY = 2048
WORD_CLASSES = 32
SUFFIX_CLASSES = 32
CLASSES = WORD_CLASSES + SUFFIX_CLASSES
SLOTS = VOCABULARY // WORD_CLASSES
OWN = 128  # tokens with a history value of their own; the others share HASHED ones
OWN_FAR = 64
HASHED = 32
HASHED_FAR = 64
NEAR = OWN + HASHED + 1  # values of the previous token, the last one for the start
FAR = OWN_FAR + HASHED_FAR + 1  # values of the token before it
FEATURES = 1 << 15
STEPS = 12
RATE = 0.4
PRIOR = 0.5
LONGEST = 64
_START_NEAR, _START_FAR = NEAR - 1, FAR - 1
# Codes of tokens in a history: the index of a frequent one, 40 bits of hash of any other, the start.
RARE, START = 1 << 40, 1 << 41
RARE_TOKEN = 1 << 18  # an event's token: its index, or this and its class
# Events of a shard, and those a task holds before it sends them.
SHARD, HELD = 400_000, 500_000
BLOCK = 12  # log2 of the texts whose sums make a row
CONTEXT_STEPS = 6
CONTEXT_RATE = 0.7
CONTEXT_PRIOR = 2.0


def suffix_class(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % SUFFIX_CLASSES


def token_hash(token: bytes) -> int:
    """40 bits; a sum of the bytes tells apart what the checksum does not."""
    return zlib.crc32(token) | (zlib.adler32(token) & 0xFF) << 32


def tokens_of(text: str | None) -> list[bytes]:
    words = encoded(text).lower().split()
    words.append(END)
    return words


def _runs(texts: pa.Array, most=500_000):
    held, size = [], 0
    for at in range(0, len(texts), 100):  # a batch holds thousands of texts
        for t in texts.slice(at, 100).to_pylist():
            held.append(tokens_of(t))
            size += len(t or "")
            if size >= most:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_tokens(training: DataFrame) -> DataFrame:
    """Exact counts (token, n) of the `text` column, added up per task before the shuffle."""
    def run(batches):
        total: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

        for batch in batches:
            for run_of in _runs(batch.column(0)):
                for words in run_of:
                    total.update(words)
                if len(total) > 400_000:
                    yield rows()
                    total.clear()
        yield rows()

    return training.mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Lexicon:
    """Frequent tokens with their counts, classes and history values; sums of the suffix classes."""

    def __init__(self, frequent: list[tuple[bytes, int]], n_all: int, n_types: int, suffix: dict[int, tuple[int, int]]):
        ranked = sorted(frequent, key=lambda x: (x[0] != END, -x[1], x[0]))  # the end is always in the vocabulary
        self.n_all, self.n_types = n_all, n_types
        self.index = {t: i for i, (t, _) in enumerate(ranked)}
        self.log_count = np.log10(np.array([c for _, c in ranked] or [0], np.float64) + 0.1)
        size = len(ranked)
        self.known = min(size, VOCABULARY)
        place = np.arange(size)
        ending = np.array([suffix_class(t) for t, _ in ranked], np.int64).reshape(size)
        self.in_vocabulary = place < VOCABULARY
        self.cls = np.where(self.in_vocabulary, place % WORD_CLASSES, WORD_CLASSES + ending)
        self.slot = np.where(self.in_vocabulary, place // WORD_CLASSES, 0)
        hashed = np.array([token_hash(t) for t, _ in ranked], np.int64).reshape(size)
        self.near = np.where(place < OWN, place, OWN + hashed % HASHED)
        self.far = np.where(place < OWN_FAR, place, OWN_FAR + hashed % HASHED_FAR)
        rest = {r: list(suffix.get(r, (0, 0))) for r in range(SUFFIX_CLASSES)}
        for t, c in ranked[:VOCABULARY]:
            rest[suffix_class(t)][0] -= c
            rest[suffix_class(t)][1] -= 1
        self.log_suffix = np.array([math.log10(n + 0.1 * (v + 1)) for n, v in (rest[r] for r in range(SUFFIX_CLASSES))])
        self.log_all = math.log10(n_all + 0.1 * (n_types + 1))

    def look_up(self, texts: list[list[bytes]]):
        """Arrays over all tokens of some texts: index (-1 if not frequent), class, slot, history values and codes."""
        get = self.index.get
        flat = [t for words in texts for t in words]
        at = np.array([get(t, -1) for t in flat], np.int64)
        rare = np.flatnonzero(at < 0)
        unknown = [flat[i] for i in rare.tolist()]
        ending = np.array([suffix_class(t) for t in unknown], np.int64).reshape(len(rare))
        hashed = np.array([token_hash(t) for t in unknown], np.int64).reshape(len(rare))
        safe = np.maximum(at, 0)
        sizes = np.array([len(w) for w in texts], np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        second = first[sizes > 1] + 1

        def column(values, of_rare):
            out = values[safe] if len(values) else np.zeros(len(flat), np.int64)
            out[rare] = of_rare
            return out

        def earlier(values, by, start):
            out = np.full(len(flat), start, np.int64)
            out[by:] = values[:-by]
            out[first] = start
            if by == 2:
                out[second] = start
            return out

        cls, slot = column(self.cls, WORD_CLASSES + ending), column(self.slot, 0)
        near, far = column(self.near, OWN + hashed % HASHED), column(self.far, OWN_FAR + hashed % HASHED_FAR)
        code = column(np.arange(len(self.cls)), RARE + hashed)
        return (flat, at, rare, cls, slot, earlier(near, 1, _START_NEAR), earlier(far, 2, _START_FAR),
                earlier(code, 1, START), earlier(code, 2, START), first, sizes)


def gather(training: DataFrame, lexicon) -> DataFrame:
    """(kind, history, column, n): class counts by history, and slot counts by previous token and class."""
    def run(batches):
        words = lexicon.value
        one = np.zeros(NEAR * FAR * CLASSES, np.int64)
        two = np.zeros(NEAR * WORD_CLASSES * SLOTS, np.int64)
        for batch in batches:
            for texts in _runs(batch.column(0)):
                _, _, _, cls, slot, near, far, _, _, _, _ = words.look_up(texts)
                np.add.at(one, (near * FAR + far) * CLASSES + cls, 1)
                v = cls < WORD_CLASSES
                np.add.at(two, (near[v] * WORD_CLASSES + cls[v]) * SLOTS + slot[v], 1)
        for kind, table, width in ((0, one, CLASSES), (1, two, SLOTS)):
            cells = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), kind, np.int32)), pa.array((cells // width).astype(np.int32)),
                 pa.array((cells % width).astype(np.int32)), pa.array(table[cells])], names=["kind", "history", "c", "n"])

    cells = training.mapInArrow(run, "kind int, history int, c int, n long")
    return cells.groupBy("kind", "history", "c").agg(F.sum("n").alias("n"))


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))


def _mix(*values: np.ndarray) -> np.ndarray:
    h = np.full(len(values[0]), 0x9E3779B97F4A7C15, np.uint64)
    for v in values:
        h = (h ^ v.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def feature_rows(kind: int, history: np.ndarray) -> np.ndarray:
    """Hashed weight rows of each history's active features."""
    if kind == 0:
        near, far = history // FAR, history % FAR
        named = [(1, near), (2, far), (3, history)]
    else:
        named = [(4, history % WORD_CLASSES), (5, history)]
    out = []
    for name, value in named:
        h = (value.astype(np.uint64) + np.uint64(name << 32)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(50)).astype(np.int64))
    return np.stack(out, axis=1)


def allowed_columns(kind: int, history: np.ndarray, known: int) -> np.ndarray:
    """Classes or slots that have tokens: [history, column]."""
    if kind == 0:
        open_ = np.concatenate((np.arange(WORD_CLASSES) < known, np.ones(SUFFIX_CLASSES, bool)))
        return np.broadcast_to(open_, (len(history), CLASSES))
    return np.arange(SLOTS)[None, :] * WORD_CLASSES + (history % WORD_CLASSES)[:, None] < known


def log_softmax(kind: int, history: np.ndarray, weights: np.ndarray, known: int) -> np.ndarray:
    """Natural log-probabilities [history, column]; -inf where there is no token."""
    logits = np.zeros((len(history), CLASSES))
    for column in feature_rows(kind, history).T:
        logits += weights[column]
    logits[~allowed_columns(kind, history, known)] = -np.inf
    top = logits.max(axis=1, keepdims=True)
    top[~np.isfinite(top)] = 0
    total = np.exp(logits - top).sum(axis=1, keepdims=True)
    return np.where(total > 0, logits - top - np.log(np.maximum(total, 1e-300)), -np.inf)


def train(cells: DataFrame, known: int, steps: int = STEPS) -> tuple[np.ndarray, list[float]]:
    """Weights [feature, column] and the log-likelihood before each step, by gradients added up over tasks."""
    spark = cells.sparkSession
    shards = store(cells.groupBy("kind", "history").agg(F.collect_list(F.struct("c", "n")).alias("cells"))  # a row per history
                   .repartition("kind", "history"), "histories")
    weights, history_of_fit = np.zeros((FEATURES, CLASSES), np.float32), []
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches, shared=shared):
            seen, expected, fit = (np.zeros((FEATURES, CLASSES)), np.zeros((FEATURES, CLASSES)), 0.0)
            for batch in batches:
                kinds, histories = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
                lists = batch.column(2)
                owner = np.repeat(np.arange(len(kinds)), np.diff(lists.offsets.to_numpy()))
                counts = np.zeros((len(kinds), CLASSES))
                flat = lists.flatten()
                counts[owner, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
                for kind in (0, 1):
                    rows = np.flatnonzero(kinds == kind)
                    if not len(rows):
                        continue
                    n = counts[rows]
                    log_p = log_softmax(kind, histories[rows], shared.value, known)
                    fit += float(n[n > 0] @ log_p[n > 0])
                    model = np.exp(log_p) * n.sum(axis=1, keepdims=True)
                    for column in feature_rows(kind, histories[rows]).T:
                        order = np.argsort(column)
                        first = _starts(column[order])
                        at = column[order[first]]
                        seen[at] += np.add.reduceat(n[order], first, axis=0)
                        expected[at] += np.add.reduceat(model[order], first, axis=0)
            used = np.flatnonzero(expected.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([fit]), pa.array([used.astype("<i4").tobytes()], pa.binary()),
                 pa.array([seen[used].astype("<f4").tobytes()], pa.binary()), pa.array([expected[used].astype("<f4").tobytes()], pa.binary())],
                names=["fit", "used", "seen", "expected"])

        # Each task sends one gradient of the model's size.
        parts = shards.mapInArrow(gradient, "fit double, used binary, seen binary, expected binary").collect()
        seen, expected = (np.zeros((FEATURES, CLASSES), np.float32) for _ in range(2))
        for r in parts:
            used = np.frombuffer(r["used"], "<i4")
            seen[used] += np.frombuffer(r["seen"], "<f4").reshape(-1, CLASSES)
            expected[used] += np.frombuffer(r["expected"], "<f4").reshape(-1, CLASSES)
        history_of_fit.append(sum(r["fit"] for r in parts))
        del parts
        # The gradient over the expected counts: steps of like size for frequent and rare features.
        step = (seen - expected - PRIOR * weights) / (expected + PRIOR)
        weights = (weights + RATE * np.clip(step, -1.0, 2.0)).astype(np.float32)
        shared.unpersist()
    return weights, history_of_fit


def _own_word(code: np.ndarray) -> np.ndarray:
    return (code < OWN) | (code == START)


def _own_pair(prev: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Pairs whose history stands for no other one."""
    return _own_word(prev) & ((back < OWN_FAR) | (back == START))


class Tables:
    """What the shards need: classes, slots, shares and history values of the frequent tokens, and the fitted tables."""

    def __init__(self, lexicon: Lexicon, classes: np.ndarray, slots: np.ndarray | None):
        self.cls, self.slot, self.near, self.far = (a.astype(np.int32) for a in (lexicon.cls, lexicon.slot, lexicon.near, lexicon.far))
        scale = math.log(10)
        self.classes = np.exp(classes * scale).astype(np.float32)
        self.slots = None if slots is None else (slots * scale).astype(np.float32)
        self.rest = (-lexicon.log_suffix * scale).astype(np.float32)
        # ln of a frequent token's share of its suffix class
        self.share = (lexicon.log_count * scale).astype(np.float32)[:len(self.cls)] + self.rest[np.maximum(self.cls - WORD_CLASSES, 0)]

    def history(self, prev: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def value(code, known, own, hashed, start):
            out = own + (code - RARE) % hashed
            here = code < RARE
            out[here] = known[code[here]]
            out[code == START] = start
            return out

        return value(prev, self.near, OWN, HASHED, _START_NEAR), value(back, self.far, OWN_FAR, HASHED_FAR, _START_FAR)


def previous_word(prev, near, far, cls, training, table: np.ndarray) -> np.ndarray:
    """ln p(class) of events after each previous word has a row of class weights of its own, fitted upon the table's histories."""
    key = prev.astype(np.uint64) * np.uint64(FAR) + far.astype(np.uint64)
    order = np.argsort(key)
    pair = _starts(key[order])  # a previous word and a value before it
    held = np.diff(np.append(pair, len(order)))
    n = np.add.reduceat(training[order].astype(np.float32), pair)
    one = order[pair]
    history, word = near[one] * FAR + far[one], _starts(prev[one])
    of_word = np.repeat(np.arange(len(word)), np.diff(np.append(word, len(pair))))
    ends, event = np.append(word, len(pair)), np.append(pair, len(order))
    out, a = np.empty(len(prev), np.float32), 0
    while a < len(word):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + 8192)) - 1)  # a word has at most FAR pairs
        i, j = ends[a], ends[b]
        p, own, first, times = table[history[i:j]], of_word[i:j] - a, word[a:b] - i, n[i:j]
        mine = order[event[i]:event[j]]
        at = np.repeat(np.arange(j - i), held[i:j])
        c, rows = cls[mine], own[at]
        seen = np.bincount(rows * CLASSES + c, weights=training[mine], minlength=(b - a) * CLASSES).reshape(-1, CLASSES).astype(np.float32)
        w = np.zeros((b - a, CLASSES), np.float32)
        for step in range(CONTEXT_STEPS + 1):
            e = np.exp(w)
            z = np.einsum("uc,uc->u", p, e[own])
            if step < CONTEXT_STEPS:
                expected = np.add.reduceat(p * (times / z)[:, None], first, axis=0) * e
                w += CONTEXT_RATE * np.clip((seen - expected - CONTEXT_PRIOR * w) / (expected + CONTEXT_PRIOR), -1, 2)
        out[mine] = np.log(np.maximum(p[at, c], 1e-30)) + w[rows, c] - np.log(z)[at]
        a = b
    return out


def sharpen(context: np.ndarray, outcome: np.ndarray, base: np.ndarray, training: np.ndarray, known: int) -> np.ndarray:
    """ln p of events whose ln p without the context is `base`, which context and outcome decide.

    Outcomes below `known` that training events of a context have get a weight each; the others keep their
    proportions, and the sum over all outcomes stays 1.
    """
    low = np.uint64((1 << 20) - 1)
    key = (context & ~low) | outcome.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    cell = _starts(key)
    group = _starts(key[cell] & ~low)
    n = np.add.reduceat(training[order].astype(np.float32), cell)
    owner = np.repeat(np.arange(len(group)), np.diff(np.append(group, len(cell))))
    gain = np.zeros(len(cell), np.float32)
    own = np.flatnonzero((n > 0) & ((key[cell] & low) < np.uint64(known)))
    if len(own):
        seen, p = n[own], np.exp(base[order[cell[own]]])
        first = _starts(owner[own])
        with_weight = owner[own[first]]
        g = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(own))))
        total, w = np.add.reduceat(n, group)[with_weight], np.zeros(len(own), np.float32)
        for step in range(CONTEXT_STEPS + 1):
            e = np.exp(w)
            z = 1 + np.add.reduceat(p * (e - 1), first)
            if step < CONTEXT_STEPS:
                expected = (total / z)[g] * p * e
                w += CONTEXT_RATE * np.clip((seen - expected - CONTEXT_PRIOR * w) / (expected + CONTEXT_PRIOR), -1, 2)
        gain[own] = w
        log_z = np.zeros(len(group), np.float32)
        log_z[with_weight] = np.log(z)
        gain -= log_z[owner]
    out = np.empty(len(order), np.float32)
    out[order] = base[order] + np.repeat(gain, np.diff(np.append(cell, len(order))))
    return out


def score_events(tables: Tables, prev: np.ndarray, back: np.ndarray, token: np.ndarray, training: np.ndarray) -> np.ndarray:
    """log10 p of the events of a shard; a token that is not frequent lacks the log10 of its smoothed count."""
    here = token < RARE_TOKEN
    known = np.where(here, token, 0)
    cls = np.where(here, tables.cls[known] if len(tables.cls) else 0, token - RARE_TOKEN)
    near, far = tables.history(prev, back)
    p_class = np.log(np.maximum(tables.classes[near * FAR + far, cls], 1e-30))
    other = np.flatnonzero(~_own_word(prev))
    if len(other):
        p_class[other] = previous_word(*(a[other] for a in (prev, near, far, cls, training)), tables.classes)
    shared = np.flatnonzero(~_own_pair(prev, back))
    if len(shared):
        p_class[shared] = sharpen(_mix(prev[shared], back[shared]), cls[shared], p_class[shared], training[shared], CLASSES)

    p_token = np.where(here, tables.share[known] if len(tables.cls) else 0, tables.rest[np.maximum(cls - WORD_CLASSES, 0)]).astype(np.float32)
    v = cls < WORD_CLASSES
    if v.any():
        p_token[v] = tables.slots[near[v] * WORD_CLASSES + cls[v], tables.slot[known[v]]]
    context = np.where(_own_word(prev), _mix(prev, back, cls), _mix(prev, cls))
    p_token = sharpen(context, token, p_token, training, RARE_TOKEN)
    return (p_class.astype(np.float64) + p_token) / math.log(10)


_WIDTHS = (6, 6, 3, 4)  # bytes of an event's previous two tokens, its token, and its document with the held-out flag


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of numbers as planes of equal bytes, compressed."""
    planes = [np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8)[:, :w].T for c, w in zip(columns, _WIDTHS, strict=True)]
    return pa.compress(np.ascontiguousarray(np.concatenate(planes)), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, n * sum(_WIDTHS), codec="zstd", asbytes=True), np.uint8).reshape(-1, n)
    out, at = [], 0
    for w in _WIDTHS:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = planes[at:at + w].T
        out.append(wide.view("<i8").reshape(n))
        at += w
    return out


class Model:
    """What scoring needs: the lexicon and log10 tables of classes and slots."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon = lexicon
        scale = 1 / math.log(10)
        self.classes = (log_softmax(0, np.arange(NEAR * FAR), weights, lexicon.known) * scale).astype(np.float32)
        self.slots = (log_softmax(1, np.arange(NEAR * WORD_CLASSES), weights, lexicon.known) * scale).astype(np.float32) if lexicon.known else None
        # Held-out rows alone make no more shards.
        self.shards = 64 + lexicon.n_all // SHARD

    def parts(self, texts: list[list[bytes]]):
        """Per text: tokens, frequent ones, their summed log10(c + 0.1), what is scored on the spot, rare tokens; and the events."""
        lex = self.lexicon
        flat, at, rare, cls, slot, near, far, prev, back, first, sizes = lex.look_up(texts)
        here, v, pair = at >= 0, cls < WORD_CLASSES, _own_pair(prev, back)
        exact = v & pair
        score = np.zeros(len(flat))
        if exact.any():
            n, c = near[exact], cls[exact]
            score[exact] = self.classes[n * FAR + far[exact], c] + self.slots[n * WORD_CLASSES + c, slot[exact]]
        # Counts of suffix classes are in the events' shares; here only for the base.
        counted = np.where(here, lex.log_count[np.maximum(at, 0)], 0.0)
        cut = np.searchsorted(rare, np.concatenate((first, [len(flat)])))
        rare = rare.tolist()
        unknown = [[flat[i] for i in rare[a:b]] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        send = np.flatnonzero(~exact)
        prev, back, cls = prev[send], back[send], cls[send]
        at_word, at_pair, at_class = _mix(prev), _mix(prev, back), _mix(prev, back, cls)
        shard = np.where(pair[send], at_class, np.where(_own_word(prev), at_pair, at_word)) % np.uint64(self.shards)
        text = np.repeat(np.arange(len(texts)), sizes)[send]
        events = shard.astype(np.int64), prev, back, np.where(here[send], at[send], RARE_TOKEN + cls), text
        return (sizes, np.add.reduceat(here.astype(np.int64), first), np.add.reduceat(counted, first),
                np.add.reduceat(score, first), unknown, events)


def _threshold(counts: DataFrame, most: int) -> int:
    """Least log-scale step of a count such that at most `most` tokens reach it."""
    sizes = counts.where(F.octet_length("token") <= LONGEST).groupBy("step").count().orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 30  # at most a few hundred steps
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return least


def fit(docs: DataFrame, held_out, text_col: str = "text") -> tuple[Model, DataFrame, list[float]]:
    """Model, stored exact counts (token, n, step), and the course of the log-likelihood."""
    training = docs.where(~held_out).select(F.col(text_col).alias("text"))
    counts = count_tokens(training)
    counts = store(counts.withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "counts")
    ending = F.crc32(F.expr("right_bytes")) % SUFFIX_CLASSES
    sums = counts.withColumn("right_bytes", F.expr("substring(token, -2, 2)")).groupBy(ending.alias("r")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    frequent = counts.where((F.octet_length("token") <= LONGEST) & (F.col("step") >= _threshold(counts, FREQUENT)))
    found = frequent.select("token", "n").toArrow()
    pairs = list(zip(found.column(0).to_pylist(), found.column(1).to_pylist()))
    if not any(t == END for t, _ in pairs):  # many token kinds may be more frequent than the ends of few long texts
        pairs += [(bytes(r["token"]), r["n"]) for r in counts.where(F.col("token") == F.lit(END)).collect()]
    del found
    lexicon = Lexicon(pairs, sum(r["n"] for r in sums), sum(r["v"] for r in sums), {r["r"]: (r["n"], r["v"]) for r in sums})
    del pairs
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    weights, course = train(gather(training, shared), lexicon.known)
    shared.unpersist()
    return Model(lexicon, weights), counts, course


_TEXT = ("row", "doc_id", "held_out", "n_tokens", "known", "counted", "modelled", "rare")


def _frame(columns: dict[str, pa.Array], kinds: dict[str, pa.DataType], n: int) -> pa.RecordBatch:
    """A batch of all columns in `kinds`; those not given are null."""
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in kinds.items()], names=list(kinds))


def _kinds(doc_id: pa.DataType) -> dict[str, pa.DataType]:
    types = (pa.int64(), doc_id, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()))
    return dict(zip(_TEXT, types, strict=True))


def _sent(batches, model: Model):
    """The texts' own rows, and their events packed by shard."""
    waiting, size = [], 0

    def flush(kinds):
        shard, prev, back, token, row, held = (np.concatenate(c) for c in zip(*waiting))
        first = int(row.min())
        order = np.argsort(shard, kind="stable")
        cut = np.append(_starts(shard[order]), len(order))
        columns = [c[order] for c in (prev, back, token, (row - first) * 2 + held)]
        data = [pack([c[a:b] for c in columns]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        n = len(data)
        return _frame({"shard": pa.array(shard[order[cut[:-1]]]), "row": pa.array(np.full(n, first)), "n": pa.array(np.diff(cut).astype(np.int32)),
                       "events": pa.array(data, pa.binary())}, kinds, n)

    kinds = None
    for batch in batches:
        at = 0
        kinds = {"shard": pa.int64(), **_kinds(batch.schema.field(0).type), "n": pa.int32(), "events": pa.binary()}
        for texts in _runs(batch.column(2)):
            sizes, known, counted, modelled, rare, (shard, prev, back, token, text) = model.parts(texts)
            n = len(texts)
            doc_id, held, row = (batch.column(i).slice(at, n) for i in (0, 1, 3))
            at += n
            numbers, flags = row.to_numpy(), held.to_numpy(zero_copy_only=False).astype(np.int64)
            own = {"row": row, "doc_id": doc_id, "held_out": held, "n_tokens": pa.array(sizes), "known": pa.array(known),
                   "counted": pa.array(counted), "modelled": pa.array(modelled), "rare": pa.array(rare, pa.list_(pa.binary()))}
            yield _frame({"shard": pa.array(-1 - numbers % 1021)} | own, kinds, n)
            if len(shard):
                waiting.append((shard, prev, back, token, numbers[text], flags[text]))
                size += len(shard)
            if size >= HELD:
                yield flush(kinds)
                waiting.clear()
                size = 0
    if waiting:
        yield flush(kinds)


def _scored(batches, tables: Tables):
    """The texts' own rows as they are, and the sums of their events' scores, a row for each block of texts."""
    events, shard, sums = [], None, []

    def work():
        prev, back, token, text = (np.concatenate(c) for c in zip(*events))
        p = score_events(tables, prev, back, token, text & 1 == 0)
        sums.append(_added(text >> 1, p))
        events.clear()

    def added(kinds):
        rows, total = _added(*(np.concatenate(c) for c in zip(*sums)))
        sums.clear()
        cut = np.append(_starts(rows >> BLOCK), len(rows))
        place, value = (rows & (1 << BLOCK) - 1).astype("<u2"), total.astype("<f4")
        data = [place[a:b].tobytes() + value[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return _frame({"row": pa.array(rows[cut[:-1]] >> BLOCK), "part": pa.array(data, pa.binary())}, kinds, len(data))

    kinds = None
    for batch in batches:
        kinds = {**_kinds(batch.schema.field("doc_id").type), "part": pa.binary()}
        shards, rows, n = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("shard", "row", "n"))
        data = batch.column(batch.schema.get_field_index("events"))
        texts = int(np.searchsorted(shards, 0))  # they come first
        if texts:
            part = batch.slice(0, texts)
            yield _frame({c: part.column(part.schema.get_field_index(c)) for c in _TEXT}, kinds, texts)
        for i in range(texts, len(shards)):
            if shards[i] != shard and events:
                work()
                if sum(len(s[0]) for s in sums) > 2_000_000:
                    yield added(kinds)
            shard = shards[i]
            prev, back, token, text = unpack(data[i].as_py(), int(n[i]))
            events.append((prev, back, token, text + 2 * rows[i]))
    if events:
        work()
    if sums:
        yield added(kinds)


def _summed(batches):
    """The sums of each text from those of all tasks."""
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total, there = blocks.setdefault(block, (np.zeros(1 << BLOCK), np.zeros(1 << BLOCK, bool)))
            n = len(data) // 6
            place = np.frombuffer(data, "<u2", n)
            total[place] += np.frombuffer(data, "<f4", n, 2 * n)
            there[place] = True
    for block, (total, there) in blocks.items():
        place = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array((block << BLOCK) + place), pa.array(total[place])], names=["row", "m"])


def _added(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the values by row."""
    order = np.argsort(rows, kind="stable")
    first = _starts(rows[order])
    return rows[order[first]], np.add.reduceat(values[order], first)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on the rows whose crc32(id as text) modulo 10 is not 0 and score all rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), (bucket_of(id_col, 10) == 0).alias("held_out"), F.col(text_col).alias("text"))
    model, counts, _ = fit(rows, F.col("held_out"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    tables = spark.sparkContext.broadcast(Tables(model.lexicon, model.classes, model.slots))
    kind = rows.schema["doc_id"].dataType.simpleString()
    per_text = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, counted double, modelled double, rare array<binary>"
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # A row is a text, or the events that some texts have for one shard.
    sent = rows.mapInArrow(lambda batches: _sent(batches, shared.value), f"shard long, {per_text}, n int, events binary")
    parts = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        lambda batches: _scored(batches, tables.value), f"{per_text}, part binary")
    parts = store(parts, "parts")
    texts = parts.where(F.col("n_tokens").isNotNull())
    # A rare token has a small count, so no token of this join is hot.
    found = texts.select("row", F.explode("rare").alias("token")).join(counts.select("token", "n"), "token", "left")
    found = found.select("row", F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)).alias("s"), F.col("n").isNotNull().cast("int").alias("k"), F.lit(0.0).alias("m"))
    sums = parts.where(F.col("part").isNotNull()).select("row", "part").repartition("row").mapInArrow(_summed, "row long, m double")
    sums = sums.select("row", F.lit(0.0).alias("s"), F.lit(0).alias("k"), "m")
    sums = found.unionByName(sums).groupBy("row").agg(*[F.sum(c).alias(c) for c in ("s", "k", "m")])
    out = texts.drop("rare", "part").join(sums, "row", "left")
    lex, s, m = model.lexicon, F.coalesce("s", F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(lex.n_all).cast("long").alias("train_tokens"),
        (F.col("counted") + s - F.col("n_tokens") * F.lit(lex.log_all)).alias("base_score"), (F.col("modelled") + m + s).alias("score"))
