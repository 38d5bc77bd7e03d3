"""Periodic runs against a plain search of every period, and the grammar's extensions against direct comparison."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from panelkit.llm import periodic

SCHEMA = "doc_id long, text string"


def brute_runs(words):
    """(start, length, smallest period) of all runs: every period's stretches, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), len(words)
    if h % 10 == 0 and n:
        a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def text_of(rng):
    k = rng.choice([1, 2, 2, 3, 5, 50])
    words = []
    for _ in range(rng.randrange(8)):
        words += [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, 20))] * rng.randrange(1, 9)
    return rng.choice([" ", "\n", " \t "]).join(words)


def test_rows_equal_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, text_of(rng)) for i in range(1500)]
    docs += [(2000, None), (2001, ""), (2002, " \n"), (None, "a " * 30), (5, "x y " * 20), (5, "x y " * 20), (2003, "a b " * 30)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    want = sorted((brute_row(*d) for d in docs), key=str)
    assert sum(r[1] > 1 for r in want) > 50
    for size in (1, 500, periodic.GROUP_WORDS):
        got = [tuple(r) for r in periodic.find(frame, plant=True, group_words=size).collect()]
        assert sorted(got, key=str) == want


def test_runs_that_are_not_planted(spark):
    rng = random.Random(4)
    docs = [[b"%d" % rng.randrange(2) for _ in range(rng.randrange(400))] for _ in range(200)]
    got = [[tuple(r) for r in runs.tolist()] for runs in periodic.runs_of_texts(docs)]
    assert got == [brute_runs(d) for d in docs]
    assert periodic.runs_of_texts([]) == []


def test_extensions_equal_direct_comparison():
    rng = random.Random(5)
    for _ in range(30):
        part = [rng.randrange(rng.choice([1, 2, 4])) + 2 for _ in range(rng.randrange(1, 30))]
        s = [0] + part * rng.randrange(1, 6) + [rng.randrange(2, 5) for _ in range(20)] * rng.randrange(1, 4) + [1]
        grammar = periodic.Grammar(np.array(s))
        x, y = (np.array(v) for v in zip(*[sorted(rng.sample(range(1, len(s) - 1), 2)) for _ in range(200)]))
        for a, b, ahead, back in zip(x, y, grammar.common(x, y, True), grammar.common(x, y, False)):
            want = next(k for k in range(len(s)) if s[a + k] != s[b + k])
            before = next(k for k in range(len(s)) if s[a - 1 - k] != s[b - 1 - k])
            assert (ahead, back) == (want, before)


def test_long_and_highly_repetitive_texts():
    rng = random.Random(6)
    part = [b"%d" % rng.randrange(1000) for _ in range(20_000)]
    one, block, plain = periodic.runs_of_texts([[b"a"] * 100_000, part * 5 + part[:7], part])
    assert one.tolist() == [[0, 100_000, 1]]
    assert block.tolist() == [[0, 100_007, 20_000]]
    assert not len(plain)


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 12, 9, "x")], "doc_id long, text string, start long, n_runs string")
    assert periodic.find(docs.limit(0)).count() == 0
    assert tuple(periodic.find(docs).first())[:6] == (1, 1, 0, 24, 2, 12_000)
