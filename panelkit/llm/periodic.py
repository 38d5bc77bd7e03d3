"""Periodic run detection by recompression over words.

A run is a stretch of consecutive words with smallest period q and length >= max(24, 3q) that cannot
be extended. The words of many texts, with a unique separator after each, form one sequence of
numbers. Recompression shortens it level by level: maximal blocks of equal symbols become one symbol
(symbol, length), then neighbours (a, b) with a in the left half and b in the right half of a split
alphabet become one symbol, until no symbol occurs twice. Equal stretches are cut in the same way
except near their ends, so the levels are a run-length grammar on which the longest common extension
of two places is found by going up while both sides agree and down to the first difference: one
step per level and side, forwards or backwards.

Candidates come from harmonic grids: a run of period q holds three consecutive multiples of q with
equal words, and there are n/q multiples, n log n in all. The two extensions of a candidate give
the exact run. Candidates that a run already found covers are not asked again. A stretch found for
several periods keeps the smallest, which is its smallest period: the others are its multiples.

Scale: texts are independent, so there is no shuffle; a task works through groups of texts of about
`GROUP_WORDS` words, a longer text by itself. Memory is some ten numbers a word of the group.

Defined results: null text has no words; a null id counts as empty text in the checksum; repeated
rows each get their own result; an empty table gives an empty result; only the id and text columns
are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelkit.llm.common import encoded

LEAST_LENGTH, LEAST_TIMES = 24, 3
GROUP_WORDS = 300_000
# Rounds in which covered candidates are dropped before all that are left are asked at once.
_ROUNDS = 4
# Candidates whose extensions are looked up at once.
_AT_ONCE = 1 << 18


def _named(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """Numbers from `first` on for equal keys, and the next free number."""
    _, codes = np.unique(keys, return_inverse=True)
    return codes + first, first + (int(codes.max()) + 1 if len(codes) else 0)


def _left_half(symbols: np.ndarray, level: int) -> np.ndarray:
    """A repeatable split of the alphabet in two halves, a new one on each level."""
    x = symbols.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(63)).astype(bool)


class Grammar:
    """Levels of a sequence whose last symbol occurs nowhere else."""

    def __init__(self, sequence: np.ndarray):
        # Per level: symbols, words under each symbol, parent on the next level; first child of each symbol below.
        self.symbols = [np.asarray(sequence, np.int64)]
        self.words = [np.ones(len(sequence), np.int64)]
        self.parent: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        # On a block level the children of a symbol are equal, on a pair level they are one or two different ones.
        self.block: list[bool] = []
        free, level = int(self.symbols[0].max(initial=0)) + 1, 0
        while self._repeats(free):
            free = self._add_blocks(free)
            free = self._add_pairs(free, level)
            level += 1

    def _repeats(self, free: int) -> bool:
        s = self.symbols[-1]
        if len(s) * 4 < free:
            return len(np.unique(s)) < len(s)
        return bool((np.bincount(s, minlength=1) > 1).any())

    def _push(self, starts: np.ndarray, symbols: np.ndarray, block: bool) -> None:
        n = len(self.symbols[-1])
        marks = np.zeros(n, np.int64)
        marks[starts] = 1
        self.parent.append(np.cumsum(marks) - 1)
        self.first.append(np.append(starts, n))
        self.words.append(np.add.reduceat(self.words[-1], starts))
        self.symbols.append(symbols)
        self.block.append(block)

    def _add_blocks(self, free: int) -> int:
        s = self.symbols[-1]
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        if len(starts) == len(s):
            return free
        sizes = np.diff(np.append(starts, len(s)))
        symbols, long = s[starts].copy(), sizes > 1
        # A block's name: its symbol and its length, both below 2^31.
        symbols[long], free = _named(symbols[long] << 32 | sizes[long], free)
        self._push(starts, symbols, True)
        return free

    def _add_pairs(self, free: int, level: int) -> int:
        s = self.symbols[-1]
        left = _left_half(s, level)
        at = np.flatnonzero(left[:-1] & ~left[1:])
        if not len(at):
            return free
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        starts = np.flatnonzero(keep)
        symbols = s[starts].copy()
        names, free = _named(s[at] << 32 | s[at + 1], free)
        symbols[np.searchsorted(starts, at)] = names
        self._push(starts, symbols, False)
        return free

    def common(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """Length of the longest common extension of the places x and y, x != y.

        Forwards it starts at the words x and y, backwards just before them. The sequence must
        differ before either side leaves it, as separators make sure.
        """
        x, y = np.array(x, np.int64), np.array(y, np.int64)
        if not forward:
            x, y = x - 1, y - 1
        step = 1 if forward else -1
        matched = np.zeros(len(x), np.int64)
        # The level on which the two sides are known to differ; going down starts there.
        differ = np.full(len(x), -1, np.int64)
        rows = np.arange(len(x))
        for level in range(len(self.parent)):
            if not len(rows):
                break
            u, v = x[rows], y[rows]
            up, vp = self.parent[level][u], self.parent[level][v]
            ru, rv = self._left_over(level, u, up, forward), self._left_over(level, v, vp, forward)
            both_start = (ru == self._size(level, up)) & (rv == self._size(level, vp))
            equal = self.symbols[level][u] == self.symbols[level][v]
            taken = np.where(both_start | ~equal, 0, np.minimum(ru, rv))
            matched[rows] += taken * self.words[level][u]
            goes_up = both_start | (equal & (ru == rv))
            # Ahead of the parents if their rest was used up, else the parents themselves.
            x[rows] = np.where(goes_up, np.where(both_start, up, up + step), u + step * taken)
            y[rows] = np.where(goes_up, np.where(both_start, vp, vp + step), v + step * taken)
            differ[rows[~goes_up]] = level
            rows = rows[goes_up]
        top = len(self.parent)
        # No symbol occurs twice on the top level, so what is left there differs.
        differ[rows] = top
        for level in range(top, 0, -1):
            down = np.flatnonzero(differ >= level)
            if not len(down):
                continue
            u, v = self._child(level, x[down], forward), self._child(level, y[down], forward)
            below = level - 1
            equal = self.symbols[below][u] == self.symbols[below][v]
            if self.block[below]:
                ru = self._size(below, self.parent[below][u])
                rv = self._size(below, self.parent[below][v])
                taken = np.where(equal, np.minimum(ru, rv), 0)
            else:
                taken = equal.astype(np.int64)
            matched[down] += taken * self.words[below][u]
            x[down], y[down] = u + step * taken, v + step * taken
        return matched

    def _size(self, level: int, parents: np.ndarray) -> np.ndarray:
        first = self.first[level]
        return first[parents + 1] - first[parents]

    def _left_over(self, level: int, node: np.ndarray, parents: np.ndarray, forward: bool) -> np.ndarray:
        """Children of the parent from this node on, itself included."""
        first = self.first[level]
        return first[parents + 1] - node if forward else node - first[parents] + 1

    def _child(self, level: int, node: np.ndarray, forward: bool) -> np.ndarray:
        first = self.first[level - 1]
        return first[node] if forward else first[node + 1] - 1


def _candidates(sequence: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, first of a row of neighbours) of every grid place where three multiples of the period agree."""
    held, size = [], 0
    for q in range(1, longest // LEAST_TIMES + 1):
        grid = sequence[::q]
        same = grid[1:] == grid[:-1]
        at = np.flatnonzero(same[1:] & same[:-1])
        if len(at):
            fresh = np.append(True, np.diff(at) > 1)
            held.append((at * q, np.full(len(at), q, np.int64), fresh))
            size += len(at)
            if size > _AT_ONCE:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def find_runs(sequence: np.ndarray, longest: int) -> np.ndarray:
    """All runs of a sequence as rows (start, length, period), sorted.

    The sequence must begin and end with symbols that occur nowhere else; `longest` bounds the
    length of a stretch between two such symbols.
    """
    grammar, found = None, []
    for places, periods, fresh in _candidates(sequence, longest):
        grammar = grammar or Grammar(sequence)
        left = np.arange(len(places))
        for turn in range(_ROUNDS):
            # First the candidates that begin a row of neighbours, whose run mostly covers the rest of the row.
            asked = left[fresh[left]] if turn + 1 < _ROUNDS else left
            if not len(asked):
                break
            x, q = places[asked], periods[asked]
            ahead = grammar.common(x, x + q, True)
            back = grammar.common(x, x + q, False)
            start, end = x - back, x + q + ahead
            ok = end - start >= np.maximum(LEAST_LENGTH, LEAST_TIMES * q)
            found.append(np.stack([start[ok], (end - start)[ok], q[ok]], 1))
            if len(asked) == len(left):
                break
            # A candidate that lies, with its next multiple, in the stretch of the row's first one gives the same run.
            row = np.cumsum(fresh[left]) - 1
            rest = ~fresh[left]
            later = left[rest]
            uncovered = places[later] + periods[later] > end[row[rest]]
            left = later[uncovered]
            # The first one left of each row is asked next.
            fresh[left] = np.append(True, np.diff(row[rest][uncovered]) > 0) if len(left) else False
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.append(True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0))
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(words: list[bytes], doc_id) -> list[bytes]:
    """The words of a text, every tenth document (by checksum) made periodic from some place on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words outside of every run's part after its first period."""
    if not len(runs):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def _result(words: list[bytes], runs: np.ndarray) -> tuple:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    best = max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    start, length, period = best or (None, None, None)
    return (
        len(runs), start, length, period, 1000 * length // period if best else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
    )


def runs_of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Runs of each list of words, found in one common sequence."""
    numbers: dict[bytes, int] = {}
    parts, starts, at = [[0]], [], 1
    for k, words in enumerate(texts):
        starts.append(at)
        # Numbers below len(texts) + 1 are separators.
        parts.append([numbers.setdefault(w, len(numbers)) + len(texts) + 1 for w in words])
        parts.append([k + 1])
        at += len(words) + 1
    sequence = np.fromiter((x for part in parts for x in part), np.int64, at)
    runs = find_runs(sequence, max(map(len, texts), default=0))
    owned = runs[:, 0].copy()
    starts = np.array(starts, np.int64)
    runs[:, 0] -= starts[np.searchsorted(starts, runs[:, 0], side="right") - 1]
    return np.split(runs, np.searchsorted(owned, starts[1:])) if texts else []


_FIELDS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
_TYPES = [pa.int64()] * 5 + [pa.string()] * 2


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per document: number of runs, the most periodic one, and digests of all runs and of the collapsed text.

    With `plant`, every tenth document is first made periodic.
    """
    kind = docs.schema[id_col].dataType
    names, types = ["doc_id", *_FIELDS], [to_arrow_type(kind), *_TYPES]

    def solve(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        rows = [_result(w, r) for w, r in zip(texts, runs_of_texts(texts))]
        columns = [ids, *zip(*rows)] if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = encoded(text.as_py()).split()
                words = planted(words, doc_id) if plant else words
                if ids and size + len(words) >= group_words:
                    yield solve(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(words)
                size += len(words) + 1
        if ids:
            yield solve(ids, texts)

    schema = f"doc_id {kind.simpleString()}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
