"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the 13-word windows of the benchmark items (an item of fewer words is one window).
Patterns of equal length form one machine: a shift table over blocks of two words tells how far the
search may jump, blocks that end a pattern lead to a bucket of candidates, and candidates are
compared word by word. Words outside every pattern share one number, so such blocks give the
largest jump.

The benchmark is read in blocks of at most `block_windows` windows, so what is broadcast is bounded
whatever the benchmark's size; every block is searched in all documents.

Defined results: null and empty texts have no words and are not contaminated; empty items have no
windows; items with a null id mark words as hit but have no id to list; repeated items and windows
count once; repeated documents each get their own row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import encoded, fresh, hold, store

WINDOW = 13
# Most windows in one broadcast block.
BLOCK_WINDOWS = 200_000

# Every byte that is not in a word becomes a space; A-Z become a-z.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z in lower case."""
    return encoded(text).translate(_TABLE).split()


def windows_of(words: list[bytes], n: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]


class WuManber:
    """Search for patterns of one length, given as tuples of word numbers (1 and up; 0 is any other word)."""

    def __init__(self, patterns: Iterable[tuple[int, ...]]):
        patterns = list(patterns)
        self.m = len(patterns[0])
        self.block = min(2, self.m)
        self.jump = self.m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for p in patterns:
            for end in range(self.block, self.m + 1):
                key = p[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.jump), self.m - end)
            # Candidates of a bucket are told apart by their first block before the whole comparison.
            self.buckets.setdefault(p[-self.block:], {}).setdefault(p[:self.block], []).append(p)

    def find(self, ids: list[int]) -> Iterable[tuple[int, tuple[int, ...]]]:
        """(start, pattern) of every occurrence, in order."""
        m, block, jump, shift, n = self.m, self.block, self.jump, self.shift, len(ids)
        end = m
        while end <= n:
            key = tuple(ids[end - block:end])
            step = shift.get(key, jump)
            if step:
                end += step
                continue
            start = end - m
            for p in self.buckets[key].get(tuple(ids[start:start + block]), ()):
                if tuple(ids[start:end]) == p:
                    yield start, p
            end += 1


class Searcher:
    """All machines of a block of windows; `windows` maps a window to the ids of its items."""

    def __init__(self, windows: dict[tuple[bytes, ...], list]):
        self.number: dict[bytes, int] = {}
        lengths: dict[int, list] = {}
        self.items: dict = {}
        for window, items in windows.items():
            p = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
            lengths.setdefault(len(p), []).append(p)
            self.items[p] = items
        self.machines = [WuManber(ps) for _, ps in sorted(lengths.items())]

    def search(self, words: list[bytes]) -> tuple[list[int], set]:
        """Flat list of merged [start, end) ranges of hit words, and the ids of the items found."""
        get = self.number.get
        ids = [get(w, 0) for w in words]
        ranges, items = [], set()
        for machine in self.machines:
            for start, p in machine.find(ids):
                ranges.append((start, start + machine.m))
                items.update(self.items[p])
        return merge_ranges(ranges), items


def merge_ranges(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def window_table(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """Stored table of distinct windows with their item ids and a block number."""
    def cut(batches):
        for batch in batches:
            ids, keys = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in windows_of(words_of(text), n):
                    ids.append(item)
                    keys.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(keys, pa.binary())], names=["item", "window"])

    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item string, window binary").distinct()


def _blocks(windows: DataFrame, most: int):
    """Windows in pieces of about `most`, dealt by hash, each collected with its items."""
    n = windows.select("window").distinct().count()
    pieces = max(1, -(-n // most))
    for k in range(pieces):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(pieces)) == k)
        found: dict = {}
        for row in part.toLocalIterator():
            items = found.setdefault(tuple(bytes(row["window"]).split(b" ")), [])
            if row["item"] is not None:
                items.append(row["item"])
        yield found


def _verdict(n_words: int, ranges: list[int], items: Iterable[str]) -> tuple:
    n_hit = sum(ranges[1::2]) - sum(ranges[::2])
    names = sorted(items)
    return (n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode("utf-8", "surrogatepass")).hexdigest(),
            n_hit > 0 and 20 * n_hit >= n_words)


_FIELDS = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
           ("contaminated", pa.bool_())]
_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document: words, hit words, items found and the verdict (n_hit > 0 and 20 * n_hit >= n_words)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    windows = store(window_table(benchmark, n=window), "windows")
    block = _one_block(windows, block_windows)
    if block is None:
        numbered = store(rows.withColumn("row", F.monotonically_increasing_id()), "docs")
        return _find_in_blocks(numbered, windows, block_windows).drop("row")
    shared, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches):
        with hold("decontaminate", _CACHE.clear):
            machine = _machine(token, shared)
            for batch in batches:
                out = [_judge(machine, text) for text in batch.column(1).to_pylist()]
                yield _verdicts([batch.column(0)], ["doc_id"], out)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
               block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows that are not contaminated, all columns kept."""
    windows = store(window_table(benchmark, n=window), "windows")
    block = _one_block(windows, block_windows)
    if block is None:
        row = fresh(docs, "row")
        numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "docs")
        found = _find_in_blocks(numbered.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(row).alias("row")),
                                windows, block_windows)
        return numbered.join(found.where("contaminated").select(F.col("row").alias(row)), row, "left_anti").select(*docs.columns)
    shared, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    at = docs.columns.index(text_col)

    def run(batches):
        with hold("decontaminate", _CACHE.clear):
            machine = _machine(token, shared)
            for batch in batches:
                yield batch.filter(pa.array([not _judge(machine, text)[4] for text in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _judge(machine: Searcher, text: str | None) -> tuple:
    words = words_of(text)
    return _verdict(len(words), *machine.search(words))


def _verdicts(columns: list, names: list[str], out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [[]] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([*columns, *[pa.array(c, t) for c, (_, t) in zip(cols, _FIELDS)]],
                                      names=[*names, *[n for n, _ in _FIELDS]])


def _one_block(windows: DataFrame, most: int) -> dict | None:
    """All windows if they fit one block, else None."""
    if windows.limit(most + 1).count() > most:
        return None
    return next(iter(_blocks(windows, most)))


_CACHE: dict = {}


def _machine(token: str, shared) -> Searcher:
    """The searcher of a broadcast block, built once per worker process; one is held at a time."""
    found = _CACHE.get(token)
    if found is None:
        _CACHE.clear()
        found = _CACHE[token] = Searcher(shared.value)
    return found


def _find_in_blocks(numbered: DataFrame, windows: DataFrame, most: int) -> DataFrame:
    """As `find` for stored rows with a unique `row`, with one scan per block of windows."""
    spark = numbered.sparkSession
    hits = None
    for block in _blocks(windows, most):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            machine = Searcher(shared.value)
            for batch in batches:
                found = [(r, *machine.search(words_of(t))) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                found = [(r, a, sorted(b)) for r, a, b in found if a]
                cols = list(zip(*found)) if found else [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.list_(pa.string()))],
                    names=["row", "ranges", "items"])

        part = store(numbered.select("row", "text").mapInArrow(scan, "row long, ranges array<long>, items array<string>"), "hits")
        hits = part if hits is None else hits.unionByName(part)
    # One row per block at most meets for a document.
    hits = hits.groupBy("row").agg(F.collect_list("ranges").alias("ranges"), F.flatten(F.collect_list("items")).alias("items"))

    def finish(batches):
        for batch in batches:
            out = []
            for text, ranges, items in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                flat = merge_ranges([(x[i], x[i + 1]) for x in ranges or [] for i in range(0, len(x), 2)])
                out.append(_verdict(len(words_of(text)), flat, set(items or ())))
            yield _verdicts([batch.column(0), batch.column(1)], ["row", "doc_id"], out)

    joined = numbered.join(hits, "row", "left").select("row", "doc_id", "text", "ranges", "items")
    return joined.mapInArrow(finish, f"row long, doc_id {numbered.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")
