"""Per-process cache of what pieces or white-space separated chunks of texts encode to.

No pre-token of this tokenizer spans white space, and neither NFC nor lower-casing reaches across it,
so the ids of a text are the ids of its chunks in order. Texts of ASCII and Latin-1 letters are split
into their pre-tokens right away, which come again more often than chunks; other texts, and those with
special tokens, go by chunks. A cache of two generations keeps what comes again; its size is bounded,
and chunks and pieces longer than 64 are never kept.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelkit.llm.common import encoded

LONGEST = 64

# The rules that pieces_of_file knows. NFC changes none of the plain characters, and Python's lower case of them is Unicode's.
_RULES = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
)
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")


# The same for arrays of plain texts: pieces that are no run of letters, and a text that is not plain.
_NO_WORD = r"('s|'t|'re|'ve|'m|'ll|'d|[0-9]|[!-/:-@\[-`{-~]+)"
_NOT_PLAIN = r"[^\t-\r -~À-ÖØ-öø-ÿ]"
# Texts of more bytes are not split as arrays, whose offsets have 32 bits.
_LARGE = 64_000_000


def _special_tokens(file: str) -> list[str] | None:
    """Special tokens of a file with the known rules, None for other files."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec["normalizer"], spec["pre_tokenizer"]) != _RULES or any(t["normalized"] for t in spec["added_tokens"]):
        return None
    return [t["content"] for t in spec["added_tokens"]]


def pieces_of_file(file: str) -> Callable[[str | None], list[str] | None]:
    """A function that gives a text's pre-tokens (before bytes become letters), or None where the library has to split it."""
    special = _special_tokens(file)
    if special is None:
        return lambda text: None

    def split(text: str | None) -> list[str] | None:
        if text is None:
            return []
        if not _PLAIN.fullmatch(text) or any(s in text for s in special):
            return None
        return _PIECE.findall(text.lower())

    return split


def array_pieces_of_file(file: str) -> Callable[[pa.Array], tuple[np.ndarray, pa.ListArray]]:
    """The same for an array of texts without nulls: whether each is split, and its pieces, empty ones among them."""
    special = _special_tokens(file)

    def split(texts: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
        if special is None:
            plain = np.zeros(len(texts), bool)
        else:
            other = pc.or_(pc.match_substring_regex(texts, _NOT_PLAIN), pc.greater(pc.binary_length(texts), _LARGE))
            for s in special:
                other = pc.or_(other, pc.match_substring(texts, s))
            plain = ~other.to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(texts if plain.all() else pc.if_else(pa.array(plain), texts, ""))
        return plain, pc.ascii_split_whitespace(pc.replace_substring_regex(lower, _NO_WORD, r" \1 "))

    return split


@contextmanager
def uncollected():
    """No search for reference cycles meanwhile: it would visit the many values of the cache again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class ChunkCache:
    """`encode` maps a list of chunks to a list of values; `limit` bounds each of two generations."""

    def __init__(self, encode: Callable[[list[bytes]], list], limit: int):
        self.encode, self.limit = encode, limit
        self.young: dict = {}
        self.old: dict = {}

    def values(self, chunks_of_texts: list[list[bytes]]) -> Iterator[Iterable]:
        """The values of every text's chunks, text by text."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        new, young, old = set().union(*chunks_of_texts), self.young, self.old
        missing = []
        for c in new - young.keys():
            kept = old.get(c)
            if kept is None:
                missing.append(c)
            else:
                young[c] = kept
        long: dict = {}
        if missing:
            with uncollected():
                for c, v in zip(missing, self.encode(missing)):
                    (young if len(c) <= LONGEST else long)[c] = v
        if not long:
            for chunks in chunks_of_texts:
                yield map(young.__getitem__, chunks)
        else:
            for chunks in chunks_of_texts:
                yield (long[c] if c in long else young[c] for c in chunks)


class TextCache:
    """Values of the pieces of texts, or of their chunks where `split` gives no pieces."""

    def __init__(self, split: Callable[[str | None], list[str] | None], pieces: ChunkCache, chunks: ChunkCache):
        self.split, self.pieces, self.chunks = split, pieces, chunks

    def encode(self, chunks: list[bytes]) -> list:
        return self.chunks.encode(chunks)

    def values(self, texts: list[str | None]) -> Iterator[Iterable]:
        """The values of every text's pieces or chunks, text by text."""
        split = [self.split(t) for t in texts]
        pieces = self.pieces.values([s for s in split if s is not None])
        chunks = self.chunks.values([encoded(t).split() for t, s in zip(texts, split) if s is None])
        for s in split:
            yield next(chunks if s is None else pieces)


def slices(column: pa.Array, most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Texts of a column, in runs of about so many characters; a single text is never cut."""
    held, size = [], 0
    for text in column.to_pylist():
        held.append(text)
        size += len(text or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def array_slices(column: pa.Array, most_bytes: int = 4_000_000) -> Iterator[pa.Array]:
    """A column of texts, null ones empty, in runs of about so many bytes; a single text is never cut."""
    texts = pc.fill_null(column, "")
    run = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)
