"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can be the last of its encoding. An automaton over
the vocabulary gives, at each place, all tokens that are suffixes of the prefix. Such a token is the
last one if it is compatible with the stored last token of what stands before it: no merge across
their border would have come before the merges that made the two. Following the stored tokens
backwards from the end gives the ids. No merge loop is run over the text. Pre-tokens are taken in
order, so what is stored for the prefix that one shares with the next is used again.

Text is prepared as the tokenizer file says (NFC, white space, lower case, its split pattern, bytes
as letters) by the tokenizers library's own normaliser and pre-tokeniser, or in texts of ASCII and
Latin-1 letters by the same rules as one pattern; special tokens are cut out of the raw text first. Decoding joins the tokens' strings with spaces, as the file names no decoder.

Defined results: null and empty texts have no tokens and decode to the empty text; repeated rows
each get their own result; only the two named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
import struct
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import hold, tokenizer_file
from panelkit.llm.wordcache import ChunkCache, TextCache, pieces_of_file, slices

# Stands for the mark of a word's end inside the automaton, as one character.
_END = "\ue000"
_NEVER = 1 << 60
# Pieces of plain texts, chunks of others (two generations of each), pieces of such chunks, and pairs of tokens that a worker keeps.
PLAIN_KEPT = 150_000
CACHED = 50_000
PIECES_KEPT = 100_000
PAIRS_KEPT = 200_000
# Chunks are prepared in one text, parted by this character where they do not hold it.
_PART = "\x01"
# Letters of the bytes that are not letters of their own; the file's rules name this table by "ByteLevel".
_LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}


class PrefixBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole in self.made:
                raise ValueError("two merges make the same token; its history is not unique")
            self.rank[left, right] = k
            self.made[whole] = (left, right, k)
        self._make_automaton(vocab)
        # Pieces that are the text of one token.
        self.whole = {s[:len(s) - len(self.suffix)]: i for s, i in vocab.items() if s.endswith(self.suffix)}
        self.span = max(vocab.values(), default=0) + 1
        self.fits: dict[int, bool] = {}  # by left * span + right
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.sound: dict[int, bool] = {}
        self.file = file

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def normalise(self, text: str) -> str:
        return self.library.normalizer.normalize_str(text) if self.library.normalizer else text

    def pieces(self, text: str) -> list:
        return self.library.pre_tokenizer.pre_tokenize_str(text)

    def _make_automaton(self, vocab: dict[str, int]) -> None:
        """Aho-Corasick automaton: `child` by state * 2^21 + letter, `fail`, and `ends`, all (token, size) that end in a state, the longest first."""
        self.child, self.fail, self.ends = {}, [0], [()]
        above, levels = [(0, 0)], []
        for s, i in vocab.items():
            ends = bool(self.suffix) and s.endswith(self.suffix)
            body = s[:len(s) - len(self.suffix)] if ends else s
            if not body:
                continue
            state = 0
            for depth, letter in enumerate(body + _END if ends else body):
                key = state << 21 | ord(letter)
                state = self.child.get(key)
                if state is None:
                    state = self.child[key] = len(above)
                    above.append(divmod(key, 1 << 21))
                    self.fail.append(0)
                    self.ends.append(())
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append(state)
            self.ends[state] = ((i, len(body)),)
        for level in levels[1:]:
            for state in level:
                parent, letter = above[state]
                self.fail[state] = other = self._step(self.fail[parent], letter)
                self.ends[state] += self.ends[other]

    def _step(self, state: int, letter: int) -> int:
        child = self.child
        found = child.get(state << 21 | letter)
        while found is None and state:
            state = self.fail[state]
            found = child.get(state << 21 | letter)
        return found or 0

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces that stood at one edge of a token while it was made: (piece, rank of the merge that took it)."""
        out, taken = [(token, _NEVER)], _NEVER
        while token in self.made:
            left, right, taken = self.made[token]
            token = (left, right)[side]
            out.append((token, taken))
        return out

    def _border_free(self, left: int, right: int, limit: int) -> bool:
        """No merge across the border comes before both its pieces are taken, nor before `limit`.

        Of equal ranks the leftmost place goes first: inside `left` before the border, the border
        before the inside of `right`.
        """
        starts = self._edge(right, 0)
        for a, a_taken in self._edge(left, 1):
            for b, b_taken in starts:
                k = self.rank.get((a, b))
                if k is not None and k < limit and k < a_taken and k <= b_taken:
                    return False
        return True

    def is_sound(self, token: int) -> bool:
        """The token's own text is encoded as this token."""
        known = self.sound.get(token)
        if known is None:
            if token not in self.made:
                known = True
            else:
                left, right, k = self.made[token]
                known = self.is_sound(left) and self.is_sound(right) and self._border_free(left, right, k)
            self.sound[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        known = self.fits.get(left * self.span + right)
        if known is None:
            if len(self.fits) > PAIRS_KEPT:
                self.fits.clear()
            known = self.fits[left * self.span + right] = self.is_sound(right) and self._border_free(left, right, _NEVER)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        return next(self.encode_pieces([piece]))[1]

    def encode_pieces(self, pieces: Iterable[str]) -> Iterable[tuple[str, list[int]]]:
        """Pre-tokens in order, each with its ids."""
        child, fail, ends, fits, sound, span = self.child, self.fail, self.ends, self.fits, self.sound, self.span
        # By place in the piece before, all but its end: state, last token (-1 for none) and its start.
        before, states, last, start_of = "", [0], [-1], [0]
        for piece in sorted(pieces):
            whole = self.whole.get(piece)
            if whole is not None and self.is_sound(whole):
                yield piece, [whole]  # it is the last token of the whole piece, and nothing stands before it
                continue
            n = len(piece)
            at, shared = 0, min(n, len(before)) - 1
            while at < shared and piece[at] == before[at]:
                at += 1
            del states[at + 1:], last[at + 1:], start_of[at + 1:]
            state, before = states[at], piece
            for end, letter in enumerate(piece[at:], at + 1):
                letter = ord(letter)
                found = child.get(state << 21 | letter)
                while found is None and state:
                    state = fail[state]
                    found = child.get(state << 21 | letter)
                state = found or 0
                # The last letter only counts with the end mark.
                tokens = ends[state] if end < n or not self.suffix else ends[self._step(state, ord(_END))]
                best, from_ = -1, 0
                for token, size in tokens:
                    start = end - size
                    if start:
                        left = last[start]
                        if left < 0:
                            continue
                        good = fits.get(left * span + token)
                        if good is None:
                            good = self.compatible(left, token)
                    else:
                        good = sound.get(token)
                        if good is None:
                            good = self.is_sound(token)
                    if good:
                        best, from_ = token, start
                        break
                if end < n:
                    states.append(state)
                    last.append(best)
                    start_of.append(from_)
            if best < 0:
                raise ValueError(f"no encoding of {piece!r}")
            out = [best]
            while from_ > 0:
                out.append(last[from_])
                from_ = start_of[from_]
            yield piece, out[::-1]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, special tokens in it included."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece, _ in self.pieces(self.normalise(part)):
                    out.extend(self.encode_piece(piece))
        return out

    def packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Packed ids and decoded text."""
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode("utf-8")

    def packed_plain(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids and decoded text of distinct pieces, before their bytes become letters."""
        by_letters = {p if p.isascii() else p.encode("utf-8").decode("latin-1").translate(_LETTERS): p for p in pieces}
        found = {by_letters[p]: self.packed(ids) for p, ids in self.encode_pieces(by_letters)}
        return [found[p] for p in pieces]

    def packed_chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids and decoded text of white-space separated chunks, normalised and split in one text."""
        part = [p for p, _ in self.pieces(self.normalise(_PART))]
        found: dict[str, tuple[bytes, bytes]] = {}
        plain = [c for c in chunks if _PART not in c and not (self.cut and self.cut.search(c))] if len(part) == 1 else []
        if plain:
            if len(self.known) > PIECES_KEPT:
                self.known.clear()
            pieces, known = [p for p, _ in self.pieces(self.normalise(f" {_PART} ".join(plain)))], self.known
            for piece, ids in self.encode_pieces(set(pieces) - known.keys()):
                known[piece] = self.packed(ids)
            held, at, mark = [], 0, part[0]
            for piece in pieces:
                if piece == mark:
                    found[plain[at]] = held[0] if len(held) == 1 else joined(held)
                    held, at = [], at + 1
                else:
                    held.append(known[piece])
            found[plain[at]] = joined(held)
        for c in chunks:
            if c not in found:
                found[c] = self.packed(self.encode(c))
        return [found[c] for c in chunks]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


def joined(values: Iterable[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """Packed ids and decoded text of consecutive parts; a part without ids has no place in the text."""
    held = list(values)
    ids = [v[0] for v in held]
    return b"".join(ids), b" ".join([t for i, t in held if i] if b"" in ids else [v[1] for v in held])


_CODECS: dict = {}


def chunk_cache(tokenizer: str) -> TextCache:
    """The worker's cache: piece or chunk to (packed ids, decoded text)."""
    found = _CODECS.get(tokenizer)
    if found is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        file = tokenizer_file(tokenizer)
        codec = PrefixBpe(file)

        def encode(chunks: list[bytes]) -> list[tuple[bytes, bytes]]:
            return codec.packed_chunks([c.decode("utf-8") for c in chunks])

        found = _CODECS[tokenizer] = TextCache(pieces_of_file(file), ChunkCache(codec.packed_plain, PLAIN_KEPT), ChunkCache(encode, CACHED))
    return found


def digests(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of tokens, sha256 of the ids and of the decoded text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        with hold("bpe", _CODECS.clear):
            cache = chunk_cache(tokenizer)
            for batch in batches:
                sizes, ids_sha, text_sha = [], [], []
                for texts in slices(batch.column(1)):
                    for values in cache.values(texts):
                        ids, decoded = joined(values)
                        sizes.append(len(ids) // 4)
                        ids_sha.append(hashlib.sha256(ids).hexdigest())
                        text_sha.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the ids themselves and the decoded text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        with hold("bpe", _CODECS.clear):
            cache = chunk_cache(tokenizer)
            for batch in batches:
                ids, texts_out = [], []
                for texts in slices(batch.column(1)):
                    for values in cache.values(texts):
                        packed, decoded = joined(values)
                        ids.append(np.frombuffer(packed, "<i4"))
                        texts_out.append(decoded.decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(texts_out, pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
