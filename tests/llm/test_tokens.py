"""Token files and the prefix encoder against the tokenizers library on whole texts."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelkit.llm import bpe, tokens
from panelkit.llm.common import tokenizer_file

FILE = tokenizer_file("word_bpe_49k.json")
TEXTS = [
    None, "", "  ", "Hello, world! It's 2024.", "a<|endoftext|>b <|startoftext|><|endoftext|> c", "É é ﬁ İ ΣΑΣ ß",
    "世界 мир 🙂👩‍💻 ́x", "a b c   \x1c\x85d", "</w> <w/> l'été 's 'LL don't", "aaaaaaaaaaaaaaaaaaaaaaaa!!!!!!!!",
    "x" * 3000, " ".join(f"w{i}" for i in range(20_000)), "<|endoftext", "a\x01b \x01 \x01\x01 c", "\u3000 \xa0 x", "THE the The\n\tthe", " ab",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def sha(data):
    return hashlib.sha256(data).hexdigest()


def docs(spark):
    rows = [(i, t, 7, 8) for i, t in enumerate(TEXTS)] + [(0, "again", 7, 8), (None, "null id", 7, 8), (-5, "low", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, part int, n_tokens int")


@functools.cache
def both():
    return Tokenizer.from_file(FILE), bpe.PrefixBpe(FILE)


ANY = st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60)


@settings(max_examples=600, deadline=None)
@given(st.one_of(ANY, st.text(alphabet="abehinorst.'", max_size=40)))
def test_prefix_encoder(text):
    library, codec = both()
    assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, library):
    out = {(r["doc_id"], r["ids_sha256"]): r for r in bpe.digests(docs(spark)).collect()}
    assert len(out) == len(TEXTS) + 3
    for i, t in [*enumerate(TEXTS), (0, "again"), (None, "null id"), (-5, "low")]:
        ids = ids_of(library, t)
        r = out[i, sha(np.array(ids, "<u4").tobytes())]
        assert r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False).encode())
    assert bpe.digests(docs(spark).limit(0)).count() == 0


def test_ids_and_decoded_text(spark, library):
    for r in bpe.encode_documents(docs(spark).where("doc_id > 0")).collect():
        ids = ids_of(library, TEXTS[r["doc_id"]])
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_token_files(spark, library, tmp_path):
    path = str(tmp_path / "tokens")
    tokens.write_tokens(docs(spark), path)
    got = [tuple(r) for r in tokens.checksums(tokens.read_tokens(spark, path)).collect()]
    texts = sorted([*enumerate(TEXTS), (0, "again"), (None, "null id"), (-5, "low")], key=lambda x: (x[0] is not None, x[0] or 0))
    start, want = 0, set()
    by_start = {g[1]: g for g in got}
    for _ in texts:
        g = by_start[start]
        match = [t for i, t in texts if i == g[0] and zlib.crc32(np.array([*ids_of(library, t), 1], "<u4").tobytes()) == g[3]]
        assert match and g[2] == len(ids_of(library, match[0])) + 1
        want.add(g)
        start += g[2]
    assert len(want) == len(got) == len(texts)
    ordered = [g[0] for g in sorted(got, key=lambda g: g[1])]
    assert ordered == [i for i, _ in texts]
    some = tokens.read_tokens(spark, path, first=3, last=5).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 4, 5] and all(r["ids"][-1] == 1 for r in some)
    assert "ids" not in tokens.read_metadata(spark, path).columns
    empty = str(tmp_path / "empty")
    tokens.write_tokens(docs(spark).limit(0), empty)
    assert tokens.read_tokens(spark, empty).count() == 0


def test_row_groups_have_page_indexes(spark, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "tokens"
    tokens.write_tokens(docs(spark), str(path))
    column = pq.ParquetFile(next(path.glob("*.parquet"))).metadata.row_group(0).column(0)
    assert column.has_offset_index and column.has_column_index


def test_chunks_prepared_together_equal_the_library():
    library, codec = both()
    rng = random.Random(12)
    alphabet = ["a", "B", "the", "ing", "é", "e\u0301", "ß", "漢", "😀", "1", "23", "-", "'s", ".", "\x01", "\u00a0", "\u2028", "\x00", "_", *list(codec.special)[:3]]
    chunks = list(dict.fromkeys("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(3000)))
    for chunk, (ids, text) in zip(chunks, codec.packed_chunks(chunks)):
        want = library.encode(chunk, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, chunk
        assert text.decode("utf-8") == library.decode(want, skip_special_tokens=False)
    assert codec.packed_chunks([]) == []


def test_new_chunks_are_kept_without_searches_for_cycles():
    """While many values are made the collector rests, and works again after; long chunks are not kept."""
    import gc

    from panelkit.llm.wordcache import ChunkCache

    seen = []

    def encode(chunks):
        seen.append(gc.isenabled())
        return [c[::-1] for c in chunks]

    cache = ChunkCache(encode, 10)
    assert [list(v) for v in cache.values([[b"ab", b"x" * 70], [b"ab"]])] == [[b"ba", b"x" * 70], [b"ba"]]
    assert seen == [False] and gc.isenabled() and set(cache.young) == {b"ab"}


def test_chunks_that_hold_the_mark_between_chunks():
    from panelkit.llm.tokens import chunk_cache

    chunks = [b"one", b"a\x01b", b"two"]
    cache = chunk_cache("word_bpe_49k.json")
    assert cache.encode(chunks) == [cache.encode([c])[0] for c in chunks] and cache.encode([b"a\x01"]) != cache.encode([b"a"])


PLAIN = st.text(alphabet="aBehnOrsT'.,-!?$019 \n\t\x0béÉßÿÀöØþ~@[`{", max_size=60)


@settings(max_examples=600, deadline=None)
@given(PLAIN)
def test_pieces_of_plain_texts(text):
    """Plain texts are split without the library, with the pieces that it makes."""
    from panelkit.llm.wordcache import pieces_of_file

    library, _ = both()
    want = [text for text, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
    assert [p.encode("utf-8").decode("latin-1").translate(bpe._LETTERS) for p in pieces_of_file(FILE)(text)] == want


def test_every_character_is_split_as_by_the_library_or_left_to_it():
    from panelkit.llm.wordcache import pieces_of_file

    library, split = both()[0], pieces_of_file(FILE)
    for code in range(0x300):
        text = f"a{chr(code)}1{chr(code)}'s{chr(code)}."
        found = split(text)
        if found is not None:
            want = [t for t, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
            assert [p.encode("utf-8").decode("latin-1").translate(bpe._LETTERS) for p in found] == want, code
    assert split(None) == [] and split("é à") == ["é", "à"] and split("a <|endoftext|>") is None and split("e\u0301") is None


def test_pieces_encoded_in_order_equal_the_library():
    """Pieces that share prefixes, in both caches."""
    from panelkit.llm.tokens import chunk_cache

    library, codec = both()
    rng = random.Random(5)
    pieces = sorted({"".join(rng.choice(["th", "e", "in", "ing", "a", "é", "tion", "ß"]) for _ in range(rng.randrange(1, 9))) for _ in range(4000)})
    rng.shuffle(pieces)
    packed = [np.array(ids_of(library, p), "<u4").tobytes() for p in pieces]
    assert [ids for ids, _ in codec.packed_plain(pieces)] == packed
    assert chunk_cache("word_bpe_49k.json").pieces.encode(pieces) == packed


def test_case_and_punctuation_share_one_entry():
    """A word in three spellings takes one place in the cache, where chunks took three."""
    from panelkit.llm.wordcache import ChunkCache, TextCache, pieces_of_file

    cache = TextCache(pieces_of_file(FILE), ChunkCache(lambda p: p, 10), ChunkCache(lambda c: c, 10))
    assert [list(v) for v in cache.values(["Word word, WORD.", None, "\u4e16 x"])] == [
        ["word", "word", ",", "word", "."], [], ["\u4e16".encode(), b"x"]]
    assert set(cache.pieces.young) == {"word", ",", "."} and set(cache.chunks.young) == {"\u4e16".encode(), b"x"}


def test_idle_workers_drop_their_caches(monkeypatch):
    import time

    from panelkit.llm import common

    monkeypatch.setattr(common, "IDLE_S", 0.2)
    cache = {"a": 1}
    with common.hold("test", cache.clear):
        time.sleep(0.5)
        assert cache
    with common.hold("test", cache.clear):  # taken up in time
        time.sleep(0.5)
        assert cache
    time.sleep(0.8)
    assert not cache and "test" not in common._HELD


def test_texts_split_as_arrays():
    """Array and pattern give the same pieces, and ids of runs of mixed texts are the library's."""
    import pyarrow as pa

    from panelkit.llm.wordcache import array_pieces_of_file, array_slices, pieces_of_file

    library, split, split_array = both()[0], pieces_of_file(FILE), array_pieces_of_file(FILE)
    rng = random.Random(3)
    letters = list("aBsTdéÉßÿ×÷'.,-!09 \n\t\x0b") + ["'s", "'LL", "the", "ing", "'ve"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [f"a{chr(code)}1{chr(code)}'s{chr(code)}." for code in range(0x300)] + [t for t in TEXTS if t is not None]
    plain, lists = split_array(pa.array(texts))
    for text, is_plain, pieces in zip(texts, plain, lists.to_pylist()):
        assert (split(text) if is_plain else None) == split(text), text
        assert [p for p in pieces if p] == (split(text) or []), text
    rng.shuffle(texts)
    column = pa.array([None, *texts, None])
    got = []
    for run in array_slices(column, 5_000):
        starts, ids = tokens.ids_of_run(tokens.chunk_cache("word_bpe_49k.json"), split_array, run, 1)
        assert len(starts) == len(run) + 1 and starts[-1] == len(ids)
        got += [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]
    assert got == [[*ids_of(library, t), 1] for t in column.to_pylist()]
    assert list(array_slices(pa.array([], pa.string()))) == []
