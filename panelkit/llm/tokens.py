"""Token ids of documents in Parquet list columns, with selective reads of ids and metadata.

Format: a folder of Parquet files in ascending document order. One row per document: `doc_id`,
`part` (number of the file's range), `before` (tokens of the documents before it in its part),
`n_tokens`, and `ids` (list of int, the end id last). Columns are dictionary-encoded (delta where the
writer finds dictionaries too large), row groups are small enough to skip, and pages hold at most
1,000 rows and have column and offset indexes, so a range of documents or the metadata alone is read
without the other ids. The first token of a document is `before` plus the tokens of all parts before.

Defined results: null and empty texts are the end id alone; null document ids come first; rows of
equal ids are each written, in the order of their texts; an empty table gives an empty folder of
files; only the two named columns are read.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import encoded, hold, tokenizer_file
from panelkit.llm.wordcache import ChunkCache, TextCache, array_pieces_of_file, array_slices, pieces_of_file
from panelkit.session import scratch_path

END_ID = 1
WRITE = {
    "compression": "zstd", "parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "1000",
}
# Pieces, and chunks, that each of two cache generations of a worker may hold.
PIECES_KEPT = 300_000
CACHED = 100_000
_PART = "\x01"
_CACHES: dict = {}


def chunk_cache(tokenizer: str) -> TextCache:
    """The worker's cache of packed ids, encoded by the tokenizers library."""
    found = _CACHES.get(tokenizer)
    if found is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        codec = Tokenizer.from_file(tokenizer_file(tokenizer))
        codec.no_truncation()
        codec.no_padding()

        # Chunks without this character are encoded in one text, parted by it; alone it is one token.
        part = codec.encode(_PART, add_special_tokens=False).ids

        def alone(chunk: bytes) -> bytes:
            return np.array(codec.encode(chunk.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

        def encode(chunks: list[bytes]) -> list[bytes]:
            if len(part) != 1:
                return [alone(c) for c in chunks]
            mark = _PART.encode()
            plain = [c for c in chunks if mark not in c] if mark in b"".join(chunks) else chunks
            text = (b" " + mark + b" ").join(plain).decode("utf-8")
            ids = np.array(codec.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(ids == part[0]) * 4).tolist()
            packed = ids.tobytes()
            values = [packed[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(packed)])]
            if len(plain) == len(chunks):
                return values
            found = dict(zip(plain, values))
            return [found[c] if c in found else alone(c) for c in chunks]

        # Pieces need no such character: each one's last token ends with the file's mark of a word's end.
        with open(tokenizer_file(tokenizer), encoding="utf-8") as f:
            suffix = json.load(f)["model"].get("end_of_word_suffix")
        last = np.array([bool(suffix) and (codec.id_to_token(i) or "").endswith(suffix) for i in range(codec.get_vocab_size())], bool)

        def encode_pieces(pieces: list[str]) -> list[bytes]:
            if "" in pieces:
                values = iter(encode_pieces([p for p in pieces if p]))
                return [next(values) if p else b"" for p in pieces]
            ids = np.array(codec.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
            cuts = ((np.flatnonzero(last[ids]) + 1) * 4).tolist()
            if len(cuts) != len(pieces):
                return [alone(p.encode()) for p in pieces]
            packed = ids.tobytes()
            return [packed[a:b] for a, b in zip([0, *cuts], cuts)]

        found = _CACHES[tokenizer] = TextCache(
            pieces_of_file(tokenizer_file(tokenizer)), ChunkCache(encode_pieces, PIECES_KEPT), ChunkCache(encode, CACHED))
    return found


def ids_of_run(cache: TextCache, split, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of every text's ids, and of what follows the last, and all ids with the end ids.

    Each distinct piece is looked up once. Texts that are not split are pieces of their own, and so is the end.
    """
    plain, lists = split(texts)
    offsets, pieces = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
    distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist
    others = np.flatnonzero(~plain)
    whole = [encoded(t).split() for t in texts.take(pa.array(others)).to_pylist()]
    values = [*next(cache.pieces.values([distinct])), np.array([end_id], "<u4").tobytes(), *map(b"".join, cache.chunks.values(whole))]
    ends, n = offsets[1:] - offsets[0], len(distinct)
    index = np.insert(pieces.indices.to_numpy().astype(np.int64), np.concatenate((ends[others], ends)),
                      np.concatenate((n + 1 + np.arange(len(others)), np.full(len(ends), n))))
    sizes = np.array([len(v) // 4 for v in values], np.int64)
    counts, first = sizes[index], np.cumsum(sizes) - sizes
    upto = np.cumsum(counts)
    ids = np.frombuffer(b"".join(values), "<i4")[np.repeat(first[index] - upto + counts, counts) + np.arange(counts.sum())]
    return np.concatenate(([0], upto[np.flatnonzero(index == n)])), ids


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every document and write the files."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def encode(batches):
        with hold("tokens", _CACHES.clear):
            cache, before = chunk_cache(tokenizer), 0
            split = array_pieces_of_file(tokenizer_file(tokenizer))
            for batch in batches:
                at = 0
                for run in array_slices(batch.column(1)):
                    starts, ids = ids_of_run(cache, split, run, end_id)
                    sizes, n = np.diff(starts), len(run)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, n), batch.column(2).slice(at, n), pa.array(before + starts[:-1]), pa.array(sizes),
                         pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))],
                        names=["doc_id", "part", "before", "n_tokens", "ids"])
                    before += int(starts[-1])
                    at += n

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(encode, f"doc_id {kind}, part int, before long, n_tokens long, ids array<int>")
    out.write.options(**WRITE).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens of every document; no ids are read."""
    return _with_start(spark, path).drop("ids")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids of all documents, or of those with ids from `first` to `last`."""
    out = _with_start(spark, path)
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    return out if last is None else out.where(F.col("doc_id") <= last)


def _with_start(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per file range
    starts = list(itertools.accumulate((r["n"] for r in totals), initial=0))
    parts = spark.createDataFrame([(r["part"], s) for r, s in zip(totals, starts)], "part int, base long")
    joined = files.join(F.broadcast(parts), "part")
    return joined.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def crc(batches):
        for batch in batches:
            column = batch.column(3)
            at, flat = column.offsets.to_numpy(), column.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(crc, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Write all documents to a fresh folder and return the checksums of what is read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, f"tokens-{uuid.uuid4().hex[:8]}")
    write_tokens(docs, path, tokenizer)
    return checksums(read_tokens(spark, path))
