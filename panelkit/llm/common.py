"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import materialise, scratch_path

# White space of the word rules: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to a fresh path in the shared folder and read it back, cutting the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small frame that several later jobs read."""
    return materialise(df)


def bucket_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def encoded(text: str | None) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def lower_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text with A-Z in lower case, as UTF-8 bytes.

    bytes.lower() changes A-Z only, and bytes.split() splits on exactly these six characters.
    """
    return encoded(text).lower().split()


def let(value: str, name: str, body: str) -> str:
    """SQL text that evaluates `value` once per row and uses it as `name` in `body`."""
    return f"transform(array({value}), {name} -> {body})[0]"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer file on this machine; every executor has the package."""
    import public_tokenizers

    return public_tokenizers.path(name) if not os.path.isabs(name) else name


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet."""
    while name in df.columns:
        name = f"_{name}"
    return name


def hash_bound(n: int, most: int) -> int:
    """A 64-bit hash under which at least `most` of `n` rows lie, and few more: ten standard deviations are added."""
    wanted = most + 10 * most ** 0.5 + 100
    return (1 << 63) - 1 if wanted >= n else int(-(1 << 63) + wanted / n * (1 << 64))


# Seconds without a task after which a worker process drops its caches.
IDLE_S = 2.0
_HELD: dict[str, Callable[[], None]] = {}
_DROP: list[threading.Timer] = []


@contextmanager
def hold(owner: str, clear: Callable[[], None]) -> Iterator[None]:
    """Around a task's use of a cache of its worker process: caches of other owners are dropped.

    Worker processes are reused by later stages, so the caches of several stages would add up, and they stay
    for a minute beside stages without Python. So a cache that no task takes up again is dropped soon.
    """
    while _DROP:
        _DROP.pop().cancel()
    for other in list(_HELD):  # a timer that is already at work may empty it meanwhile
        if other != owner:
            _HELD.pop(other, gc.collect)()
    _HELD[owner] = clear
    try:
        yield
    finally:
        timer = threading.Timer(IDLE_S, drop_held)
        timer.daemon = True
        _DROP.append(timer)
        timer.start()


def drop_held() -> None:
    """Drop all caches; a running task keeps what it works with."""
    for owner in list(_HELD):
        _HELD.pop(owner, gc.collect)()
    gc.collect()
