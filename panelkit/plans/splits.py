"""Rolling-origin train/test splits and repeatable row splits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.scalars import hash_uniform


@dataclass(frozen=True)
class Split:
    train_start: dt.date
    train_end: dt.date
    test_start: dt.date
    test_end: dt.date


def months_after(day: dt.date, months: int) -> dt.date:
    at = day.year * 12 + day.month - 1 + months
    first = dt.date(at // 12, at % 12 + 1, 1)
    following = dt.date((at + 1) // 12, (at + 1) % 12 + 1, 1)
    return first.replace(day=min(day.day, (following - first).days))


def rolling_splits(start: dt.date, end: dt.date, window: int, latest: bool = False) -> list[Split]:
    """Expanding training span from `start`, tested on the next `window` months, until `end`.

    `latest` gives the single split whose test span closes the period.
    """
    day = dt.timedelta(days=1)
    if latest:
        train_end = months_after(end, -window) - day
        return [Split(start, train_end, train_end + day, months_after(train_end + day, window) - day)]
    out = []
    step = 1
    while True:
        test_start = months_after(start, step * window)
        if months_after(test_start - day, window) > end:
            return out
        out.append(Split(start, test_start - day, test_start, months_after(test_start, window) - day))
        step += 1


def splits_frame(spark: SparkSession, splits: Sequence[Split]) -> DataFrame:
    rows = [(i, s.train_start, s.train_end, s.test_start, s.test_end) for i, s in enumerate(splits)]
    return spark.createDataFrame(
        rows, "split int, train_start date, train_end date, test_start date, test_end date"
    )


def tag_splits(df: DataFrame, date: str, splits: Sequence[Split]) -> DataFrame:
    """One row per row and split it belongs to, with its role; a projection, not a join."""
    d = F.col(date)
    roles = [
        F.struct(
            F.lit(i).alias("split"),
            F.when(d.between(F.lit(s.train_start), F.lit(s.train_end)), F.lit("train"))
            .when(d.between(F.lit(s.test_start), F.lit(s.test_end)), F.lit("test")).alias("role"),
        )
        for i, s in enumerate(splits)
    ]
    return df.select("*", F.inline(F.filter(F.array(*roles), lambda r: r["role"].isNotNull())))


def apply_split(
    df: DataFrame, split: Split, date: str, label: str, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one split with a known label."""
    known = df.where(F.col(label).isNotNull())
    train = known.where(F.col(date).between(F.lit(split.train_start), F.lit(split.train_end)))
    test = known.where(F.col(date).between(F.lit(split.test_start), F.lit(split.test_end)))
    return train.select(*columns), test.select(*columns)


def split_counts(df: DataFrame, date: str, label: str, splits: Sequence[Split]) -> DataFrame:
    """Rows and positives per split and role; rows are counted per date before they are repeated."""
    daily = df.where(F.col(label).isNotNull()).groupBy(date).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")
    )
    return tag_splits(daily, date, splits).groupBy("split", "role").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")
    )


def hash_split(df: DataFrame, keys: Sequence[str], seed: int, train_share: float = 0.8) -> DataFrame:
    """Repeatable random split by key: adds `part` with train or test."""
    draw = hash_uniform(keys, seed)
    return df.withColumn("part", F.when(draw < train_share, F.lit("train")).otherwise(F.lit("test")))


def hash_folds(df: DataFrame, keys: Sequence[str], seed: int, folds: int) -> DataFrame:
    return df.withColumn("fold", F.floor(hash_uniform(keys, seed) * folds).cast("int"))
