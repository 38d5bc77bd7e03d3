"""Joins used across the panel: lookups, period shifts, update-joins, membership."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalars import col
from panelkit.session import names, salt_count

_SALT = "__salt"


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join in which null keys match each other, keeping the left side's key columns."""
    right = right.withColumnsRenamed({c: f"__k_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in on]
    return left.join(right, same, how).drop(*[f"__k_{c}" for c in on])


# Most groups whose figures are sent to every task.
FEW_GROUPS = 10_000


def group_join(rows: DataFrame, figures: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the figures of their group, a stored frame of one short row a group; null keys match each other.

    The figures of few groups are broadcast, so that the rows of a hot group stay where they are.
    """
    few = figures.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return null_safe_join(rows, F.broadcast(figures) if few else figures, by, "inner")


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "left", spread: Sequence[str] = (),
    salted: bool = False,
) -> DataFrame:
    """Join rows to a lookup with one row per key.

    The join carries no hint: adaptive execution broadcasts a side that turns out small and splits
    skewed partitions. For a lookup key known to be so hot that its rows need more than that,
    `salted` adds a hash of the `spread` columns to the key and repeats the lookup once per salt, so one key
    becomes many join partitions. The lookup is unique per key, so no row is multiplied; joins that
    keep unmatched lookup rows would repeat them per salt and are refused.
    """
    on = names(on)
    if not salted:
        return rows.join(lookup, on, how)
    if how.replace("_", "").replace("outer", "") in ("right", "full", ""):
        raise ValueError(f"a salted join cannot keep unmatched lookup rows ({how})")
    salts = salt_count(rows.sparkSession)
    left = rows.withColumn(_SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, _SALT], how).drop(_SALT)


def shifted_join(
    rows: DataFrame,
    source: DataFrame,
    on: str | Sequence[str],
    period: str,
    offset: int,
    rename: Mapping[str, str],
    how: str = "left",
    spread: Sequence[str] = (),
    salted: bool = False,
) -> DataFrame:
    """Bring in the source's columns from exactly `offset` periods earlier."""
    on = names(on)
    past = source.select(
        *on, (F.col(period) + offset).alias(period), *[F.col(a).alias(b) for a, b in rename.items()]
    )
    return lookup_join(rows, past, [*on, period], how, spread, salted)


def update_join(
    target: DataFrame, source: DataFrame, on: str | Sequence[str], columns: Mapping[str, str | Column],
    spread: Sequence[str] = (),
) -> DataFrame:
    """Overwrite target columns where the source has the key, even with null; keep the rest.

    `columns` maps a target column to a source column or expression; the source is unique per key.
    """
    on = names(on)
    patch = source.select(
        *on, *[col(expr).alias(f"__new_{name}") for name, expr in columns.items()], F.lit(True).alias("__hit")
    )
    joined = lookup_join(target, patch, on, "left", spread)
    out = [
        F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in target.columns
    ]
    added = [F.col(f"__new_{c}").alias(c) for c in columns if c not in target.columns]
    return joined.select(*out, *added)


def membership_flag(
    rows: DataFrame, members: DataFrame, on: str, name: str, spread: Sequence[str] = (), salted: bool = False
) -> DataFrame:
    """0/1 column: 1 where the key occurs in the member list."""
    listed = members.select(on).where(F.col(on).isNotNull()).distinct().withColumn("__in", F.lit(1))
    joined = lookup_join(rows, listed, on, "left", spread, salted)
    return joined.withColumn(name, F.coalesce(F.col("__in"), F.lit(0)).cast("int")).drop("__in")


def attribute_join(rows: DataFrame, attributes: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join to an attribute table; adaptive execution broadcasts it if its measured size allows."""
    return rows.join(attributes, names(on), how)
