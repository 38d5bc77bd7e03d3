"""Outcome labels of a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.order import assign_tiles
from panelkit.operators.panel import value_at_offset
from panelkit.session import materialise


def top_tile_labels(
    df: DataFrame,
    entity: str,
    period: str,
    labels: Mapping[str, str],
    required: str,
    tiles: int = 5,
    first: int | None = None,
    end: int | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per period, 1 for the top tile of each measure and 0 below; nulls rank first.

    `labels` maps label name to measure. Rows with a null `required` get no label; `end` is exclusive.
    Columns in `keep` ride along, which spares a join back to a narrow panel.
    """
    out = df.where(F.col(required).isNotNull())
    if first is not None:
        out = out.where(F.col(period) >= first)
    if end is not None:
        out = out.where(F.col(period) < end)
    # Stored, because every label counts, samples, places and reads the rows.
    out = materialise(out.select(entity, period, *dict.fromkeys([*labels.values(), *keep])))
    plain = out
    for name, measure in labels.items():
        order = [F.col(measure).desc_nulls_first(), F.col(entity)]
        out = assign_tiles(out, order, tiles, period, "__tile", plain)
        out = out.withColumn(name, (F.col("__tile") == 1).cast("int")).drop("__tile")
    return out.select(entity, period, *labels, *keep)


def tile_discretise(df: DataFrame, column: str, entity: str, period: str, year: int, tiles: int = 4) -> DataFrame:
    """n-tile of one column for one period."""
    rows = df.where(F.col(period) == year).select(entity, period, column)
    order = [F.col(column).desc_nulls_first(), F.col(entity)]
    return assign_tiles(rows, order, tiles, name=f"{column}_{tiles}tiles").drop(column)


def transition_label(
    df: DataFrame, label: str, name: str, entity: str, period: str, up: bool = True
) -> DataFrame:
    """1 where the label moved 0 to 1 (or 1 to 0) since the previous period; rows without one are left out."""
    step = 1 if up else -1
    present = df.withColumn("__had", value_at_offset("true", 1, entity, period))
    present = present.withColumn("__before", value_at_offset(label, 1, entity, period))
    moved = F.coalesce(F.col(label) - F.col("__before") == step, F.lit(False)).cast("int")
    return present.where(F.col("__had")).withColumn(name, moved).drop("__had", "__before")


def increase_label(df: DataFrame, change: str, name: str, threshold: float = 20.0) -> DataFrame:
    """1 where the percent change exceeds the threshold; null where there is no change value."""
    return df.withColumn(name, (F.col(change) > threshold).cast("int"))


def lagged_labels(df: DataFrame, labels: list[str], entity: str, period: str) -> DataFrame:
    return df.select("*", *[value_at_offset(c, 1, entity, period).alias(f"{c}_lag") for c in labels])
