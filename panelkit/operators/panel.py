"""Features over an (entity, period) panel that holds one row per key.

Entity windows order by an integer period and use range frames, so a missing period stays missing.
An entity has at most one row per period; event-level data is rolled up (with map-side partial
aggregation) before these operators see it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.joins import attribute_join, lookup_join, shifted_join
from panelkit.session import names

# Fixed value: the change recorded when the base is zero and the current value is not.
ZERO_BASE_CHANGE = 999999


def _frame(entity: str | Sequence[str], period: str, first: int, last: int) -> str:
    """Window over the rows `first` to `last` periods before the current one."""
    keys = ", ".join(f"`{c}`" for c in names(entity))
    return f"OVER (PARTITION BY {keys} ORDER BY `{period}` RANGE BETWEEN {first} PRECEDING AND {last} PRECEDING)"


def mean_expression(c: str, n: int, entity: str | Sequence[str], period: str) -> str:
    """Mean of the n periods before this one."""
    return f"avg(`{c}`) {_frame(entity, period, n, 1)}"


def offset_expression(c: str, n: int, entity: str | Sequence[str], period: str) -> str:
    """Value exactly n periods earlier; null when that period is absent."""
    return f"first({c}) {_frame(entity, period, n, n)}"


def value_at_offset(c: str, n: int, entity: str | Sequence[str], period: str) -> Column:
    return F.expr(offset_expression(c, n, entity, period))


def change_expression(now: str, base: str) -> str:
    """Percent change with the zero-base rules."""
    return (
        f"CASE WHEN `{now}` = 0 AND `{base}` = 0 THEN 0D WHEN `{now}` > 0 AND `{base}` = 0 THEN {ZERO_BASE_CHANGE}D "
        f"WHEN `{now}` < 0 AND `{base}` = 0 THEN -{ZERO_BASE_CHANGE}D "
        f"ELSE try_divide(CAST(`{now}` - `{base}` AS DOUBLE), CAST(`{base}` AS DOUBLE)) * 100 END"
    )


def trailing_mean(df: DataFrame, columns: str | Sequence[str], n: int, entity: str, period: str) -> DataFrame:
    return feature_batch(df, entity, period, [(names(columns), [n], [])])


def pct_change(df: DataFrame, columns: str | Sequence[str], n: int, entity: str, period: str) -> DataFrame:
    return feature_batch(df, entity, period, [(names(columns), [], [n])])


def feature_batch(
    df: DataFrame,
    entity: str,
    period: str,
    measures: Sequence[tuple[Sequence[str], Sequence[int], Sequence[int]]],
) -> DataFrame:
    """All trailing means and changes at once, so one shuffle and one sort serve them all.

    `measures` lists (columns, mean spans, change spans). Base values are taken in a first
    projection: the change rule reads its base several times, and would repeat the window each time.
    """
    windowed, out = [], [f"`{c}`" for c in df.columns]
    for columns, mean_spans, change_spans in measures:
        for c in columns:
            for n in mean_spans:
                name = f"{c}_avg_{n}yr"
                windowed.append(f"{mean_expression(c, n, entity, period)} AS `{name}`")
                out.append(f"`{name}`")
            for n in change_spans:
                base = f"__{c}_{n}_before"
                windowed.append(f"{offset_expression(f'`{c}`', n, entity, period)} AS `{base}`")
                out.append(f"{change_expression(c, base)} AS `{c}_pct_change_{n}yr`")
    return df.selectExpr("*", *windowed).selectExpr(*out)


def lag_bundle(df: DataFrame, columns: Sequence[str], entity: str, period: str, suffix: str = "_lag") -> DataFrame:
    """Own values of exactly one period earlier; shares the window of the other panel features."""
    return df.selectExpr("*", *[f"{offset_expression(f'`{c}`', 1, entity, period)} AS `{c}{suffix}`" for c in columns])


def parent_bundle(
    child: DataFrame, parent: DataFrame, on: str, period: str, columns: Sequence[str],
    spread: Sequence[str], suffix: str = "_tr", salted: bool = False,
) -> DataFrame:
    """Parent-level values of the same period. `spread` is the child key, used to split hot parents."""
    source = parent.select(on, period, *[F.col(c).alias(f"{c}{suffix}") for c in columns])
    return lookup_join(child, source, [on, period], "left", spread, salted)


def parent_lag_bundle(
    child: DataFrame, parent: DataFrame, on: str, period: str, columns: Sequence[str],
    spread: Sequence[str], suffix: str = "_lag_tr", salted: bool = False,
) -> DataFrame:
    """Parent-level values of exactly one period earlier."""
    return shifted_join(child, parent, on, period, 1, {c: f"{c}{suffix}" for c in columns}, "left", spread, salted)


def parent_mean(child: DataFrame, parent_key: str, period: str, columns: Sequence[str]) -> DataFrame:
    """Mean of the children per parent and period."""
    return child.groupBy(parent_key, period).agg(*[F.avg(c).alias(c) for c in columns])


def sentinel_repair(
    df: DataFrame, columns: str | Sequence[str], period: str, sentinel: int = ZERO_BASE_CHANGE
) -> DataFrame:
    """Replace the sentinel by the period's largest other value; periods with none keep it."""
    columns = names(columns)
    ceilings = df.groupBy(period).agg(
        *[F.expr(f"max(CASE WHEN `{c}` <> {sentinel} THEN `{c}` END) AS `__max_{c}`") for c in columns]
    )
    fixed = {c: f"CASE WHEN `{c}` = {sentinel} THEN coalesce(`__max_{c}`, `{c}`) ELSE `{c}` END AS `{c}`" for c in columns}
    joined = attribute_join(df, ceilings, period)
    return joined.selectExpr(*[fixed.get(c, f"`{c}`") for c in df.columns])


def carry_forward(
    df: DataFrame, vintage: str, spans: Mapping[object, tuple[int, int]], period: str
) -> DataFrame:
    """Repeat each survey vintage over the years it stands for; unlisted vintages are dropped."""
    bounds = None
    for value, (first, last) in spans.items():
        years = F.sequence(F.lit(first), F.lit(last))
        hit = F.col(vintage) == F.lit(value)
        bounds = F.when(hit, years) if bounds is None else bounds.when(hit, years)
    return df.withColumn(period, F.explode(bounds))


def period_bounds(df: DataFrame, period: str) -> tuple[int, int]:
    """First and last period of the data (one aggregated row)."""
    row = df.agg(F.min(period), F.max(period)).first()
    return row[0], row[1]


def densify(df: DataFrame, entities: DataFrame, entity: str, period: str, first: int, last: int) -> DataFrame:
    """One row per entity and period in the span, with nulls where the panel has no row."""
    grid = entities.select(entity).withColumn(period, F.explode(F.sequence(F.lit(first), F.lit(last))))
    # The grid is many times the entities it is estimated by, so it must not be taken for a side small enough to broadcast.
    return grid.join(df.hint("merge"), [entity, period], "left")
