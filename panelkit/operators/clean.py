"""Filling, binning and row cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalars import finite_or_null
from panelkit.operators.order import exact_quantiles
from panelkit.session import names, with_row

# The four bin labels in ascending order.
BIN_LABELS = ["low", "med-low", "med-high", "high"]


def null_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Names of the columns that hold at least one null."""
    columns = list(columns or df.columns)
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(c) for c in columns])
    return flags.unpivot([], columns, "column", "has_nulls").where("has_nulls").select("column")


def column_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row holding the exact median of each column (non-finite values ignored)."""
    clean = df.select(*[finite_or_null(F.col(c).cast("double")).alias(c) for c in columns])
    long = exact_quantiles(clean, columns, [0.5])
    return long.agg(*[F.max(F.when(F.col("variable") == c, F.col("quantiles")[0])).alias(c) for c in columns])


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.avg(finite_or_null(F.col(c).cast("double"))).alias(c) for c in columns])


def fill_from(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Fill nulls and non-finite values from a one-row frame of fitted values."""
    row = F.col("__fit")
    filled = {c: F.coalesce(finite_or_null(F.col(c).cast("double")), row[c]) for c in fitted.columns}
    return with_row(df, fitted, "__fit").select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def fill_median(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Fill with the column median, fitted on the frame itself or on another one."""
    return fill_from(df, column_medians(df if fit_on is None else fit_on, columns))


def fill_median_halves(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Fill both halves of a split, each with its own medians, which are fitted together."""
    slim = [half.select(F.lit(i).alias("__half"), *[finite_or_null(F.col(c).cast("double")).alias(c) for c in columns])
            for i, half in enumerate((train, test))]
    found = exact_quantiles(slim[0].unionByName(slim[1]), columns, [0.5], "__half")
    # Two numbers a column reach the driver.
    medians = {(r["__half"], r["variable"]): r["quantiles"][0] for r in found.where(F.col("quantiles").isNotNull()).collect()}

    def filled(df: DataFrame, half: int) -> DataFrame:
        known = {c: F.coalesce(finite_or_null(F.col(c).cast("double")), F.lit(medians.get((half, c))).cast("double")) for c in columns}
        return df.select(*[known[c].alias(c) if c in known else F.col(c) for c in df.columns])

    return filled(train, 0), filled(test, 1)


def fill_mean(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    return fill_from(df, column_means(df if fit_on is None else fit_on, columns))


def _labelled(index: Column, labels: Sequence[str] | None) -> Column:
    return index if labels is None else F.get(F.array(*[F.lit(s) for s in labels]), index)


def _above(x: Column, edges: Sequence[Column]) -> Column:
    total = F.lit(0)
    for edge in edges:
        total = total + (x > edge).cast("int")
    return total


def equal_width_bins(
    df: DataFrame, columns: str | Sequence[str], bins: int = 4, labels: Sequence[str] | None = None,
    suffix: str = "_bins",
) -> DataFrame:
    """Right-closed bins of equal width, lowest value included; a constant column falls in the middle."""
    columns = names(columns)
    ends = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"),
                             F.max(F.col(c).cast("double")).alias("hi")).alias(c) for c in columns])
    row = F.col("__ends")
    out = []
    for c in columns:
        lo, hi, x = row[c]["lo"], row[c]["hi"], F.col(c).cast("double")
        edges = [lo + F.lit(float(i)) * ((hi - lo) / bins) for i in range(1, bins)]
        index = F.when(lo == hi, F.when(x.isNotNull(), F.lit((bins + 1) // 2 - 1))).otherwise(_above(x, edges))
        out.append(_labelled(index, labels).alias(f"{c}{suffix}"))
    return with_row(df, ends, "__ends").select(*df.columns, *out)


def bin_edges(df: DataFrame, columns: str | Sequence[str], bins: int = 4) -> DataFrame:
    """The edges of the equal-width bins, one row per column."""
    columns = names(columns)
    lo_hi = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"),
                              F.max(F.col(c).cast("double")).alias("hi")).alias(c) for c in columns])
    long = lo_hi.unpivot([], columns, "variable", "ends")
    step = (F.col("ends.hi") - F.col("ends.lo")) / bins
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("ends.lo") + i * step)
    return long.select("variable", edges.alias("edges"))


def given_bins(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str] | None = None) -> DataFrame:
    """Right-closed bins between given edges, lowest edge included; values outside give null."""
    x = F.col(column).cast("double")
    index = F.when(x.between(float(edges[0]), float(edges[-1])), _above(x, [F.lit(float(e)) for e in edges[1:-1]]))
    return df.withColumn(f"{column}_bins", _labelled(index, labels))


def quantile_bins(
    df: DataFrame, column: str, bins: int | None = None, labels: Sequence[str] | None = None
) -> DataFrame:
    """Right-closed bins at the quantiles; the bin count defaults to the label count, else 4."""
    if bins is not None and labels is not None and bins != len(labels):
        raise ValueError("bin count and label count must be equal")
    bins = bins or (len(labels) if labels else 4)
    probs = [i / bins for i in range(1, bins)]
    edges = exact_quantiles(df.select(column), column, probs).select("quantiles")
    at = F.col("__edges")["quantiles"]
    x = F.col(column).cast("double")
    index = _labelled(_above(x, [at[i] for i in range(len(probs))]), labels)
    return with_row(df, edges, "__edges").withColumn(f"{column}_bins", index).drop("__edges")


def dummies(df: DataFrame, column: str, values: Sequence | None = None) -> DataFrame:
    """One 0/1 column per value; values not given are read from the data (they become columns, so they are few)."""
    if values is None:
        found = df.select(column).distinct().where(F.col(column).isNotNull()).orderBy(column)
        values = [r[0] for r in found.collect()]
    hit = [F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int").alias(f"{column}_{v}") for v in values]
    return df.select("*", *hit)


def min_max_scale(df: DataFrame, column: str, name: str) -> DataFrame:
    """(x - min) / (max - min); a constant column gives null."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    scaled = F.try_divide(x - F.col("__ends")["lo"], F.col("__ends")["hi"] - F.col("__ends")["lo"])
    return with_row(df, ends, "__ends").withColumn(name, scaled).drop("__ends")


def drop_subheaders(df: DataFrame, numeric_key: str) -> DataFrame:
    """Drop rows whose numeric key is not a number (header lines repeated inside the data)."""
    return df.where(F.col(numeric_key).try_cast("double").isNotNull())


def features_and_target(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Feature frame and target frame, both carrying the row keys."""
    return df.select(*keys, *features), df.select(*keys, target)


def rename_and_drop(df: DataFrame, renamed: Mapping[str, str], dropped: Sequence[str] = ()) -> DataFrame:
    return df.drop(*dropped).withColumnsRenamed(dict(renamed))
