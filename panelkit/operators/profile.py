"""Profiling tables: summaries, outliers, correlations, fits, boxes, histograms, trends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators.joins import attribute_join, group_join, null_safe_join
from panelkit.operators.order import exact_quantiles
from panelkit.session import names, with_row


def _tall(wide: DataFrame, columns: Sequence[str], fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Turn one struct column per variable into one row per variable."""
    return wide.unpivot(list(by), list(columns), "variable", "__s").select(
        *by, "variable", *[F.col(f"__s.{f}").alias(f) for f in fields]
    )


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def summary_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, min, max and sample standard deviation per column, in one pass."""
    wide = df.agg(*[
        F.struct(F.avg(_num(c)).alias("avg"), F.min(_num(c)).alias("min"), F.max(_num(c)).alias("max"),
                 F.stddev_samp(_num(c)).alias("std")).alias(c)
        for c in columns
    ])
    return _tall(wide, columns, ["avg", "min", "max", "std"])


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with a struct per column: its mean, ends and deviation."""
    return df.agg(*[
        F.struct(F.avg(_num(c)).alias("avg"), F.min(_num(c)).alias("min"), F.max(_num(c)).alias("max"),
                 F.stddev_samp(_num(c)).alias("std")).alias(c)
        for c in columns
    ])


def _outlier_fields(c: str, width: float) -> list[Column]:
    moments = F.col("__m")
    x, reach = _num(c), moments[c]["std"] * width
    high, low = x > moments[c]["avg"] + reach, x < moments[c]["avg"] - reach
    return [
        F.count_if(high).alias("count_high"), F.avg(F.when(high, x)).alias("avg_high"),
        F.count_if(low).alias("count_low"), F.avg(F.when(low, x)).alias("avg_low"),
    ]


def outlier_table(df: DataFrame, columns: Sequence[str], width: float = 3.0) -> DataFrame:
    """Count and mean of the values beyond mean +/- width standard deviations, all columns in one pass."""
    known = with_row(df.select(*columns), _moments(df, columns), "__m")
    wide = known.agg(*[F.struct(*_outlier_fields(c, width)).alias(c) for c in columns])
    return _tall(wide, columns, ["count_high", "avg_high", "count_low", "avg_low"])


def summary_with_outliers(df: DataFrame, columns: Sequence[str], width: float = 3.0) -> DataFrame:
    """Both tables joined on variable: one pass for the moments, one for the outliers."""
    known = with_row(df.select(*columns), _moments(df, columns), "__m")
    counted = known.agg(
        F.first("__m").alias("__m"), *[F.struct(*_outlier_fields(c, width)).alias(c) for c in columns]
    )
    wide = counted.select(*[
        F.struct(*[F.col("__m")[c][f].alias(f) for f in ("avg", "min", "max", "std")],
                 *[F.col(c)[f].alias(f) for f in ("count_high", "avg_high", "count_low", "avg_low")]).alias(c)
        for c in columns
    ])
    return _tall(wide, columns, ["avg", "min", "max", "std", "count_high", "avg_high", "count_low", "avg_low"])


def describe_exact(df: DataFrame, columns: Sequence[str], by: str | Sequence[str] = ()) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max per column."""
    by = names(by)
    wide = df.groupBy(*by).agg(*[
        F.struct(F.count(c).alias("count"), F.avg(_num(c)).alias("mean"), F.stddev_samp(_num(c)).alias("std"),
                 F.min(_num(c)).alias("min"), F.max(_num(c)).alias("max")).alias(c)
        for c in columns
    ])
    moments = _tall(wide, columns, ["count", "mean", "std", "min", "max"], by)
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by).select(
        *by, "variable", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75"])]
    )
    return null_safe_join(moments, quartiles, [*by, "variable"])


# Buckets of the distinct-count sketches, as a power of two: a relative error of 1.04 / sqrt(2^12), 1.6 percent.
HLL_LG_K = 12


def dataset_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, row count, null count, distinct count, and numeric min, max and mean of every column.

    Exact distinct counts are one aggregate per column, which reads that column only and drops
    repeats before the shuffle; no row is written out once per column. `approximate` counts by
    sketch within the one scan of the other figures.
    """
    numeric = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema}
    none = F.lit(None).cast("double")
    wide = df.agg(*[
        F.struct(
            F.lit(f.dataType.simpleString()).alias("type"), F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(f.name).isNull()).alias("nulls"),
            *([F.approx_count_distinct(f.name, 1.04 / 2 ** (HLL_LG_K / 2)).alias("distinct")] if approximate else []),
            (F.min(_num(f.name)) if numeric[f.name] else none).alias("min"),
            (F.max(_num(f.name)) if numeric[f.name] else none).alias("max"),
            (F.avg(_num(f.name)) if numeric[f.name] else none).alias("mean"),
        ).alias(f.name)
        for f in df.schema
    ])
    fields = ["type", "rows", "nulls", "distinct", "min", "max", "mean"]
    if approximate:
        return _tall(wide, df.columns, fields)
    counts = reduce(DataFrame.unionAll, [
        df.agg(F.count_distinct(F.col(c)).alias("distinct")).select(F.lit(c).alias("variable"), "distinct") for c in df.columns])
    out = _tall(wide, df.columns, [f for f in fields if f != "distinct"]).join(counts, "variable")
    return out.select("variable", *fields)


def distinct_sketches(df: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """A mergeable sketch of the distinct values of every column that is no key, per group: one row per (group, variable)."""
    by = names(by)
    columns = [c for c in df.columns if c not in by]
    wide = df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(c).cast("string"), F.lit(HLL_LG_K)).alias(c) for c in columns])
    return wide.unpivot(by, columns, "variable", "sketch")


def merged_distincts(sketches: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Distinct counts (within the sketch error) of merged sketches, over all groups or those that `by` keeps."""
    return sketches.groupBy(*names(by), "variable").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def null_share(df: DataFrame, column: str, by: str | Sequence[str]) -> DataFrame:
    """Null count, row count and null percentage per group; groups without nulls show null, not 0."""
    out = df.groupBy(*names(by)).agg(
        F.nullif(F.count_if(F.col(column).isNull()), F.lit(0)).alias("count_nulls"),
        F.count(F.lit(1)).alias("count_all"),
    )
    return out.withColumn("pct", F.col("count_nulls") / F.col("count_all") * 100)


def condition_share(df: DataFrame, condition: Column, by: str | Sequence[str] = ()) -> DataFrame:
    """Rows meeting a condition, rows where it is known, and their share."""
    hits, known = F.count_if(condition), F.count(condition)
    return df.groupBy(*names(by)).agg(
        hits.alias("hits"), known.alias("known"), F.avg(condition.cast("double")).alias("share")
    )


def _pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows where both are known; null if either is constant there."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pair_moments(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Six sums of every pair over the rows where both are known: 1, x, y, xx, yy and xy, as matrices.

    A row becomes one vector (values, squares, flags of known values) with zeros for nulls; the sums
    are blocks of its Gramian, which the JVM adds up over tasks as a tree. Values are centred on the
    column mean first, so the sums stay well conditioned. What reaches the driver depends on the
    number of columns only.
    """
    means = df.agg(*[F.avg(F.when(~F.isnan(_num(c)), _num(c))).alias(c) for c in columns]).first()
    # One array per row keeps the generated code small for many columns.
    centred = F.zip_with(F.array(*map(_num, columns)), F.array(*[F.lit(means[c]).cast("double") for c in columns]), lambda a, m: a - m)
    known = F.transform(centred, lambda a: F.when(F.isnan(a), F.lit(None)).otherwise(a))
    rows = df.select(known.alias("x"))
    x = F.transform("x", lambda a: F.coalesce(a, F.lit(0.0)))
    flags = F.transform("x", lambda a: a.isNotNull().cast("double"))
    vector = array_to_vector(F.concat(x, F.transform(x, lambda a: a * a), flags)).alias("v")
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(vector), "v")).computeGramianMatrix().toArray()
    n = len(columns)
    xs, squares, ones = (slice(i * n, (i + 1) * n) for i in range(3))
    return np.stack([gram[ones, ones], gram[xs, ones], gram[ones, xs], gram[squares, ones], gram[ones, squares], gram[xs, xs]])


# Most pairs that are written as aggregates of their own; the Gramian serves wider tables.
_PLAIN_PAIRS = 100


def correlation_pairs(df: DataFrame, columns: Sequence[str], full: bool = False) -> DataFrame:
    """Pearson correlation of column pairs, nulls dropped pair by pair, one row per pair.

    The lower triangle by default; `full` adds the diagonal and the mirrored pairs. Everything is
    added up on the JVM and a task sends one partial result.
    """
    spark = df.sparkSession
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[i + 1:]]
    if full:
        pairs += [(c, c) for c in columns]
    if len(pairs) <= _PLAIN_PAIRS:
        known = {c: F.when(~F.isnan(_num(c)), _num(c)) for c in columns}
        wide = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), _pearson(known[a], known[b]).alias("r")).alias(f"p{i}")
                        for i, (a, b) in enumerate(pairs)])
        out = wide.select(F.inline(F.array(*wide.columns)))
    elif df.isEmpty():
        out = spark.createDataFrame([(a, b, None) for a, b in pairs], "a string, b string, r double")
    else:
        n, sx, sy, sxx, syy, sxy = _pair_moments(df, columns)
        spread = np.sqrt(np.maximum(n * sxx - sx * sx, 0.0)) * np.sqrt(np.maximum(n * syy - sy * sy, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            r = (n * sxy - sx * sy) / spread
        at = {c: i for i, c in enumerate(columns)}
        rows = [(a, b, float(r[at[a], at[b]]) if spread[at[a], at[b]] > 0 else None) for a, b in pairs]
        out = spark.createDataFrame(rows, "a string, b string, r double")
    if not full:
        return out
    mirrored = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    return out.select(F.inline(mirrored), "r")


def correlation_with(df: DataFrame, columns: Sequence[str], target: str, above: float | None = None) -> DataFrame:
    """Correlation of each column with one target, optionally only those above a (signed) threshold."""
    wide = df.agg(*[_pearson(_num(c), _num(target)).alias(c) for c in columns])
    out = wide.unpivot([], list(columns), "variable", "r")
    return out if above is None else out.where(F.col("r") > above)


def linear_fit(df: DataFrame, y: str, x: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x, overall or per group."""
    return df.groupBy(*names(by)).agg(
        F.regr_slope(_num(y), _num(x)).alias("slope"), F.regr_intercept(_num(y), _num(x)).alias("intercept"),
        F.regr_r2(_num(y), _num(x)).alias("r2"), F.regr_count(_num(y), _num(x)).alias("n"),
    )


def box_stats(df: DataFrame, column: str, by: str | Sequence[str] = (), reach: float = 1.5) -> DataFrame:
    """Quartiles, whisker ends within `reach` IQRs, and the count of points beyond them, per group."""
    by = names(by)
    q = exact_quantiles(df, column, [0.25, 0.5, 0.75], by).select(
        *by, *[F.col("quantiles")[i].alias(n) for i, n in enumerate(["q1", "median", "q3"])]
    )
    rows = df.select(*by, _num(column).alias("__x")).where(F.col("__x").isNotNull())
    if by:
        rows = group_join(rows, q, by)
    else:
        rows = with_row(rows, q, "__q").select("*", "__q.*")
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("__x") >= F.col("q1") - reach * iqr) & (F.col("__x") <= F.col("q3") + reach * iqr)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.max(n).alias(n) for n in ["q1", "median", "q3"]],
        F.min(F.when(inside, F.col("__x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def histogram(
    df: DataFrame, column: str, bins: int = 10, span: tuple[float, float] | None = None,
    by: str | Sequence[str] = (),
) -> DataFrame:
    """Counts in equal bins, left-closed with the last bin closed; values outside the span are left out.

    Every bin is listed, for every group too.
    """
    by = names(by)
    x = _num(column)
    if span is None:
        widen = F.when(F.min(x) == F.max(x), F.lit(0.5)).otherwise(F.lit(0.0))
        ends = df.agg((F.min(x) - widen).alias("lo"), (F.max(x) + widen).alias("hi"))
        df = with_row(df, ends, "__ends")
        lo, hi = F.col("__ends")["lo"], F.col("__ends")["hi"]
    else:
        lo, hi = F.lit(float(span[0])), F.lit(float(span[1]))
    width = (hi - lo) / bins
    index = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    counts = df.where(x.between(lo, hi)).groupBy(*by, index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    every = df.select(*by).distinct().select("*", listed) if by else df.sparkSession.range(1).select(listed)
    counts = null_safe_join(every, counts, [*by, "bin"]).select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"))
    if span is None:
        counts = with_row(counts, ends, "__ends")
    return counts.select(
        *by, "bin", (lo + F.col("bin") * width).alias("from_value"), (lo + (F.col("bin") + 1) * width).alias("to_value"), "n"
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def group_means(df: DataFrame, by: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*names(by)).agg(*[F.avg(_num(c)).alias(c) for c in columns])


def mean_differences(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean of each feature where the label is 0 and where it is 1."""
    wide = df.agg(*[
        F.struct(F.avg(F.when(F.col(label) == 0, _num(c))).alias("mean_0"),
                 F.avg(F.when(F.col(label) == 1, _num(c))).alias("mean_1")).alias(c)
        for c in columns
    ])
    return _tall(wide, columns, ["mean_0", "mean_1"])


def metric_by(df: DataFrame, metric: str, by: Sequence[str]) -> DataFrame:
    """Mean, spread and count of a metric per combination of keys."""
    return df.groupBy(*by).agg(
        F.avg(_num(metric)).alias("mean"), F.stddev_samp(_num(metric)).alias("std"), F.count(metric).alias("n")
    )


def pivot_sum(df: DataFrame, row: str, column: str, values: Sequence, measure: str) -> DataFrame:
    """Sums with one row per `row` key and one column per listed value."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.sum(measure))


def sums_over(df: DataFrame, by: str | Sequence[str], measure: Column, threshold: Column) -> DataFrame:
    """Groups whose total reaches a threshold."""
    out = df.groupBy(*names(by)).agg(F.sum(measure).alias("total"))
    return out.where(F.col("total") >= threshold)
