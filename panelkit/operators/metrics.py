"""Metrics of a ranked, labelled list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.joins import null_safe_join
from panelkit.operators.order import assign_ranks, flag_first, running_totals
from panelkit.session import materialise, names, with_row

# The population percentages at which precision, recall and F1 are reported.
TOP_PERCENTS = [1, 2, 5, 10, 20, 30, 50]


def _ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise))


def metrics_at_k(
    df: DataFrame, score: str, label: str, key: str | Sequence[str],
    percents: Sequence[float] = TOP_PERCENTS, by: str | Sequence[str] = (),
) -> DataFrame:
    """Precision, recall and F1 when the top int(n * k / 100) rows are called positive.

    One ranking serves every k. Ties in score are ordered by key.
    """
    by = names(by)
    slim = df.select(*by, *names(key), score, label)
    ranked = assign_ranks(slim, [F.col(score).desc(), *names(key)], by, "__rank", "__n")
    cutoffs = [F.floor(F.col("__n") * F.lit(k / 100.0)) for k in percents]
    agg = ranked.groupBy(*by).agg(
        F.max("__n").alias("__n"), F.sum(F.col(label).cast("long")).alias("__pos"),
        *[F.sum(F.when(F.col("__rank") <= c, F.col(label).cast("long")).otherwise(F.lit(0))).alias(f"__tp{i}")
          for i, c in enumerate(cutoffs)],
    )
    rows = F.array(*[
        F.struct(F.lit(float(k)).alias("k"), cutoffs[i].cast("long").alias("cutoff"), F.col(f"__tp{i}").alias("hits"))
        for i, k in enumerate(percents)
    ])
    long = agg.select(*by, F.col("__pos").alias("__pos"), F.inline(rows))
    precision, recall = _ratio(F.col("hits"), F.col("cutoff")), _ratio(F.col("hits"), F.col("__pos"))
    return long.select(
        *by, "k", "cutoff", "hits", precision.alias("precision"), recall.alias("recall"),
        _ratio(2 * F.col("hits"), F.col("cutoff") + F.col("__pos")).alias("f1"),
    )


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: the combined form both curves start from."""
    y = F.col(label).cast("long")
    return df.groupBy(*by, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def roc_auc(df: DataFrame, score: str, label: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when one class is missing."""
    by = names(by)
    # Stored, as it is much smaller than the rows and read more than once.
    counts = running_totals(materialise(score_counts(df, score, label, by)), [F.col(score).asc()], {"below": "neg"}, by)
    won = F.col("pos").cast("double") * (F.col("below") - F.col("neg") / 2)
    return counts.groupBy(*by).agg(
        F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc")
    )


def pr_curve(df: DataFrame, score: str, label: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Precision, recall and share of the population at or above every distinct score."""
    by = names(by)
    counts = materialise(score_counts(df, score, label, by).withColumn("n", F.col("pos") + F.col("neg")))
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("__p"), F.sum("n").alias("__n"))
    cum = running_totals(counts, [F.col(score).desc()], {"tp": "pos", "above": "n"}, by)
    if by:
        cum = null_safe_join(cum, totals, by, "inner")
        p, n = F.col("__p"), F.col("__n")
    else:
        cum = with_row(cum, totals, "__t")
        p, n = F.col("__t.__p"), F.col("__t.__n")
    return cum.select(
        *by, F.col(score).alias("threshold"), _ratio(F.col("tp"), F.col("above")).alias("precision"),
        _ratio(F.col("tp"), p).alias("recall"), _ratio(F.col("above"), n).alias("pct_above"),
    )


def confusion_counts(df: DataFrame, label: str, predicted: str, by: str | Sequence[str] = ()) -> DataFrame:
    """2x2 counts with accuracy and precision."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    agg = df.groupBy(*names(by)).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
    )
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return agg.select(
        "*", _ratio(F.col("tp") + F.col("tn"), total, None).alias("accuracy"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def confusion_matrix(df: DataFrame, label: str, predicted: str, classes: Sequence) -> DataFrame:
    """Counts of predicted class (columns) per actual class (rows)."""
    counts = df.groupBy(label).pivot(predicted, list(classes)).count()
    return counts.na.fill(0, [str(c) for c in classes])


def accuracy(df: DataFrame, label: str, predicted: str, by: str | Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*names(by)).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def flag_top(df: DataFrame, score: str, key: str | Sequence[str], k: int, name: str = "pred") -> DataFrame:
    """1 for the k highest scores (ties by key), 0 below; missing and NaN scores come last.

    Rows are compared with the k-th one, so they are neither ranked nor exchanged.
    """
    x = F.col(score)
    last = x.isNull() | F.isnan(x.cast("double"))
    return flag_first(df, [last.asc(), x.desc(), *names(key)], k, name)
