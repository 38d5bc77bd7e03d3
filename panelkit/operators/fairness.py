"""Group audit of a ranked list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelkit.operators.clean import BIN_LABELS, equal_width_bins

# The audited attributes, the metrics compared, the ratio recorded for a zero
# reference, and the band within which a ratio counts as parity.
BIAS_ATTRIBUTES = [
    "pct_renter_occupied", "pct_white", "pct_af_am", "pct_hispanic", "pct_am_ind", "pct_asian", "pct_nh_pi",
    "pct_multiple", "pct_other", "renter_occupied_households", "median_household_income", "median_property_value",
]
RATE_METRICS = ["ppr", "pprev", "precision", "fdr", "for", "fpr", "fnr", "tpr", "tnr", "npv"]
ZERO_REFERENCE_RATIO = 10.0
PARITY_BAND = (0.8, 1.25)
PARITY_OF = {
    "statistical_parity": "ppr", "impact_parity": "pprev", "fdr_parity": "fdr", "fpr_parity": "fpr",
    "for_parity": "for", "fnr_parity": "fnr", "tpr_parity": "tpr", "tnr_parity": "tnr", "npv_parity": "npv",
    "precision_parity": "precision",
}
COMBINED_PARITY = {
    "type_i_parity": ("fdr_parity", "fpr_parity"),
    "type_ii_parity": ("for_parity", "fnr_parity"),
    "equalized_odds": ("fpr_parity", "tpr_parity"),
    "unsupervised_fairness": ("statistical_parity", "impact_parity"),
    "supervised_fairness": ("type_i_parity", "type_ii_parity"),
}


def audit_input(
    df: DataFrame, attributes: Sequence[str], label: str, score: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Attributes binned in four, with the label and score."""
    binned = equal_width_bins(df, list(attributes), 4, BIN_LABELS)
    return binned.select(
        *keys, *[f"{a}_bins" for a in attributes], F.col(label).alias("label_value"), F.col(score).alias("score")
    )


def group_crosstab(df: DataFrame, attributes: Sequence[str], label: str, predicted: str) -> DataFrame:
    """Counts and rates per (attribute, value); a rate with an empty base is null.

    Rows are counted once per attribute value on the map side before anything is shuffled, and the
    list totals come from those counts, so the list itself is read once.
    """
    y, p = F.col("__y") == 1, F.col("__p") == 1
    slim = df.select(
        *[F.col(a).cast("string").alias(a) for a in attributes], F.col(label).alias("__y"), F.col(predicted).alias("__p")
    )
    long = slim.unpivot(["__y", "__p"], list(attributes), "attribute_name", "attribute_value")
    counts = long.groupBy("attribute_name", "attribute_value").agg(
        F.count_if(p).alias("pp"), F.count_if(~p).alias("pn"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & p).alias("tp"),
        F.count_if(~y).alias("group_label_neg"), F.count_if(y).alias("group_label_pos"),
        F.count(F.lit(1)).alias("group_size"),
    )
    whole = W.partitionBy("attribute_name")
    counts = counts.select(
        "*", F.sum("pp").over(whole).alias("k"), F.sum("group_size").over(whole).alias("total_entities")
    ).where(F.col("attribute_value").isNotNull())

    def rate(a: str, b: str) -> Column:
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))

    return counts.select(
        "*", rate("pp", "k").alias("ppr"), rate("pp", "group_size").alias("pprev"),
        rate("tp", "group_label_pos").alias("tpr"), rate("tn", "group_label_neg").alias("tnr"),
        rate("fp", "group_label_neg").alias("fpr"), rate("fn", "group_label_pos").alias("fnr"),
        rate("fn", "pn").alias("for"), rate("fp", "pp").alias("fdr"), rate("tn", "pn").alias("npv"),
        rate("tp", "pp").alias("precision"), rate("group_label_pos", "group_size").alias("prev"),
    )


def ratio_to_reference(x: Column, reference: Column) -> Column:
    return F.when(reference != 0, F.try_divide(x, reference)).when(
        (reference == 0) & (x > 0), F.lit(ZERO_REFERENCE_RATIO)
    )


def disparities(crosstab: DataFrame, references: Mapping[str, str], metrics: Sequence[str] = RATE_METRICS) -> DataFrame:
    """Each rate divided by the rate of the attribute's reference value.

    `references` maps attribute to reference value. The reference row is found with a window over
    the crosstab, which holds one row per attribute value.
    """
    is_reference = F.lit(False)
    for attribute, value in references.items():
        hit = (F.col("attribute_name") == attribute) & (F.col("attribute_value") == str(value))
        is_reference = is_reference | hit
    whole = W.partitionBy("attribute_name")

    def at_reference(c: str) -> Column:
        return F.max(F.when(F.col("__is_ref"), F.col(c))).over(whole)

    marked = crosstab.withColumn("__is_ref", is_reference).select(
        "*", at_reference("attribute_value").alias("ref_group_value"),
        *[at_reference(m).alias(f"__ref_{m}") for m in metrics],
    )
    return marked.select(
        *crosstab.columns, "ref_group_value",
        *[ratio_to_reference(F.col(m), F.col(f"__ref_{m}")).alias(f"{m}_disparity") for m in metrics],
    )


def parity_flags(disparity: DataFrame) -> DataFrame:
    """True when a disparity lies in the parity band; blank when it is blank; plus the combined flags."""
    low, high = PARITY_BAND
    out = disparity.select(
        "*", *[F.col(f"{m}_disparity").between(low, high).alias(flag) for flag, m in PARITY_OF.items()]
    )
    for flag, (a, b) in COMBINED_PARITY.items():
        out = out.withColumn(flag, F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a) & F.col(b)))
    return out


def attribute_verdict(flags: DataFrame) -> DataFrame:
    """Per attribute, whether every non-blank value passes."""
    every = [*PARITY_OF, *COMBINED_PARITY]
    return flags.groupBy("attribute_name").agg(*[F.bool_and(c).alias(c) for c in every])
