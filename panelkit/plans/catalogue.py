"""Named feature sets, generated from measures and the naming rule of derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Measures, spans and flags that make up the four feature sets.
SLOW_MEASURES = [
    "population", "poverty_rate", "median_gross_rent", "median_household_income", "median_property_value",
    "rent_burden", "pct_white", "pct_af_am", "pct_hispanic", "pct_am_ind", "pct_asian", "pct_nh_pi", "pct_multiple",
    "pct_other", "renter_occupied_households", "pct_renter_occupied",
]
OWN_MEASURES = ["eviction_filings", "evictions", "eviction_rate", "eviction_filing_rate", "conversion_rate"]
COUNTY_MEASURES = ["total_bldg", "total_units", "total_value"]
ECONOMIC_FLAGS = ["div_sa", "div_enc", "urban"]
SLOW_SPANS = [5]
OWN_SPANS = [1, 3, 5]
OWN_MEAN_SPANS = [3, 5]
COUNTY_MEAN_SPANS = [3, 5]
COUNTY_CHANGE_SPANS = [1, 3, 5]
# Derived columns the published lists leave out.
LEFT_OUT = ["conversion_rate_avg_3yr_lag", "conversion_rate_avg_3yr_lag_tr"]


def derived(measures: list[str], mean_spans: list[int], change_spans: list[int], suffix: str = "") -> list[str]:
    """Measures, then their means and changes by span, each with the suffix."""
    out = list(measures)
    out += [f"{c}_avg_{n}yr" for n in mean_spans for c in measures]
    out += [f"{c}_pct_change_{n}yr" for n in change_spans for c in measures]
    return [c + suffix for c in out if c + suffix not in LEFT_OUT]


def feature_sets() -> dict[str, list[str]]:
    slow = derived(SLOW_MEASURES, SLOW_SPANS, SLOW_SPANS)
    own = derived(OWN_MEASURES, OWN_MEAN_SPANS, OWN_SPANS)
    return {
        "demographic": slow + ["avg_hh_size"],
        "economic": derived(COUNTY_MEASURES, COUNTY_MEAN_SPANS, COUNTY_CHANGE_SPANS) + ECONOMIC_FLAGS,
        "eviction": [c + "_lag" for c in own if c + "_lag" not in LEFT_OUT],
        "tract": [c + "_tr" for c in slow] + [c + "_lag_tr" for c in own if c + "_lag_tr" not in LEFT_OUT],
    }


def subset_table(sets: DataFrame) -> DataFrame:
    """All non-empty subsets of named sets.

    `sets` has (position, name, features) with one row per set; 2^n subsets keep n small by nature.
    """
    packed = sets.agg(F.sort_array(F.collect_list(F.struct("position", "name", "features"))).alias("sets"))
    masks = packed.select("sets", F.expr("explode(sequence(1, shiftleft(1, size(sets)) - 1))").alias("subset"))
    chosen = F.expr("filter(sets, (s, i) -> (subset & shiftleft(1, i)) <> 0)")
    return masks.select(
        "subset", F.transform(chosen, lambda s: s["name"]).alias("labels"),
        F.flatten(F.transform(chosen, lambda s: s["features"])).alias("features"),
    )


def subsets(sets: dict[str, list[str]]) -> list[dict]:
    """The same subsets for driving model runs."""
    keys = list(sets)
    out = []
    for mask in range(1, 2 ** len(keys)):
        labels = [k for i, k in enumerate(keys) if mask >> i & 1]
        out.append({"labels": labels, "features": [c for k in labels for c in sets[k]]})
    return out
