"""The full panel: keys, features, lags, parent and county attributes, labels, in one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.functions.scalars import SAMPLE_STATES, conversion_rate, division_flags, prefix_keys
from panelkit.operators.joins import lookup_join, membership_flag
from panelkit.operators.labels import increase_label, lagged_labels, top_tile_labels
from panelkit.operators.panel import feature_batch, lag_bundle, sentinel_repair
from panelkit.plans.catalogue import (
    COUNTY_CHANGE_SPANS,
    COUNTY_MEASURES,
    COUNTY_MEAN_SPANS,
    OWN_MEAN_SPANS,
    OWN_MEASURES,
    OWN_SPANS,
    SLOW_MEASURES,
    SLOW_SPANS,
    derived,
)
from panelkit.session import materialise

OWN_DERIVED = derived(OWN_MEASURES, OWN_MEAN_SPANS, OWN_SPANS)
SLOW_DERIVED = derived(SLOW_MEASURES, SLOW_SPANS, SLOW_SPANS)
COUNTY_DERIVED = derived(COUNTY_MEASURES, COUNTY_MEAN_SPANS, COUNTY_CHANGE_SPANS)


# Household size is joined to both levels and gets the spans of the slow measures.
HOME = "avg_hh_size"
HOME_DERIVED = derived([HOME], SLOW_SPANS, SLOW_SPANS)
# A feature looks back its own span and, lagged, one period more.
LOOK_BACK = max(OWN_SPANS + SLOW_SPANS + COUNTY_CHANGE_SPANS) + 1

SENTINEL_COLUMNS = (
    [f"{c}_pct_change_{n}yr{tail}" for c in [*SLOW_MEASURES, HOME] for n in SLOW_SPANS for tail in ("", "_tr")]
    + [f"{c}_pct_change_{n}yr{tail}" for c in OWN_MEASURES for n in OWN_SPANS for tail in ("_lag", "_lag_tr")]
    + [f"{c}_pct_change_{n}yr" for c in COUNTY_MEASURES for n in COUNTY_CHANGE_SPANS]
)


def level_features(level: DataFrame) -> DataFrame:
    """Rates, trailing means and changes of one geographic level."""
    rated = level.withColumn("conversion_rate", conversion_rate("evictions", "eviction_filings"))
    return feature_batch(rated, "geo_id", "year", [
        (OWN_MEASURES, OWN_SPANS, OWN_SPANS), ([*SLOW_MEASURES, HOME], SLOW_SPANS, SLOW_SPANS),
    ])


def build_labels(keyed: DataFrame) -> DataFrame:
    """Top-quintile and large-increase labels with their lags, and moves into and out of the top quintile.

    The increase label reads the unrepaired change, so a rise from zero counts as an increase.
    """
    raised = feature_batch(keyed.select("geo_id", "year", "evictions"), "geo_id", "year", [(["evictions"], [], [1])])
    raised = increase_label(raised, "evictions_pct_change_1yr", "e_num_inc_20pct")
    ranked = top_tile_labels(keyed, "geo_id", "year", {"top20_num": "evictions", "top20_rate": "eviction_rate"},
                             "evictions")
    labels = ranked.join(raised.select("geo_id", "year", "e_num_inc_20pct"), ["geo_id", "year"])
    labels = lagged_labels(labels, ["top20_num", "top20_rate", "e_num_inc_20pct"], "geo_id", "year")
    # Null where there was no label the year before.
    moves = {f"{c}_{name}": (F.col(c) - F.col(f"{c}_lag") == step).cast("int")
             for c in ("top20_num", "top20_rate") for name, step in (("01", 1), ("10", -1))}
    return labels.withColumns(moves)


def build_panel(
    groups: DataFrame, tracts: DataFrame, permits: DataFrame, households: DataFrame, urban: DataFrame,
    states: Sequence[str] = SAMPLE_STATES,
) -> DataFrame:
    """The modelling table: one row per block group and year with every catalogued feature and label.

    Attributes keyed like the panel, then parents, then counties are joined while the rows are still
    narrow; the entity windows come last, on one shuffle. Same-year and prior-year parent columns
    are put side by side on the (smaller) parent level first, so the panel is joined to it once.
    Sentinels are repaired at the end, over all change columns in one aggregation; the panel is
    written to reliable storage before that second pass.
    """
    keyed = groups.select("*", *prefix_keys("geo_id")).where(F.col("state").isin(list(states)))
    homes = households.select("geo_id", "year", F.col("avg_size").alias(HOME))
    out = keyed.join(homes, ["geo_id", "year"], "left")
    out = out.join(build_labels(keyed), ["geo_id", "year"], "left")

    # The household size of a tract is the mean over its block groups.
    tract_homes = homes.groupBy(F.substring("geo_id", 1, 11).alias("geo_id"), "year").agg(F.avg(HOME).alias(HOME))
    upper = level_features(tracts.join(tract_homes, ["geo_id", "year"], "left")).withColumnRenamed("geo_id", "tract")
    same_year = upper.selectExpr("tract", "year", *[f"`{c}` AS `{c}_tr`" for c in [*SLOW_DERIVED, *HOME_DERIVED]])
    year_before = upper.selectExpr("tract", "year + 1 AS year", *[f"`{c}` AS `{c}_lag_tr`" for c in OWN_DERIVED])
    parents = same_year.join(year_before, ["tract", "year"], "full")
    out = lookup_join(out, parents, ["tract", "year"], "left", ["geo_id"])

    county = feature_batch(permits.select("geo_id", "year", *COUNTY_MEASURES), "geo_id", "year",
                           [(COUNTY_MEASURES, COUNTY_CHANGE_SPANS, COUNTY_CHANGE_SPANS)])
    county = county.select(F.col("geo_id").alias("county"), "year", *COUNTY_DERIVED)
    out = lookup_join(out, county, ["county", "year"], "left", ["geo_id"])
    members = urban.select(F.lpad(F.col("GEOID").cast("string"), 5, "0").alias("county"))
    out = membership_flag(out, members, "county", "urban", ["geo_id", "year"])
    out = out.select("*", *division_flags("state"))

    out = lag_bundle(level_features(out), OWN_DERIVED, "geo_id", "year")
    # Unlabelled rows fed the windows; only labelled rows are modelled.
    out = out.where(F.col("top20_num").isNotNull())
    return sentinel_repair(materialise(out), SENTINEL_COLUMNS, "year")


def build_periods(
    groups: DataFrame, tracts: DataFrame, permits: DataFrame, households: DataFrame, urban: DataFrame, after: int,
    states: Sequence[str] = SAMPLE_STATES,
) -> DataFrame:
    """The rows of `build_panel` for the periods after a watermark, from the inputs that these can look back to.

    Means, changes and labels of a period need at most LOOK_BACK periods before it, and sentinels are
    repaired within a period, so the rows equal those of the whole build.
    """
    recent = [df.where(F.col("year") > after - LOOK_BACK) for df in (groups, tracts, permits, households)]
    return build_panel(*recent, urban, states).where(F.col("year") > after)


def extend_panel(
    path: str, groups: DataFrame, tracts: DataFrame, permits: DataFrame, households: DataFrame, urban: DataFrame,
    states: Sequence[str] = SAMPLE_STATES,
) -> DataFrame:
    """Append the periods that a stored panel does not have yet, and return the whole of it.

    The panel is partitioned by year; its latest one is the watermark. A first call stores all periods.
    """
    spark = groups.sparkSession
    try:
        after = spark.read.parquet(path).agg(F.max("year")).first()[0]
    except AnalysisException:  # nothing is stored yet
        after = None
    inputs = (groups, tracts, permits, households, urban)
    new = build_panel(*inputs, states) if after is None else build_periods(*inputs, after, states)
    new.write.mode("append").partitionBy("year").parquet(path)
    return spark.read.parquet(path)
