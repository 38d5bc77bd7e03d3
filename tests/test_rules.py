"""Each rule on a hand-made input."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from panelkit.functions.scalars import (
    capped_ratio,
    category_of,
    code_slices,
    conversion_rate,
    conversion_rate_or_zero,
    finite_or_null,
    padded_key,
    prefix_keys,
    shift_date,
    to_number,
    year_in_date_text,
)
from panelkit.operators.clean import (
    bin_edges,
    drop_subheaders,
    dummies,
    equal_width_bins,
    fill_mean,
    fill_median,
    given_bins,
    min_max_scale,
    null_columns,
    quantile_bins,
)
from panelkit.operators.fairness import (
    COMBINED_PARITY,
    PARITY_OF,
    attribute_verdict,
    disparities,
    group_crosstab,
    parity_flags,
    ratio_to_reference,
)
from panelkit.operators.joins import membership_flag, update_join
from panelkit.operators.labels import increase_label, tile_discretise, top_tile_labels, transition_label
from panelkit.operators.metrics import confusion_counts, flag_top, metrics_at_k, roc_auc
from panelkit.operators.order import assign_tiles
from panelkit.operators.panel import (
    carry_forward,
    lag_bundle,
    parent_mean,
    pct_change,
    sentinel_repair,
    trailing_mean,
)
from panelkit.operators.profile import box_stats, dataset_profile, histogram, null_share
from panelkit.plans.catalogue import feature_sets, subset_table, subsets
from panelkit.plans.models import GRIDS, parameter_grid
from panelkit.plans.splits import rolling_splits, split_counts, tag_splits


def panel(spark, data, schema="g string, year int, x double"):
    return spark.createDataFrame(data, schema)


def test_trailing_mean_skips_missing_years(spark):
    out = trailing_mean(panel(spark, [("a", 2000, 1.0), ("a", 2001, 2.0), ("a", 2004, 4.0)]), "x", 3, "g", "year")
    assert rows(out, "year", "x_avg_3yr") == [(2000, None), (2001, 1.0), (2004, 2.0)]


@pytest.mark.parametrize("before, now, expected", [
    (0.0, 0.0, 0.0), (0.0, 3.0, 999999.0), (0.0, -3.0, -999999.0), (4.0, 5.0, 25.0), (None, 5.0, None), (5.0, None, None),
    (0.0, None, None),
])
def test_change_rules(spark, before, now, expected):
    out = pct_change(panel(spark, [("a", 2000, before), ("a", 2001, now)]), "x", 1, "g", "year")
    assert rows(out, "year", "x_pct_change_1yr") == [(2000, None), (2001, expected)]


def test_change_needs_the_exact_year(spark):
    out = pct_change(panel(spark, [("a", 2000, 5.0), ("a", 2002, 10.0)]), "x", 1, "g", "year")
    assert rows(out, "year", "x_pct_change_1yr") == [(2000, None), (2002, None)]


def test_lag_needs_the_exact_year(spark):
    out = lag_bundle(panel(spark, [("a", 2000, 5.0), ("a", 2002, 10.0), ("a", 2003, 1.0)]), ["x"], "g", "year")
    assert rows(out, "year", "x_lag") == [(2000, None), (2002, None), (2003, 10.0)]


def test_sentinel_repair(spark):
    data = [("a", 1, 999999.0), ("b", 1, 40.0), ("c", 1, -999999.0), ("d", 1, None), ("a", 2, 999999.0)]
    out = sentinel_repair(panel(spark, data), "x", "year")
    assert rows(out, "g", "year", "x") == [
        ("a", 1, 40.0), ("a", 2, 999999.0), ("b", 1, 40.0), ("c", 1, -999999.0), ("d", 1, None)]


def test_tile_sizes_and_label(spark):
    data = [(f"e{i}", 2000, float(i)) for i in range(1, 8)]
    tiles = assign_tiles(panel(spark, data), [F.desc("x"), "g"], 5, "year")
    assert rows(tiles.groupBy("tile").count()) == [(1, 2), (2, 2), (3, 1), (4, 1), (5, 1)]
    out = top_tile_labels(panel(spark, data), "g", "year", {"top": "x"}, "x")
    assert [r[0] for r in rows(out.where("top = 1"), "g")] == ["e6", "e7"]


def test_null_rate_ranks_first_and_null_count_has_no_label(spark):
    data = [("a", 1, 1.0, None), ("b", 1, 1.0, 3.0), ("c", 1, 1.0, 2.0), ("d", 1, 1.0, 1.0), ("e", 1, 1.0, 0.0), ("f", 1, None, 9.0)]
    df = panel(spark, data, "g string, year int, n double, rate double")
    out = top_tile_labels(df, "g", "year", {"top": "rate"}, "n")
    assert rows(out, "g", "top") == [("a", 1), ("b", 0), ("c", 0), ("d", 0), ("e", 0)]


def test_label_span_end_is_exclusive(spark):
    data = [("a", y, 1.0) for y in (1999, 2000, 2001, 2002)]
    out = top_tile_labels(panel(spark, data), "g", "year", {"top": "x"}, "x", first=2000, end=2002)
    assert [r[0] for r in rows(out, "year")] == [2000, 2001]


def test_transitions(spark):
    df = panel(spark, [("a", 1, 0.0), ("a", 2, 1.0), ("a", 3, 1.0), ("a", 4, 0.0)]).withColumn("x", F.col("x").cast("int"))
    assert rows(transition_label(df, "x", "t", "g", "year"), "year", "t") == [(2, 1), (3, 0), (4, 0)]
    assert rows(transition_label(df, "x", "t", "g", "year", up=False), "year", "t") == [(2, 0), (3, 0), (4, 1)]


def test_transition_with_null_before_is_zero(spark):
    df = panel(spark, [("a", 1, None), ("a", 2, 1.0)])
    assert rows(transition_label(df, "x", "t", "g", "year"), "year", "t") == [(2, 0)]


def test_increase_label(spark):
    df = panel(spark, [("a", 1, 20.0), ("b", 1, 20.5), ("c", 1, 999999.0), ("d", 1, None)])
    assert rows(increase_label(df, "x", "y"), "g", "y") == [("a", 0), ("b", 1), ("c", 1), ("d", None)]


def test_tile_discretise(spark):
    df = panel(spark, [(f"e{i}", 2000, float(i)) for i in range(8)] + [("z", 1999, 100.0)])
    out = tile_discretise(df, "x", "g", "year", 2000)
    assert rows(out, "g", "x_4tiles")[0] == ("e0", 4) and out.count() == 8


def test_ratios(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (1.0, None)], "a double, b double")
    assert rows(df.select(conversion_rate("a", "b").alias("r"))) == [(0.0,), (0.5,), (None,)]
    assert rows(df.select(conversion_rate_or_zero("a", "b").alias("r"))) == [(0.0,), (0.0,), (0.5,)]
    df = spark.createDataFrame([(1, 9.0, 1.0), (2, 5.0, 0.0), (3, 0.0, 0.0), (4, 3.0, 2.0), (5, None, 2.0)], "i int, a double, b double")
    assert rows(df.select("i", capped_ratio("a", "b", 7).alias("r"))) == [(1, 7.0), (2, 7.0), (3, None), (4, 1.5), (5, None)]


def test_text_and_keys(spark):
    df = spark.createDataFrame([("G17003100101001", "(datetime.datetime(2016, 1, 1, 0, 0), datetime.datetime(2017, 1, 1, 0, 0))", "x1", 17)],
                               "j string, t string, n string, k int")
    out = df.select(
        code_slices("j", [(1, 3), (4, 7), (8, 15)]).alias("c"), year_in_date_text("t").alias("y"),
        to_number("n").alias("n"), padded_key("k", 5).alias("k")).first()
    assert tuple(out) == ("170310101001", "2016", None, "00017")
    keys = spark.createDataFrame([("170310101001",)], "c string").select(*prefix_keys("c")).first()
    assert tuple(keys) == ("17", "17031", "17031010100")


def test_values_and_categories(spark):
    df = spark.createDataFrame([(1, float("inf")), (2, float("nan")), (3, 1.5), (4, None)], "i int, x double")
    assert rows(df.select("i", finite_or_null("x").alias("x"))) == [(1, None), (2, None), (3, 1.5), (4, None)]
    df = spark.createDataFrame([("NY",), ("PR",)], "s string")
    assert rows(df.select("s", category_of("s", {"Mid-Atlantic": ["NJ", "NY", "PA"]}).alias("r"))) == [("NY", "Mid-Atlantic"), ("PR", None)]
    day = spark.createDataFrame([(dt.date(2006, 1, 31),)], "d date")
    assert day.select(shift_date("d", 1, -1)).first()[0] == dt.date(2006, 2, 27)


def test_parent_mean(spark):
    df = panel(spark, [("p", 2000, 2.0), ("p", 2000, 4.0), ("q", 2000, 1.0)])
    assert rows(parent_mean(df, "g", "year", ["x"])) == [("p", 2000, 3.0), ("q", 2000, 1.0)]


def test_carry_forward_covers_each_year_once(spark):
    df = spark.createDataFrame([("k", v) for v in ("c2000", "s2006", "c2010", "s2011")], "k string, vintage string")
    spans = {"c2000": (2000, 2005), "s2006": (2006, 2009), "c2010": (2010, 2010), "s2011": (2011, 2016)}
    out = carry_forward(df, "vintage", spans, "year")
    assert [r[0] for r in rows(out, "year")] == list(range(2000, 2017))


def test_update_join_keeps_unmatched_and_writes_null(spark):
    target = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    source = spark.createDataFrame([(1, 11), (2, None)], "k int, w int")
    assert rows(update_join(target, source, "k", {"v": "w"})) == [(1, 11), (2, None), (3, 30)]


def test_membership_flag(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    listed = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(membership_flag(df, listed, "k", "urban")) == [("a", 1), ("b", 0)]


def test_bins(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(5)], "x double, c double")
    out = equal_width_bins(df, ["x", "c"], 4)
    assert rows(out, "x", "x_bins") == [(0.0, 0), (1.0, 0), (2.0, 1), (3.0, 2), (4.0, 3)]
    assert {r.c_bins for r in out.collect()} == {1}
    named = equal_width_bins(df, "x", 4, ["low", "med-low", "med-high", "high"])
    assert [r[1] for r in rows(named, "x", "x_bins")] == ["low", "low", "med-low", "med-high", "high"]
    assert bin_edges(df, "x", 4).first().edges == [0.0, 1.0, 2.0, 3.0, 4.0]
    given = given_bins(df, "x", [1, 2, 4])
    assert rows(given, "x", "x_bins") == [(0.0, None), (1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)]


def test_quantile_bins(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert rows(quantile_bins(df, "x"), "x", "x_bins") == [(1.0, 0), (10.0, 3), (2.0, 1), (3.0, 2)]
    with pytest.raises(ValueError):
        quantile_bins(df, "x", 3, ["a", "b"])


def test_fills(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    assert (2.5,) in rows(fill_median(df, ["x"]))
    assert (4.0,) in rows(fill_mean(df, ["x"]))
    df = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),)], "x double")
    assert rows(fill_median(df, ["x"])) == [(1.0,), (2.0,), (3.0,)]
    other = spark.createDataFrame([(7.0,)], "x double")
    assert (7.0,) in rows(fill_median(df, ["x"], fit_on=other))


def test_null_columns_and_subheaders(spark):
    df = spark.createDataFrame([("1", None), ("code", "x")], "a string, b string")
    assert rows(null_columns(df)) == [("b",)]
    assert rows(drop_subheaders(df, "a"), "a") == [("1",)]


def test_dummies_and_scale(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(dummies(df, "k")) == [("a", 1, 0), ("b", 0, 1), (None, 0, 0)]
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert rows(min_max_scale(df, "x", "s"), "s") == [(0.0,), (1.0,)]
    assert rows(min_max_scale(df, "c", "s"), "s") == [(None,), (None,)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    assert rows(histogram(df, "x", 4), "bin", "n") == [(0, 1), (1, 1), (2, 1), (3, 2)]
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert rows(histogram(flat, "x", 2), "bin", "from_value", "n") == [(0, 1.5, 0), (1, 2.0, 2)]


def test_box_and_null_share(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("a", None)], "g string, x double")
    r = box_stats(df, "x", "g").first()
    assert (r.n, r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers) == (5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)
    df = df.unionByName(spark.createDataFrame([("b", 1.0)], "g string, x double"))
    assert rows(null_share(df, "x", "g"), "g", "count_nulls", "count_all") == [("a", 1, 6), ("b", None, 1)]
    profile = dataset_profile(df).where("variable = 'x'").first()
    assert (profile.nulls, profile.distinct, profile.max) == (1, 5, 100.0)


def test_splits():
    splits = rolling_splits(dt.date(2006, 1, 1), dt.date(2017, 1, 1), 12)
    assert [s.test_start.year for s in splits] == list(range(2007, 2017))
    assert splits[0].train_end == dt.date(2006, 12, 31) and splits[-1].test_end == dt.date(2016, 12, 31)
    (last,) = rolling_splits(dt.date(2006, 1, 1), dt.date(2017, 1, 1), 12, latest=True)
    assert (last.train_end, last.test_start, last.test_end) == (dt.date(2015, 12, 31), dt.date(2016, 1, 1), dt.date(2016, 12, 31))


def test_split_rows_and_counts(spark):
    splits = rolling_splits(dt.date(2000, 1, 1), dt.date(2003, 1, 1), 12)
    df = spark.createDataFrame([(dt.date(y, 1, 1), y % 2) for y in (2000, 2001, 2002)], "d date, y int")
    assert rows(tag_splits(df, "d", splits).select("split", "role")) == [
        (0, "test"), (0, "train"), (1, "test"), (1, "train"), (1, "train")]
    assert rows(split_counts(df, "d", "y", splits), "split", "role", "n", "pos") == [
        (0, "test", 1, 1), (0, "train", 1, 0), (1, "test", 1, 0), (1, "train", 2, 1)]


def test_feature_sets_and_subsets(spark):
    sets = feature_sets()
    assert {k: len(v) for k, v in sets.items()} == {"demographic": 49, "economic": 21, "eviction": 29, "tract": 77}
    assert len(subsets(sets)) == 15
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(sets.items())], "position int, name string, features array<string>")
    found = {tuple(r.labels): len(r.features) for r in subset_table(df).collect()}
    assert found == {tuple(s["labels"]): len(s["features"]) for s in subsets(sets)}


def test_grids():
    assert len(parameter_grid(GRIDS["RF"][1])) == 24 and parameter_grid(GRIDS["NB"][0]) == [{}]
    assert len(parameter_grid(GRIDS["LR"][1])) == 10 and len(parameter_grid(GRIDS["BAG"][1])) == 8


def test_cutoff_arithmetic(spark):
    n = 6762
    df = spark.range(n).select("id", (n - F.col("id")).alias("score"), (F.col("id") < 65).cast("int").alias("label"))
    r = metrics_at_k(df, "score", "label", "id", [1]).first()
    assert (r.cutoff, r.hits) == (67, 65) and abs(r.precision - 0.9701492537313433) < 1e-12
    few = df.where("id < 50")
    assert metrics_at_k(few, "score", "label", "id", [1]).first().precision == 0.0


def test_auc_and_confusion(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 1), (3, 0.5, 0), (4, 0.1, 0)], "id int, score double, label int")
    assert roc_auc(df, "score", "label").first().auc == 0.875
    one = df.where("label = 1")
    assert roc_auc(one, "score", "label").first().auc is None
    r = confusion_counts(df.withColumn("p", (F.col("score") > 0.4).cast("int")), "label", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy) == (2, 1, 0, 1, 0.75)


def test_flag_top_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.0), (3, 5.0), (4, None)], "id int, s double")
    assert rows(flag_top(df, "s", "id", 2), "id", "pred") == [(1, 1), (2, 1), (3, 0), (4, 0)]


def test_fairness_arithmetic(spark):
    # Published values of one audited list: 223 of 1000 flags in a group of 488, and the reference 84 of 3096.
    assert 223 / 488 == pytest.approx(0.4569672131147541) and 0.223 / 0.084 == pytest.approx(2.6547619047619047)
    df = spark.createDataFrame([(0.998, 0.0), (0.0, 0.0), (0.223, 0.084), (None, 0.5)], "x double, r double")
    assert rows(df.select(ratio_to_reference(F.col("x"), F.col("r")).alias("d"))) == [
        (10.0,), (pytest.approx(2.6547619047619047),), (None,), (None,)]


def test_parity_band_and_verdict(spark):
    metrics = list(PARITY_OF.values())
    data = [("a", "u", 0.7544), ("a", "v", 0.9095), ("b", "u", 1.0), ("b", "v", None)]
    df = spark.createDataFrame(data, "attribute_name string, attribute_value string, d double")
    df = df.select("attribute_name", "attribute_value", *[F.col("d").alias(f"{m}_disparity") for m in metrics])
    flags = parity_flags(df)
    assert rows(flags, "attribute_name", "attribute_value", "statistical_parity") == [
        ("a", "u", False), ("a", "v", True), ("b", "u", True), ("b", "v", None)]
    assert set(COMBINED_PARITY) <= set(flags.columns)
    assert rows(attribute_verdict(flags), "attribute_name", "unsupervised_fairness") == [("a", False), ("b", True)]


def test_crosstab_totals_and_reference(spark):
    data = [("x" if i % 3 else "y", None if i % 5 == 0 else "z", i % 2, int(i < 4)) for i in range(20)]
    df = spark.createDataFrame(data, "a string, b string, y int, p int")
    tab = group_crosstab(df, ["a", "b"], "y", "p")
    totals = {(r.attribute_name, r.attribute_value): r for r in tab.collect()}
    assert all(r.k == 4 and r.total_entities == 20 for r in totals.values())
    assert totals["a", "x"].group_size + totals["a", "y"].group_size == 20 and totals["b", "z"].group_size == 16
    out = {(r.attribute_name, r.attribute_value): r for r in disparities(tab, {"a": "x"}).collect()}
    assert out["a", "x"].ppr_disparity == 1.0 and out["b", "z"].ppr_disparity is None
    assert out["a", "y"].ppr_disparity == pytest.approx(totals["a", "y"].ppr / totals["a", "x"].ppr)
