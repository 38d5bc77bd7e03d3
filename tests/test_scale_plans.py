"""The distributed plans give what plain windows and aggregates give, on skewed data."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelkit.operators import joins, order
from panelkit.operators.joins import group_join, lookup_join
from panelkit.operators.metrics import flag_top, metrics_at_k, pr_curve, roc_auc
from panelkit.operators.order import (
    assign_ranks,
    assign_tiles,
    exact_quantiles,
    running_totals,
    sample_entities,
    top_share,
)
from panelkit.operators.labels import top_tile_labels
from panelkit.operators.panel import densify, trailing_mean
from panelkit.operators.profile import box_stats, correlation_pairs, correlation_with, histogram
from panelkit.session import materialise


def nulls_first():
    return [F.col("x").desc_nulls_first(), F.col("id")]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds two thirds of the rows; values are tied and sometimes null; one group key is null."""
    rng = random.Random(4)
    data = []
    for i in range(3000):
        g = "hot" if rng.random() < 0.66 else rng.choice(["a", "b", "c", None])
        x = None if rng.random() < 0.05 else float(rng.choice([rng.randint(0, 5), rng.random() * 100]))
        data.append((i, g, x, rng.randint(0, 1)))
    return spark.createDataFrame(data, "id int, g string, x double, y int").repartition(7).cache()


@pytest.fixture(autouse=True)
def small_ranges(monkeypatch):
    """Many ranges, so that every plan here is the one of a large frame."""
    monkeypatch.setattr(order, "RANGE_ROWS", 150)


def test_rank_windows_are_dealt_by_range(spark, skewed):
    """One exchange of the rows by (group, range), and no range holds more than its share."""
    exploded = spark.range(3).select(F.explode(F.sequence(F.lit(1), F.lit(1000))).alias("x"), F.col("id"))
    joined = skewed.join(skewed.select("id", F.col("y").alias("z")), "id")
    for df in (exploded, joined):
        plan = assign_ranks(df, [F.desc("x"), "id"])._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "row_number" in line and "Window" in line]
        assert windows and all("[__at" in line for line in windows)
    ranges = order._Ranges(skewed, nulls_first())
    sizes = [r["count"] for r in skewed.groupBy("g", ranges.of(skewed).alias("r")).count().collect()]
    assert max(sizes) < 500 and len(ranges.bounds) == 19


def test_running_totals_exchange_rows_once(spark, skewed):
    out = running_totals(skewed, ["id"], {"cum": "y"}, "g")
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 2  # one over the rows, one over the subtotals
    executed = out._jdf.queryExecution().executedPlan().toString()
    assert executed.count("hashpartitioning(__at") <= 2  # the rows and their subtotals


def test_ranges_follow_every_direction_and_type(spark):
    rng = random.Random(8)
    data = [(i, rng.choice(["a", "b", None, "é"]), rng.choice([None, float("nan"), -0.0, 0.0, 1.5, float("-inf")]), rng.random() < 0.5)
            for i in range(900)]
    df = spark.createDataFrame(data, "id int, s string, x double, b boolean")
    df = df.withColumn("t", F.timestamp_seconds(F.col("id") % 97)).withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id") % 13))
    df = df.withColumn("m", (F.col("id") % 31).cast("decimal(12,2)"))
    for keys in (["s", "id"], [F.desc("s"), "id"], [F.col("s").asc_nulls_last(), F.desc("id")], [F.col("x").desc_nulls_first(), "id"],
                 [F.col("x").asc(), F.col("s").desc(), "id"], [F.desc("t"), "id"], ["d", F.desc("m"), "id"], [F.col("b").desc(), (F.col("id") * 7 % 901).desc()]):
        truth = df.withColumn("r", F.row_number().over(W.orderBy(*keys)).cast("long"))
        assert rows(assign_ranks(df, keys, name="r"), "id", "r") == rows(truth, "id", "r")
        want = sorted(r.id for r in truth.where("r <= 333").collect())
        assert sorted(r.id for r in top_share(df, keys, 0.37).collect()) == want
        assert sorted(r.id for r in order.flag_first(df, keys, 333, "f").where("f = 1").collect()) == want


def test_empty_frames(spark, skewed):
    none = skewed.limit(0)
    assert assign_ranks(none, ["id"], total="n").count() == running_totals(none, ["id"], {"c": "y"}).count() == 0
    assert top_share(none, ["id"], 0.5).count() == flag_top(none, "x", "id", 3).count() == 0
    assert exact_quantiles(none, "x", [0.5], "g").count() == 0
    assert [r.pred for r in flag_top(skewed.limit(2), "x", "id", 0).collect()] == [0, 0]


def test_ranks(spark, skewed):
    w = W.partitionBy("g").orderBy(*nulls_first())
    truth = skewed.withColumn("r", F.row_number().over(w).cast("long")).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("g")))
    assert rows(truth) == rows(assign_ranks(skewed, nulls_first(), "g", "r", "n"))
    truth = skewed.withColumn("r", F.row_number().over(W.orderBy(*nulls_first())).cast("long"))
    assert rows(truth) == rows(assign_ranks(skewed, nulls_first(), name="r"))


@pytest.mark.parametrize("n", [1, 4, 5, 7, 5000])
def test_tiles_match_ntile(spark, skewed, n):
    truth = skewed.withColumn("tile", F.ntile(n).over(W.partitionBy("g").orderBy(*nulls_first())))
    assert rows(truth, "id", "tile") == rows(assign_tiles(skewed, nulls_first(), n, "g"), "id", "tile")


def test_tile_sizes_differ_by_at_most_one(spark, skewed):
    for r in assign_tiles(skewed, ["id"], 5, "g").groupBy("g", "tile").count().groupBy("g").agg(
            (F.max("count") - F.min("count")).alias("d")).collect():
        assert r.d <= 1


def test_running_totals(spark, skewed):
    df = skewed.withColumn("y", F.when(F.col("id") % 3 == 0, F.col("y")))  # nulls, also at the start of partitions
    w = W.partitionBy("g").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    truth = df.withColumn("cum", F.sum("y").over(w))
    assert rows(truth) == rows(running_totals(df, ["id"], {"cum": "y"}, "g"))


PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def test_quantiles(spark, skewed):
    df = skewed.unionByName(spark.createDataFrame([(9000, "none", None, 1)], skewed.schema))
    for by in (["g"], []):
        wide = df.groupBy(*by).agg(*[F.percentile(c, F.array(*map(F.lit, PROBS))).alias(c) for c in ("x", "y")])
        truth = {tuple(r)[:-1]: r.quantiles for r in wide.unpivot(by, ["x", "y"], "variable", "quantiles").collect()}
        got = {tuple(r)[:-1]: r.quantiles for r in exact_quantiles(df, ["x", "y"], PROBS, by).collect()}
        assert truth.keys() == got.keys()
        for key, q in truth.items():
            assert got[key] is None if q is None else q == pytest.approx(got[key])


def test_quantiles_when_a_bracket_misses(spark, skewed, monkeypatch):
    plain = {r.g: r.quantiles for r in exact_quantiles(skewed, "x", [0.1, 0.5], "g").collect()}
    real = order._bracketed_counts

    def miss(*args):
        return real(*args).withColumn("single", F.lit(False))

    monkeypatch.setattr(order, "_bracketed_counts", miss)
    large = {r.g: r.quantiles for r in exact_quantiles(skewed, "x", [0.1, 0.5], "g").collect()}
    assert plain.keys() == large.keys() and all(q == pytest.approx(large[g]) for g, q in plain.items())


def test_brackets_keep_few_values(spark):
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    counts = order._bracketed_counts(df, ["x"], [0.25, 0.5], [])
    assert counts.count() < 2_500 and counts.agg(F.sum("times")).first()[0] == 200_000
    truth = df.agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5)))).first()[0]
    assert exact_quantiles(df, "x", [0.25, 0.5]).first().quantiles == pytest.approx(truth)


def test_top_share(spark, skewed):
    w = W.partitionBy("g").orderBy(F.desc("x"), "id")
    truth = skewed.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("g")))
    truth = truth.where("r <= floor(n * 0.2)").drop("r", "n")
    assert rows(truth) == rows(top_share(skewed, [F.desc("x"), "id"], 0.2, "g"))


def test_auc_of_very_many_rows(spark):
    """Counts whose product is beyond a long."""
    counts = spark.createDataFrame([(0.1, 0, 4 * 10**9), (0.9, 4 * 10**9, 0)], "s double, pos long, neg long")
    import panelkit.operators.metrics as m

    saved, m.score_counts = m.score_counts, lambda *a: counts
    try:
        assert roc_auc(counts, "s", "pos").first().auc == 1.0
    finally:
        m.score_counts = saved


def test_null_groups_are_kept(spark, skewed):
    df = skewed.where("x is not null")
    groups = {r.g for r in df.select("g").distinct().collect()}
    assert None in groups
    assert {r.g for r in box_stats(df, "x", "g").collect()} == groups
    assert {r.g for r in pr_curve(df, "x", "y", "g").select("g").distinct().collect()} == groups
    bins = histogram(df, "x", 7, (0, 100), "g").collect()
    assert len(bins) == 7 * len(groups) and sum(r.n for r in bins) == df.count()


def test_constant_columns_have_no_correlation(spark, skewed):
    df = skewed.withColumn("one", F.lit(1.0))
    got = {(r.a, r.b): r.r for r in correlation_pairs(df, ["x", "one", "y"]).collect()}
    assert len(got) == 3 and sum(v is None for v in got.values()) == 2
    truth = df.agg(F.corr("x", "y")).first()[0]
    assert [v for v in got.values() if v is not None] == [pytest.approx(truth)]
    assert {r.variable: r.r for r in correlation_with(df, ["x", "one"], "y").collect()} == {"x": pytest.approx(truth), "one": None}


def test_flags_put_nan_and_null_last(spark):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, None), (4, 0.9), (5, 0.5)], "id int, s double")
    assert [r.pred for r in flag_top(df, "s", "id", 2).orderBy("id").collect()] == [1, 0, 0, 1, 0]
    assert sum(r.pred for r in flag_top(df, "s", "id", 4).collect()) == 4


def test_recall_grows_with_k(spark, skewed):
    df = skewed.where("x is not null")
    recalls = [r.recall for r in metrics_at_k(df, "x", "y", "id").orderBy("k").collect()]
    assert recalls == sorted(recalls)


def test_salted_lookup_equals_plain_join(spark, skewed):
    lookup = spark.createDataFrame([("hot", 1), ("a", 2), ("z", 3)], "g string, w int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = (lookup_join(skewed, lookup, "g", how, ["id"], salted) for salted in (False, True))
        assert rows(a, *sorted(a.columns)) == rows(b, *sorted(b.columns))
    assert "__salt" in b._jdf.queryExecution().optimizedPlan().toString()
    for how in ("right", "full", "full_outer", "outer"):
        with pytest.raises(ValueError):
            lookup_join(skewed, lookup, "g", how, ["id"], True)


def test_window_form_equals_self_join(spark, skewed):
    df = skewed.where("g is not null").groupBy("g", (F.col("id") % 60).alias("t")).agg(F.avg("x").alias("x"))
    df = df.where("t % 7 <> 3").cache()
    out = trailing_mean(df, "x", 4, "g", "t").select("g", "t", F.round("x_avg_4yr", 9).alias("m"))
    b = df.select(F.col("g").alias("g2"), F.col("t").alias("t2"), F.col("x").alias("x2"))
    joined = df.join(b, (F.col("g") == F.col("g2")) & F.col("t2").between(F.col("t") - 4, F.col("t") - 1), "left")
    truth = joined.groupBy("g", "t").agg(F.round(F.avg("x2"), 9).alias("m"))
    assert rows(out) == rows(truth)


def test_wide_correlations_drop_nulls_by_pair(spark, skewed):
    wide = skewed.select("id", *[
        F.when((F.col("id") + i) % 9 != 0, F.col("x") * i + F.col("id") % (i + 3)).alias(f"c{i}") for i in range(13)])
    columns = [f"c{i}" for i in range(13)]
    got = {(r.a, r.b): r.r for r in correlation_pairs(wide, columns).collect()}
    assert len(got) == 78
    exprs = [F.corr(a, b).alias(f"{a}|{b}") for a, b in list(got)[:20]]
    for key, value in wide.agg(*exprs).first().asDict().items():
        assert got[tuple(key.split("|"))] == pytest.approx(value, abs=1e-9)


def test_correlations_stay_on_the_jvm(spark, skewed, monkeypatch):
    from panelkit.operators import profile

    df = skewed.select("x", "y", (F.col("x") * 2 + F.col("id")).alias("z"), F.lit(3.0).alias("one"), F.col("id").alias("w"))
    plain = correlation_pairs(df, df.columns, full=True)
    assert "Python" not in plain._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(profile, "_PLAIN_PAIRS", 0)
    wide = {(r.a, r.b): r.r for r in correlation_pairs(df, df.columns, full=True).collect()}
    got = {(r.a, r.b): r.r for r in plain.collect()}
    assert got.keys() == wide.keys() and len(got) == 25
    for key, value in got.items():
        assert wide[key] is None if value is None else wide[key] == pytest.approx(value)
    assert all(r.r is None for r in correlation_pairs(df.limit(0), df.columns).collect())


def test_sample_keeps_whole_entities(spark, skewed):
    out = sample_entities(skewed, "g", 2, 9)
    kept = {r.g for r in out.select("g").distinct().collect()}
    assert len(kept) <= 2
    assert out.count() == skewed.where(F.col("g").isin([k for k in kept if k])).count()
    assert rows(out) == rows(sample_entities(skewed.repartition(3), "g", 2, 9))


def test_profile_counts_distincts_exactly_and_by_merged_sketches(spark, skewed):
    from panelkit.operators.profile import dataset_profile, distinct_sketches, merged_distincts

    truth = {c: skewed.select(c).where(F.col(c).isNotNull()).distinct().count() for c in skewed.columns}
    profile = dataset_profile(skewed)
    assert {r.variable: r.distinct for r in profile.collect()} == truth
    # The one that is there turns the single row of results into rows; none stands below an aggregate.
    assert profile._jdf.queryExecution().optimizedPlan().toString().count("Expand [") == 1
    merged = merged_distincts(distinct_sketches(skewed, "g")).collect()
    assert {r.variable for r in merged} == {"id", "x", "y"}
    assert all(abs(r.distinct - truth[r.variable]) <= 0.05 * truth[r.variable] for r in merged)
    approximate = {r.variable: r.distinct for r in dataset_profile(skewed, approximate=True).collect()}
    assert all(abs(approximate[c] - truth[c]) <= max(1, 0.06 * truth[c]) for c in truth)


def test_rows_of_few_groups_stay_where_they_are(spark, skewed, monkeypatch):
    figures = materialise(skewed.groupBy("g").agg(F.max("x").alias("m")))
    few = group_join(skewed, figures, ["g"])
    assert "hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(joins, "FEW_GROUPS", 3)
    many = group_join(skewed, figures, ["g"])
    assert few.count() == 3000 and rows(few) == rows(many)
    seen = []
    monkeypatch.setattr(order, "group_join", lambda *a: seen.append(1) or group_join(*a))
    exact_quantiles(skewed, "x", [0.5], "g")
    assert seen


def test_grids_are_never_broadcast(spark):
    panel = spark.createDataFrame([(i % 40, 2000 + i // 40, i) for i in range(90)], "e int, t int, v int")
    entities = spark.range(40).select(F.col("id").cast("int").alias("e"))
    grid = densify(panel, entities, "e", "t", 2000, 2003)
    assert grid.count() == 160
    known = grid.where(F.col("v").isNotNull())
    assert "BroadcastHashJoin" not in known._jdf.queryExecution().sparkPlan().toString() and known.count() == 90


def test_labels_read_a_stored_panel(spark, skewed):
    """Ranking counts, samples and places the rows of every label, so the work before is done once."""
    done = spark.sparkContext.accumulator(0)

    def slow(v):
        done.add(1)
        return v

    rows_ = skewed.select("id", F.lit(1).alias("t"), F.udf(slow, "int")("y").alias("v"))
    out = top_tile_labels(rows_, "id", "t", {"a": "v"}, "v")
    out.write.format("noop").mode("overwrite").save()
    assert done.value <= 2 * 3000  # the filter and the column may each ask once
