"""The full panel on a small made-up geography, and the file sources."""

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.plans.build import build_panel, build_periods, extend_panel
from panelkit.plans.catalogue import feature_sets
from panelkit.session import checkpoint_dir, scratch_path
from panelkit.sources.files import (
    HOUSEHOLD_SCHEMA,
    PANEL_MEASURES,
    PANEL_SCHEMA,
    PERMIT_SCHEMA,
    URBAN_SCHEMA,
    column_for_years,
    read_csv,
    read_csv_tree,
    read_feature_sets,
    read_yearly,
    replace_table,
    snapshot,
    stack,
    write_csv,
)

GROUPS = ["170310101001", "170310101002", "180010301001", "060010101001"]
YEARS = range(2000, 2008)


def _panel(spark, codes):
    data = []
    for i, code in enumerate(codes):
        for year in YEARS:
            if i == 1 and year == 2003:
                continue
            values = [float((i + 1) * (year - 1999) + j) for j in range(len(PANEL_MEASURES))]
            values[PANEL_MEASURES.index("evictions")] = 0.0 if year == 2000 else float(10 * i + year - 2000)
            data.append((code, year, "n", "p", *values, False, False, False))
    return spark.createDataFrame(data, PANEL_SCHEMA)


def _inputs(spark):
    tracts = _panel(spark, sorted({c[:11] for c in GROUPS}))
    permits = spark.createDataFrame(
        [(y, "17", "031", "2", "3", 5 * (y - 1999), 7, 9.0, "17031") for y in YEARS], PERMIT_SCHEMA)
    homes = spark.createDataFrame(
        [(2004, GROUPS[0], 2.5), (2002, GROUPS[0], 2.0), (1999, GROUPS[0], 1.0), (2004, GROUPS[1], 3.5), (2007, GROUPS[0], 4.0)], HOUSEHOLD_SCHEMA)
    urban = spark.createDataFrame([(1, 17, 31, 17031)], URBAN_SCHEMA)
    return _panel(spark, GROUPS), tracts, permits, homes, urban


@pytest.fixture(scope="module")
def built(spark):
    return build_panel(*_inputs(spark)).cache()


def test_panel_has_every_catalogued_feature(built):
    wanted = {c for columns in feature_sets().values() for c in columns}
    assert wanted <= set(built.columns)
    assert {"top20_num", "top20_rate", "e_num_inc_20pct", "top20_num_lag", "e_num_inc_20pct_lag"} <= set(built.columns)


def test_panel_rows_and_states(built):
    assert built.count() == 3 * 8 - 1 == built.select("geo_id", "year").distinct().count()
    assert {r.state for r in built.select("state").distinct().collect()} == {"17", "18"}


def test_panel_values(built):
    r = built.where(f"geo_id = '{GROUPS[0]}' and year = 2004").first()
    assert (r.avg_hh_size, r.urban, r.div_enc, r.div_sa, r.total_bldg) == (2.5, 1, 1, 0, 25)
    assert r.evictions_lag == 3.0 and r.population_tr is not None and r.evictions_lag_tr is None
    late = built.where(f"geo_id = '{GROUPS[0]}' and year = 2006").first()
    assert late.evictions_lag_tr == 15.0
    assert r.evictions_avg_3yr_lag == pytest.approx((0 + 1 + 2) / 3)
    assert r.total_bldg_avg_3yr == pytest.approx((10 + 15 + 20) / 3)
    gap = built.where(f"geo_id = '{GROUPS[1]}' and year = 2004").first()
    assert gap.evictions_lag is None and gap.top20_num_lag is None and gap.e_num_inc_20pct is None
    outside = built.where(f"geo_id = '{GROUPS[2]}' and year = 2004").first()
    assert (outside.urban, outside.total_bldg) == (0, None)


def test_panel_sentinels_and_increase(built):
    # 2001 rises from zero: the label counts it, and the lagged change of 2002 has only sentinels to keep.
    r = built.where(f"geo_id = '{GROUPS[0]}' and year = 2001").first()
    assert r.e_num_inc_20pct == 1
    assert built.where("year = 2002").select(F.max("evictions_pct_change_1yr_lag")).first()[0] == 999999.0
    assert built.where("year > 2003").where("evictions_pct_change_1yr_lag = 999999").count() == 0


def test_panel_label_share(built):
    for r in built.groupBy("year").agg(F.sum("top20_num").alias("top"), F.count("*").alias("n")).collect():
        assert r.top == -(-r.n // 5)


def test_household_features_and_moves(built):
    r = {y: built.where(f"geo_id = '{GROUPS[0]}' and year = {y}").first() for y in (2004, 2007)}
    assert (r[2004].avg_hh_size_tr, r[2007].avg_hh_size_tr) == (3.0, 4.0)
    assert r[2007].avg_hh_size_avg_5yr == pytest.approx((2.0 + 2.5) / 2) and r[2007].avg_hh_size_pct_change_5yr == pytest.approx(100.0)
    assert r[2007].avg_hh_size_avg_5yr_tr == pytest.approx((2.0 + 3.0) / 2)
    moves = built.where("top20_num_lag is not null").select((F.col("top20_num") - F.col("top20_num_lag")).alias("d"), "top20_num_01", "top20_num_10")
    assert all((m.top20_num_01, m.top20_num_10) == (int(m.d == 1), int(m.d == -1)) for m in moves.collect())
    assert built.where("top20_num_lag is null and top20_num_01 is not null").count() == 0


def test_incremental_builds_equal_the_whole_one(spark, built):
    inputs = _inputs(spark)
    columns = sorted(built.columns)
    part = build_periods(*inputs, 2005)
    assert rows(part, *columns) == rows(built.where("year > 2005"), *columns)
    path = scratch_path(spark, "panel")
    early = [df.where("year <= 2003") for df in inputs[:4]]
    extend_panel(path, *early, inputs[4])
    assert extend_panel(path, *inputs).count() == built.count()
    stored = extend_panel(path, *inputs)  # nothing new
    assert rows(stored, *columns) == rows(built, *columns)


def test_csv_sources(spark):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'q"t', 2.5)], "k int, s string, x double")
    path = scratch_path(spark, "csv")
    write_csv(df, path)
    assert rows(read_csv(spark, path, df.schema)) == rows(df)
    assert dict(read_csv(spark, path, columns=["k", "x"]).dtypes) == {"k": "int", "x": "double"}


def test_csv_tree_keeps_first_rows_and_skips(spark):
    base = scratch_path(spark, "tree")
    schema = T.StructType([T.StructField("k", T.IntegerType())])
    for state in ("IL", "IN", "US"):
        write_csv(spark.createDataFrame([(len(state),), (7,)], schema).coalesce(1), f"{base}/{state}/block-groups.csv")
        write_csv(spark.createDataFrame([(99,)], schema), f"{base}/{state}/tracts.csv")
    out = read_csv_tree(spark, base, schema, "state", r"/([A-Z]{2})/[^/]*csv", "block-groups", ["US"])
    assert rows(out) == [("IL", 2), ("IL", 7), ("IN", 2), ("IN", 7)]


def test_yearly_stack_and_catalogue(spark):
    base = scratch_path(spark, "years")
    for y in (2000, 2001):
        write_csv(spark.createDataFrame([(y,)], "year int"), f"{base}/{y}")
    assert rows(read_yearly(spark, [f"{base}/2000", f"{base}/2001"], "year int")) == [(2000,), (2001,)]
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    assert rows(stack([a, b])) == [(1, None), (2, 3)]
    path = scratch_path(spark, "json")
    spark.createDataFrame([(["p", "q"], ["r"])], "one array<string>, two array<string>").coalesce(1).write.json(path)
    assert rows(read_feature_sets(spark, path)) == [("one", 0, "p"), ("one", 1, "q"), ("two", 0, "r")]


def test_replace_and_prune(spark):
    path = scratch_path(spark, "table")
    df = spark.createDataFrame([(1, 2000), (2, 2001)], "x int, year int")
    replace_table(df, path, ["year"])
    replace_table(df.where("x = 2"), path, ["year"])
    stored = spark.read.parquet(path)
    assert rows(stored, "x", "year") == [(2, 2001)]
    assert rows(column_for_years(stored, "x", 2001)) == [(2,)] and rows(column_for_years(stored, "x", 1999, 2001)) == [(2,)]
    plan = column_for_years(stored, "x", 2001)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [year" in plan
    assert snapshot(df, scratch_path(spark, "snap"), ["x"]).columns == ["x"]


def test_shared_folder_comes_from_the_session(spark):
    assert scratch_path(spark, "a").startswith(checkpoint_dir(spark))
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured.rstrip("/") in checkpoint_dir(spark)
