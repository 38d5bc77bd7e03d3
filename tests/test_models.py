"""Neighbours against brute force, model helpers, and the run driver on a small panel."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from helpers import rows
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelkit.operators import neighbours, order
from panelkit.operators.neighbours import cross_validated_accuracy, nearest, visited_share, vote
from panelkit.plans.models import (
    assemble,
    bagging_draws,
    chosen_features,
    class1_score,
    estimator,
    fit_score,
    importance_table,
    random_baseline,
    tree_table,
)
from panelkit.plans.runs import BASELINES, Ledger, plan_frame, plan_runs, run_models, run_phases
from panelkit.plans.splits import hash_folds, hash_split, rolling_splits
from panelkit.plans.trees import node_table, path_sql, score_by_nodes
from panelkit.session import scratch_path


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 6, size=(240, 3)).astype(float)
    y = (x[:, 0] + x[:, 1] > 5).astype(int)
    data = [(i, [float(v) for v in x[i]], int(y[i])) for i in range(240)]
    return spark.createDataFrame(data, "id long, v array<double>, label int").cache(), x, y


@pytest.mark.parametrize("metric, p", [("euclidean", 2.0), ("manhattan", 1.0), ("minkowski", 3.0)])
def test_nearest_is_exact_over_many_blocks(points, metric, p):
    df, x, _ = points
    train, test = df.where("id < 200"), df.where("id >= 200")
    got = nearest(train, test, 5, "id", "v", "label", metric, p, block_rows=23)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    for q in range(200, 240):
        d = (np.abs(x[:200] - x[q]) ** p).sum(axis=1)
        assert found[q] == list(np.lexsort((np.arange(200), np.round(d, 9)))[:5])


def _clustered(spark, n=1500, dims=4, centres=30):
    rng = np.random.default_rng(7)
    x = rng.uniform(-100, 100, (centres, dims))[rng.integers(0, centres, n)] + rng.normal(0, 1, (n, dims))
    x[:60] = x[0]  # one place holds many rows
    return x, spark.createDataFrame([(i, [float(v) for v in x[i]], i % 2) for i in range(n)], "id long, v array<double>, label int").repartition(5)


@pytest.mark.parametrize("metric, p, block_rows", [("euclidean", 2.0, 40), ("manhattan", 1.0, 100_000), ("minkowski", 3.0, 40), ("minkowski", 0.5, 40)])
def test_pruned_search_equals_all_pairs(spark, metric, p, block_rows):
    x, df = _clustered(spark, 700)
    got = nearest(df.where("id >= 100"), df.where("id < 150"), 9, "id", "v", "label", metric, p, block_rows=block_rows)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.distance))
    assert len(found) == 150
    for q in range(150):
        gap = np.abs(x[100:] - x[q])
        d = gap.sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1)) if p == 2 else (gap**p).sum(axis=1) ** (1 / p)
        best = np.lexsort((np.arange(len(d)), d))[:9]
        assert found[q] == [(int(i) + 100, d[i]) for i in best]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_rows_are_sent_once_a_block_where_nothing_can_be_left_out(spark, monkeypatch, metric):
    """Rows without clusters: a query goes to blocks, not to each of their many cells, and the result is that of all pairs."""
    monkeypatch.setattr(neighbours, "_CELL_ROWS", 25)
    x = np.random.default_rng(3).normal(size=(1200, 24)).astype(np.float32)
    x[5], x[7] = 1e6, x[8]  # a far row, and two at one place
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(1200)], "id long, v array<float>, label int").repartition(4)
    shaped = neighbours._shaped(df, "id", "v", "label", None)
    cells, train, test = neighbours._cells_of(shaped, shaped, metric, 2.0, 400)
    home = neighbours._own_cell_search(train, test, 4, cells, False, ["bigint", "bigint"])
    sent = home.agg(F.max(F.size("visits")).alias("most"), F.avg("compared").alias("compared")).first()
    assert len(cells.rows) == 48 and cells.blocks <= 6 and 1 < sent.most <= cells.blocks and sent.compared > 600
    found = {}
    for r in nearest(df, df.where("id < 90"), 4, "id", "v", "label", metric, block_rows=400).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.distance))
    for q in range(90):
        gap = np.abs(x.astype(float) - x[q].astype(float))
        d = gap.sum(axis=1) if metric == "manhattan" else np.sqrt((gap * gap).sum(axis=1))
        assert found[q] == [(int(i), d[i]) for i in np.lexsort((np.arange(1200), d))[:4]]


def test_blocks_shrink_with_the_pairs_and_are_searched_alike(spark, monkeypatch):
    """Rows of one full block are dealt over many groups of bounded size, and columns of small integers lie in one piece."""
    monkeypatch.setattr(neighbours, "_CELL_ROWS", 20)
    monkeypatch.setattr(neighbours, "_LEAST_ROWS", 16)
    x, df = _clustered(spark)
    shaped = neighbours._shaped(df, "id", "v", "label", None)
    cells, _, _ = neighbours._cells_of(shaped, shaped.where("id < 400"), "manhattan", 1.0, None)
    assert cells.block_rows == cells.query_rows == 96 and cells.blocks >= 15
    assert max(cells.query_parts(np.array([400] * cells.blocks))) == 5
    few, _, _ = neighbours._cells_of(shaped.where("id < 40"), shaped.where("id < 40"), "manhattan", 1.0, None)
    assert few.block_rows == 16
    minima = neighbours._Minima(x[:9], x)
    assert minima.left.flags.c_contiguous and minima.right.flags.c_contiguous
    got = nearest(df, df.where("id < 60"), 30, "id", "v", "label", "manhattan", 1.0)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.id, r.distance))
    for q in range(60):
        d = np.abs(x - x[q]).sum(axis=1)
        assert found[q] == [(int(i), d[i]) for i in np.lexsort((np.arange(len(d)), d))[:30]]


def test_few_pairs_are_compared_where_rows_cluster(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_CELL_ROWS", 20)
    _, df = _clustered(spark)
    row = visited_share(df, df.where("id % 10 = 0"), 5, "id", "v").first()
    assert row.all_pairs == 1500 * 150 and row.share < 0.15


def test_neighbours_of_nothing_and_of_rows_without_features(spark):
    schema = "id long, v array<double>, label int"
    some = spark.createDataFrame([(1, [0.0], 1), (2, None, 0), (3, [float("nan")], 0), (4, [1.0], 0)], schema)
    assert nearest(some.limit(0), some, 3, "id", "v", "label").count() == 0
    assert nearest(some, some.limit(0), 3, "id", "v", "label").count() == 0
    got = rows(nearest(some, some, 3, "id", "v", "label"), "query_id", "id", "rank")
    assert got == [(1, 1, 1), (1, 4, 2), (4, 1, 2), (4, 4, 1)]


def test_votes(spark):
    near = spark.createDataFrame(
        [(1, 0, 10, 1, 0.0, 1), (1, 0, 11, 0, 1.0, 2), (1, 0, 12, 0, 1.0, 3), (2, 1, 13, 1, 1.0, 1), (2, 1, 14, 0, 4.0, 2)],
        "query_id long, query_label int, id long, label int, distance double, rank int")
    out = {(r.query_id, r.weights): (r.predicted, r.score) for r in vote(near, [(3, "uniform"), (3, "distance")]).collect()}
    assert out[1, "uniform"][0] == 0 and out[1, "distance"] == (1, 1.0)
    assert out[2, "uniform"][0] == 0 and out[2, "distance"] == (1, pytest.approx(0.8))


def test_cross_validation_never_uses_own_fold(points):
    df, _, _ = points
    folded = hash_folds(df, ["id"], 1, 4)
    near = nearest(folded, folded, 3, "id", "v", "label", fold="fold")
    both = near.join(folded.select(F.col("id"), F.col("fold").alias("a")), "id").join(
        folded.select(F.col("id").alias("query_id"), F.col("fold").alias("b")), "query_id")
    assert both.where("a = b").count() == 0 and both.count() == 240 * 3
    assert cross_validated_accuracy(df, [1, 3], 4, "id", "v", "label").where("accuracy > 0.7").count() == 2


def test_splits_are_repeatable(points):
    df, _, _ = points
    a, b = hash_split(df, ["id"], 3), hash_split(df.repartition(5), ["id"], 3)
    assert rows(a, "id", "part") == rows(b, "id", "part")
    assert 150 < a.where("part = 'train'").count() < 230


@pytest.fixture(scope="module")
def frames(spark, points):
    df, _, _ = points
    wide = df.select("id", "label", *[F.col("v")[i].alias(f"f{i}") for i in range(3)])
    train = assemble(wide.where("id < 200"), ["f0", "f1", "f2"], "label", ["id"])
    return train.cache(), assemble(wide.where("id >= 200"), ["f0", "f1", "f2"], "label", ["id"]).cache()


@pytest.mark.parametrize("key, params", [
    ("RF", {"n_estimators": 10}), ("LR", {"penalty": "l1", "C": 10}), ("NB", {}), ("GB", {"n_estimators": 5}),
    ("DT", {"max_depth": 5}), ("SVM", {"C": 1.0}), ("KNN", {"n_neighbors": 5, "weights": "distance"}),
])
def test_models_learn(frames, key, params):
    train, test = frames
    _, scored = fit_score(key, params, train, test, "id", 200)
    r = scored.agg(F.count("*").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"),
                   F.avg(((F.col("score") > 0.5).cast("int") == F.col("label")).cast("int")).alias("acc")).first()
    assert r.n == 40 and 0 <= r.lo <= r.hi <= 1 and r.acc > 0.7


@pytest.mark.parametrize("key, params", [("RF", {"n_estimators": 5, "max_depth": 12}), ("DT", {"max_depth": 20})])
def test_rows_keep_their_nodes_in_deep_trees(frames, key, params):
    train = frames[0].coalesce(1).cache()
    deep = estimator(key, params, 0, 1)
    assert deep.getCacheNodeIds() and not estimator(key, {"max_depth": 5}, 0, 1).getCacheNodeIds()
    one, other = (m.fit(train).toDebugString.split("\n", 1)[1] for m in (deep, deep.copy({deep.cacheNodeIds: False})))
    assert one == other


def test_bagging(frames):
    train, test = frames
    models, scored = fit_score("BAG", {"n_estimators": 3, "max_samples": 5, "max_features": 2}, train, test, "id", 200)
    assert models.select("tree").distinct().count() == 3
    assert all(r.n <= 2 for r in models.groupBy("tree").agg(F.count_distinct("feature_index").alias("n")).collect())
    assert scored.where("score between 0 and 1").count() == 40


def _brute_tree(rows, chosen):
    """A full tree as nested tuples: every split of every chosen feature is tried."""
    ones = sum(y for _, y in rows)

    def gini(part):
        k = sum(y for _, y in part)
        return 2 * k * (len(part) - k) / len(part)

    splits = []
    if 0 < ones < len(rows):
        for place, f in enumerate(chosen):
            values = sorted({x[f] for x, _ in rows})
            for a, b in zip(values, values[1:]):
                t = (a + b) / 2
                sides = [[r for r in rows if r[0][f] <= t], [r for r in rows if r[0][f] > t]]
                splits.append((round(sum(map(gini, sides)), 9), place, t, f, sides))
    if not splits:
        return ones / len(rows)
    _, _, t, f, sides = min(splits, key=lambda s: s[:3])
    return f, t, _brute_tree(sides[0], chosen), _brute_tree(sides[1], chosen)


def test_bagged_trees_and_scores_equal_brute_force(frames):
    train, test = frames
    trees, rows_, width = 100, 10, 2
    params = {"n_estimators": trees, "max_samples": rows_, "max_features": width}
    nodes, scored = fit_score("BAG", params, train, test, "id", 200, seed=4)
    samples = {}
    for r in bagging_draws(train, "id", trees, rows_, 4).orderBy("draw").collect():
        samples.setdefault(r.tree, []).append((r.v, r.label))
    assert {len(s) for s in samples.values()} == {rows_} and len(samples) == trees
    want = {t: _brute_tree(s, chosen_features(4, t, width, 3)) for t, s in samples.items()}

    def value(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    by = {r.id: r.v for r in test.select("id", vector_to_array("features").alias("v")).collect()}
    for r in scored.collect():
        assert r.score == pytest.approx(sum(value(t, by[r.id]) for t in want.values()) / trees)
    roots = {r.tree: r.feature_index for r in nodes.where("id = 0").collect()}
    assert roots == {t: tree[0] if isinstance(tree, tuple) else None for t, tree in want.items()}


def test_importance_and_tree(spark, frames):
    train, _ = frames
    table = importance_table(spark, estimator("RF", {}, 200).fit(train), ["f0", "f1", "f2"], "RF")
    values = [r.value for r in table.collect()]
    assert values == sorted(values, reverse=True) and sum(values) == pytest.approx(1.0)
    tree = tree_table(spark, estimator("BASELINE_DT", {"max_depth": 2}, 200).fit(train), ["f0", "f1", "f2"])
    root = tree.where("id = 0").first()
    assert root.samples == 200 and sum(root.class_counts) == 200 and root.feature in ("f0", "f1")
    leaves = tree.where("left_child is null")
    assert leaves.agg(F.sum("samples")).first()[0] == 200


@pytest.mark.parametrize("key, params, depth", [
    ("RF", {"n_estimators": 7, "max_depth": 4}, 4), ("GB", {"n_estimators": 4, "max_depth": 3}, 3), ("DT", {"max_depth": 6}, 6),
])
def test_node_tables_score_in_frames_and_in_sql(spark, frames, key, params, depth):
    train, test = frames
    model = estimator(key, params, 200, 3).fit(train)
    nodes = node_table(spark, model, ["f0", "f1", "f2"])
    scored = class1_score(key, model.transform(test), "fitted").withColumn("v", vector_to_array("features"))
    got = score_by_nodes(scored, nodes, "v", depth, key == "GB").select("id", "v", "fitted", "score").collect()
    assert len(got) == 40 and all(r.score == pytest.approx(r.fitted, abs=1e-12) for r in got)
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, f0 DOUBLE, f1 DOUBLE, f2 DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [[r.id, *r.v] for r in got])
    replayed = dict(con.execute(f"SELECT id, {path_sql(nodes, key == 'GB')} FROM t").fetchall())
    assert all(replayed[r.id] == pytest.approx(r.fitted, abs=1e-12) for r in got)
    assert nodes.where("left_child is null").agg(F.sum("samples")).first()[0] > 0


def test_random_baseline_share(spark):
    df = spark.range(4000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    share = random_baseline(df, df, "y", ["id"], 1).agg(F.avg("score")).first()[0]
    assert 0.22 < share < 0.28


@pytest.fixture(scope="module")
def small_panel(spark):
    rng = np.random.default_rng(1)
    data = []
    for g in range(60):
        for year in range(2000, 2005):
            x = float(rng.normal()) + g / 30
            data.append((g, year, x, None if rng.random() < 0.1 else float(rng.normal()), int(x > 1), int(rng.random() < 0.4)))
    return spark.createDataFrame(data, "g int, year int, x double, z double, top int, top_lag int").cache()


def test_plan_counts(spark):
    splits = rolling_splits(dt.date(2000, 1, 1), dt.date(2005, 1, 1), 12)
    sets = [{"labels": ["a"], "features": ["x"]}, {"labels": ["a", "b"], "features": ["x", "z"]}]
    runs = plan_runs(splits, sets, ["top"], ["RF", "NB", *BASELINES], 1)
    assert len(runs) == len(splits) * 2 * (24 + 1 + 2)
    assert plan_frame(spark, runs).count() == len(runs)


def test_run_models_writes_results_and_outputs(spark, small_panel):
    splits = rolling_splits(dt.date(2000, 1, 1), dt.date(2005, 1, 1), 12, latest=True)
    runs = plan_runs(splits, [{"labels": ["a", "b"], "features": ["x", "z"]}], ["top"], ["BASELINE_DT", *BASELINES], 2)
    path = scratch_path(spark, "runs")
    out = run_models(small_panel, runs, "g", "year", output=path, bias_attributes=["x"])
    assert len(out.columns) == 30
    by = {r.model_key: r for r in out.collect()}
    assert by["BASELINE_DT"].auc_roc > 0.9 and by["BASELINE_DT"].p_at_10 == 1.0
    assert by["BASELINE_PRIOR"].parameters == {} and by["BASELINE_RAND"].training_dates.end == dt.date(2003, 12, 31)
    stored = by["BASELINE_DT"].model_result
    assert spark.read.parquet(f"{stored}/tree").count() >= 3
    bias = spark.read.option("header", True).csv(f"{stored}/bias")
    assert set(bias.columns) == {"x_bins", "label_value", "score"} and bias.count() == 60


def test_training_rows_are_spread_over_all_cores(spark, small_panel, monkeypatch):
    import panelkit.plans.runs as module

    seen, real = [], module.fit_score

    def looked_at(key, params, train, *rest):
        seen.append(train.rdd.getNumPartitions())
        return real(key, params, train, *rest)

    monkeypatch.setattr(module, "fit_score", looked_at)
    split = rolling_splits(dt.date(2000, 1, 1), dt.date(2005, 1, 1), 12, latest=True)
    runs = plan_runs(split, [{"labels": ["a"], "features": ["x", "z"]}], ["top"], ["BASELINE_DT"], 0)
    out = run_models(small_panel.coalesce(1), runs, "g", "year").collect()
    assert seen == [spark.sparkContext.defaultParallelism] and out[0].auc_roc is not None


def test_a_stopped_batch_goes_on_from_its_ledger(spark, small_panel, monkeypatch):
    import panelkit.plans.runs as module

    splits = rolling_splits(dt.date(2000, 1, 1), dt.date(2005, 1, 1), 12)
    runs = plan_runs(splits, [{"labels": ["a"], "features": ["x", "z"]}], ["top"], ["NB", *BASELINES], 0)
    path, fitted, real = scratch_path(spark, "ledger"), [], module.score_metrics
    state = {"stop": 4}

    def counted(scored, key):
        fitted.append(1)
        if len(fitted) > state["stop"]:
            raise KeyboardInterrupt
        return real(scored, key)

    monkeypatch.setattr(module, "score_metrics", counted)
    with pytest.raises(KeyboardInterrupt):
        run_models(small_panel, runs, "g", "year", parallel=1, ledger=path)
    done = len(Ledger(spark, path).finished())
    assert done == 4
    state["stop"] = 10**9
    fitted.clear()
    out = run_models(small_panel, runs, "g", "year", parallel=2, ledger=path)
    assert len(fitted) == len(runs) - done
    whole = run_models(small_panel, runs, "g", "year")
    assert rows(out, "testing_dates", "model_key", "auc_roc", "p_at_10") == rows(whole, "testing_dates", "model_key", "auc_roc", "p_at_10")
    assert out.count() == len(runs)
    # Another seed is another run; a failed one is made again.
    fitted.clear()
    run_models(small_panel, runs[:1], "g", "year", seed=9, ledger=path)
    assert len(fitted) == 1
    monkeypatch.setattr(module, "score_metrics", lambda *a: 1 / 0)
    failed = scratch_path(spark, "ledger")
    assert run_models(small_panel, runs[:1], "g", "year", ledger=failed).first().model_result.startswith("failed")
    monkeypatch.setattr(module, "score_metrics", real)
    assert run_models(small_panel, runs[:1], "g", "year", ledger=failed).first().model_result is None


def test_phases(spark, small_panel):
    plan = [{"name": "p1", "models": ["NB"], "grid": 0, "latest": False}, {"name": "p3", "models": ["BASELINE_DT"], "grid": 2, "latest": True}]
    out = run_phases(small_panel, plan, start=dt.date(2002, 1, 1), end=dt.date(2005, 1, 1), window=12,
                     feature_subsets=[{"labels": ["a"], "features": ["x"]}], outcomes=["top"], entity="g", period="year")
    counts = {(r.phase, r.model_key): r["count"] for r in out.groupBy("phase", "model_key").count().collect()}
    assert counts == {("p1", "NB"): 2, ("p1", "BASELINE_RAND"): 2, ("p1", "BASELINE_PRIOR"): 2,
                      ("p3", "BASELINE_DT"): 1, ("p3", "BASELINE_RAND"): 1, ("p3", "BASELINE_PRIOR"): 1}


@pytest.mark.parametrize("value", [0, 1])
def test_one_class_split_is_scored_with_its_class(small_panel, value):
    flat = small_panel.withColumn("top", F.when(F.col("year") < 2004, F.lit(value)).otherwise(F.col("top")))
    splits = rolling_splits(dt.date(2000, 1, 1), dt.date(2005, 1, 1), 12, latest=True)
    runs = plan_runs(splits, [{"labels": ["a"], "features": ["x"]}], ["top"], ["RF", "NB", "DT"], 0)
    got = run_models(flat, runs, "g", "year").collect()
    assert [r.auc_roc for r in got] == [0.5] * 3 and all(r.model_result is None for r in got)


def test_a_failing_run_is_recorded_and_the_others_go_on(small_panel):
    splits = rolling_splits(dt.date(2000, 1, 1), dt.date(2005, 1, 1), 12, latest=True)
    sets = [{"labels": ["a"], "features": ["x"]}]
    runs = plan_runs(splits, sets, ["top"], ["NB", "BASELINE_DT"], 0)
    broken = [type(runs[0])(runs[0].split, runs[0].labels, runs[0].features, "top", "KNN", {"n_neighbors": "many"}), runs[1]]
    got = {r.model_key: r for r in run_models(small_panel, broken, "g", "year").collect()}
    assert got["KNN"].auc_roc is None and got["KNN"].model_result.startswith("failed")
    assert got["BASELINE_DT"].auc_roc > 0.9


def test_stored_analysis_names_entity_and_period_and_bias_needs_all_sets(spark, small_panel):
    splits = rolling_splits(dt.date(2000, 1, 1), dt.date(2005, 1, 1), 12, latest=True)
    sets = [{"labels": ["a"], "features": ["x"]}, {"labels": ["a", "b"], "features": ["x", "z"]}]
    runs = plan_runs(splits, sets, ["top"], ["BASELINE_DT"], 0)
    path = scratch_path(spark, "runs")
    stored = [r.model_result for r in run_models(small_panel, runs, "g", "year", output=path, bias_attributes=["x"]).collect()]
    analysis = spark.read.option("header", True).csv(f"{stored[0]}/feature_analysis")
    assert analysis.columns == ["g", "year", "x", "label_value", "score"]
    assert analysis.select("g", "year").distinct().count() == 60
    with pytest.raises(Exception):
        spark.read.csv(f"{stored[0]}/bias").count()
    assert spark.read.option("header", True).csv(f"{stored[1]}/bias").count() == 60


def test_several_windows_and_intercept(spark, small_panel, frames):
    plan = {"name": "p", "models": [], "grid": 0, "latest": True}
    out = run_phases(small_panel, [plan], start=dt.date(2000, 1, 1), end=dt.date(2005, 1, 1), window=[12, 24],
                     feature_subsets=[], outcomes=["top"], entity="g", period="year")
    assert {r.testing_dates.start.year for r in out.collect()} == {2003, 2004}
    model = estimator("LR", {"C": 1.0}, 200).fit(frames[0])
    table = {r.feature: r.value for r in importance_table(spark, model, ["f0", "f1", "f2"], "LR").collect()}
    assert table["(intercept)"] == model.intercept and len(table) == 4


def test_bagging_draws_any_row(frames):
    train, _ = frames
    params = {"n_estimators": 2, "max_samples": 5, "max_features": 2}
    first, again = (fit_score("BAG", params, t, t, "id", 200)[0] for t in (train, train.repartition(3)))
    assert rows(first) == rows(again)


def test_bagging_draws_are_the_same_over_many_ranges(frames, monkeypatch):
    train, _ = frames
    few = rows(bagging_draws(train, "id", 3, 4, 2), "tree", "draw", "label")
    monkeypatch.setattr(order, "RANGE_ROWS", 20)
    assert len(few) == 12 and rows(bagging_draws(train, "id", 3, 4, 2), "tree", "draw", "label") == few
