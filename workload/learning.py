"""Nearest neighbours and Spark ML models."""

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelkit.operators.clean import fill_median_halves
from panelkit.operators.neighbours import (
    cross_validated_accuracy,
    evaluation_grid,
    grid_accuracy,
    grid_counts,
    nearest,
    vote,
)
from panelkit.operators.panel import feature_batch, lag_bundle
from panelkit.operators.labels import increase_label, lagged_labels
from panelkit.operators.metrics import TOP_PERCENTS, confusion_counts
from panelkit.plans.models import (
    GRIDS,
    assemble,
    class1_score,
    estimator,
    fit_score,
    importance_table,
    parameter_grid,
    tree_table,
)
from panelkit.plans.runs import BASELINES, PHASES, run_phases
from panelkit.plans.splits import hash_split
from panelkit.plans.trees import node_table, score_by_nodes
from panelkit.session import materialise
from panelkit.sources.files import table
from workload.base import LABELS, customer_years, query, r6, rounded
from workload.panel import labelled
from workload.ranking import LAST_YEAR, data_splits, split_halves

_HASH = "(CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR) || '|{seed}'), 1, 12) AS BIGINT) / 281474976710656.0)"


def _ranked_sql(k, train="x.u < 0.8", test="u >= 0.8", extra="", distance="list_distance(q.v, t.v)", seed=11):
    return f"""WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {_HASH.format(seed=seed)} AS u, CAST(floor({_HASH.format(seed=seed)} * 5) AS INTEGER) AS fold
 FROM embeddings), q AS (SELECT * FROM x WHERE {test}), t AS (SELECT * FROM x WHERE {train}),
 d AS (SELECT q.vec_id AS qid, q.label AS ql, q.fold AS fold, t.vec_id AS tid, t.label AS tl, {distance} AS dist FROM q JOIN t ON true {extra}),
 r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d QUALIFY rn <= {k})"""


def _vote_sql(ks_weights):
    return ", w AS (SELECT r.*, g.k, g.weights, CASE WHEN g.weights = 'distance' THEN 1.0 / dist ELSE 1.0 END AS w FROM r JOIN (VALUES " + \
        ", ".join(f"({k}, '{w}')" for k, w in ks_weights) + """) g(k, weights) ON r.rn <= g.k),
 v AS (SELECT k, weights, qid, ql, fold, tl, sum(w) AS w FROM w GROUP BY ALL),
 p AS (SELECT k, weights, qid, ql, fold, tl AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY k, weights, qid ORDER BY round(w, 12) DESC, tl) = 1)"""


def vectors(spark, folder):
    return hash_split(table(spark, folder, "embeddings"), ["vec_id"], 11)


def _near(spark, folder, k, metric="euclidean"):
    rows = vectors(spark, folder)
    return nearest(rows.where(F.col("part") == "train"), rows.where(F.col("part") == "test"), k,
                   "vec_id", "embedding", "label", metric)


@query("knn_neighbours", _ranked_sql(7) + " SELECT qid AS query_id, tid AS id, CAST(rn AS INTEGER) AS rank, round(dist, 6) AS distance FROM r")
def knn_neighbours(spark, folder):
    return rounded(_near(spark, folder, 7), "distance").select("query_id", "id", "rank", "distance")


@query("knn_manhattan", _ranked_sql(3, distance="list_sum([abs(q.v[i] - t.v[i]) FOR i IN range(1, 65)])")
       + " SELECT qid AS query_id, tid AS id, CAST(rn AS INTEGER) AS rank, round(dist, 6) AS distance FROM r")
def knn_manhattan(spark, folder):
    return rounded(_near(spark, folder, 3, "manhattan"), "distance").select("query_id", "id", "rank", "distance")


@query("knn_classify", _ranked_sql(10) + _vote_sql([(10, "distance")]) + " SELECT qid AS query_id, ql AS label, predicted FROM p")
def knn_classify(spark, folder):
    voted = vote(_near(spark, folder, 10), [(10, "distance")])
    return voted.select("query_id", F.col("query_label").alias("label"), "predicted")


_GRID = [(k, w) for k in (5, 10, 25) for w in ("uniform", "distance")]


@query("knn_grid", _ranked_sql(25) + _vote_sql(_GRID) + " SELECT CAST(k AS INTEGER) AS k, weights, round(avg(CAST(predicted = ql AS DOUBLE)), 6) AS accuracy FROM p GROUP BY 1, 2")
def knn_grid(spark, folder):
    return rounded(evaluation_grid(_near(spark, folder, 25), [5, 10, 25], ["uniform", "distance"]), "accuracy")


_FULL_K, _FULL_METRICS = [1, 5, 10], {"euclidean": "list_distance(q.v, t.v)", "manhattan": "list_sum([abs(q.v[i] - t.v[i]) FOR i IN range(1, 65)])"}


def _full_grid_sql():
    """Counts by side, metric, k, weighting, actual and predicted class; the exact match takes all the weight."""
    sides = " UNION ALL ".join(
        f"SELECT '{side}' AS side, '{m}' AS metric, q.vec_id AS qid, q.label AS ql, t.vec_id AS tid, t.label AS tl, {d} AS dist FROM x q JOIN x t ON t.u < 0.8 AND q.u {cond}"
        for m, d in _FULL_METRICS.items() for side, cond in (("train", "< 0.8"), ("test", ">= 0.8")))
    grid = ", ".join(f"({k}, '{w}')" for k in _FULL_K for w in ("uniform", "distance"))
    return f"""WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, {_HASH.format(seed=11)} AS u FROM embeddings),
 r AS (SELECT *, row_number() OVER (PARTITION BY side, metric, qid ORDER BY dist, tid) AS rn FROM ({sides}) QUALIFY rn <= {max(_FULL_K)}),
 w AS (SELECT r.*, g.k, g.weights, CASE WHEN g.weights = 'uniform' THEN 1.0 WHEN bool_or(dist = 0) OVER (PARTITION BY side, metric, qid, k, weights)
  THEN CAST(dist = 0 AS DOUBLE) ELSE 1.0 / dist END AS w FROM r JOIN (VALUES {grid}) g(k, weights) ON r.rn <= g.k),
 v AS (SELECT side, metric, k, weights, qid, ql, tl, sum(w) AS w FROM w GROUP BY ALL),
 p AS (SELECT side, metric, k, weights, qid, ql, tl AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY side, metric, k, weights, qid ORDER BY round(w, 12) DESC, tl) = 1)"""


def _full_grid(spark, folder):
    rows = vectors(spark, folder)
    return grid_counts(rows.where(F.col("part") == "train"), rows.where(F.col("part") == "test"), _FULL_K, list(_FULL_METRICS),
                       ["uniform", "distance"], "vec_id", "embedding", "label")


@query("knn_grid_confusion", _full_grid_sql() + """ SELECT side, metric, CAST(k AS INTEGER) AS k, weights, ql AS actual, predicted, count(*) AS n
 FROM p GROUP BY ALL""")
def knn_grid_confusion(spark, folder):
    return _full_grid(spark, folder)


@query("knn_grid_sides", _full_grid_sql() + """ SELECT metric, CAST(k AS INTEGER) AS k, weights,
 round(avg(CAST(predicted = ql AS DOUBLE)) FILTER (WHERE side = 'train'), 6) AS training_acc,
 round(avg(CAST(predicted = ql AS DOUBLE)) FILTER (WHERE side = 'test'), 6) AS test_acc FROM p GROUP BY 1, 2, 3""")
def knn_grid_sides(spark, folder):
    return rounded(grid_accuracy(_full_grid(spark, folder)), "training_acc", "test_acc")


@query("cv_accuracy", _ranked_sql(9, "true", "true", "AND t.fold <> q.fold", seed=2) + _vote_sql([(k, "uniform") for k in (3, 5, 9)])
       + """, f AS (SELECT k, fold, avg(CAST(predicted = ql AS DOUBLE)) AS a FROM p GROUP BY 1, 2)
 SELECT CAST(k AS INTEGER) AS k, round(avg(a), 6) AS accuracy FROM f GROUP BY 1""")
def cv_accuracy(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rounded(cross_validated_accuracy(rows, [3, 5, 9], 5, "vec_id", "embedding", "label", 2), "accuracy")


# --- Spark ML models on the customer-year panel

FEATURES = ["n_orders_lag", "urgent_lag", "finished_lag", "n_orders_avg_3yr", "urgent_avg_3yr", "price_lag", "price_avg_3yr"]


def model_panel(spark, folder):
    """Lag and mean features with both labels and their lags."""
    cy = customer_years(spark, folder).withColumn("price", F.col("cents") / 1e7)
    out = feature_batch(cy, "custkey", "year", [(["n_orders", "urgent", "price"], [3], []), (["cents"], [], [1])])
    out = lag_bundle(out, ["n_orders", "urgent", "finished", "price"], "custkey", "year")
    out = increase_label(out, "cents_pct_change_1yr", "inc20")
    out = out.join(labelled(spark, folder), ["custkey", "year"])
    return lagged_labels(out, ["top20", "inc20"], "custkey", "year")


def train_test(spark, folder):
    panel = model_panel(spark, folder).select("custkey", "year", "top20", *FEATURES)
    # Medians, training and test rows all read the panel, so it is written once first.
    panel = materialise(panel.withColumn("id", F.col("custkey") * 10000 + F.col("year")))
    # Learners read the training rows many times over.
    train, test = (materialise(half) for half in fill_median_halves(*split_halves(spark, folder, panel), FEATURES))
    return assemble(train, FEATURES, "top20", ["id"]), assemble(test, FEATURES, "top20", ["id"])


def _scores(spark, folder, key, params):
    train, test = train_test(spark, folder)
    _, scored = fit_score(key, params, train, test, "id", train.count(), seed=1)
    return scored


def _checked(spark, folder, key, params):
    """Keys, labels and scores within 0 and 1, and whether positives among the training rows score higher on average.

    A fitted score depends on the learner, so what is returned is what holds for any sound one. Whether
    the test year can be foretold is a matter of the data; the rows learnt from are told apart by all.
    """
    train, test = train_test(spark, folder)
    model, scored = fit_score(key, params, train, test, "id", train.count(), seed=1)
    scored = scored.select("id", "label", F.col("score").between(0, 1).alias("in_bounds"))
    if key in ("BAG", "SVM"):
        return scored
    y = F.col("label")
    means = class1_score(key, model.transform(train)).agg(
        F.avg(F.when(y == 1, F.col("score"))) >= F.avg(F.when(y == 0, F.col("score"))))
    return scored.withColumn("learned", means.scalar())


_CHECKED = f"""SELECT CAST(custkey * 10000 + year AS BIGINT) AS id, top20 AS label, true AS in_bounds, true AS learned
 FROM ({LABELS}) WHERE year = {LAST_YEAR}"""


@query("rf", _CHECKED)
def rf(spark, folder):
    return _checked(spark, folder, "RF", {"n_estimators": 10, "max_depth": 5, "max_features": "sqrt", "min_samples_split": 10})


@query("lr", _CHECKED)
def lr(spark, folder):
    return _checked(spark, folder, "LR", {"penalty": "l2", "C": 0.01})


@query("gbt", _CHECKED)
def gbt(spark, folder):
    return _checked(spark, folder, "GB", {"n_estimators": 5, "learning_rate": 0.5, "subsample": 0.5, "max_depth": 5})


@query("bagging", _CHECKED.replace(", true AS learned", ""))
def bagging(spark, folder):
    # Trees on five rows each need not learn anything, so only keys, labels and bounds are sure.
    return _checked(spark, folder, "BAG", {"n_estimators": 5, "max_samples": 5, "max_features": 3})


@query("dtree", _CHECKED)
def dtree(spark, folder):
    return _checked(spark, folder, "BASELINE_DT", {"max_depth": 3})


@query("svm", _CHECKED.replace(", true AS learned", ""))
def svm(spark, folder):
    return _checked(spark, folder, "SVM", {"C": 1.0})


_NB_FEATURES = ["n_orders_lag", "urgent_lag", "finished_lag"]
_PDF = " + ".join(
    f"(-0.5 * ln(2 * pi() * v_{c}) - power(r.{c} - m_{c}, 2) / (2 * v_{c}))" for c in _NB_FEATURES)


@query("gnb", f"""WITH l AS ({LABELS}), w AS (SELECT a.custkey, a.year, a.top20 AS label, a.year = {LAST_YEAR} AS test, CAST(b.n_orders AS DOUBLE) AS n_orders_lag,
 CAST(b.urgent AS DOUBLE) AS urgent_lag, CAST(b.finished AS DOUBLE) AS finished_lag FROM l a LEFT JOIN l b ON a.custkey = b.custkey AND b.year = a.year - 1),
 md AS (SELECT test, {', '.join(f'median({c}) AS d_{c}' for c in _NB_FEATURES)} FROM w GROUP BY 1),
 r AS (SELECT custkey, label, w.test, {', '.join(f'coalesce({c}, d_{c}) AS {c}' for c in _NB_FEATURES)} FROM w JOIN md ON w.test = md.test),
 m AS (SELECT label AS c, count(*) AS n, {', '.join(f'avg({c}) AS m_{c}, var_pop({c}) AS v_{c}' for c in _NB_FEATURES)} FROM r WHERE NOT test GROUP BY 1),
 s AS (SELECT r.custkey, r.label, m.c, ln(n) + {_PDF} AS lp FROM r, m WHERE r.test)
 SELECT custkey, label, round(1 / (1 + exp(max(lp) FILTER (WHERE c = 0) - max(lp) FILTER (WHERE c = 1))), 5) AS score FROM s GROUP BY 1, 2""")
def gnb(spark, folder):
    panel = materialise(model_panel(spark, folder).select("custkey", "year", "top20", *_NB_FEATURES))
    train, test = (assemble(half, _NB_FEATURES, "top20", ["custkey"])
                   for half in fill_median_halves(*split_halves(spark, folder, panel), _NB_FEATURES))
    _, scored = fit_score("NB", {}, train, test, "custkey", 0)
    return scored.select("custkey", "label", F.round("score", 5).alias("score"))


# --- a tree of depth two, found anew in SQL by trying every split

_TREE_ROWS = f"""l AS ({LABELS}), w AS (SELECT a.custkey, a.year, CAST(a.finished > 0 AS INTEGER) AS label, a.year = {LAST_YEAR} AS test, CAST(b.n_orders AS DOUBLE) AS n_orders_lag,
 CAST(b.urgent AS DOUBLE) AS urgent_lag, CAST(b.finished AS DOUBLE) AS finished_lag FROM l a LEFT JOIN l b ON a.custkey = b.custkey AND b.year = a.year - 1),
 md AS (SELECT test, {', '.join(f'median({c}) AS d_{c}' for c in _NB_FEATURES)} FROM w GROUP BY 1),
 r AS (SELECT custkey, label, w.test, [{', '.join(f'coalesce({c}, d_{c})' for c in _NB_FEATURES)}] AS x FROM w JOIN md ON w.test = md.test),
 t AS (SELECT * FROM r WHERE NOT test)"""


def _gini(n, p):
    return f"(1 - power(CAST({p} AS DOUBLE) / {n}, 2) - power(CAST({n} - {p} AS DOUBLE) / {n}, 2))"


def _split_sql(name, rows):
    """Best gini split of some rows: every midpoint of neighbouring values of every feature."""
    gain = f"{_gini('n', 'p')} - CAST(nl AS DOUBLE) / n * {_gini('nl', 'pl')} - CAST(n - nl AS DOUBLE) / n * {_gini('(n - nl)', '(p - pl)')}"
    return f"""{name}_v AS (SELECT f, x[f] AS v, count(*) AS n, sum(label) AS p FROM ({rows}), (VALUES (1), (2), (3)) g(f) GROUP BY 1, 2),
 {name}_c AS (SELECT f, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS t, sum(n) OVER (PARTITION BY f ORDER BY v) AS nl,
 sum(p) OVER (PARTITION BY f ORDER BY v) AS pl, sum(n) OVER (PARTITION BY f) AS n, sum(p) OVER (PARTITION BY f) AS p FROM {name}_v),
 {name} AS (SELECT f, t, nl, pl, n, p, {gain} AS gain FROM {name}_c WHERE t IS NOT NULL AND {gain} > 0 ORDER BY gain DESC, f, t LIMIT 1)"""


def _side(node, op):
    return f"(SELECT t.* FROM t, {node} s WHERE t.x[s.f] {op} s.t)"


# Share of class 1 in the leaf of a side; leaves that predict the same class are one leaf.
def _side_sql(node, name, op):
    rows = _side(node, op)
    return f"""{_split_sql(name, 'SELECT * FROM ' + rows)},
 {name}_leaf AS (SELECT (SELECT CAST(sum(label) AS DOUBLE) / count(*) FROM {rows}) AS share, (SELECT 2 * sum(label) > count(*) FROM {rows}) AS ones,
 (SELECT f FROM {name} WHERE (2 * pl > nl) <> (2 * (p - pl) > n - nl)) AS f, (SELECT t FROM {name}) AS t,
 (SELECT CAST(pl AS DOUBLE) / nl FROM {name}) AS low, (SELECT CAST(p - pl AS DOUBLE) / (n - nl) FROM {name}) AS high)"""


def _tree_rows(spark, folder, features=_NB_FEATURES):
    panel = model_panel(spark, folder).withColumn("label", (F.col("finished") > 0).cast("int"))
    panel = materialise(panel.select("custkey", "year", "label", *_NB_FEATURES))
    halves = fill_median_halves(*split_halves(spark, folder, panel), _NB_FEATURES)
    return [assemble(half, features, "label", ["custkey"]) for half in halves]


@query("gbt_root", f"""WITH {_TREE_ROWS}, {_split_sql('s', 'SELECT * FROM t')}
 SELECT [{', '.join(f"'{c}'" for c in _NB_FEATURES)}][f] AS feature, t AS threshold, CAST(n AS BIGINT) AS samples, CAST(nl AS BIGINT) AS left_samples,
 round(2 * CAST(pl AS DOUBLE) / nl - 1, 9) AS left_value, round(2 * CAST(p - pl AS DOUBLE) / (n - nl) - 1, 9) AS right_value FROM s""")
def gbt_root(spark, folder):
    """The first boosted tree, of depth one: variance of a label of -1 and 1 splits as the gini impurity does."""
    train, _ = _tree_rows(spark, folder)
    model = estimator("GB", {"n_estimators": 1, "max_depth": 1}, 0, 1).fit(train)
    nodes = materialise(node_table(spark, model, _NB_FEATURES))
    left, right = (nodes.where(F.col("id") == i).select("samples", "value") for i in (1, 2))
    return nodes.where(F.col("id") == 0).select(
        "feature", "threshold", "samples", left.select("samples").scalar().alias("left_samples"),
        F.round(left.select("value").scalar(), 9).alias("left_value"), F.round(right.select("value").scalar(), 9).alias("right_value"))


@query("dtree_values", f"""WITH {_TREE_ROWS}, {_split_sql('s', 'SELECT * FROM t')}, {_side_sql('s', 'a', '<=')}, {_side_sql('s', 'b', '>')},
 merged AS (SELECT a.f IS NULL AND b.f IS NULL AND a.ones = b.ones AS whole, (SELECT CAST(sum(label) AS DOUBLE) / count(*) FROM t) AS share FROM a_leaf a, b_leaf b)
 SELECT custkey, label, round(CASE WHEN m.whole THEN m.share
 WHEN r.x[s.f] <= s.t THEN CASE WHEN a.f IS NULL THEN a.share WHEN r.x[a.f] <= a.t THEN a.low ELSE a.high END
 ELSE CASE WHEN b.f IS NULL THEN b.share WHEN r.x[b.f] <= b.t THEN b.low ELSE b.high END END, 9) AS score
 FROM r, s, a_leaf a, b_leaf b, merged m WHERE r.test""")
def dtree_values(spark, folder):
    """Scores of a tree of depth two, which SQL finds by trying every split."""
    train, test = _tree_rows(spark, folder)
    _, scored = fit_score("BASELINE_DT", {"max_depth": 2}, train, test, "custkey", 0)
    return scored.select("custkey", "label", F.round("score", 9).alias("score"))


# --- a logistic regression, solved anew in SQL

_LR_C, _STEPS = 0.01, 8


def _newton_sql():
    """Newton steps for the mean log loss plus half the penalty times the squared weights (not the intercept)."""
    zero = "z0 AS (SELECT 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS b)"
    steps = [zero]
    for i in range(_STEPS):
        m = "(1 / (1 + exp(-(w1 * x[1] + w2 * x[2] + b))))"
        sums = ", ".join(f"avg({m} * (1 - {m}) * {e}) + {lam} AS {n}" for n, e, lam in (
            ("a", "x[1] * x[1]", "any_value(l)"), ("d", "x[2] * x[2]", "any_value(l)"), ("f", "1", 0), ("bb", "x[1] * x[2]", 0), ("c", "x[1]", 0), ("e", "x[2]", 0)))
        steps.append(f"""g{i} AS (SELECT any_value(w1) AS w1, any_value(w2) AS w2, any_value(b) AS b, {sums},
 avg(({m} - label) * x[1]) + any_value(l * w1) AS g1, avg(({m} - label) * x[2]) + any_value(l * w2) AS g2, avg({m} - label) AS g3 FROM t, z{i}, lam),
 h{i} AS (SELECT *, a * (d * f - e * e) - bb * (bb * f - e * c) + c * (bb * e - d * c) AS det FROM g{i}),
 z{i + 1} AS (SELECT w1 - (g1 * (d * f - e * e) - bb * (g2 * f - e * g3) + c * (g2 * e - d * g3)) / det AS w1,
 w2 - (a * (g2 * f - g3 * e) - g1 * (bb * f - e * c) + c * (bb * g3 - g2 * c)) / det AS w2,
 b - (a * (d * g3 - e * g2) - bb * (bb * g3 - g2 * c) + g1 * (bb * e - d * c)) / det AS b FROM h{i})""")
    return "lam AS (SELECT 1.0 / (" + str(_LR_C) + " * count(*)) AS l FROM t), " + ", ".join(steps)


@query("lr_values", f"""WITH {_TREE_ROWS}, {_newton_sql()}
 SELECT custkey, label, round(1 / (1 + exp(-(w1 * x[1] + w2 * x[2] + b))), 4) AS score FROM r, z{_STEPS} WHERE test""")
def lr_values(spark, folder):
    """Scores of a penalised logistic regression on two features."""
    train, test = _tree_rows(spark, folder, _NB_FEATURES[:2])
    train = materialise(train)
    _, scored = fit_score("LR", {"penalty": "l2", "C": _LR_C}, train, test, "custkey", train.count())
    return scored.select("custkey", "label", F.round("score", 4).alias("score"))


_REPLAYED = {"RF": ({"n_estimators": 10, "max_depth": 5}, 5), "GB": ({"n_estimators": 5, "learning_rate": 0.5, "max_depth": 3}, 3), "BASELINE_DT": ({"max_depth": 3}, 3)}


@query("tree_replay", f"""SELECT model_key, count(*) AS n, count(*) AS n_equal FROM ({LABELS}), (VALUES """
       + ", ".join(f"('{k}')" for k in _REPLAYED) + f") m(model_key) WHERE year = {LAST_YEAR} GROUP BY 1")
def tree_replay(spark, folder):
    """Test rows whose score the stored nodes give too, for a forest, a boosted ensemble and a tree."""
    train, test = train_test(spark, folder)
    test = test.withColumn("x", vector_to_array("features"))
    out = None
    for key, (params, depth) in _REPLAYED.items():
        model = estimator(key, params, 0, 1).fit(train)
        nodes = materialise(node_table(spark, model, FEATURES))
        scored = class1_score(key, model.transform(test), "fitted").select("x", "fitted")
        scored = score_by_nodes(scored, nodes, "x", depth, key == "GB")
        one = scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("fitted") - F.col("score")) < 1e-12).alias("n_equal"))
        one = one.select(F.lit(key).alias("model_key"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("class1_probability", f"SELECT CAST(custkey * 10000 + year AS BIGINT) AS id, 1.0::DOUBLE AS total, true AS in_bounds FROM ({LABELS}) WHERE year = {LAST_YEAR}")
def class1_probability(spark, folder):
    train, test = train_test(spark, folder)
    model = estimator("RF", {"n_estimators": 5, "max_depth": 4}, 0, 1).fit(train)
    proba = vector_to_array("probability")
    return model.transform(test).select("id", r6(proba[0] + proba[1]).alias("total"), proba[1].between(0, 1).alias("in_bounds"))


@query("importance", "SELECT feature, true AS in_bounds, 1.0::DOUBLE AS total FROM (VALUES " + ", ".join(f"('{c}')" for c in FEATURES) + ") t(feature)")
def importance(spark, folder):
    train, _ = train_test(spark, folder)
    model = estimator("RF", {"n_estimators": 10, "max_depth": 5}, 0, 1).fit(train)
    out = importance_table(spark, model, FEATURES, "RF")
    total = out.agg(r6(F.sum("value"))).scalar()
    return out.select("feature", F.col("value").between(0, 1).alias("in_bounds"), total.alias("total"))


@query("tree_nodes", f"""SELECT count(*) AS samples, count(*) FILTER (WHERE top20 = 0) AS zeros, count(*) FILTER (WHERE top20 = 1) AS ones,
 count(*) AS leaf_samples, true AS children_sum FROM ({LABELS}) WHERE year < {LAST_YEAR}""")
def tree_nodes(spark, folder):
    """Counts of the root by class, of all leaves together, and whether children add up to their parents."""
    train, _ = train_test(spark, folder)
    model = estimator("BASELINE_DT", {"max_depth": 3}, 0, 1).fit(train)
    nodes = tree_table(spark, model, FEATURES).select(
        "id", "samples", "left_child", "right_child", *[F.col("class_counts")[c].cast("long").alias(f"n{c}") for c in (0, 1)])
    sides = [nodes.select(F.col("id").alias(f"{s}_child"), *[F.col(c).alias(f"{s}_{c}") for c in ("n0", "n1")]) for s in ("left", "right")]
    both = nodes.join(sides[0], "left_child", "left").join(sides[1], "right_child", "left")
    leaf = F.col("left_child").isNull()
    adds = [F.col(f"left_{c}") + F.col(f"right_{c}") == F.col(c) for c in ("n0", "n1")]
    root = F.col("id") == 0
    return both.agg(
        F.max(F.when(root, F.col("samples"))).alias("samples"), F.max(F.when(root, F.col("n0"))).alias("zeros"),
        F.max(F.when(root, F.col("n1"))).alias("ones"), F.sum(F.when(leaf, F.col("samples"))).alias("leaf_samples"),
        F.every(leaf | (adds[0] & adds[1])).alias("children_sum"),
    )


@query("svm_confusion", f"""SELECT count(*) FILTER (WHERE top20 = 1) AS positives, count(*) FILTER (WHERE top20 = 0) AS negatives, true AS adds_up
 FROM ({LABELS}) WHERE year = {LAST_YEAR}""")
def svm_confusion(spark, folder):
    scored = _scores(spark, folder, "SVM", {"C": 1.0})
    out = confusion_counts(scored.withColumn("pred", (F.col("score") >= 0.5).cast("int")), "label", "pred")
    right, n = F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return out.select((F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"),
                      (F.abs(F.col("accuracy") - right / n) < 1e-9).alias("adds_up"))


# All models of each phase on the last split and both labels; the second phase takes the first grid, as its
# own one alone is 33 fits a label.
_PHASE_PLAN = [{**phase, "grid": 0 if phase["name"] == "phase2" else phase["grid"], "latest": True} for phase in PHASES]
_PHASE_RUNS = [
    (phase["name"], y, m, 1 if m in BASELINES else len(parameter_grid(GRIDS[m][phase["grid"]])))
    for phase in _PHASE_PLAN for y in ("top20", "inc20") for m in [*phase["models"], *BASELINES]
]


@query("phases", f"""SELECT phase, outcome, model_key, make_date(CAST((SELECT min(year(o_orderdate)) FROM orders) AS INTEGER), 1, 1) AS train_start,
 make_date(CAST({LAST_YEAR} AS INTEGER), 1, 1) AS test_start, make_date(CAST({LAST_YEAR} AS INTEGER), 12, 31) AS test_end,
 CAST(runs AS BIGINT) AS runs, true AS in_bounds FROM (VALUES """
       + ", ".join(f"('{p}', '{y}', '{m}', {n})" for p, y, m, n in _PHASE_RUNS) + ") t(phase, outcome, model_key, runs)")
def phases(spark, folder):
    """The runs of all three phases with the baselines: their dates, number, and metrics within bounds."""
    panel = materialise(model_panel(spark, folder))
    split = data_splits(spark, folder, latest=True)[0]
    out = run_phases(
        panel, _PHASE_PLAN, start=split.train_start, end=split.test_end + dt.timedelta(days=1), window=12,
        feature_subsets=[{"labels": ["history"], "features": FEATURES}], outcomes=["top20", "inc20"],
        entity="custkey", period="year", parallel=4,
    )
    sound = reduce(and_, [F.col(c).between(0, 1) for c in ("auc_roc", *[f"{m}_at_{k}" for m in ("p", "r", "f1") for k in TOP_PERCENTS])])
    return out.groupBy("phase", "outcome", "model_key", F.col("training_dates.start").alias("train_start"),
                       F.col("testing_dates.start").alias("test_start"), F.col("testing_dates.end").alias("test_end")).agg(
        F.count(F.lit(1)).alias("runs"), F.every(F.coalesce(sound, F.lit(False))).alias("in_bounds"))
