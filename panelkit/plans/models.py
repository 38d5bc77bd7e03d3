"""Classifiers on Spark ML: estimators, scores, importances, tree tables, baselines."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.scalars import hash_uniform
from panelkit.operators.clean import min_max_scale
from panelkit.operators.neighbours import nearest, vote
from panelkit.operators.order import assign_ranks
from panelkit.plans.trees import score_by_nodes
from panelkit.session import materialise, scratch_path

# The parameter grids of the three phases.
GRIDS = {
    "RF": [
        {"n_estimators": [10], "max_depth": [5], "max_features": ["sqrt"], "min_samples_split": [10]},
        {"n_estimators": [10, 100], "max_depth": [5, 10, 20], "max_features": ["sqrt", "log2"],
         "min_samples_split": [2, 10]},
        {"n_estimators": [100], "max_depth": [10, 20], "max_features": ["sqrt"], "min_samples_split": [10]},
    ],
    "LR": [{"penalty": ["l2"], "C": [0.01]}, {"penalty": ["l1", "l2"], "C": [0.001, 0.01, 0.1, 1, 10]}, {}],
    "NB": [{}, {}, {}],
    "GB": [
        {"n_estimators": [5], "learning_rate": [0.5], "subsample": [0.5], "max_depth": [5]},
        {"n_estimators": [5, 10], "learning_rate": [0.1, 0.5], "subsample": [0.1, 0.5], "max_depth": [10]},
        {},
    ],
    "BAG": [
        {"n_estimators": [5], "max_samples": [5], "max_features": [3]},
        {"n_estimators": [10, 100], "max_samples": [5, 10], "max_features": [5, 10]},
        {},
    ],
    "DT": [{"max_depth": [20], "min_samples_split": [10]}, {"max_depth": [20], "min_samples_split": [10]}, {}],
    "BASELINE_DT": [{"max_depth": [3]}, {"max_depth": [3]}, {"max_depth": [3]}],
    "KNN": [{"n_neighbors": [10], "weights": ["distance"]},
            {"n_neighbors": [5, 10, 25], "weights": ["distance", "uniform"]}, {}],
    "SVM": [{"C": [1.0]}, {"C": [1.0]}, {}],
}


def parameter_grid(grid: Mapping[str, Sequence]) -> list[dict]:
    """Every combination of the listed values; an empty grid is one run with defaults."""
    keys = list(grid)
    return [dict(zip(keys, combo)) for combo in itertools.product(*[grid[k] for k in keys])]


def assemble(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str]) -> DataFrame:
    """Keys, label and one feature vector per row."""
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return vector.transform(df).select(*keys, F.col(label).cast("int").alias("label"), "features")


def estimator(key: str, params: Mapping, n_train: int, seed: int = 0):
    """The Spark ML estimator for a model key. min_samples_split maps to the nearest leaf minimum."""
    leaf = max(1, int(params.get("min_samples_split", 2)) // 2)
    # Deep trees: rows keep the node they reached, else every pass walks them down from the root. The trees are the same.
    kept = params.get("max_depth", 5) >= 10
    if key == "RF":
        return RandomForestClassifier(
            numTrees=params.get("n_estimators", 10), maxDepth=params.get("max_depth", 5), seed=seed, cacheNodeIds=kept,
            featureSubsetStrategy=params.get("max_features", "sqrt"), minInstancesPerNode=leaf,
        )
    if key in ("DT", "BASELINE_DT"):
        return DecisionTreeClassifier(
            impurity="gini", maxDepth=params.get("max_depth", 5), minInstancesPerNode=leaf, seed=seed, cacheNodeIds=kept
        )
    if key == "GB":
        return GBTClassifier(
            maxIter=params.get("n_estimators", 10), stepSize=params.get("learning_rate", 0.1), seed=seed,
            subsamplingRate=params.get("subsample", 1.0), maxDepth=params.get("max_depth", 3),
        )
    if key == "NB":
        return NaiveBayes(modelType="gaussian")
    penalty = 1.0 / (float(params.get("C", 1.0)) * max(1, n_train))
    if key == "LR":
        return LogisticRegression(
            elasticNetParam=1.0 if params.get("penalty") == "l1" else 0.0, regParam=penalty, standardization=False
        )
    if key == "SVM":
        return LinearSVC(regParam=penalty, maxIter=50, tol=1e-3)
    raise ValueError(f"unknown model key {key}")


def class1_score(key: str, predictions: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1, or the min-max scaled decision value for the linear SVM."""
    if key == "SVM":
        raw = predictions.withColumn("__raw", vector_to_array("rawPrediction")[1])
        return min_max_scale(raw, "__raw", name).drop("__raw")
    # A model that only saw class 0 knows no second class.
    one = F.get(vector_to_array("probability"), F.lit(1))
    return predictions.withColumn(name, F.coalesce(one, F.lit(0.0)))


def fit_score(
    key: str, params: Mapping, train: DataFrame, test: DataFrame, id_col: str, n_train: int, seed: int = 0
) -> tuple[object | None, DataFrame]:
    """Fit one model; return it with the test rows (id, label, score)."""
    if key == "BAG":
        models = fit_bagging(train, id_col, params, seed)
        return models, score_bagging(models, test, params.get("max_samples", 5) - 1).select(id_col, "label", "score")
    if key == "KNN":
        k, weights = params.get("n_neighbors", 5), params.get("weights", "uniform")
        plain = [df.select(id_col, "label", vector_to_array("features").alias("v")) for df in (train, test)]
        near = nearest(plain[0], plain[1], k, id_col, "v", "label")
        voted = vote(near, [(k, weights)])
        return None, voted.select(F.col("query_id").alias(id_col), F.col("query_label").alias("label"), "score")
    model = estimator(key, params, n_train, seed).fit(train)
    return model, class1_score(key, model.transform(test)).select(id_col, "label", "score")


_BAG_SCHEMA = ("tree int, id int, feature_index int, threshold double, left_child int, right_child int, value double, "
               "samples long, weight double")


def bagging_draws(train: DataFrame, id_col: str, trees: int, rows: int, seed: int = 0) -> DataFrame:
    """Rows drawn with replacement from all training rows, by hashed position: tree, draw, features as `v`, label."""
    placed = assign_ranks(train.select(id_col, "features", "label"), [F.col(id_col)], name="__at")
    n = train.agg(F.count(F.lit(1))).scalar()
    draws = train.sparkSession.range(trees * rows).select(
        F.col("id").alias("draw"), (F.floor(hash_uniform(["id"], f"{seed}:row") * n) + 1).cast("long").alias("__at"))
    # The draws are trees * rows numbers.
    return placed.join(F.broadcast(draws), "__at").select(
        F.floor(F.col("draw") / rows).cast("int").alias("tree"), "draw", vector_to_array("features").alias("v"), "label")


def grow_tree(x: np.ndarray, y: np.ndarray, chosen: Sequence[int]) -> list[tuple]:
    """All nodes of a full tree by exact gini splits: (id, feature, threshold, left, right, share of class 1, rows).

    Of equal splits the first feature in the order chosen and then the lowest threshold is taken.
    """
    nodes: list = []

    def grow(at: np.ndarray) -> int:
        me, n, ones = len(nodes), len(at), int(y[at].sum())
        nodes.append((me, None, None, None, None, ones / n, n))
        best = None
        if 0 < ones < n:
            for f in chosen:
                order = at[np.argsort(x[at, f], kind="stable")]
                v, hits = x[order, f], np.cumsum(y[order])[:-1]
                left = np.arange(1, n)
                right_hits, right = ones - hits, n - left
                impurity = 2 * (hits * (left - hits) / left + right_hits * (right - right_hits) / right)
                impurity = np.where(v[1:] > v[:-1], impurity, np.inf)
                i = int(impurity.argmin())
                if np.isfinite(impurity[i]) and (best is None or impurity[i] < best[0] - 1e-12):
                    best = impurity[i], f, (v[i] + v[i + 1]) / 2
        if best:
            _, f, threshold = best
            low = x[at, f] <= threshold
            left_id = grow(at[low])
            right_id = grow(at[~low])
            nodes[me] = (me, int(f), float(threshold), left_id, right_id, ones / n, n)
        return me

    grow(np.arange(len(y)))
    return nodes


def chosen_features(seed: int, tree: int, width: int, size: int) -> list[int]:
    return [_hash_position(f"{seed}:{tree}:{j}", size) for j in range(width)]


def fit_bagging(train: DataFrame, id_col: str, params: Mapping, seed: int = 0) -> DataFrame:
    """Trees on tiny bootstrap samples, as a node table: an absolute number of rows and of (repeatable) features each.

    All trees are grown by one grouped job over the tree number; a group has `max_samples` rows.
    """
    trees, rows, width = (params.get(k, d) for k, d in (("n_estimators", 10), ("max_samples", 5), ("max_features", 3)))

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("draw")
        tree = int(sample["tree"].iloc[0])
        x = np.stack(sample["v"].to_numpy()).astype(float)
        found = grow_tree(x, sample["label"].to_numpy().astype(int), chosen_features(seed, tree, width, x.shape[1]))
        columns = ["id", "feature_index", "threshold", "left_child", "right_child", "value", "samples"]
        out = pd.DataFrame(found, columns=columns).astype({c: "Int32" for c in ("feature_index", "left_child", "right_child")})
        return out.assign(tree=tree, weight=1.0)[[f.split()[0] for f in _BAG_SCHEMA.split(", ")]]

    return materialise(bagging_draws(train, id_col, trees, rows, seed).groupBy("tree").applyInPandas(grow, _BAG_SCHEMA))


def _hash_position(text: str, size: int) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big") % size


def score_bagging(nodes: DataFrame, test: DataFrame, depth: int) -> DataFrame:
    """Mean class-1 share over the trees; `depth` is at most the rows of a tree less one."""
    rows = test.withColumn("__v", vector_to_array("features"))
    return score_by_nodes(rows, nodes, "__v", depth).drop("__v")


def importance_table(spark: SparkSession, model, features: Sequence[str], key: str) -> DataFrame:
    """Feature importances or coefficients, largest first; linear models add a row for the intercept."""
    linear = key in ("LR", "SVM")
    values = model.coefficients if linear else model.featureImportances
    rows = [(f, float(v)) for f, v in zip(features, values.toArray())]
    if linear:
        rows.append(("(intercept)", float(model.intercept)))
    return spark.createDataFrame(rows, "feature string, value double").orderBy(F.desc("value"), "feature")


def tree_table(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """Nodes of a fitted decision tree: split, impurity, class counts and children."""
    path = scratch_path(spark, "tree")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    names = F.array(*[F.lit(f) for f in features])
    leaf = F.col("leftChild") < 0
    inner = F.when(~leaf, F.col("split.featureIndex"))
    return nodes.select(
        "id", F.get(names, inner).alias("feature"),
        F.when(~leaf, F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        "impurity", F.col("rawCount").cast("long").alias("samples"), F.col("impurityStats").alias("class_counts"),
        F.when(~leaf, F.col("leftChild")).alias("left_child"), F.when(~leaf, F.col("rightChild")).alias("right_child"),
        "prediction",
    )


def negative_share(train: DataFrame, label: str) -> Column:
    """Share of class 0 in the training rows, as a scalar subquery."""
    return train.agg(F.avg((F.col(label) == 0).cast("double"))).scalar()


def random_baseline(train: DataFrame, test: DataFrame, label: str, keys: Sequence[str], seed: int) -> DataFrame:
    """1 with the training rows' positive share, drawn repeatably per key."""
    hit = hash_uniform(keys, seed) > negative_share(train, label)
    return test.withColumn("score", hit.cast("double"))


def prior_baseline(test: DataFrame, lagged: str) -> DataFrame:
    """The previous period's label as the score."""
    return test.withColumn("score", F.col(lagged).cast("double"))
