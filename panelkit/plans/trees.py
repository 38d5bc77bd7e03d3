"""Fitted trees as node tables that score rows, in DataFrames and as SQL text.

A node table has one row per node of every tree, with its split, its children and its value: the
share of class 1 for classification trees, the prediction for the regression trees of boosting. Ids
are dense within a tree and the root is 0. As for the model itself, the table must fit a broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import scratch_path, with_row

_FIELDS = ["tree", "id", "feature_index", "feature", "threshold", "left_child", "right_child", "value", "samples", "weight"]


def node_table(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """All nodes of a fitted decision tree, random forest or boosted ensemble."""
    path = scratch_path(spark, "trees")
    model.write().overwrite().save(path)
    saved = spark.read.parquet(f"{path}/data")
    ensemble = "nodeData" in saved.columns
    nodes = saved.select(F.col("treeID").alias("tree"), "nodeData.*") if ensemble else saved.select(F.lit(0).alias("tree"), "*")
    boosted = type(model).__name__.startswith("GBT")
    weights = list(model.treeWeights) if ensemble else [1.0]
    leaf = F.col("leftChild") < 0
    share = F.get("impurityStats", F.lit(1)) / F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    index = F.when(~leaf, F.col("split.featureIndex"))
    return nodes.select(
        F.col("tree").cast("int").alias("tree"), F.col("id").cast("int").alias("id"), index.alias("feature_index"),
        F.get(F.array(*map(F.lit, features)), index).alias("feature"),
        F.when(~leaf, F.get(F.col("split.leftCategoriesOrThreshold"), F.lit(0))).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).alias("left_child"), F.when(~leaf, F.col("rightChild")).alias("right_child"),
        (F.col("prediction") if boosted else F.coalesce(share, F.lit(0.0))).alias("value"),
        F.col("rawCount").cast("long").alias("samples"), F.get(F.array(*map(F.lit, weights)), F.col("tree").cast("int")).alias("weight"),
    ).select(*_FIELDS)


def _combined(values: Column, weights: Column, boosted: bool) -> Column:
    """The score of a row from the values it reached in all trees."""
    if boosted:
        total = F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
        return 1.0 / (1.0 + F.exp(-2.0 * total))
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def score_by_nodes(df: DataFrame, nodes: DataFrame, vector: str, depth: int, boosted: bool = False, name: str = "score") -> DataFrame:
    """Add each row's score by walking down every tree; `vector` is an array of the features, `depth` the greatest one."""
    fields = F.struct("id", "feature_index", "threshold", "left_child", "right_child", "value")
    trees = nodes.groupBy("tree", "weight").agg(F.array_sort(F.collect_list(fields)).alias("nodes"))
    forest = trees.agg(F.array_sort(F.collect_list(F.struct("tree", "nodes", "weight"))).alias("trees"))
    x = F.col(vector)

    def walk(tree: Column) -> Column:
        at = tree["nodes"]

        def down(node: Column, _: Column) -> Column:
            to = F.when(F.get(x, node["feature_index"]) <= node["threshold"], node["left_child"]).otherwise(node["right_child"])
            return F.when(node["left_child"].isNull(), node).otherwise(F.get(at, to))

        return F.aggregate(F.array_repeat(F.lit(0), depth), F.get(at, F.lit(0)), down)["value"]

    rows = with_row(df, forest, "__forest")
    all_trees = F.col("__forest")["trees"]
    score = _combined(F.transform(all_trees, walk), F.transform(all_trees, lambda t: t["weight"]), boosted)
    return rows.withColumn(name, score).drop("__forest")


def path_sql(nodes: DataFrame, boosted: bool = False) -> str:
    """A SQL expression over the feature columns that gives the score; for models small enough to be read as text."""
    trees: dict = {}
    for r in nodes.collect():
        trees.setdefault((r["tree"], r["weight"]), {})[r["id"]] = r

    def case(tree: dict, at: int) -> str:
        node = tree[at]
        if node["left_child"] is None:
            return f"{node['value']!r}::DOUBLE"
        left, right = (case(tree, node[side]) for side in ("left_child", "right_child"))
        return f'CASE WHEN "{node["feature"]}" <= {node["threshold"]!r} THEN {left} ELSE {right} END'

    cases = [(weight, case(tree, 0)) for (_, weight), tree in sorted(trees.items())]
    if boosted:
        return "1 / (1 + exp(-2 * (" + " + ".join(f"{w!r} * ({c})" for w, c in cases) + ")))"
    return "(" + " + ".join(f"({c})" for _, c in cases) + f") / {len(cases)}"
