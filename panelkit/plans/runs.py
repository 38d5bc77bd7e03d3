"""Model runs over splits, feature sets, labels and parameters, and the phased selection."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions.scalars import year_start
from panelkit.operators.clean import fill_median_halves
from panelkit.operators.fairness import audit_input
from panelkit.operators.metrics import TOP_PERCENTS, metrics_at_k, pr_curve, roc_auc
from panelkit.plans.models import (
    GRIDS,
    assemble,
    fit_score,
    importance_table,
    parameter_grid,
    prior_baseline,
    random_baseline,
    tree_table,
)
from panelkit.plans.splits import Split, apply_split, rolling_splits
from panelkit.session import scratch_path
from panelkit.sources.files import write_csv

BASELINES = ("BASELINE_RAND", "BASELINE_PRIOR")
# Most rows that a partition of the cached training rows is meant to hold.
PART_ROWS = 250_000

# The models of each phase, its grid, and whether only the latest split is run.
PHASES = [
    {"name": "phase1", "models": ["RF", "LR", "NB", "GB", "BAG", "KNN", "DT", "BASELINE_DT"], "grid": 0, "latest": False},
    {"name": "phase2", "models": ["RF", "GB", "BASELINE_DT"], "grid": 1, "latest": False},
    {"name": "phase3", "models": ["RF", "BASELINE_DT"], "grid": 2, "latest": True},
]

_SPAN = "struct<start:date,end:date>"
_AT = [f"{m}_at_{k}" for m in ("p", "r", "f1") for k in TOP_PERCENTS]
RESULT_SCHEMA = (
    f"training_dates {_SPAN}, testing_dates {_SPAN}, model_key string, classifier string, "
    "parameters map<string,string>, feature_sets array<string>, outcome string, model_result string, auc_roc double, "
    + ", ".join(f"{c} double" for c in _AT)
)


class Ledger:
    """Results of finished runs, one stored row each under the hash of all that decides it.

    A row is visible only when its write is committed, and each has a folder of its own, so runs may
    finish side by side and a batch that was stopped goes on where it was.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """All stored results with their `run` hash."""
        schema = f"{RESULT_SCHEMA}, run string"
        try:
            return self.spark.read.schema(schema).parquet(self.path)
        except AnalysisException:  # nothing is stored yet
            return self.spark.createDataFrame([], schema)

    def finished(self) -> set[str]:
        """Hashes of the runs that need not be made again; failed ones are."""
        failed = F.coalesce(F.col("model_result").startswith("failed:"), F.lit(False))
        return {r["run"] for r in self.rows().where(~failed).select("run").collect()}

    def add(self, run: str, row: tuple) -> None:
        frame = self.spark.createDataFrame([row], RESULT_SCHEMA)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={run}")


@dataclass(frozen=True)
class Run:
    """One row of the run plan."""

    split: Split
    labels: tuple[str, ...]
    features: tuple[str, ...]
    outcome: str
    model: str
    params: dict = field(hash=False)

    def key(self, *context) -> str:
        """Hash of the run and of what else decides its result."""
        spans = [str(d) for d in (self.split.train_start, self.split.train_end, self.split.test_start, self.split.test_end)]
        text = json.dumps([spans, self.labels, self.features, self.outcome, self.model, sorted(self.params.items()), context], default=str)
        return hashlib.md5(text.encode()).hexdigest()


def plan_runs(
    splits: Sequence[Split], feature_subsets: Sequence[Mapping], outcomes: Sequence[str], models: Sequence[str],
    grid: int,
) -> list[Run]:
    """Every combination, in split, outcome, feature set, model, parameter order."""
    return [
        Run(s, tuple(f["labels"]), tuple(f["features"]), y, m, p)
        for s in splits for y in outcomes for f in feature_subsets for m in models
        for p in ([{}] if m in BASELINES else parameter_grid(GRIDS[m][grid]))
    ]


def plan_frame(spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
    rows = [
        (i, r.split.train_start, r.split.train_end, r.split.test_start, r.split.test_end, r.model,
         {k: str(v) for k, v in r.params.items()}, list(r.labels), r.outcome)
        for i, r in enumerate(runs)
    ]
    return spark.createDataFrame(
        rows, "run int, train_start date, train_end date, test_start date, test_end date, model_key string, "
        "parameters map<string,string>, feature_sets array<string>, outcome string",
    )


def score_metrics(scored: DataFrame, key: str) -> dict:
    """All 22 metrics of one scored test set; a single aggregated row reaches the driver."""
    at_k = metrics_at_k(scored, "score", "label", key)
    wide = at_k.agg(*[
        F.max(F.when(F.col("k") == k, F.col(column))).alias(f"{short}_at_{k}")
        for short, column in (("p", "precision"), ("r", "recall"), ("f1", "f1")) for k in TOP_PERCENTS
    ])
    row = wide.select("*", roc_auc(scored, "score", "label").select("auc").scalar().alias("auc_roc")).first()
    return row.asDict()


def store_outputs(
    path: str, run: Run, model, scored: DataFrame, features: DataFrame, bias_attributes: Sequence[str],
    keys: Sequence[str],
) -> None:
    """Write what the final phase reports about one run."""
    spark = scored.sparkSession
    if model is None:
        pass
    elif run.model in ("DT", "BASELINE_DT"):
        tree_table(spark, model, run.features).write.mode("overwrite").parquet(f"{path}/tree")
    elif run.model in ("RF", "GB", "LR", "SVM"):
        write_csv(importance_table(spark, model, run.features, run.model), f"{path}/importance")
    write_csv(pr_curve(scored, "score", "label"), f"{path}/pr_curve")
    analysis = features.join(scored, "__id")
    named = analysis.select(*keys, *[c for c in analysis.columns if c != "__id" and c not in keys])
    write_csv(named.withColumnRenamed("label", "label_value"), f"{path}/feature_analysis")
    if bias_attributes:
        write_csv(audit_input(analysis, bias_attributes, "label", "score"), f"{path}/bias")


def run_models(
    panel: DataFrame, runs: Sequence[Run], entity: str, period: str, seed: int = 0, parallel: int = 2,
    output: str | None = None, bias_attributes: Sequence[str] = (), ledger: str | None = None,
) -> DataFrame:
    """Fit and score every planned run; one result row each.

    Results are stored in the `ledger` folder as they come (a fresh one if none is given), so nothing
    is held on the driver, and runs that it already has for the same plan and seed are not made
    again. Give the same ledger only for the same panel. A query that Spark rejects stops the batch.

    With `output`, every fitted run also stores its importances or tree, its precision-recall table,
    the scored features by entity and period, and (runs with all feature sets) the binned audit input.
    Training rows of one class are not fitted: every test row gets that class as its score. A run that
    fails is recorded with null metrics and the reason as its model_result; the others go on.

    Rows of one split and outcome are filtered, filled and cached once with the union of the columns
    their runs need; a feature set is then only a different vector over the cached columns. Spark
    does the fitting; the threads only submit jobs. Give it a stored panel: it is read per split.
    """
    spark = panel.sparkSession
    dated = panel.withColumn("__date", year_start(period)).withColumn("__id", F.to_json(F.struct(entity, period)))
    widest = max((len(r.labels) for r in runs if r.model not in BASELINES), default=0)
    groups: dict = {}
    for r in runs:
        groups.setdefault((r.split, r.outcome), []).append(r)
    book = Ledger(spark, ledger or scratch_path(spark, "ledger"))
    position = {id(r): i for i, r in enumerate(runs)}
    keys = {id(r): r.key(entity, period, seed) for r in runs}
    finished = book.finished() if ledger else set()
    # Every fit reads its rows many times over; a small stored panel has fewer partitions than there are cores.
    parts = max(spark.sparkContext.defaultParallelism, -(-panel.count() // PART_ROWS))
    for (split, outcome), members in groups.items():
        members = [r for r in members if keys[id(r)] not in finished]
        if not members:
            continue
        needed = list(dict.fromkeys(f for r in members for f in r.features))
        lag = [f"{outcome}_lag"] if any(r.model == "BASELINE_PRIOR" for r in members) else []
        columns = list(dict.fromkeys(["__id", entity, period, outcome, *needed, *lag]))
        train, test = apply_split(dated, split, "__date", outcome, columns)
        train, test = (half.repartition(parts, "__id").cache() for half in fill_median_halves(train, test, needed))
        n_train, ones = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col(outcome).cast("long")), F.lit(0))).first()
        spans = (split.train_start, split.train_end), (split.test_start, split.test_end)

        def record(r: Run, model, stored: str | None, m: Mapping) -> None:
            book.add(keys[id(r)], (
                *spans, r.model, type(model).__name__ if model is not None else r.model,
                {k: str(v) for k, v in r.params.items()}, list(r.labels), outcome, stored, m.get("auc_roc"),
                *[m.get(c) for c in _AT],
            ))

        def one(r: Run):
            try:
                fit(r)
            except AnalysisException:  # a wrong column or type is the caller's mistake in every run
                raise
            except Exception as e:  # the run is recorded as failed
                record(r, None, f"failed: {type(e).__name__}: {str(e)[:200]}", {})

        def fit(r: Run):
            model = None
            if r.model == "BASELINE_RAND":
                scored = random_baseline(train, test, outcome, ["__id"], seed)
                scored = scored.withColumnRenamed(outcome, "label")
            elif r.model == "BASELINE_PRIOR":
                scored = prior_baseline(test, lag[0]).withColumnRenamed(outcome, "label")
            elif ones in (0, n_train):
                scored = test.select("__id", F.col(outcome).cast("int").alias("label"), F.lit(float(ones > 0)).alias("score"))
            else:
                a, b = (assemble(df, r.features, outcome, ["__id"]) for df in (train, test))
                model, scored = fit_score(r.model, r.params, a, b, "__id", n_train, seed)
            scored = scored.select("__id", "label", "score").cache()
            m = score_metrics(scored, "__id")
            stored = None
            if output and r.model not in BASELINES:
                stored = f"{output}/{r.model}{position[id(r)]}"
                audited = bias_attributes if len(r.labels) == widest and set(bias_attributes) <= set(r.features) else ()
                shown = list(dict.fromkeys(["__id", entity, period, *r.features]))
                store_outputs(stored, r, model, scored, test.select(*shown), audited, [entity, period])
            scored.unpersist()
            record(r, model, stored, m)

        with ThreadPoolExecutor(max_workers=parallel) as pool:
            list(pool.map(one, members))
        train.unpersist()
        test.unpersist()
    wanted = spark.createDataFrame([(keys[id(r)],) for r in runs], "run string").distinct()
    return book.rows().join(wanted, "run", "left_semi").drop("run")


def run_phase(
    panel: DataFrame, phase: Mapping, start: dt.date, end: dt.date, window: int | Sequence[int], feature_subsets: Sequence[Mapping],
    outcomes: Sequence[str], entity: str, period: str, seed: int = 0, parallel: int = 2,
    output: str | None = None, bias_attributes: Sequence[str] = (), ledger: str | None = None,
) -> DataFrame:
    """One phase: its models over all splits of every window and all feature sets, then the two baselines."""
    windows = [window] if isinstance(window, int) else window
    splits = [s for w in windows for s in rolling_splits(start, end, w, phase["latest"])]
    runs = plan_runs(splits, feature_subsets, outcomes, phase["models"], phase["grid"])
    prior = [{"labels": ["prior_year"], "features": [f"{y}_lag" for y in outcomes]}]
    runs += plan_runs(splits, prior, outcomes, BASELINES, phase["grid"])
    out = output if phase["latest"] else None
    return run_models(panel, runs, entity, period, seed, parallel, out, bias_attributes, ledger)


def run_phases(panel: DataFrame, phases: Sequence[Mapping] = PHASES, **kwargs) -> DataFrame:
    """All phases in turn, each tagged with its name."""
    out = None
    for phase in phases:
        one = run_phase(panel, phase, **kwargs).select(F.lit(phase["name"]).alias("phase"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def best_parameters(results: DataFrame, metric: str, n: int, outcome: str) -> DataFrame:
    """All rows of the outcome whose parameter set is among its top n rows by the metric."""
    mine = results.where(F.col("outcome") == outcome)
    params = F.to_json("parameters") if dict(results.dtypes)["parameters"].startswith("map") else F.col("parameters")
    mine = mine.withColumn("__p", params)
    best = mine.orderBy(F.col(metric).desc(), "model_key", "__p").limit(n).select("__p").distinct()
    return mine.join(F.broadcast(best), "__p", "left_semi").drop("__p")
