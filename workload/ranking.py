"""Ranked lists, splits, metrics and the fairness audit."""

from pyspark.sql import functions as F

from panelkit.operators.fairness import (
    audit_input,
    attribute_verdict,
    disparities,
    group_crosstab,
    parity_flags,
)
from panelkit.operators.labels import lagged_labels
from panelkit.operators.metrics import (
    TOP_PERCENTS,
    accuracy,
    confusion_counts,
    confusion_matrix,
    flag_top,
    metrics_at_k,
    pr_curve,
    roc_auc,
)
from panelkit.operators.order import assign_ranks, top_rows, top_share
from panelkit.operators.panel import period_bounds
from panelkit.plans.catalogue import subset_table
from panelkit.plans.models import prior_baseline, random_baseline
from panelkit.plans.runs import best_parameters, plan_frame, plan_runs
from panelkit.plans.splits import apply_split, hash_folds, hash_split, rolling_splits, split_counts, splits_frame, tag_splits
from panelkit.functions.scalars import year_start
from panelkit.session import materialise
from panelkit.sources.files import table
from workload.base import CY, LABELS, customer_years, many_ranges, query, rounded
from workload.panel import MEASURES, labelled

SCORED = f"""SELECT a.custkey, a.year, a.top20 AS label, b.n_orders * 3 + b.urgent AS score, a.n_orders, a.urgent, a.finished, b.top20 AS lagged
 FROM ({LABELS}) a JOIN ({LABELS}) b ON a.custkey = b.custkey AND b.year = a.year - 1"""


def scored(spark, folder):
    """Labelled customer-years with last year's order counts as a (heavily tied) score."""
    rows = labelled(spark, folder, MEASURES)
    rows = lagged_labels(rows, ["n_orders", "urgent", "top20"], "custkey", "year")
    rows = rows.where(F.col("top20_lag").isNotNull())
    return rows.select(
        "custkey", "year", F.col("top20").alias("label"), (F.col("n_orders_lag") * 3 + F.col("urgent_lag")).alias("score"),
        "n_orders", "urgent", "finished", F.col("top20_lag").alias("lagged"),
    )


# --- top lists

@query("top_pct", """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER () AS n
 FROM orders) WHERE rn <= floor(n * 0.2)""")
def top_pct(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return top_share(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 0.2)


@query("top_pct_large", """SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER () AS n
 FROM orders) WHERE rn <= floor(n * 0.2)""")
def top_pct_large(spark, folder):
    with many_ranges(spark):
        return top_pct(spark, folder)


@query("top_pct_compare", """WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, (SELECT count(*) FROM customer) AS n FROM customer),
 a AS (SELECT c_nationkey, count(*) AS num FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM c) WHERE rn <= floor(n * 0.2) GROUP BY 1),
 b AS (SELECT c_nationkey, count(*) AS rate FROM (SELECT *, row_number() OVER (ORDER BY c_acctbal / (c_nationkey + 1) DESC, c_custkey) AS rn FROM c) WHERE rn <= floor(n * 0.2) GROUP BY 1)
 SELECT c_nationkey, num, rate FROM a LEFT JOIN b USING (c_nationkey)""")
def top_pct_compare(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    customers = customers.withColumn("rate", F.col("c_acctbal") / (F.col("c_nationkey") + 1))
    a = top_share(customers, [F.col("c_acctbal").desc(), "c_custkey"], 0.2).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("num"))
    b = top_share(customers, [F.col("rate").desc(), "c_custkey"], 0.2).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rate"))
    return a.join(b, "c_nationkey", "left")


@query("first_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 21")
def first_n(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return top_rows(orders, [F.col("o_totalprice").desc(), "o_orderkey"], 21)


@query("joint_sort", f"WITH s AS ({SCORED}) SELECT custkey, year, score, label, row_number() OVER (ORDER BY score DESC, custkey, year) AS position FROM s")
def joint_sort(spark, folder):
    rows = scored(spark, folder).select("custkey", "year", "score", "label")
    return assign_ranks(rows, [F.col("score").desc(), "custkey", "year"], name="position")


# Results-like table: one row per brand, type and size class with a metric.
RESULTS = """SELECT p_brand AS model_key, p_type AS parameters, CASE WHEN p_size % 2 = 0 THEN 'top20_num' ELSE 'e_num_inc_20pct' END AS outcome,
 CAST(count(*) AS BIGINT) AS runs, max(p_retailprice) AS metric FROM part GROUP BY 1, 2, 3"""


def results(spark, folder):
    parts = table(spark, folder, "part")
    outcome = F.when(F.col("p_size") % 2 == 0, "top20_num").otherwise("e_num_inc_20pct")
    return parts.groupBy(F.col("p_brand").alias("model_key"), F.col("p_type").alias("parameters"), outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("runs"), F.max("p_retailprice").alias("metric"))


def _best(outcome, n=3):
    return f"""SELECT DISTINCT parameters FROM (SELECT * FROM ({RESULTS}) WHERE outcome = '{outcome}'
 ORDER BY metric DESC, model_key, parameters LIMIT {n})"""


@query("best_params", f"SELECT * FROM ({RESULTS}) WHERE outcome = 'top20_num' AND parameters IN ({_best('top20_num')})")
def best_params(spark, folder):
    return best_parameters(results(spark, folder), "metric", 3, "top20_num")


def _best_names(spark, folder, outcome):
    return best_parameters(results(spark, folder), "metric", 3, outcome).select("parameters").distinct()


@query("param_intersect", f"{_best('top20_num')} INTERSECT {_best('e_num_inc_20pct')}")
def param_intersect(spark, folder):
    return _best_names(spark, folder, "top20_num").intersect(_best_names(spark, folder, "e_num_inc_20pct"))


@query("param_except", f"""SELECT 'first' AS side, parameters FROM ({_best('top20_num')} EXCEPT {_best('e_num_inc_20pct')})
 UNION ALL SELECT 'second', parameters FROM ({_best('e_num_inc_20pct')} EXCEPT {_best('top20_num')})""")
def param_except(spark, folder):
    a, b = _best_names(spark, folder, "top20_num"), _best_names(spark, folder, "e_num_inc_20pct")
    left = a.subtract(b).select(F.lit("first").alias("side"), "parameters")
    return left.unionByName(b.subtract(a).select(F.lit("second").alias("side"), "parameters"))


@query("many_to_many_merge", f"""SELECT p_partkey, model_key, parameters, outcome, runs, metric FROM
 (SELECT p_partkey, p_brand AS model_key, p_type AS parameters FROM part) l JOIN ({RESULTS}) r USING (model_key, parameters)""")
def many_to_many_merge(spark, folder):
    """Several parts on the one side, the results of both outcomes on the other."""
    rows = table(spark, folder, "part").select(
        "p_partkey", F.col("p_brand").alias("model_key"), F.col("p_type").alias("parameters"))
    return rows.join(results(spark, folder), ["model_key", "parameters"])


@query("panel_label_join", f"SELECT p.custkey, p.year, p.urgent, l.top20 FROM ({CY}) p JOIN ({LABELS}) l USING (custkey, year)")
def panel_label_join(spark, folder):
    panel = customer_years(spark, folder).select("custkey", "year", "urgent")
    return panel.join(labelled(spark, folder), ["custkey", "year"])


# --- splits and plans

_SPLITS = """WITH b AS (SELECT make_date(CAST(min(year(o_orderdate)) AS INTEGER), 1, 1) AS s, make_date(CAST(max(year(o_orderdate)) AS INTEGER) + 1, 1, 1) AS e FROM orders),
 sp AS (SELECT CAST(i - 1 AS INTEGER) AS split, s AS train_start, CAST(s + to_months(CAST(12 * i AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS train_end,
 CAST(s + to_months(CAST(12 * i AS INTEGER)) AS DATE) AS test_start, CAST(s + to_months(CAST(12 * i + 12 AS INTEGER)) - INTERVAL 1 DAY AS DATE) AS test_end, e
 FROM b, range(1, 40) r(i))"""


def data_splits(spark, folder, latest=False):
    import datetime as dt

    years = table(spark, folder, "orders").select(F.year("o_orderdate").alias("year"))
    first, last = period_bounds(years, "year")
    return rolling_splits(dt.date(first, 1, 1), dt.date(last + 1, 1, 1), 12, latest)


@query("temporal_splits", _SPLITS + " SELECT split, train_start, train_end, test_start, test_end FROM sp WHERE test_end <= e")
def temporal_splits(spark, folder):
    return splits_frame(spark, data_splits(spark, folder))


@query("latest_split", _SPLITS + """ SELECT CAST(0 AS INTEGER) AS split, train_start, CAST(e - INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS train_end,
 CAST(e - INTERVAL 12 MONTH AS DATE) AS test_start, CAST(e - INTERVAL 1 DAY AS DATE) AS test_end FROM sp WHERE split = 0""")
def latest_split(spark, folder):
    return splits_frame(spark, data_splits(spark, folder, latest=True))


@query("split_counts", _SPLITS + f""", l AS (SELECT make_date(year, 1, 1) AS d, top20 FROM ({LABELS}))
 SELECT split, 'train' AS role, count(*) AS n, CAST(sum(top20) AS BIGINT) AS pos FROM sp JOIN l ON d BETWEEN train_start AND train_end WHERE test_end <= e GROUP BY 1
 UNION ALL SELECT split, 'test', count(*), CAST(sum(top20) AS BIGINT) FROM sp JOIN l ON d BETWEEN test_start AND test_end WHERE test_end <= e GROUP BY 1""")
def q_split_counts(spark, folder):
    rows = labelled(spark, folder).withColumn("d", year_start("year"))
    return split_counts(rows, "d", "top20", data_splits(spark, folder))


@query("split_rows", _SPLITS + f""", l AS (SELECT custkey, make_date(year, 1, 1) AS d FROM ({LABELS}))
 SELECT custkey, d, split, CASE WHEN d <= train_end THEN 'train' ELSE 'test' END AS role FROM sp JOIN l ON d BETWEEN train_start AND test_end WHERE test_end <= e""")
def split_rows(spark, folder):
    rows = labelled(spark, folder).select("custkey", year_start("year").alias("d"))
    return tag_splits(rows, "d", data_splits(spark, folder))


# Fixed to the data: the last split tests on the last year.
LAST_YEAR = "(SELECT max(year(o_orderdate)) FROM orders)"


def last_split(spark, folder):
    return data_splits(spark, folder, latest=True)[0]


@query("apply_split", f"""SELECT CASE WHEN year < {LAST_YEAR} THEN 'train' ELSE 'test' END AS half, custkey, year, top20 FROM ({LABELS})""")
def q_apply_split(spark, folder):
    rows = labelled(spark, folder).withColumn("d", year_start("year"))
    halves = apply_split(rows, last_split(spark, folder), "d", "top20", ["custkey", "year", "top20"])
    train, test = (h.select(F.lit(name).alias("half"), "*") for name, h in zip(("train", "test"), halves))
    return train.unionByName(test)


def split_halves(spark, folder, rows):
    """Labelled rows of the last split: before its test year, and in it."""
    year = last_split(spark, folder).test_start.year
    return rows.where(F.col("year") < year), rows.where(F.col("year") == year)


@query("feature_subsets", """WITH s AS (SELECT r_regionkey AS position, r_name AS name, list(n_name ORDER BY n_nationkey) AS features
 FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2),
 m AS (SELECT CAST(i AS INTEGER) AS subset FROM range(1, 32) r(i))
 SELECT subset, string_agg(name, '+' ORDER BY position) AS labels, CAST(sum(len(features)) AS INTEGER) AS n_features
 FROM m JOIN s ON (subset >> position) & 1 = 1 GROUP BY 1""")
def feature_subsets(spark, folder):
    joined = table(spark, folder, "region").join(table(spark, folder, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    sets = joined.groupBy(F.col("r_regionkey").alias("position"), F.col("r_name").alias("name")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("features"))
    out = subset_table(sets)
    return out.select("subset", F.array_join("labels", "+").alias("labels"), F.size("features").alias("n_features"))


_GRID_RUNS = {"RF": 2 * 3 * 2 * 2, "GB": 2 * 2 * 2 * 1, "BASELINE_DT": 1}


@query("run_plan", _SPLITS + " SELECT model_key, outcome, train_end, CAST(per * 15 AS BIGINT) AS runs FROM sp, (VALUES "
       + ", ".join(f"('{m}', {n})" for m, n in _GRID_RUNS.items())
       + ") g(model_key, per), (VALUES ('top20_num'), ('e_num_inc_20pct')) y(outcome) WHERE test_end <= e")
def run_plan(spark, folder):
    from panelkit.plans.catalogue import feature_sets, subsets

    runs = plan_runs(data_splits(spark, folder), subsets(feature_sets()), ["top20_num", "e_num_inc_20pct"],
                     ["RF", "GB", "BASELINE_DT"], 1)
    return plan_frame(spark, runs).groupBy("model_key", "outcome", "train_end").agg(F.count(F.lit(1)).alias("runs"))


_U = "(CAST('0x' || substr(md5(CAST(custkey AS VARCHAR) || '|' || CAST(year AS VARCHAR) || '|{seed}'), 1, 12) AS BIGINT) / 281474976710656.0)"


@query("hash_split", f"SELECT custkey, year, CASE WHEN {_U.format(seed=7)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM ({CY})")
def q_hash_split(spark, folder):
    return hash_split(customer_years(spark, folder), ["custkey", "year"], 7).select("custkey", "year", "part")


@query("hash_folds", f"SELECT custkey, year, CAST(floor({_U.format(seed=3)} * 10) AS INTEGER) AS fold FROM ({CY})")
def q_hash_folds(spark, folder):
    return hash_folds(customer_years(spark, folder), ["custkey", "year"], 3, 10).select("custkey", "year", "fold")


# --- metrics

METRICS = f"WITH s AS ({SCORED}), r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY score DESC, custkey) AS rn, count(*) OVER (PARTITION BY year) AS n FROM s), " + \
    "k AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({k} AS DOUBLE))" for k in TOP_PERCENTS) + ") t(k)), " + \
    """c AS (SELECT year, k, CAST(floor(max(n) * (k / 100.0)) AS BIGINT) AS cutoff, CAST(sum(label) AS BIGINT) AS pos,
 CAST(coalesce(sum(label) FILTER (WHERE rn <= floor(n * (k / 100.0))), 0) AS BIGINT) AS hits FROM r, k GROUP BY year, k)
 SELECT year, k, cutoff, hits, round(coalesce(CAST(hits AS DOUBLE) / nullif(cutoff, 0), 0), 6) AS precision,
 round(coalesce(CAST(hits AS DOUBLE) / nullif(pos, 0), 0), 6) AS recall,
 round(coalesce(CAST(2 * hits AS DOUBLE) / nullif(cutoff + pos, 0), 0), 6) AS f1 FROM c"""


@query("metrics_at_k", METRICS)
def q_metrics_at_k(spark, folder):
    # The scored rows are read for the number, the ranges and the ranks, so they are written once first.
    out = metrics_at_k(materialise(scored(spark, folder)), "score", "label", "custkey", by="year")
    return rounded(out, "precision", "recall", "f1")


@query("metrics_at_k_large", METRICS)
def metrics_at_k_large(spark, folder):
    with many_ranges(spark):
        return q_metrics_at_k(spark, folder)


AUC = f"""WITH s AS ({SCORED}), r AS (SELECT year, label, rank() OVER (PARTITION BY year ORDER BY score)
 + (count(*) OVER (PARTITION BY year, score) - 1) / 2.0 AS avg_rank FROM s)
 SELECT year, round((sum(CASE WHEN label = 1 THEN CAST(avg_rank AS DOUBLE) END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * sum(1 - label)), 6) AS auc
 FROM r GROUP BY year"""


@query("roc_auc", AUC)
def q_roc_auc(spark, folder):
    return rounded(roc_auc(scored(spark, folder), "score", "label", "year"), "auc")


@query("roc_auc_large", AUC)
def roc_auc_large(spark, folder):
    with many_ranges(spark):
        return q_roc_auc(spark, folder)


CURVE = f"""WITH s AS ({SCORED}) SELECT CAST(t.score AS BIGINT) AS threshold, round(CAST(sum(label) AS DOUBLE) / count(*), 6) AS precision,
 round(CAST(sum(label) AS DOUBLE) / (SELECT sum(label) FROM s), 6) AS recall,
 round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM s), 6) AS pct_above
 FROM (SELECT DISTINCT score FROM s) t JOIN s ON s.score >= t.score GROUP BY t.score"""


@query("pr_curve", CURVE)
def q_pr_curve(spark, folder):
    out = pr_curve(scored(spark, folder), "score", "label")
    return rounded(out, "precision", "recall", "pct_above")


@query("pr_curve_large", CURVE)
def pr_curve_large(spark, folder):
    with many_ranges(spark):
        return q_pr_curve(spark, folder)


@query("confusion", f"""WITH s AS ({SCORED}) SELECT count(*) FILTER (WHERE label = 1 AND lagged = 1) AS tp, count(*) FILTER (WHERE label = 0 AND lagged = 1) AS fp,
 count(*) FILTER (WHERE label = 1 AND lagged = 0) AS fn, count(*) FILTER (WHERE label = 0 AND lagged = 0) AS tn,
 round(avg(CAST(label = lagged AS DOUBLE)), 6) AS accuracy,
 round(CAST(count(*) FILTER (WHERE label = 1 AND lagged = 1) AS DOUBLE) / nullif(count(*) FILTER (WHERE lagged = 1), 0), 6) AS precision FROM s""")
def confusion(spark, folder):
    return rounded(confusion_counts(scored(spark, folder), "label", "lagged"), "accuracy", "precision")


@query("confusion_matrix", f"""WITH s AS ({SCORED}) SELECT label, count(*) FILTER (WHERE lagged = 0) AS "0", count(*) FILTER (WHERE lagged = 1) AS "1" FROM s GROUP BY 1""")
def q_confusion_matrix(spark, folder):
    return confusion_matrix(scored(spark, folder), "label", "lagged", [0, 1])


@query("accuracy_by_year", f"WITH s AS ({SCORED}) SELECT year, round(avg(CAST(label = lagged AS DOUBLE)), 6) AS accuracy FROM s GROUP BY 1")
def accuracy_by_year(spark, folder):
    return rounded(accuracy(scored(spark, folder), "label", "lagged", "year"), "accuracy")


@query("baseline_prior", f"WITH s AS ({SCORED}) SELECT custkey, year, label, CAST(lagged AS DOUBLE) AS score FROM s WHERE year = {LAST_YEAR}")
def baseline_prior(spark, folder):
    test = split_halves(spark, folder, scored(spark, folder).drop("score"))[1]
    return prior_baseline(test, "lagged").select("custkey", "year", "label", "score")


@query("baseline_rand", f"""WITH s AS ({SCORED}) SELECT custkey, year, label, CAST({_U.format(seed=5)} > (SELECT avg(CAST(label = 0 AS DOUBLE)) FROM s WHERE year < {LAST_YEAR}) AS DOUBLE) AS score
 FROM s WHERE year = {LAST_YEAR}""")
def baseline_rand(spark, folder):
    rows = scored(spark, folder).drop("score")
    train, test = split_halves(spark, folder, rows)
    return random_baseline(train, test, "label", ["custkey", "year"], 5).select("custkey", "year", "label", "score")


# --- fairness

ATTRS = ["n_orders", "urgent", "finished"]
_LABEL = "['low', 'med-low', 'med-high', 'high']"


def _bin(c):
    steps = " + ".join(f"CAST({c} > lo_{c} + {i} * ((hi_{c} - lo_{c}) / 4) AS INTEGER)" for i in (1, 2, 3))
    return f"{_LABEL}[1 + {steps}] AS {c}_bins"


AUDIT = f"""WITH s AS (SELECT * FROM ({SCORED}) WHERE year = {LAST_YEAR}), e AS (SELECT
 {', '.join(f'CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}' for c in ATTRS)} FROM s),
 audit AS (SELECT custkey, {', '.join(_bin(c) for c in ATTRS)}, label AS label_value, score FROM s, e)"""


def audit_rows(spark, folder):
    # Scores are read for the bin ends, the cutoff and the counts, so they are written once first.
    rows = materialise(split_halves(spark, folder, scored(spark, folder))[1])
    return audit_input(rows, ATTRS, "label", "score", ["custkey"])


@query("audit_input", AUDIT + " SELECT * FROM audit")
def q_audit_input(spark, folder):
    return audit_rows(spark, folder)


FLAGGED = AUDIT + ", flagged AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, custkey) <= 150 AS INTEGER) AS pred FROM audit)"


def flagged(spark, folder):
    return flag_top(audit_rows(spark, folder), "score", "custkey", 150)


@query("predicted_flag", FLAGGED + " SELECT custkey, score, pred FROM flagged")
def predicted_flag(spark, folder):
    return flagged(spark, folder).select("custkey", "score", "pred")


@query("feature_analysis", f"""WITH s AS (SELECT * FROM ({SCORED}) WHERE year = {LAST_YEAR})
 SELECT custkey, n_orders, urgent, finished, label AS label_value, score FROM s""")
def feature_analysis(spark, folder):
    rows = split_halves(spark, folder, scored(spark, folder))[1]
    predictions = rows.select("custkey", F.col("label").alias("label_value"), "score")
    return rows.select("custkey", *ATTRS).join(predictions, "custkey")


_XTAB = FLAGGED + ", long AS (" + " UNION ALL ".join(
    f"SELECT '{c}_bins' AS attribute_name, {c}_bins AS attribute_value, label_value AS y, pred AS p FROM flagged" for c in ATTRS) + """),
 x AS (SELECT attribute_name, attribute_value, count(*) FILTER (WHERE p = 1) AS pp, count(*) FILTER (WHERE p = 0) AS pn,
 count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn,
 count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0) AS group_label_neg, count(*) FILTER (WHERE y = 1) AS group_label_pos,
 count(*) AS group_size, (SELECT count(*) FROM flagged WHERE pred = 1) AS k, (SELECT count(*) FROM flagged) AS total_entities FROM long GROUP BY 1, 2),
 xtab AS (SELECT *, CAST(pp AS DOUBLE) / nullif(k, 0) AS ppr, CAST(pp AS DOUBLE) / nullif(group_size, 0) AS pprev,
 CAST(tp AS DOUBLE) / nullif(group_label_pos, 0) AS tpr, CAST(tn AS DOUBLE) / nullif(group_label_neg, 0) AS tnr,
 CAST(fp AS DOUBLE) / nullif(group_label_neg, 0) AS fpr, CAST(fn AS DOUBLE) / nullif(group_label_pos, 0) AS fnr,
 CAST(fn AS DOUBLE) / nullif(pn, 0) AS "for", CAST(fp AS DOUBLE) / nullif(pp, 0) AS fdr, CAST(tn AS DOUBLE) / nullif(pn, 0) AS npv,
 CAST(tp AS DOUBLE) / nullif(pp, 0) AS precision, CAST(group_label_pos AS DOUBLE) / group_size AS prev FROM x)"""
_RATES = ["ppr", "pprev", "tpr", "tnr", "fpr", "fnr", "for", "fdr", "npv", "precision", "prev"]
_COUNTS = ["pp", "pn", "fp", "fn", "tn", "tp", "group_label_neg", "group_label_pos", "group_size", "k", "total_entities"]


def crosstab(spark, folder):
    return group_crosstab(flagged(spark, folder), [f"{c}_bins" for c in ATTRS], "label_value", "pred")


@query("group_crosstab", _XTAB + f" SELECT attribute_name, attribute_value, {', '.join(_COUNTS)}, "
       + ", ".join(f'round("{m}", 6) AS "{m}"' for m in _RATES) + " FROM xtab")
def q_group_crosstab(spark, folder):
    return rounded(crosstab(spark, folder), *_RATES)


_REFS = {"n_orders_bins": "low", "urgent_bins": "high", "finished_bins": "low"}
_DISP = ["ppr", "pprev", "precision", "fdr", "for", "fpr", "fnr", "tpr", "tnr", "npv"]
_DISPARITY = _XTAB + ", ref AS (SELECT * FROM xtab WHERE " + " OR ".join(
    f"(attribute_name = '{a}' AND attribute_value = '{v}')" for a, v in _REFS.items()) + """),
 disp AS (SELECT x.attribute_name, x.attribute_value, r.attribute_value AS ref_group_value, """ + ", ".join(
    f"""CASE WHEN r."{m}" <> 0 THEN x."{m}" / r."{m}" WHEN r."{m}" = 0 AND x."{m}" > 0 THEN 10.0 END AS {m}_disparity""" for m in _DISP) + \
    " FROM xtab x LEFT JOIN ref r ON r.attribute_name = x.attribute_name)"


@query("disparity", _DISPARITY + " SELECT attribute_name, attribute_value, ref_group_value, "
       + ", ".join(f"round({m}_disparity, 6) AS {m}_disparity" for m in _DISP) + " FROM disp")
def disparity(spark, folder):
    out = disparities(crosstab(spark, folder), _REFS)
    made = [f"{m}_disparity" for m in _DISP]
    return rounded(out, *made).select("attribute_name", "attribute_value", "ref_group_value", *made)


_PAR = {"statistical_parity": "ppr", "impact_parity": "pprev", "fdr_parity": "fdr", "fpr_parity": "fpr", "for_parity": "for",
        "fnr_parity": "fnr", "tpr_parity": "tpr", "tnr_parity": "tnr", "npv_parity": "npv", "precision_parity": "precision"}


def _both(a, b):
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} AND {b} END"


_FLAGS = _DISPARITY + ", p1 AS (SELECT attribute_name, attribute_value, " + ", ".join(
    f"{m}_disparity BETWEEN 0.8 AND 1.25 AS {f}" for f, m in _PAR.items()) + f""" FROM disp),
 p2 AS (SELECT *, {_both('fdr_parity', 'fpr_parity')} AS type_i_parity, {_both('for_parity', 'fnr_parity')} AS type_ii_parity,
 {_both('fpr_parity', 'tpr_parity')} AS equalized_odds, {_both('statistical_parity', 'impact_parity')} AS unsupervised_fairness FROM p1),
 flags AS (SELECT *, {_both('type_i_parity', 'type_ii_parity')} AS supervised_fairness FROM p2)"""
_FLAG_NAMES = [*_PAR, "type_i_parity", "type_ii_parity", "equalized_odds", "unsupervised_fairness", "supervised_fairness"]


def flags(spark, folder):
    return parity_flags(disparities(crosstab(spark, folder), _REFS))


@query("parity_flags", _FLAGS + " SELECT * FROM flags")
def q_parity_flags(spark, folder):
    return flags(spark, folder).select("attribute_name", "attribute_value", *_FLAG_NAMES)


@query("attribute_verdict", _FLAGS + " SELECT attribute_name, " + ", ".join(f"bool_and({f}) AS {f}" for f in _FLAG_NAMES) + " FROM flags GROUP BY 1")
def q_attribute_verdict(spark, folder):
    return attribute_verdict(flags(spark, folder))
