"""Profiling tables."""

from pyspark.sql import functions as F

from panelkit.operators.profile import (
    box_stats,
    condition_share,
    correlation_pairs,
    correlation_with,
    dataset_profile,
    describe_exact,
    group_means,
    histogram,
    linear_fit,
    mean_differences,
    metric_by,
    null_share,
    outlier_table,
    pivot_sum,
    summary_table,
    summary_with_outliers,
    value_counts,
)
from panelkit.sources.files import table
from workload.base import CY, GRID, LABELS, cents, customer_grid, customer_years, many_ranges, query, rounded
from workload.panel import MEASURES, labelled

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _per_column(template: str, columns, src: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, {template.format(c=c)} FROM {src}" for c in columns)


@query("summary_table", _per_column(
    'round(avg({c}), 6) AS avg, min({c}) AS min, max({c}) AS max, round(stddev_samp({c}), 6) AS std', LINE, "lineitem"))
def q_summary_table(spark, folder):
    return rounded(summary_table(table(spark, folder, "lineitem"), LINE), "avg", "std")


def _outlier_sql(columns, src, width=3):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} > m + d) AS count_high,
 round(avg({c}) FILTER (WHERE {c} > m + d), 6) AS avg_high, count(*) FILTER (WHERE {c} < m - d) AS count_low,
 round(avg({c}) FILTER (WHERE {c} < m - d), 6) AS avg_low FROM {src},
 (SELECT avg({c}) AS m, stddev_samp({c}) * {width} AS d FROM {src})""" for c in columns)


@query("outlier_table", f"WITH cy AS ({CY}) " + _outlier_sql(["n_orders", "cents", "urgent", "finished"], "cy"))
def q_outlier_table(spark, folder):
    cy = customer_years(spark, folder)
    return rounded(outlier_table(cy, ["n_orders", "cents", "urgent", "finished"]), "avg_high", "avg_low")


@query("summary_with_outliers", "WITH s AS (" + _per_column(
    "round(avg({c}), 6) AS avg, min({c}) AS min, max({c}) AS max, round(stddev_samp({c}), 6) AS std", LINE, "lineitem")
    + f"), o AS ({_outlier_sql(LINE, 'lineitem')}) SELECT * FROM s JOIN o USING (variable)")
def q_summary_with_outliers(spark, folder):
    out = summary_with_outliers(table(spark, folder, "lineitem"), LINE)
    return rounded(out, "avg", "std", "avg_high", "avg_low")


def _describe(columns, src, by=""):
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return " UNION ALL ".join(
        f"""SELECT {group}'{c}' AS variable, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
 CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
 round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75,
 CAST(max({c}) AS DOUBLE) AS max FROM {src}{tail}""" for c in columns)


@query("describe_exact", f"WITH g AS ({GRID}) " + _describe(["n_orders", "cents", "urgent"], "g"))
def q_describe_exact(spark, folder):
    out = describe_exact(customer_grid(spark, folder), ["n_orders", "cents", "urgent"])
    return rounded(out, "mean", "std", "p25", "p50", "p75")


DESCRIBE_BY = _describe(["l_extendedprice", "l_discount"], "lineitem", "l_returnflag")


@query("describe_by_group", DESCRIBE_BY)
def describe_by_group(spark, folder):
    out = describe_exact(table(spark, folder, "lineitem"), ["l_extendedprice", "l_discount"], "l_returnflag")
    return rounded(out, "mean", "std", "p25", "p50", "p75")


@query("describe_by_group_large", DESCRIBE_BY)
def describe_by_group_large(spark, folder):
    with many_ranges(spark):
        return describe_by_group(spark, folder)


_PROFILE = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True),
            ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]


@query("profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, '{t}' AS type, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct,
 {f'CAST(min({c}) AS DOUBLE)' if num else 'CAST(NULL AS DOUBLE)'} AS min, {f'CAST(max({c}) AS DOUBLE)' if num else 'NULL'} AS max,
 {f'round(avg({c}), 6)' if num else 'NULL'} AS mean FROM customer""" for c, t, num in _PROFILE))
def q_profile(spark, folder):
    return rounded(dataset_profile(table(spark, folder, "customer")), "mean")


NULLS = f"""SELECT c_nationkey AS nationkey, year, nullif(count(*) - count(cents), 0) AS count_nulls, count(*) AS count_all,
 round(CAST(nullif(count(*) - count(cents), 0) AS DOUBLE) / count(*) * 100, 6) AS pct
 FROM ({GRID}) g JOIN customer c ON c.c_custkey = g.custkey GROUP BY 1, 2"""


def nation_grid(spark, folder):
    keys = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey"))
    return customer_grid(spark, folder).join(keys, "custkey")


@query("null_share", NULLS)
def q_null_share(spark, folder):
    return rounded(null_share(nation_grid(spark, folder), "cents", ["nationkey", "year"]), "pct")


@query("null_count_right_join", NULLS)
def null_count_right_join(spark, folder):
    grid = nation_grid(spark, folder)
    keys = ["nationkey", "year"]
    nulls = grid.where(F.col("cents").isNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count_nulls"))
    every = grid.groupBy(*keys).agg(F.count(F.lit(1)).alias("count_all"))
    out = nulls.join(every, keys, "right")
    return rounded(out.withColumn("pct", F.col("count_nulls") / F.col("count_all") * 100), "pct")


@query("zero_share", f"""SELECT year, count(*) FILTER (WHERE urgent = 0) AS hits, count(urgent) AS known,
 round(avg(CAST(urgent = 0 AS DOUBLE)), 6) AS share FROM ({GRID}) GROUP BY year""")
def zero_share(spark, folder):
    return rounded(condition_share(customer_grid(spark, folder), F.col("urgent") == 0, "year"), "share")


@query("yearly_agg", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n,
 CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, round(avg(o_totalprice), 6) AS mean_price
 FROM orders GROUP BY 1 ORDER BY 1""")
def yearly_agg(spark, folder):
    return table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("cents"),
        F.round(F.avg("o_totalprice"), 6).alias("mean_price"),
    ).orderBy("year")


@query("yearly_correlation", f"""WITH y AS (SELECT year, sum(n_orders) AS n_orders, avg(cents) AS cents, sum(urgent) AS urgent FROM ({CY}) GROUP BY 1)
 SELECT 'cents' AS a, 'n_orders' AS b, round(corr(cents, n_orders), 6) AS r FROM y UNION ALL
 SELECT 'urgent', 'n_orders', round(corr(urgent, n_orders), 6) FROM y UNION ALL SELECT 'urgent', 'cents', round(corr(urgent, cents), 6) FROM y""")
def yearly_correlation(spark, folder):
    yearly = customer_years(spark, folder).groupBy("year").agg(
        F.sum("n_orders").alias("n_orders"), F.avg("cents").alias("cents"), F.sum("urgent").alias("urgent"))
    return rounded(correlation_pairs(yearly, ["n_orders", "cents", "urgent"]), "r")


@query("group_counts", """SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1""")
def group_counts(spark, folder):
    return table(spark, folder, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@query("having_share", """SELECT c_nationkey, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS total FROM customer
 WHERE c_mktsegment <> 'BUILDING' GROUP BY 1
 HAVING 100.0 * sum(CAST(round(c_acctbal * 100) AS BIGINT)) / (SELECT sum(CAST(round(c_acctbal * 100) AS BIGINT)) FROM customer) >= 3.0""")
def having_share(spark, folder):
    from panelkit.operators.profile import sums_over

    customers = table(spark, folder, "customer")
    all_cents = customers.agg(F.sum(cents("c_acctbal"))).scalar()
    urban = customers.where(F.col("c_mktsegment") != "BUILDING")
    return sums_over(urban, "c_nationkey", cents("c_acctbal"), all_cents * 0.03)


@query("pivot_trend", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year,
 """ + ", ".join(f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS BIGINT) AS \"{s}\"" for s in "FOP")
       + " FROM orders GROUP BY 1")
def pivot_trend(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("year"), "o_orderstatus", cents("o_totalprice").alias("cents"))
    return pivot_sum(orders, "year", "o_orderstatus", ["F", "O", "P"], "cents")


@query("region_trend", f"""SELECT year, CAST(sum(cy.cents) AS BIGINT) AS cents, CAST(sum(cy.urgent) AS BIGINT) AS urgent FROM ({CY}) cy
 JOIN customer ON c_custkey = custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
 WHERE r_name = 'EUROPE' GROUP BY year""")
def region_trend(spark, folder):
    europe = table(spark, folder, "region").where(F.col("r_name") == "EUROPE")
    nations = table(spark, folder, "nation").join(europe, F.col("n_regionkey") == F.col("r_regionkey"))
    keys = table(spark, folder, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("c_custkey").alias("custkey"))
    cy = customer_years(spark, folder).join(keys, "custkey", "left_semi")
    return cy.groupBy("year").agg(F.sum("cents").alias("cents"), F.sum("urgent").alias("urgent"))


@query("group_means", f"""SELECT top20, round(avg(n_orders), 6) AS n_orders, round(avg(urgent), 6) AS urgent, round(avg(finished), 6) AS finished
 FROM ({LABELS}) GROUP BY top20""")
def q_group_means(spark, folder):
    rows = labelled(spark, folder, MEASURES)
    columns = ["n_orders", "urgent", "finished"]
    return rounded(group_means(rows, "top20", columns), *columns)


@query("diff_of_means", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, round(avg({c}) FILTER (WHERE top20 = 0), 6) AS mean_0,
 round(avg({c}) FILTER (WHERE top20 = 1), 6) AS mean_1 FROM ({LABELS})""" for c in ("n_orders", "urgent", "finished")))
def diff_of_means(spark, folder):
    rows = labelled(spark, folder, MEASURES)
    return rounded(mean_differences(rows, "top20", ["n_orders", "urgent", "finished"]), "mean_0", "mean_1")


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in LINE for b in LINE))
def corr_matrix(spark, folder):
    return rounded(correlation_pairs(table(spark, folder, "lineitem"), LINE, full=True), "r")


_WIDE = [f"e{i}" for i in range(1, 65)]


@query("corr_matrix_wide", """WITH u AS (SELECT vec_id, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
 SELECT 'e' || a.i AS a, 'e' || b.i AS b, round(corr(a.x, b.x), 6) AS r FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i > b.i GROUP BY a.i, b.i""")
def corr_matrix_wide(spark, folder):
    vectors = table(spark, folder, "embeddings").select(*[F.col("embedding")[i].alias(c) for i, c in enumerate(_WIDE)])
    return rounded(correlation_pairs(vectors, _WIDE), "r")


@query("high_corr", f"SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, round(corr({c}, top20), 6) AS r FROM ({LABELS})" for c in ("n_orders", "urgent", "finished", "cents"))
       + ") WHERE r > 0.2")
def high_corr(spark, folder):
    rows = labelled(spark, folder, MEASURES)
    return rounded(correlation_with(rows, ["n_orders", "urgent", "finished", "cents"], "top20", 0.2), "r")


@query("linear_fit", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
 round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
 CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def q_linear_fit(spark, folder):
    out = linear_fit(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", "l_returnflag")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("r2", 6).alias("r2"), "n")


@query("linear_fit_overall", f"""SELECT round(regr_slope(cents, n_orders), 4) AS slope, round(regr_intercept(cents, n_orders), 4) AS intercept,
 round(regr_r2(cents, n_orders), 6) AS r2, CAST(regr_count(cents, n_orders) AS BIGINT) AS n FROM ({CY})""")
def linear_fit_overall(spark, folder):
    out = linear_fit(customer_years(spark, folder), "cents", "n_orders")
    return out.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("r2", 6).alias("r2"), "n")


def _box_sql(src, column, by):
    group = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    return f"""WITH q AS (SELECT {group}quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({column} AS DOUBLE), 0.5) AS median,
 quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {src}{tail}),
 x AS (SELECT {group}CAST({column} AS DOUBLE) AS v, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
 FROM {src} JOIN q {on})
 SELECT {group}count(*) AS n, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3,
 min(v) FILTER (WHERE v BETWEEN lo AND hi) AS whisker_low, max(v) FILTER (WHERE v BETWEEN lo AND hi) AS whisker_high,
 count(*) FILTER (WHERE NOT v BETWEEN lo AND hi) AS outliers FROM x{tail}"""


@query("box_stats", _box_sql("orders", "o_totalprice", "o_orderpriority"))
def q_box_stats(spark, folder):
    return rounded(box_stats(table(spark, folder, "orders"), "o_totalprice", "o_orderpriority"), "q1", "median", "q3")


@query("box_stats_overall_large", _box_sql("events", "value", ""))
def box_stats_overall_large(spark, folder):
    return rounded(box_stats(table(spark, folder, "events"), "value"), "q1", "median", "q3")


_HIST = """WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT CAST(i AS INTEGER) AS bin FROM range(20) r(i)),
 c AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM orders, e GROUP BY 1)
 SELECT b.bin, round(lo + b.bin * ((hi - lo) / 20), 6) AS from_value, round(lo + (b.bin + 1) * ((hi - lo) / 20), 6) AS to_value,
 coalesce(c.n, 0) AS n FROM b LEFT JOIN c ON c.bin = b.bin, e"""


@query("histogram", _HIST)
def q_histogram(spark, folder):
    return rounded(histogram(table(spark, folder, "orders"), "o_totalprice", 20), "from_value", "to_value")


@query("histogram_by_class", """WITH c AS (SELECT event_type, CAST(least(floor(value / 5.0), 9) AS INTEGER) AS bin, count(*) AS n
 FROM events WHERE value BETWEEN 0 AND 50 GROUP BY 1, 2)
 SELECT g.event_type, CAST(b.bin AS INTEGER) AS bin, round(b.bin * CAST(5 AS DOUBLE), 6) AS from_value,
 round((b.bin + 1) * CAST(5 AS DOUBLE), 6) AS to_value, coalesce(c.n, 0) AS n
 FROM (SELECT DISTINCT event_type FROM events) g CROSS JOIN range(10) b(bin)
 LEFT JOIN c ON c.event_type IS NOT DISTINCT FROM g.event_type AND c.bin = b.bin""")
def histogram_by_class(spark, folder):
    out = histogram(table(spark, folder, "events"), "value", 10, (0, 50), "event_type")
    return rounded(out, "from_value", "to_value")


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def q_value_counts(spark, folder):
    return value_counts(table(spark, folder, "events"), "event_type")


@query("metric_by_hue", """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, round(avg(o_totalprice), 6) AS mean,
 round(stddev_samp(o_totalprice), 4) AS std, count(o_totalprice) AS n FROM orders GROUP BY 1, 2""")
def metric_by_hue(spark, folder):
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate"))
    out = metric_by(orders, "o_totalprice", ["year", "o_orderstatus"])
    return out.select("year", "o_orderstatus", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"), "n")


@query("daily_panel_mean", """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
 SELECT a.user_id, a.day, a.n, round(avg(b.n), 6) AS n_avg_7yr FROM d a LEFT JOIN d b ON a.user_id = b.user_id
 AND b.day BETWEEN a.day - 7 AND a.day - 1 GROUP BY 1, 2, 3""")
def daily_panel_mean(spark, folder):
    from panelkit.operators.panel import trailing_mean

    daily = table(spark, folder, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))
    daily = daily.withColumn("day_number", F.unix_date("day"))
    return rounded(trailing_mean(daily, "n", 7, "user_id", "day_number").drop("day_number"), "n_avg_7yr")


@query("row_vs_aggregate", """SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS gap FROM orders""")
def row_vs_aggregate(spark, folder):
    orders = table(spark, folder, "orders")
    mean = orders.agg(F.avg("o_totalprice")).scalar()
    return orders.select("o_orderkey", F.round(F.col("o_totalprice") - mean, 4).alias("gap"))


@query("count_left_merge", """WITH a AS (SELECT o_orderpriority AS k, count(*) AS num FROM orders GROUP BY 1),
 b AS (SELECT o_orderpriority AS k, count(*) AS rate FROM orders WHERE o_totalprice > 499000 GROUP BY 1)
 SELECT k, num, rate FROM a LEFT JOIN b USING (k)""")
def count_left_merge(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("k"), "o_totalprice")
    a = orders.groupBy("k").agg(F.count(F.lit(1)).alias("num"))
    b = orders.where(F.col("o_totalprice") > 499000).groupBy("k").agg(F.count(F.lit(1)).alias("rate"))
    return a.join(b, "k", "left")


@query("multi_key_merge", """SELECT l_orderkey, l_linenumber, s_name, s_nationkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
 JOIN part ON p_partkey = l_partkey AND p_size > l_linenumber * 7""")
def multi_key_merge(spark, folder):
    from panelkit.operators.joins import lookup_join

    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    spread = ["l_orderkey", "l_linenumber"]
    out = lookup_join(lookup_join(lines, suppliers, "l_suppkey", "inner", spread), parts, "l_partkey", "inner", spread)
    return out.where(F.col("p_size") > F.col("l_linenumber") * 7).select("l_orderkey", "l_linenumber", "s_name", "s_nationkey")
