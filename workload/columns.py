"""Projections, filters, keys, flags and row cleaning."""

from pyspark.sql import functions as F

from panelkit.functions.scalars import (
    DIVISION_STATES,
    SAMPLE_STATES,
    capped_ratio,
    category_of,
    code_slices,
    division_flags,
    finite_or_null,
    null_sum,
    padded_key,
    per_thousand,
    prefix_keys,
    shift_date,
    to_number,
    weighted_sum,
    year_in_date_text,
    year_start,
)
from panelkit.operators.clean import (
    bin_edges,
    drop_subheaders,
    dummies,
    equal_width_bins,
    features_and_target,
    fill_mean,
    fill_median,
    given_bins,
    min_max_scale,
    null_columns,
    quantile_bins,
    rename_and_drop,
)
from panelkit.operators.joins import lookup_join, membership_flag
from panelkit.operators.order import sample_entities
from panelkit.sources.files import stack, table
from workload.base import CY, GRID, cents, customer_grid, customer_years, many_ranges, query, rounded

IN_STATES = ", ".join(f"'{s}'" for s in SAMPLE_STATES)


@query("hierarchy_keys", """SELECT o_orderkey, substr(code, 1, 2) AS state, substr(code, 1, 5) AS county,
 substr(code, 1, 11) AS tract FROM (SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS code FROM orders)""")
def hierarchy_keys(spark, folder):
    coded = table(spark, folder, "orders").select("o_orderkey", padded_key("o_orderkey", 12).alias("code"))
    return coded.select("o_orderkey", *prefix_keys("code"))


@query("default_column", """SELECT c_custkey, 0 AS urban, CAST(NULL AS DOUBLE) AS rate FROM customer""")
def default_column(spark, folder):
    customers = table(spark, folder, "customer")
    return customers.select("c_custkey", F.lit(0).alias("urban"), F.lit(None).cast("double").alias("rate"))


@query("rename_drop", """SELECT p_partkey AS part, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part""")
def rename_drop(spark, folder):
    names = {"p_partkey": "part", "p_brand": "brand", "p_size": "size", "p_retailprice": "price"}
    return rename_and_drop(table(spark, folder, "part"), names, ["p_name", "p_type"])


@query("join_dedup_keys", f"""WITH cy AS ({CY}) SELECT a.custkey, a.year, a.cents, b.urgent FROM cy a
 JOIN cy b ON a.custkey = b.custkey AND a.year = b.year""")
def join_dedup_keys(spark, folder):
    cy = customer_years(spark, folder)
    return cy.select("custkey", "year", "cents").join(cy.select("custkey", "year", "urgent"), ["custkey", "year"])


@query("numeric_coerce", """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS level,
 TRY_CAST(o_orderpriority AS DOUBLE) AS whole FROM orders""")
def numeric_coerce(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", to_number(F.substring("o_orderpriority", 1, 1)).alias("level"),
        to_number("o_orderpriority").alias("whole"),
    )


@query("row_sums", f"""SELECT custkey, year, n_orders + urgent + finished AS total, n_orders * 2 + urgent * 3 + finished * 7 AS weighted
 FROM ({GRID})""")
def row_sums(spark, folder):
    grid = customer_grid(spark, folder)
    return grid.select(
        "custkey", "year", null_sum(["n_orders", "urgent", "finished"]).alias("total"),
        weighted_sum({"n_orders": 2, "urgent": 3, "finished": 7}).alias("weighted"),
    )


@query("ratio_capped", f"""SELECT custkey, year, round(CASE WHEN finished = 0 AND n_orders * 3 - 3 > 0 THEN 7
 WHEN CAST(n_orders * 3 - 3 AS DOUBLE) / nullif(finished, 0) > 7 THEN 7
 ELSE CAST(n_orders * 3 - 3 AS DOUBLE) / nullif(finished, 0) END, 6) AS ratio FROM ({GRID})""")
def ratio_capped(spark, folder):
    grid = customer_grid(spark, folder)
    out = grid.withColumn("ratio", capped_ratio(F.col("n_orders") * 3 - 3, "finished", 7))
    return rounded(out, "ratio").select("custkey", "year", "ratio")


@query("per_thousand", f"""SELECT custkey, year, round(CAST(urgent AS DOUBLE) / nullif(finished, 0) * 1000, 6) AS per_1k FROM ({GRID})""")
def q_per_thousand(spark, folder):
    grid = customer_grid(spark, folder).withColumn("per_1k", per_thousand("urgent", "finished"))
    return rounded(grid, "per_1k").select("custkey", "year", "per_1k")


@query("composite_label", """SELECT o_orderkey, o_orderstatus || o_orderpriority AS joined,
 concat_ws(', ', o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)) AS label FROM orders""")
def composite_label(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.concat("o_orderstatus", "o_orderpriority").alias("joined"),
        F.concat_ws(", ", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).alias("label"),
    )


@query("code_slices", """SELECT c_custkey, substr(c_name, 2, 2) || substr(c_name, 5, 3) || substr(c_name, 9, 7) AS code FROM customer""")
def q_code_slices(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", code_slices("c_name", [(1, 3), (4, 7), (8, 15)]).alias("code"))


@query("year_from_text", """SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders""")
def year_from_text(spark, folder):
    d = F.col("o_orderdate")
    shown = F.concat(F.lit("(datetime.datetime("), F.year(d), F.lit(", "), F.month(d), F.lit(", "), F.dayofmonth(d),
                     F.lit(", 0, 0), datetime.datetime(1900, 1, 1, 0, 0))"))
    return table(spark, folder, "orders").select("o_orderkey", shown.alias("t")).select(
        "o_orderkey", year_in_date_text("t").alias("year"))


@query("casts_padded_key", """SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS county,
 CAST(c_nationkey AS VARCHAR) AS plain, CAST(trunc(c_acctbal) AS INTEGER) AS whole FROM customer""")
def casts_padded_key(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", padded_key("c_nationkey", 5).alias("county"), F.col("c_nationkey").cast("string").alias("plain"),
        F.col("c_acctbal").cast("int").alias("whole"),
    )


@query("year_to_date", f"SELECT custkey, year, make_date(year, 1, 1) AS start FROM ({CY})")
def year_to_date(spark, folder):
    return customer_years(spark, folder).select("custkey", "year", year_start("year").alias("start"))


@query("date_shift", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 12 MONTH - INTERVAL 1 DAY AS DATE) AS span_end,
 CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH AS DATE) AS month_before FROM orders""")
def date_shift(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", shift_date("o_orderdate", 12, -1).alias("span_end"),
        shift_date("o_orderdate", -1).alias("month_before"),
    )


@query("minmax_scale", """SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6)
 AS scaled FROM customer""")
def minmax_scale(spark, folder):
    out = min_max_scale(table(spark, folder, "customer"), "c_acctbal", "scaled")
    return rounded(out, "scaled").select("c_custkey", "scaled")


def _division_case(codes):
    return ", ".join(f"'{c}'" for c in codes)


@query("division_flags", "SELECT c_custkey, " + ", ".join(
    f"CAST(lpad(CAST(c_nationkey AS VARCHAR), 2, '0') IN ({_division_case(codes)}) AS INTEGER) AS {name}"
    for name, codes in DIVISION_STATES.items()) + " FROM customer")
def q_division_flags(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", *division_flags(padded_key("c_nationkey", 2)))


@query("category_lookup", "SELECT c_custkey, CASE " + " ".join(
    f"WHEN lpad(CAST(c_nationkey AS VARCHAR), 2, '0') IN ({_division_case(codes)}) THEN '{name}'"
    for name, codes in DIVISION_STATES.items()) + " END AS division FROM customer")
def category_lookup(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", category_of(padded_key("c_nationkey", 2), DIVISION_STATES).alias("division"))


@query("semi_flag", """SELECT c_custkey, c_nationkey, CAST(c_nationkey IN (SELECT n_nationkey FROM nation JOIN region
 ON n_regionkey = r_regionkey WHERE r_name = 'ASIA') AS INTEGER) AS urban FROM customer""")
def semi_flag(spark, folder):
    asia = table(spark, folder, "region").where(F.col("r_name") == "ASIA")
    listed = table(spark, folder, "nation").join(asia, F.col("n_regionkey") == F.col("r_regionkey"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return membership_flag(customers, listed.select(F.col("n_nationkey").alias("c_nationkey")), "c_nationkey", "urban")


@query("semi_join", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer
 WHERE c_mktsegment = 'MACHINERY')""")
def semi_join(spark, folder):
    kept = table(spark, folder, "customer").where(F.col("c_mktsegment") == "MACHINERY")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    kept = kept.select(F.col("c_custkey").alias("o_custkey"))
    return lookup_join(orders, kept, "o_custkey", "left_semi", ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("entity_sample", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM
 (SELECT DISTINCT o_custkey FROM orders) ORDER BY CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR) || '|42'), 1, 12) AS BIGINT),
 o_custkey LIMIT 75)""")
def entity_sample(spark, folder):
    return sample_entities(table(spark, folder, "orders"), "o_custkey", 75, 42).select("o_orderkey", "o_custkey")


_TYPES = "SELECT p_partkey, {} FROM part"


@query("dummies", _TYPES.format(", ".join(
    f"CAST(p_type = '{t}' AS INTEGER) AS \"p_type_{t}\"" for t in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])))
def q_dummies(spark, folder):
    parts = table(spark, folder, "part")
    return dummies(parts, "p_type").drop("p_name", "p_brand", "p_type", "p_size", "p_retailprice")


# --- filters

@query("filter_members", f"SELECT c_custkey, c_nationkey FROM customer WHERE lpad(CAST(c_nationkey AS VARCHAR), 2, '0') IN ({IN_STATES})")
def filter_members(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return customers.where(padded_key("c_nationkey", 2).isin(SAMPLE_STATES))


@query("filter_or", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '5-LOW'")
def filter_or(spark, folder):
    orders = table(spark, folder, "orders").where((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "5-LOW"))
    return orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("filter_null", f"SELECT custkey, year, cents IS NULL AS missing FROM ({GRID}) WHERE cents IS NULL OR urgent IS NOT NULL")
def filter_null(spark, folder):
    grid = customer_grid(spark, folder)
    kept = grid.where(F.col("cents").isNull() | F.col("urgent").isNotNull())
    return kept.select("custkey", "year", F.col("cents").isNull().alias("missing"))


@query("filter_dates", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders
 WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""")
def filter_dates(spark, folder):
    orders = table(spark, folder, "orders")
    # Compare the stored timestamp itself, so the range reaches the file scan.
    stamp = F.col("o_orderdate")
    kept = orders.where((stamp >= F.lit("1996-01-01").cast("timestamp_ntz")) & (stamp < F.lit("1998-01-01").cast("timestamp_ntz")))
    return kept.select("o_orderkey", stamp.cast("date").alias("day"))


@query("filter_threshold", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
def filter_threshold(spark, folder):
    return table(spark, folder, "customer").where(F.col("c_acctbal") > 5000).select("c_custkey", "c_acctbal")


@query("filter_sentinel", f"SELECT custkey, year, urgent FROM ({GRID}) WHERE urgent <> 0")
def filter_sentinel(spark, folder):
    return customer_grid(spark, folder).where(F.col("urgent") != 0).select("custkey", "year", "urgent")


@query("filter_exclude", "SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('NATION_1', 'NATION_7', 'NATION_20')")
def filter_exclude(spark, folder):
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return nations.where(~F.col("n_name").isin("NATION_1", "NATION_7", "NATION_20"))


@query("dedup_rows", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def dedup_rows(spark, folder):
    return table(spark, folder, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


@query("drop_subheader", """SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status FROM orders""")
def drop_subheader(spark, folder):
    orders = table(spark, folder, "orders")
    body = orders.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"))
    heads = orders.groupBy("o_orderpriority").agg(F.first(F.lit("o_orderkey")).alias("key")).select(
        "key", F.lit("o_orderstatus").alias("status"))
    return drop_subheaders(body.unionByName(heads), "key")


@query("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, folder):
    return table(spark, folder, "orders").select("o_orderpriority").distinct()


# --- filling and bins

_MEDIANS = f"""WITH g AS ({GRID}), m AS (SELECT quantile_cont(CAST(cents AS DOUBLE), 0.5) AS a,
 quantile_cont(CAST(urgent AS DOUBLE), 0.5) AS b FROM g) SELECT custkey, year, round(coalesce(CAST(cents AS DOUBLE), a), 6) AS cents,
 round(coalesce(CAST(urgent AS DOUBLE), b), 6) AS urgent FROM g, m"""


@query("fill_median", _MEDIANS)
def q_fill_median(spark, folder):
    grid = customer_grid(spark, folder).select("custkey", "year", "cents", "urgent")
    return rounded(fill_median(grid, ["cents", "urgent"]), "cents", "urgent")


@query("fill_median_large", _MEDIANS)
def fill_median_large(spark, folder):
    with many_ranges(spark):
        return q_fill_median(spark, folder)


@query("fill_median_from_train", f"""WITH g AS ({GRID}), m AS (SELECT quantile_cont(CAST(cents AS DOUBLE), 0.5) AS a FROM g WHERE year < 1999)
 SELECT custkey, year, round(coalesce(CAST(cents AS DOUBLE), a), 6) AS cents FROM g, m WHERE year >= 1999""")
def fill_median_from_train(spark, folder):
    grid = customer_grid(spark, folder).select("custkey", "year", "cents")
    train, test = grid.where(F.col("year") < 1999), grid.where(F.col("year") >= 1999)
    return rounded(fill_median(test, ["cents"], fit_on=train), "cents")


@query("fill_mean", f"""WITH g AS ({GRID}), m AS (SELECT avg(cents) AS a, avg(urgent) AS b FROM g)
 SELECT custkey, year, round(coalesce(CAST(cents AS DOUBLE), a), 4) AS cents, round(coalesce(CAST(urgent AS DOUBLE), b), 6) AS urgent FROM g, m""")
def q_fill_mean(spark, folder):
    grid = customer_grid(spark, folder).select("custkey", "year", "cents", "urgent")
    out = rounded(fill_mean(grid, ["cents", "urgent"]), "urgent")
    return out.withColumn("cents", F.round("cents", 4))


@query("finite_values", """SELECT c_custkey, round(CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END, 6) AS x FROM customer""")
def finite_values(spark, folder):
    inf = F.lit(float("inf"))
    raw = F.when(F.col("c_nationkey") == 0, inf).otherwise(F.try_divide("c_acctbal", "c_nationkey"))
    out = table(spark, folder, "customer").select("c_custkey", finite_or_null(raw).alias("x"))
    return rounded(out, "x")


@query("null_columns", f"""WITH g AS ({GRID}) SELECT c AS "column" FROM (SELECT 'n_orders' AS c, count(*) - count(n_orders) AS k FROM g
 UNION ALL SELECT 'cents', count(*) - count(cents) FROM g UNION ALL SELECT 'urgent', count(*) - count(urgent) FROM g
 UNION ALL SELECT 'finished', count(*) - count(finished) FROM g UNION ALL SELECT 'custkey', count(*) - count(custkey) FROM g
 UNION ALL SELECT 'year', count(*) - count(year) FROM g) WHERE k > 0""")
def q_null_columns(spark, folder):
    return null_columns(customer_grid(spark, folder))


_WIDTH = """WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
 SELECT c_custkey, ['low', 'med-low', 'med-high', 'high'][1 + (c_acctbal > lo + 1 * ((hi - lo) / 4))::INTEGER
 + (c_acctbal > lo + 2 * ((hi - lo) / 4))::INTEGER + (c_acctbal > lo + 3 * ((hi - lo) / 4))::INTEGER] AS c_acctbal_bins FROM customer, e"""


@query("equal_width_bins", _WIDTH)
def q_equal_width_bins(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    out = equal_width_bins(customers, "c_acctbal", 4, ["low", "med-low", "med-high", "high"])
    return out.select("c_custkey", "c_acctbal_bins")


@query("equal_width_bins_int", """WITH e AS (SELECT CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part)
 SELECT p_partkey, CAST(greatest(least(ceil((p_size - lo) / ((hi - lo) / 7)) - 1, 6), 0) AS INTEGER) AS p_size_bins, 3 AS one_bins FROM part, e""")
def equal_width_bins_int(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_size", F.lit(1).alias("one"))
    return equal_width_bins(parts, ["p_size", "one"], 7).select("p_partkey", "p_size_bins", "one_bins")


@query("bin_edges", """SELECT 'p_retailprice' AS variable, [round(lo, 6), round(lo + 1 * (hi - lo) / 4, 6), round(lo + 2 * (hi - lo) / 4, 6),
 round(lo + 3 * (hi - lo) / 4, 6), round(hi, 6)] AS edges FROM (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""")
def q_bin_edges(spark, folder):
    out = bin_edges(table(spark, folder, "part"), "p_retailprice", 4)
    return out.select("variable", F.transform("edges", lambda e: F.round(e, 6)).alias("edges"))


@query("given_bins", """SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'middle'
 WHEN p_size > 30 AND p_size <= 45 THEN 'large' END AS p_size_bins FROM part""")
def q_given_bins(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    return given_bins(parts, "p_size", [5, 10, 30, 45], ["small", "middle", "large"]).select("p_partkey", "p_size_bins")


_QBINS = """WITH q AS (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), [0.25, 0.5, 0.75]) AS e FROM orders)
 SELECT o_orderkey, (o_totalprice > e[1])::INTEGER + (o_totalprice > e[2])::INTEGER + (o_totalprice > e[3])::INTEGER AS o_totalprice_bins
 FROM orders, q"""


@query("quantile_bins", _QBINS)
def q_quantile_bins(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return quantile_bins(orders, "o_totalprice").select("o_orderkey", "o_totalprice_bins")


@query("quantile_bins_large", _QBINS)
def quantile_bins_large(spark, folder):
    with many_ranges(spark):
        return q_quantile_bins(spark, folder)


@query("feature_target_split", f"SELECT custkey, year, n_orders, urgent, cents FROM ({CY})")
def feature_target_split(spark, folder):
    cy = customer_years(spark, folder)
    x, y = features_and_target(cy, ["n_orders", "urgent"], "cents", ["custkey", "year"])
    return x.join(y, ["custkey", "year"])


@query("union_results", """SELECT o_orderpriority AS name, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
 FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*), NULL FROM orders GROUP BY 1""")
def union_results(spark, folder):
    orders = table(spark, folder, "orders")
    a = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("cents"))
    b = orders.groupBy(F.col("o_orderstatus").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return stack([a, b])
