"""File sources and sinks: a test table is written to the shared scratch folder and read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators.panel import period_bounds
from panelkit.session import scratch_path
from panelkit.sources.files import (
    column_for_years,
    read_csv,
    read_csv_tree,
    read_feature_sets,
    read_yearly,
    replace_table,
    snapshot,
    table,
    write_csv,
)
from workload.base import CY, customer_years, query

CUSTOMER = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType()),
])
ORDER = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_totalprice", T.DoubleType()),
])


@query("csv_typed_scan", "SELECT * FROM customer")
def csv_typed_scan(spark, folder):
    path = scratch_path(spark, "customer-csv")
    write_csv(table(spark, folder, "customer"), path)
    return read_csv(spark, path, CUSTOMER)


@query("csv_inferred_scan", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def csv_inferred_scan(spark, folder):
    path = scratch_path(spark, "customer-csv")
    write_csv(table(spark, folder, "customer"), path)
    out = read_csv(spark, path, columns=["c_custkey", "c_acctbal", "c_mktsegment"])
    return out.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("multi_file_scan", "SELECT o_orderstatus AS state, o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'")
def multi_file_scan(spark, folder):
    path = scratch_path(spark, "orders-by-status")
    orders = table(spark, folder, "orders").select(*ORDER.fieldNames(), "o_orderstatus")
    orders.write.option("header", True).partitionBy("o_orderstatus").csv(path)
    return read_csv_tree(spark, path, ORDER, "state", "o_orderstatus=([A-Z])", r"\.csv$", ["P"])


@query("year_files_union", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def year_files_union(spark, folder):
    path = scratch_path(spark, "orders-by-year")
    orders = table(spark, folder, "orders").withColumn("year", F.year("o_orderdate")).select(*ORDER.fieldNames(), "year")
    first, last = period_bounds(orders, "year")
    orders.write.option("header", True).partitionBy("year").csv(path)
    return read_yearly(spark, [f"{path}/year={y}" for y in range(first, last + 1)], ORDER)


@query("snapshot_overwrite", f"SELECT custkey, year, cents FROM ({CY}) WHERE n_orders > 1")
def snapshot_overwrite(spark, folder):
    path = scratch_path(spark, "snapshot")
    cy = customer_years(spark, folder)
    replace_table(cy.where(F.col("n_orders") == 1), path, ["year"])
    return snapshot(cy.where(F.col("n_orders") > 1), path, ["custkey", "year", "cents"])


@query("csv_round_trip", f"SELECT custkey, year, cents FROM ({CY})")
def csv_round_trip(spark, folder):
    path = scratch_path(spark, "panel-csv")
    write_csv(customer_years(spark, folder).select("custkey", "year", "cents"), path)
    return read_csv(spark, path, "custkey long, year int, cents long")


@query("column_for_years", f"SELECT cents FROM ({CY}) WHERE year = 1996 OR year = 1999")
def q_column_for_years(spark, folder):
    return column_for_years(customer_years(spark, folder), "cents", 1996, 1999)


@query("feature_catalogue", """SELECT r_name AS feature_set, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS INTEGER) AS position,
 n_name AS feature FROM region JOIN nation ON n_regionkey = r_regionkey""")
def feature_catalogue(spark, folder):
    path = scratch_path(spark, "sets-json")
    joined = table(spark, folder, "region").join(table(spark, folder, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    sets = joined.groupBy().pivot("r_name").agg(F.sort_array(F.collect_list("n_name")))
    sets.write.json(path)
    return read_feature_sets(spark, path)
