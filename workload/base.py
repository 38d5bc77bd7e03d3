"""Registry and the shared panels the queries start from."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.operators.panel import densify, period_bounds
from panelkit.session import RANGE_ROWS_KEY
from panelkit.sources.files import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable under a name, with its checking SQL when there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@contextmanager
def many_ranges(spark: SparkSession, rows: int = 2000):
    """Orders by many small ranges while a plan is built, as for a frame of many more rows."""
    before = spark.conf.get(RANGE_ROWS_KEY, None)
    spark.conf.set(RANGE_ROWS_KEY, rows)
    try:
        yield
    finally:
        spark.conf.unset(RANGE_ROWS_KEY) if before is None else spark.conf.set(RANGE_ROWS_KEY, before)


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Round the named columns to six places and keep the rest."""
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def cents(c: str) -> Column:
    """Money as whole cents, so sums do not depend on their order."""
    return F.round(F.col(c) * 100).cast("long")


def customer_years(spark: SparkSession, folder: str) -> DataFrame:
    """Panel with gaps: one row per customer and order year."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("n_orders"), F.sum(cents("o_totalprice")).alias("cents"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
            F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
        )
    )


CY = """SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders,
 CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
 count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
 count(*) FILTER (WHERE o_orderstatus = 'F') AS finished
 FROM orders GROUP BY 1, 2"""


def supplier_years(spark: SparkSession, folder: str) -> DataFrame:
    """Dense panel: one row per supplier and shipping year."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_suppkey").alias("suppkey"), F.year("l_shipdate").alias("year"))
        .agg(
            F.count(F.lit(1)).alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
            F.sum(cents("l_extendedprice")).alias("cents"),
            F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        )
    )


SY = """SELECT l_suppkey AS suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS lines,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
 CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
 count(*) FILTER (WHERE l_returnflag = 'R') AS returned
 FROM lineitem GROUP BY 1, 2"""


def customer_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer in every year; measures are null where there was no order."""
    cy = customer_years(spark, folder)
    first, last = period_bounds(table(spark, folder, "orders").select(F.year("o_orderdate").alias("year")), "year")
    entities = table(spark, folder, "customer").select(F.col("c_custkey").alias("custkey"))
    return densify(cy, entities, "custkey", "year", first, last)


GRID = f"""SELECT c.c_custkey AS custkey, y.year, cy.n_orders, cy.cents, cy.urgent, cy.finished
 FROM customer c CROSS JOIN (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) y
 LEFT JOIN ({CY}) cy ON cy.custkey = c.c_custkey AND cy.year = y.year"""


def customer_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("nationkey")
    )


def nation_years(spark: SparkSession, folder: str) -> DataFrame:
    """Parent-level panel: customer-year rows summed per nation and year."""
    cy = customer_years(spark, folder).join(customer_keys(spark, folder), "custkey")
    return cy.groupBy("nationkey", "year").agg(
        *[F.sum(c).alias(c) for c in ("n_orders", "cents", "urgent", "finished")]
    )


NY = f"""SELECT c.c_nationkey AS nationkey, cy.year, CAST(sum(n_orders) AS BIGINT) AS n_orders,
 CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(urgent) AS BIGINT) AS urgent, CAST(sum(finished) AS BIGINT) AS finished
 FROM ({CY}) cy JOIN customer c ON c.c_custkey = cy.custkey GROUP BY 1, 2"""

# The label most queries use, and the prior-year label as its score.
LABELS = f"""SELECT custkey, year, CAST(ntile(5) OVER (PARTITION BY year ORDER BY cents DESC NULLS FIRST, custkey) = 1
 AS INTEGER) AS top20, cents, n_orders, urgent, finished FROM ({CY})"""
