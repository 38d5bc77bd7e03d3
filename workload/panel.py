"""Panel features, parent levels and labels."""

from pyspark.sql import functions as F

from panelkit.functions.scalars import conversion_rate
from panelkit.operators.joins import attribute_join, shifted_join, update_join
from panelkit.operators.labels import (
    increase_label,
    lagged_labels,
    tile_discretise,
    top_tile_labels,
    transition_label,
)
from panelkit.operators.panel import (
    carry_forward,
    feature_batch,
    lag_bundle,
    parent_bundle,
    parent_lag_bundle,
    parent_mean,
    pct_change,
    sentinel_repair,
    trailing_mean,
)
from panelkit.sources.files import table
from workload.base import (
    many_ranges,
    CY,
    GRID,
    LABELS,
    NY,
    SY,
    customer_grid,
    customer_keys,
    customer_years,
    nation_years,
    query,
    rounded,
    supplier_years,
)

E_KEY, PERIOD = "custkey", "year"
MEASURES = ["n_orders", "cents", "urgent", "finished"]


def change_sql(now: str, base: str) -> str:
    return (
        f"CASE WHEN {now} = 0 AND {base} = 0 THEN 0.0 WHEN {now} > 0 AND {base} = 0 THEN 999999.0 "
        f"WHEN {now} < 0 AND {base} = 0 THEN -999999.0 "
        f"ELSE CAST({now} - {base} AS DOUBLE) / nullif({base}, 0) * 100 END"
    )


def mean_sql(src: str, entity: str, column: str, n: int) -> str:
    return (
        f"(SELECT round(avg(b.{column}), 6) FROM {src} b WHERE b.{entity} = a.{entity} "
        f"AND b.year BETWEEN a.year - {n} AND a.year - 1)"
    )


@query("panel_trailing_mean", f"""WITH cy AS ({CY})
 SELECT a.custkey, a.year, round(avg(b.n_orders), 6) AS n_orders_avg_3yr, round(avg(b.cents), 6) AS cents_avg_3yr
 FROM cy a LEFT JOIN cy b ON a.custkey = b.custkey AND b.year BETWEEN a.year - 3 AND a.year - 1 GROUP BY 1, 2""")
def panel_trailing_mean(spark, folder):
    out = trailing_mean(customer_years(spark, folder), ["n_orders", "cents"], 3, E_KEY, PERIOD)
    out = rounded(out, "n_orders_avg_3yr", "cents_avg_3yr")
    return out.select("custkey", "year", "n_orders_avg_3yr", "cents_avg_3yr")


@query("panel_pct_change", f"""WITH cy AS ({CY})
 SELECT a.custkey, a.year, round({change_sql('a.urgent', 'b.urgent')}, 6) AS urgent_pct_change_1yr,
 round({change_sql('a.cents', 'b.cents')}, 6) AS cents_pct_change_1yr,
 round({change_sql('a.cents', 'c.cents')}, 6) AS cents_pct_change_3yr
 FROM cy a LEFT JOIN cy b ON a.custkey = b.custkey AND b.year = a.year - 1
 LEFT JOIN cy c ON a.custkey = c.custkey AND c.year = a.year - 3""")
def panel_pct_change(spark, folder):
    out = pct_change(customer_years(spark, folder), ["urgent", "cents"], 1, E_KEY, PERIOD)
    out = pct_change(out, "cents", 3, E_KEY, PERIOD)
    made = ["urgent_pct_change_1yr", "cents_pct_change_1yr", "cents_pct_change_3yr"]
    return rounded(out, *made).select("custkey", "year", *made)


REPAIR = f"""WITH cy AS ({CY}), ch AS (SELECT a.custkey, a.year, {change_sql('a.urgent', 'b.urgent')} AS x
 FROM cy a LEFT JOIN cy b ON a.custkey = b.custkey AND b.year = a.year - 1),
 top AS (SELECT year, max(x) AS m FROM ch WHERE x <> 999999 GROUP BY 1)
 SELECT ch.custkey, ch.year, round(CASE WHEN x = 999999 AND m IS NOT NULL THEN m ELSE x END, 6) AS urgent_pct_change_1yr
 FROM ch LEFT JOIN top ON top.year = ch.year"""


@query("panel_sentinel_repair", REPAIR)
def panel_sentinel_repair(spark, folder):
    out = pct_change(customer_years(spark, folder), "urgent", 1, E_KEY, PERIOD)
    out = sentinel_repair(out, "urgent_pct_change_1yr", PERIOD)
    return rounded(out, "urgent_pct_change_1yr").select("custkey", "year", "urgent_pct_change_1yr")


@query("panel_sentinel_repair_large", REPAIR)
def panel_sentinel_repair_large(spark, folder):
    with many_ranges(spark):
        return panel_sentinel_repair(spark, folder)


@query("panel_lag_bundle", f"""WITH cy AS ({CY})
 SELECT a.custkey, a.year, b.n_orders AS n_orders_lag, b.cents AS cents_lag, b.urgent AS urgent_lag,
 b.finished AS finished_lag FROM cy a LEFT JOIN cy b ON a.custkey = b.custkey AND b.year = a.year - 1""")
def panel_lag_bundle(spark, folder):
    columns = ["n_orders", "cents", "urgent", "finished"]
    out = lag_bundle(customer_years(spark, folder), columns, E_KEY, PERIOD)
    return out.select("custkey", "year", *[f"{c}_lag" for c in columns])


_BATCH = ["lines", "returned"]
_SPANS = [1, 3, 5]


@query("panel_feature_batch", f"WITH sy AS ({SY}) SELECT a.suppkey, a.year, "
       + ", ".join(f"{mean_sql('sy', 'suppkey', c, n)} AS {c}_avg_{n}yr" for c in _BATCH for n in _SPANS) + ", "
       + ", ".join(f"round({change_sql('a.' + c, f'p{n}.' + c)}, 6) AS {c}_pct_change_{n}yr" for c in _BATCH for n in _SPANS)
       + " FROM sy a " + " ".join(
           f"LEFT JOIN sy p{n} ON p{n}.suppkey = a.suppkey AND p{n}.year = a.year - {n}" for n in _SPANS))
def panel_feature_batch(spark, folder):
    out = feature_batch(supplier_years(spark, folder), "suppkey", PERIOD, [(_BATCH, _SPANS, _SPANS)])
    made = [f"{c}_{kind}_{n}yr" for c in _BATCH for kind in ("avg", "pct_change") for n in _SPANS]
    return rounded(out, *made).select("suppkey", "year", *made)


@query("exact_offset_join", f"""WITH cy AS ({CY})
 SELECT a.custkey, a.year, a.cents, b.cents AS cents_before FROM cy a
 JOIN cy b ON a.custkey = b.custkey AND b.year = a.year - 2""")
def exact_offset_join(spark, folder):
    cy = customer_years(spark, folder)
    out = shifted_join(cy, cy, E_KEY, PERIOD, 2, {"cents": "cents_before"}, "inner")
    return out.select("custkey", "year", "cents", "cents_before")


_PARENT = f"""WITH cy AS ({CY}), ny AS ({NY}), pf AS (SELECT a.nationkey, a.year, a.n_orders, a.cents,
 {mean_sql('ny', 'nationkey', 'cents', 5)} AS cents_avg_5yr,
 round({change_sql('a.cents', 'p.cents')}, 6) AS cents_pct_change_5yr
 FROM ny a LEFT JOIN ny p ON p.nationkey = a.nationkey AND p.year = a.year - 5),
 ch AS (SELECT cy.custkey, c.c_nationkey AS nationkey, cy.year FROM cy JOIN customer c ON c.c_custkey = cy.custkey)"""
_PARENT_COLUMNS = ["n_orders", "cents", "cents_avg_5yr", "cents_pct_change_5yr"]


def parent_panel(spark, folder):
    out = feature_batch(nation_years(spark, folder), "nationkey", PERIOD, [(["cents"], [5], [5])])
    return rounded(out, "cents_avg_5yr", "cents_pct_change_5yr")


def child_panel(spark, folder):
    cy = customer_years(spark, folder).select("custkey", "year")
    return cy.join(customer_keys(spark, folder), "custkey")


PARENT_BUNDLE = _PARENT + """ SELECT ch.custkey, ch.nationkey, ch.year, n_orders AS n_orders_tr, cents AS cents_tr,
 cents_avg_5yr AS cents_avg_5yr_tr, cents_pct_change_5yr AS cents_pct_change_5yr_tr
 FROM ch LEFT JOIN pf ON pf.nationkey = ch.nationkey AND pf.year = ch.year"""


@query("parent_bundle", PARENT_BUNDLE)
def q_parent_bundle(spark, folder):
    return parent_bundle(child_panel(spark, folder), parent_panel(spark, folder), "nationkey", PERIOD,
                         _PARENT_COLUMNS, [E_KEY])


@query("parent_bundle_salted", PARENT_BUNDLE)
def q_parent_bundle_salted(spark, folder):
    return parent_bundle(child_panel(spark, folder), parent_panel(spark, folder), "nationkey", PERIOD,
                         _PARENT_COLUMNS, [E_KEY], salted=True)


@query("parent_lag_bundle", _PARENT + """ SELECT ch.custkey, ch.nationkey, ch.year, n_orders AS n_orders_lag_tr,
 cents AS cents_lag_tr, cents_avg_5yr AS cents_avg_5yr_lag_tr, cents_pct_change_5yr AS cents_pct_change_5yr_lag_tr
 FROM ch LEFT JOIN pf ON pf.nationkey = ch.nationkey AND pf.year = ch.year - 1""")
def q_parent_lag_bundle(spark, folder):
    return parent_lag_bundle(child_panel(spark, folder), parent_panel(spark, folder), "nationkey", PERIOD,
                             _PARENT_COLUMNS, [E_KEY])


@query("parent_mean_rollup", f"""SELECT c.c_nationkey AS nationkey, year, round(avg(n_orders), 6) AS n_orders,
 round(avg(cents), 6) AS cents FROM ({CY}) cy JOIN customer c ON c.c_custkey = cy.custkey GROUP BY 1, 2""")
def parent_mean_rollup(spark, folder):
    cy = customer_years(spark, folder).join(customer_keys(spark, folder), "custkey")
    return rounded(parent_mean(cy, "nationkey", PERIOD, ["n_orders", "cents"]), "n_orders", "cents")


@query("update_join", f"""WITH cy AS ({CY}), src AS (SELECT custkey, year, nullif(urgent, 0) AS v FROM cy WHERE n_orders >= 2)
 SELECT cy.custkey, cy.year, CASE WHEN src.custkey IS NOT NULL THEN src.v ELSE cy.finished END AS finished
 FROM cy LEFT JOIN src ON src.custkey = cy.custkey AND src.year = cy.year""")
def q_update_join(spark, folder):
    cy = customer_years(spark, folder)
    patch = cy.where(F.col("n_orders") >= 2).select("custkey", "year", F.nullif("urgent", F.lit(0)).alias("v"))
    return update_join(cy, patch, [E_KEY, PERIOD], {"finished": "v"}).select("custkey", "year", "finished")


@query("county_attr_join", f"""SELECT cy.custkey, cy.year, n.n_name, r.r_name FROM ({CY}) cy
 JOIN customer c ON c.c_custkey = cy.custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def county_attr_join(spark, folder):
    places = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
    ).select(F.col("n_nationkey").alias("nationkey"), "n_name", "r_name")
    return attribute_join(child_panel(spark, folder), places, "nationkey").select("custkey", "year", "n_name", "r_name")


@query("same_key_join", f"""WITH cy AS ({CY}), big AS (SELECT o_custkey AS custkey, CAST(year(o_orderdate) AS INTEGER) AS year,
 max(o_totalprice) AS top_price FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
 SELECT cy.custkey, cy.year, cy.n_orders, big.top_price FROM cy LEFT JOIN big USING (custkey, year)""")
def same_key_join(spark, folder):
    finished = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F")
    big = finished.groupBy(F.col("o_custkey").alias("custkey"), F.year("o_orderdate").alias("year")).agg(
        F.max("o_totalprice").alias("top_price"))
    cy = customer_years(spark, folder)
    return cy.join(big, ["custkey", "year"], "left").select("custkey", "year", "n_orders", "top_price")


# --- labels

QUINTILES = f"""WITH g AS ({GRID}), t AS (SELECT custkey, year,
 ntile(5) OVER (PARTITION BY year ORDER BY cents DESC NULLS FIRST, custkey) AS a,
 ntile(5) OVER (PARTITION BY year ORDER BY CAST(urgent AS DOUBLE) / nullif(finished, 0) DESC NULLS FIRST, custkey) AS b
 FROM g WHERE cents IS NOT NULL)
 SELECT custkey, year, CAST(a = 1 AS INTEGER) AS top20_num, CAST(b = 1 AS INTEGER) AS top20_rate FROM t"""


@query("label_top_quintile", QUINTILES)
def label_top_quintile(spark, folder):
    grid = customer_grid(spark, folder).withColumn("rate", F.try_divide("urgent", "finished"))
    return top_tile_labels(grid, E_KEY, PERIOD, {"top20_num": "cents", "top20_rate": "rate"}, "cents")


@query("label_top_quintile_large", QUINTILES)
def label_top_quintile_large(spark, folder):
    with many_ranges(spark):
        return label_top_quintile(spark, folder)


@query("label_ntile4", f"""SELECT custkey, year, ntile(4) OVER (ORDER BY cents DESC NULLS FIRST, custkey)::INTEGER AS cents_4tiles
 FROM ({CY}) WHERE year = 1997""")
def label_ntile4(spark, folder):
    return tile_discretise(customer_years(spark, folder), "cents", E_KEY, PERIOD, 1997)


def labelled(spark, folder, keep=()):
    """Customer-years with the top-quintile label."""
    return top_tile_labels(customer_years(spark, folder), E_KEY, PERIOD, {"top20": "cents"}, "cents", keep=keep)


def _transition_sql(step: int, name: str) -> str:
    return f"""WITH l AS ({LABELS}) SELECT a.custkey, a.year, a.top20,
 CAST(a.top20 - b.top20 = {step} AS INTEGER) AS {name} FROM l a JOIN l b ON a.custkey = b.custkey AND b.year = a.year - 1"""


@query("label_transition_up", _transition_sql(1, "went_up"))
def label_transition_up(spark, folder):
    return transition_label(labelled(spark, folder), "top20", "went_up", E_KEY, PERIOD)


@query("label_transition_down", _transition_sql(-1, "went_down"))
def label_transition_down(spark, folder):
    return transition_label(labelled(spark, folder), "top20", "went_down", E_KEY, PERIOD, up=False)


@query("label_increase20", f"""WITH cy AS ({CY}) SELECT a.custkey, a.year,
 CAST({change_sql('a.urgent', 'b.urgent')} > 20 AS INTEGER) AS inc20
 FROM cy a LEFT JOIN cy b ON a.custkey = b.custkey AND b.year = a.year - 1""")
def label_increase20(spark, folder):
    out = pct_change(customer_years(spark, folder), "urgent", 1, E_KEY, PERIOD)
    return increase_label(out, "urgent_pct_change_1yr", "inc20").select("custkey", "year", "inc20")


@query("label_lag", f"""WITH l AS ({LABELS}) SELECT a.custkey, a.year, a.top20, b.top20 AS top20_lag
 FROM l a LEFT JOIN l b ON a.custkey = b.custkey AND b.year = a.year - 1""")
def label_lag(spark, folder):
    return lagged_labels(labelled(spark, folder), ["top20"], E_KEY, PERIOD)


@query("period_carry_forward", f"""WITH cy AS ({CY}), v AS (SELECT * FROM (VALUES (1996, 1996, 1997), (1998, 1998, 1998),
 (1999, 1999, 2003)) t(vintage, a, b)) SELECT cy.custkey, cy.year AS vintage, CAST(y AS INTEGER) AS year, cy.n_orders
 FROM cy JOIN v ON v.vintage = cy.year, range(1990, 2010) r(y) WHERE y BETWEEN v.a AND v.b""")
def period_carry_forward(spark, folder):
    vintages = customer_years(spark, folder).withColumnRenamed("year", "vintage")
    spans = {1996: (1996, 1997), 1998: (1998, 1998), 1999: (1999, 2003)}
    return carry_forward(vintages, "vintage", spans, PERIOD).select("custkey", "vintage", "year", "n_orders")


@query("prior_conversion_rate", f"""WITH cy AS ({CY}) SELECT a.custkey, a.year,
 round(CASE WHEN b.finished IS NOT NULL AND b.finished <> 0 THEN CAST(b.urgent AS DOUBLE) / b.finished ELSE 0 END, 6) AS rate_before
 FROM cy a JOIN cy b ON a.custkey = b.custkey AND b.year = a.year - 1""")
def prior_conversion_rate(spark, folder):
    from panelkit.functions.scalars import conversion_rate_or_zero

    cy = customer_years(spark, folder)
    rated = cy.withColumn("rate", conversion_rate_or_zero("urgent", "finished"))
    out = shifted_join(cy, rated, E_KEY, PERIOD, 1, {"rate": "rate_before"}, "inner")
    return rounded(out, "rate_before").select("custkey", "year", "rate_before")


@query("conversion_rate", f"""SELECT custkey, year, round(CASE WHEN finished <> 0 THEN CAST(urgent AS DOUBLE) / finished
 WHEN finished = 0 THEN 0 ELSE NULL END, 6) AS rate FROM ({GRID})""")
def q_conversion_rate(spark, folder):
    grid = customer_grid(spark, folder)
    return rounded(grid.withColumn("rate", conversion_rate("urgent", "finished")), "rate").select(
        "custkey", "year", "rate")


_FLAG_MADE = ["cents_avg_3yr", "cents_pct_change_1yr", "returned_pct_change_1yr"]


@query("flagship_panel", f"""WITH sy AS ({SY}), f AS (SELECT a.suppkey, a.year, a.cents, a.returned,
 {mean_sql('sy', 'suppkey', 'cents', 3)} AS cents_avg_3yr, round({change_sql('a.cents', 'b.cents')}, 6) AS cents_pct_change_1yr,
 round({change_sql('a.returned', 'b.returned')}, 6) AS returned_pct_change_1yr, b.cents AS cents_lag
 FROM sy a LEFT JOIN sy b ON b.suppkey = a.suppkey AND b.year = a.year - 1)
 SELECT *, CAST(ntile(5) OVER (PARTITION BY year ORDER BY cents DESC NULLS FIRST, suppkey) = 1 AS INTEGER) AS top20_num FROM f""")
def flagship(spark, folder):
    sy = supplier_years(spark, folder)
    sy = top_tile_labels(sy, "suppkey", PERIOD, {"top20_num": "cents"}, "cents", keep=["cents", "returned"])
    out = feature_batch(sy, "suppkey", PERIOD, [(["cents"], [3], [1]), (["returned"], [], [1])])
    out = lag_bundle(out, ["cents"], "suppkey", PERIOD)
    return rounded(out, *_FLAG_MADE).select("suppkey", "year", "cents", "returned", *_FLAG_MADE, "cents_lag", "top20_num")
