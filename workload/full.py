"""The whole modelling table, with customers standing for block groups and nations for states."""

from pyspark.sql import functions as F

from panelkit.functions.scalars import SAMPLE_STATES
from panelkit.plans.build import build_panel, build_periods
from panelkit.plans.catalogue import SLOW_MEASURES
from panelkit.sources.files import table
from workload.base import CY, customer_keys, customer_years, query, rounded
from workload.panel import change_sql

_STATES = ", ".join(f"'{s}'" for s in SAMPLE_STATES)
FULL = f"""WITH g AS (SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(custkey // 4 % 7 AS VARCHAR), 3, '0')
 || lpad(CAST(custkey // 4 AS VARCHAR), 6, '0') || CAST(custkey % 4 AS VARCHAR) AS geo_id, year, CAST(urgent AS DOUBLE) AS ev,
 CAST(n_orders AS DOUBLE) AS fil, CAST(finished AS DOUBLE) AS pop FROM ({CY}) JOIN customer ON c_custkey = custkey),
 k AS (SELECT *, substr(geo_id, 1, 11) AS tract, substr(geo_id, 1, 5) AS county FROM g WHERE substr(geo_id, 1, 2) IN ({_STATES})),
 tr AS (SELECT substr(geo_id, 1, 11) AS tract, year, sum(ev) AS ev, sum(pop) AS pop FROM g GROUP BY 1, 2),
 pm AS (SELECT substr(geo_id, 1, 5) AS county, year, CAST(sum(fil) AS INTEGER) AS bldg FROM g GROUP BY 1, 2),
 f AS (SELECT a.*, {change_sql('a.ev', 'b.ev')} AS ch, (SELECT avg(m.ev) FROM k m WHERE m.geo_id = a.geo_id
 AND m.year BETWEEN a.year - 3 AND a.year - 1) AS mean3 FROM k a LEFT JOIN k b ON b.geo_id = a.geo_id AND b.year = a.year - 1),
 l AS (SELECT a.geo_id, a.year, b.ch AS ch_lag FROM f a LEFT JOIN f b ON b.geo_id = a.geo_id AND b.year = a.year - 1),
 mx AS (SELECT year, max(ch_lag) AS m FROM l WHERE ch_lag <> 999999 GROUP BY 1),
 lab AS (SELECT geo_id, year, CAST(ntile(5) OVER (PARTITION BY year ORDER BY ev DESC NULLS FIRST, geo_id) = 1 AS INTEGER) AS top20_num FROM k)
 SELECT f.geo_id, f.year, p.ev AS evictions_lag, round(p.mean3, 6) AS evictions_avg_3yr_lag,
 round(CASE WHEN l.ch_lag = 999999 THEN coalesce(mx.m, l.ch_lag) ELSE l.ch_lag END, 6) AS evictions_pct_change_1yr_lag,
 tr.pop AS population_tr, tp.ev AS evictions_lag_tr, f.fil AS avg_hh_size, pm.bldg AS total_bldg,
 CAST(substr(f.county, 3, 3) = '003' AS INTEGER) AS urban, CAST(substr(f.geo_id, 1, 2) IN ('10', '11', '12', '13', '24', '37', '45', '51', '54') AS INTEGER) AS div_sa,
 lab.top20_num, CAST(f.ch > 20 AS INTEGER) AS e_num_inc_20pct, lb.top20_num AS top20_num_lag
 FROM f LEFT JOIN f p ON p.geo_id = f.geo_id AND p.year = f.year - 1 JOIN l ON l.geo_id = f.geo_id AND l.year = f.year
 LEFT JOIN mx ON mx.year = f.year LEFT JOIN tr ON tr.tract = f.tract AND tr.year = f.year
 LEFT JOIN tr tp ON tp.tract = f.tract AND tp.year = f.year - 1 LEFT JOIN pm ON pm.county = f.county AND pm.year = f.year
 JOIN lab ON lab.geo_id = f.geo_id AND lab.year = f.year LEFT JOIN lab lb ON lb.geo_id = f.geo_id AND lb.year = f.year - 1"""


def panel_inputs(spark, folder):
    """Block groups, tracts, permits, household sizes and urban counties, made from the order tables."""
    key = F.col("custkey")
    block = F.floor(key / 4)
    code = F.concat(
        F.lpad(F.col("nationkey").cast("string"), 2, "0"), F.lpad((block % 7).cast("string"), 3, "0"),
        F.lpad(block.cast("string"), 6, "0"), (key % 4).cast("string"),
    )
    groups = customer_years(spark, folder).join(customer_keys(spark, folder), "custkey").select(
        code.alias("geo_id"), "year", F.col("urgent").cast("double").alias("evictions"),
        F.col("n_orders").cast("double").alias("eviction_filings"),
        (F.col("urgent") / F.col("n_orders") * 100).alias("eviction_rate"),
        F.col("finished").cast("double").alias("eviction_filing_rate"),
        *[F.col("finished").cast("double").alias(c) for c in SLOW_MEASURES],
    )
    measures = [c for c in groups.columns if c not in ("geo_id", "year")]
    tracts = groups.groupBy(F.substring("geo_id", 1, 11).alias("geo_id"), "year").agg(*[F.sum(c).alias(c) for c in measures])
    permits = groups.groupBy(F.substring("geo_id", 1, 5).alias("geo_id"), "year").agg(
        F.sum("eviction_filings").cast("int").alias("total_bldg"), F.sum("evictions").cast("int").alias("total_units"),
        F.sum("population").alias("total_value"),
    )
    homes = groups.select("geo_id", "year", F.col("eviction_filings").alias("avg_size"))
    urban = table(spark, folder, "nation").select((F.col("n_nationkey") * 1000 + 3).alias("GEOID"))
    return groups, tracts, permits, homes, urban


@query("full_panel", FULL)
def full_panel(spark, folder):
    out = build_panel(*panel_inputs(spark, folder))
    made = ["evictions_avg_3yr_lag", "evictions_pct_change_1yr_lag"]
    return rounded(out, *made).select(
        "geo_id", "year", "evictions_lag", *made, "population_tr", "evictions_lag_tr", "avg_hh_size", "total_bldg", "urban",
        "div_sa", "top20_num", "e_num_inc_20pct", "top20_num_lag",
    )


_HOME = FULL[:FULL.index(" SELECT f.geo_id, f.year, p.ev")] + f""",
 hm AS (SELECT a.geo_id, a.year, a.tract, a.fil, (SELECT avg(m.fil) FROM k m WHERE m.geo_id = a.geo_id AND m.year BETWEEN a.year - 5 AND a.year - 1) AS mean5,
 {change_sql('a.fil', 'b.fil')} AS ch5 FROM k a LEFT JOIN k b ON b.geo_id = a.geo_id AND b.year = a.year - 5),
 th AS (SELECT substr(geo_id, 1, 11) AS tract, year, avg(fil) AS fil FROM g GROUP BY 1, 2),
 tm AS (SELECT a.tract, a.year, a.fil, (SELECT avg(m.fil) FROM th m WHERE m.tract = a.tract AND m.year BETWEEN a.year - 5 AND a.year - 1) AS mean5 FROM th a),
 allrows AS (SELECT hm.geo_id, hm.year, hm.mean5 AS avg_hh_size_avg_5yr, hm.ch5 AS avg_hh_size_pct_change_5yr, tm.fil AS avg_hh_size_tr,
 tm.mean5 AS avg_hh_size_avg_5yr_tr, CAST(lab.top20_num - lb.top20_num = 1 AS INTEGER) AS top20_num_01, CAST(lab.top20_num - lb.top20_num = -1 AS INTEGER) AS top20_num_10
 FROM hm LEFT JOIN tm ON tm.tract = hm.tract AND tm.year = hm.year JOIN lab ON lab.geo_id = hm.geo_id AND lab.year = hm.year
 LEFT JOIN lab lb ON lb.geo_id = hm.geo_id AND lb.year = hm.year - 1)
 SELECT geo_id, year, round(avg_hh_size_avg_5yr, 6) AS avg_hh_size_avg_5yr, round(avg_hh_size_pct_change_5yr, 6) AS avg_hh_size_pct_change_5yr,
 round(avg_hh_size_tr, 6) AS avg_hh_size_tr, round(avg_hh_size_avg_5yr_tr, 6) AS avg_hh_size_avg_5yr_tr, top20_num_01, top20_num_10 FROM allrows"""
_HOME_COLUMNS = ["avg_hh_size_avg_5yr", "avg_hh_size_pct_change_5yr", "avg_hh_size_tr", "avg_hh_size_avg_5yr_tr", "top20_num_01", "top20_num_10"]
_AFTER = 1996


@query("full_panel_homes", _HOME)
def full_panel_homes(spark, folder):
    """Household-size features of both levels and the moves of the label, of the whole panel."""
    out = build_panel(*panel_inputs(spark, folder))
    return rounded(out, *_HOME_COLUMNS[:4]).select("geo_id", "year", *_HOME_COLUMNS)


@query("full_panel_since", f"{FULL.replace(' SELECT f.geo_id, f.year, p.ev', ', whole AS (SELECT f.geo_id, f.year, p.ev')}) SELECT * FROM whole WHERE year > {_AFTER}")
def full_panel_since(spark, folder):
    """The periods after a watermark, built from the periods they look back to."""
    out = build_periods(*panel_inputs(spark, folder), _AFTER)
    made = ["evictions_avg_3yr_lag", "evictions_pct_change_1yr_lag"]
    return rounded(out, *made).select(
        "geo_id", "year", "evictions_lag", *made, "population_tr", "evictions_lag_tr", "avg_hh_size", "total_bldg", "urban",
        "div_sa", "top20_num", "e_num_inc_20pct", "top20_num_lag",
    )
