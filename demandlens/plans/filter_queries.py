"""Registered queries with the filter bar set (F1–F6), and row-level measures and
categories (P1, P5–P10, B1, B2, B9, B12, X8, X10) grouped to counts and sums.

Predicates, edges and labels of the oracles are written out, apart from the engine's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bins, derive
from ..operators.analytics import campaign as cp
from ..operators.analytics import demand as dm
from ..operators.analytics import overview as ov
from ..operators.analytics import price as pr
from ..operators.analytics import stock as st
from ..operators.filters import FilterParams
from ..session import cut_lineage
from ..sources.demand import CAMPAIGN, DEMAND, DISCOUNT, PRODUCT
from .registry import ORACLES, register
from .sqlgen import POS, cut, dsum

PAGE = FilterParams(products=["Brand#11", "Brand#12", "Brand#23", "Brand#34", "Brand#45"],
                    campaigns=["1-URGENT", "2-HIGH", "5-LOW"], price_range=(20, 150), discount_range_pct=(5, 30),
                    start_date="1996-01-01", end_date="2000-06-30")
PAGE_SQL = ("Product_ID IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34', 'Brand#45')"
            " AND Marketing_Campaign IN ('1-URGENT', '2-HIGH', '5-LOW') AND Price BETWEEN 20 AND 150"
            " AND Discount BETWEEN 0.05 AND 0.30 AND Date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30'")

# one filter at a time; an empty list and a range without both ends filter nothing, the default price slider
# (0 to the whole part of the highest price) drops rows without a price and those above it
SINGLE = {
    "products": (FilterParams(products=["Brand#11", "Brand#55"]), "Product_ID IN ('Brand#11', 'Brand#55')"),
    "campaigns": (FilterParams(campaigns=["3-MEDIUM"]), "Marketing_Campaign IN ('3-MEDIUM')"),
    "price": (FilterParams(price_range=(50, 100)), "Price BETWEEN 50 AND 100"),
    "discount": (FilterParams(discount_range_pct=(0, 15)), "Discount BETWEEN 0 AND 0.15"),
    "dates": (FilterParams(start_date="1997-03-01", end_date="1997-05-31"), "Date BETWEEN DATE '1997-03-01' AND DATE '1997-05-31'"),
    "empty_lists": (FilterParams(products=[], campaigns=[], start_date="1997-03-01"), "1 = 1"),
    "default_slider": (FilterParams(price_range=(0, 209)), "Price BETWEEN 0 AND 209"),
}


def _filtered(name: str, base: str, fn, params: FilterParams, predicate: str) -> None:
    """``base``'s query with the filter bar set; its oracle is that of ``base`` with the predicate beside F7."""
    def run(df: DataFrame) -> DataFrame:
        return fn(df, params)
    run.__doc__ = fn.__doc__
    register(name, ORACLES[base].replace(POS, f"{POS} AND {predicate}"), raw_oracle=True)(run)


for _base, _fn in (("top_products", ov.top_products), ("kpi_overview", ov.kpi_overview), ("kpi_demand", dm.kpi_demand), ("weekly_variation", dm.weekly_variation),
                   ("price_funnel", pr.price_funnel), ("kpi_price", pr.kpi_price), ("kpi_stock", st.kpi_stock), ("daily_stock", st.daily_stock),
                   ("campaign_roi_summary", cp.campaign_roi_summary), ("kpi_campaign", cp.kpi_campaign), ("seasonal_campaign_rollup", cp.seasonal_campaign_rollup)):
    _filtered(f"{_base}_filtered", _base, _fn, PAGE, PAGE_SQL)
for _name, (_params, _sql) in SINGLE.items():
    _filtered(f"top_products_by_{_name}", "top_products", ov.top_products, _params, _sql)


# ------------------------------------------------------------------ row-level measures and categories
register("calendar_parts", f"""
SELECT CAST(year(Date) AS INTEGER) AS Year, CAST(quarter(Date) AS INTEGER) AS Quarter, CAST(month(Date) AS INTEGER) AS Month, monthname(Date) AS Month_Name,
       CAST(weekofyear(Date) AS INTEGER) AS Week, dayname(Date) AS Weekday, COUNT(*) AS n, {dsum('Demand')} AS demand
FROM demand WHERE {POS} GROUP BY 1, 2, 3, 4, 5, 6""")(
    lambda df: derive.with_calendar_parts(ov.prepare(df)).groupBy("Year", "Quarter", "Month", "Month_Name", "Week", "Weekday").agg(
        F.count("*").alias("n"), F.sum(DEMAND).alias("demand")))

register("price_measures", f"""
SELECT Product_ID, round(CAST(SUM(Price * (1 - Discount)) AS DOUBLE), 6) AS discounted_price,
       round(CAST(SUM(Price - Competitor_Price) AS DOUBLE), 6) AS price_difference,
       COUNT(*) FILTER (WHERE Price < Competitor_Price) AS cheaper
FROM demand WHERE {POS} GROUP BY Product_ID""")(
    lambda df: ov.prepare(df).groupBy(PRODUCT).agg(
        F.round(F.sum(derive.discounted_price()).cast("double"), 6).alias("discounted_price"),
        F.round(F.sum(derive.price_difference()).cast("double"), 6).alias("price_difference"),
        F.count_if(derive.price_difference() < 0).alias("cheaper")))

register("stock_efficiency", f"""
, r AS (SELECT Product_ID, Demand, Stock_Availability / (Demand + 1.0) AS ratio FROM demand WHERE {POS})
SELECT Product_ID, CASE WHEN ratio > 2 THEN 'excess' WHEN ratio < 0.5 THEN 'short' ELSE 'optimal' END AS efficiency,
       COUNT(*) AS n, {dsum('Demand')} AS demand, round(SUM(ratio) / COUNT(ratio), 6) AS avg_ratio
FROM r GROUP BY 1, 2""")(
    lambda df: ov.prepare(df).groupBy(PRODUCT, derive.stock_efficiency().alias("efficiency")).agg(
        F.count("*").alias("n"), F.sum(DEMAND).alias("demand"), F.round(F.avg(derive.stock_demand_ratio()), 6).alias("avg_ratio")))

register("price_discount_categories", f"""
SELECT {cut('Price', [0, 50, 100, 200, float('inf')], True)} AS price_category,
       {cut('Discount', [0, 0.05, 0.15, 0.3, 1.0], True)} AS discount_category, COUNT(*) AS n, {dsum('Demand')} AS demand
FROM demand WHERE {POS} GROUP BY 1, 2""")(
    lambda df: ov.prepare(df).groupBy(bins.price_category().alias("price_category"), bins.discount_category().alias("discount_category")).agg(
        F.count("*").alias("n"), F.sum(DEMAND).alias("demand")))

register("equal_width_stock", f"""
, base AS (SELECT * FROM demand WHERE {POS})
, s AS (SELECT min(Stock_Availability) AS mn, max(Stock_Availability) AS mx FROM base)
, b AS (SELECT Demand, {cut('Stock_Availability', ['@(s.mn - (s.mx - s.mn) * 0.001)', '@(s.mn + (s.mx - s.mn) / 4 * 1)', '@(s.mn + (s.mx - s.mn) / 4 * 2)', '@(s.mn + (s.mx - s.mn) / 4 * 3)', '@s.mx'])} AS band
        FROM base, s)
SELECT band, COUNT(*) AS n, {dsum('Demand')} AS demand FROM b GROUP BY band""")(
    lambda df: bins.equal_width_band(ov.prepare(df), "Stock_Availability", 4).groupBy("band").agg(F.count("*").alias("n"), F.sum(DEMAND).alias("demand")))

register("sales_levels", f"""
, base AS (SELECT * FROM demand WHERE {POS})
, q AS (SELECT quantile_cont(CAST(Demand AS DOUBLE), [0.33, 0.67]) AS yq FROM base)
SELECT Product_ID, {cut('Demand', ['@0', '@q.yq[1]', '@q.yq[2]', float('inf')], True)} AS sales_level, COUNT(*) AS n, {dsum('Demand')} AS demand
FROM base, q GROUP BY 1, 2""")(
    lambda df: bins.level_bands(cut_lineage(ov.prepare(df).select(PRODUCT, DISCOUNT, DEMAND))).groupBy(PRODUCT, "sales_level").agg(F.count("*").alias("n"), F.sum(DEMAND).alias("demand")))

register("history_products", """
, daily AS (SELECT Product_ID, Date, SUM(Demand) AS y FROM demand GROUP BY 1, 2)
, n AS (SELECT Product_ID, COUNT(*) AS days FROM daily GROUP BY 1)
SELECT Product_ID, days FROM n WHERE days >= 1400""")(lambda df: _long_products(df, 1400))

register("campaign_labels", """
SELECT DISTINCT Marketing_Campaign AS value, upper(substr(trim(Marketing_Campaign), 1, 1)) || lower(substr(trim(Marketing_Campaign), 2)) AS label
FROM demand WHERE Marketing_Campaign IS NOT NULL""")(
    lambda df: df.where(F.col(CAMPAIGN).isNotNull()).select(F.col(CAMPAIGN).alias("value"), derive.title_label(CAMPAIGN).alias("label")).distinct())

register("kpi_overview_text", f"""
SELECT format('{{:,.2f}}', SUM(Demand) / COUNT(Demand)) AS avg_demand,
       format('{{:,.0f}}', CAST(SUM(Demand) AS DOUBLE)) AS total_demand
FROM demand WHERE {POS}""")(
    lambda df: ov.prepare(df).agg(F.format_number(F.avg(DEMAND), 2).alias("avg_demand"), F.format_number(F.sum(DEMAND), 0).alias("total_demand")))


def _long_products(df: DataFrame, n: int) -> DataFrame:
    """products with at least ``n`` selling days."""
    from ..forecast.series import daily_series
    from ..operators.filters import min_history
    return min_history(daily_series(df), n).groupBy(PRODUCT).agg(F.count("*").alias("days"))


register("box_outliers_revenue", f"""
, base AS (SELECT * FROM demand WHERE {POS})
, b AS (SELECT *, CAST(Price * CAST(Demand AS DECIMAL(18,4)) AS DOUBLE) AS y, {cut('Marketing_Effect', [0, 0.3, 0.6, 0.8, 1.0])} AS band FROM base)
, f AS (SELECT band AS fb, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM b WHERE band IS NOT NULL GROUP BY 1)
SELECT band, list_extract(['(0, 0.3]', '(0.3, 0.6]', '(0.6, 0.8]', '(0.8, 1.0]'], band) AS band_label, Product_ID, Date, Demand AS demand, y AS measure
FROM b JOIN f ON band = fb WHERE y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1)""")(
    lambda df: ov.box_outliers(df, "Marketing_Effect", measure=derive.revenue()))
