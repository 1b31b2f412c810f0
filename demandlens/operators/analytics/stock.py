"""Stock page (A18–A22, A35 on product averages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import bins
from ...functions.aggs import dmean, dsum, r6
from ...functions.derive import stock_turnover
from ...sources.demand import DATE, DEMAND, PRICE, PRODUCT, STOCK
from ..filters import FilterParams, bin_equals
from .overview import prepare


def daily_stock(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Per day avg stock, sum Demand and the exact number of distinct
    products (Spark plans the distinct count as an expand + two-level
    aggregate, still partial map-side)."""
    d = prepare(df, filters)
    return d.groupBy(DATE).agg(r6(dmean(STOCK)).alias("avg_stock"), dsum(DEMAND).alias("demand"),
                               F.countDistinct(PRODUCT).alias("products"))


def stock_category_counts(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Rows per stock band (B3), descending, with the share of rows."""
    d = prepare(df, filters).withColumn("band", bins.stock_category())
    per = (d.where(F.col("band").isNotNull()).groupBy("band").agg(F.count("*").alias("n"))
           .withColumn("label", bins.label_of(F.col("band"), bins.interval_labels(bins.STOCK_EDGES))))
    # ≤ 4 band rows: the total over them is a tiny global window
    return (per.withColumn("share_pct", r6(F.col("n") / F.sum("n").over(Window.partitionBy()) * 100))
            .orderBy(F.desc("n"), "band"))


def stock_demand_by_product(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Avg stock, Demand and Price per product."""
    d = prepare(df, filters)
    return d.groupBy(PRODUCT).agg(r6(dmean(STOCK)).alias("avg_stock"), r6(dmean(DEMAND)).alias("avg_demand"),
                                  r6(dmean(PRICE)).alias("avg_price"))


def stock_demand_trend(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A35 (stock page): least-squares line Demand ~ Stock over product averages."""
    per = prepare(df, filters).groupBy(PRODUCT).agg(dmean(STOCK).alias("x"), dmean(DEMAND).alias("y"))
    return per.agg(r6(F.regr_slope("y", "x")).alias("slope"), r6(F.regr_intercept("y", "x")).alias("intercept"),
                   r6(F.regr_r2("y", "x")).alias("r2"), F.regr_count("y", "x").alias("n"))


def stock_turnover_top(df: DataFrame, filters: FilterParams | None = None, n: int = 15) -> DataFrame:
    """Avg turnover per product, the ``n`` highest (ties by product),
    listed ascending as the bar chart shows them."""
    d = prepare(df, filters)
    per = d.groupBy(PRODUCT).agg(dmean(stock_turnover()).alias("turnover"))
    top = per.orderBy(F.desc("turnover"), F.asc(PRODUCT)).limit(n)
    return top.select(PRODUCT, r6(F.col("turnover")).alias("turnover")).orderBy("turnover", PRODUCT)


def kpi_stock(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Avg stock, avg turnover, number of critical-stock rows (Q11)."""
    d = prepare(df, filters)
    return d.agg(r6(dmean(STOCK)).alias("avg_stock"), r6(dmean(stock_turnover())).alias("avg_turnover"),
                 F.count_if(bin_equals(bins.stock_category(), 1)).alias("critical_rows"))
