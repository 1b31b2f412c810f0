"""Filters and predicates.

F1–F5 build one composed ``Column`` predicate (F6) so Catalyst pushes it
into the parquet scan (``PushedFilters``) in one place instead of five
materialised masks.  Per-series cuts (F8, F9, F11) work on the daily series
(one row per product and day, already reduced map-side) with window
aggregates partitioned by product, so no threshold table is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.demand import CAMPAIGN, DATE, DEMAND, DISCOUNT, PRICE, PRODUCT, ROW_ID


@dataclass(frozen=True)
class FilterParams:
    """The filter bar: empty or None means "all" (Q2)."""
    products: Sequence[str] | None = None
    campaigns: Sequence[str] | None = None
    price_range: tuple[float, float] | None = None
    discount_range_pct: tuple[float, float] | None = None
    start_date: str | None = None
    end_date: str | None = None


def where_products(products: Sequence[str] | None) -> Column | None:
    """membership; an empty list means no filter."""
    return F.col(PRODUCT).isin(list(products)) if products else None


def where_campaigns(campaigns: Sequence[str] | None) -> Column | None:
    """campaign membership; null campaigns never match."""
    return F.col(CAMPAIGN).isin(list(campaigns)) if campaigns else None


def where_price(lo: float, hi: float) -> Column:
    """closed range; null prices drop out (Q4)."""
    return F.col(PRICE).between(F.lit(lo), F.lit(hi))


def where_discount(lo_pct: float, hi_pct: float) -> Column:
    """closed range on lo/100 .. hi/100."""
    return F.col(DISCOUNT).between(F.lit(lo_pct / 100.0), F.lit(hi_pct / 100.0))


def where_dates(start: str | None, end: str | None) -> Column | None:
    """closed date range, applied only when both ends are given."""
    if start and end:
        return F.col(DATE).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    return None


def smart_filter(params: FilterParams | None) -> Column:
    """F1–F5 folded into one predicate (``lit(True)`` when nothing is set)."""
    p = params or FilterParams()
    parts = [where_products(p.products), where_campaigns(p.campaigns),
             where_price(*p.price_range) if p.price_range else None,
             where_discount(*p.discount_range_pct) if p.discount_range_pct else None,
             where_dates(p.start_date, p.end_date)]
    pred = F.lit(True)
    for c in parts:
        if c is not None:
            pred = pred & c
    return pred


def apply_filters(df: DataFrame, params: FilterParams | None) -> DataFrame:
    return df.where(smart_filter(params)) if params else df


def positive_demand(df: DataFrame, col: str = DEMAND) -> DataFrame:
    """Demand not null and > 0."""
    return df.where(F.col(col).isNotNull() & (F.col(col) > 0))


def below_quantile(daily: DataFrame, q: float, value: str = DEMAND, product: str = PRODUCT) -> DataFrame:
    """F8: keep days whose value is strictly below the product's q-quantile (Q17).

    The quantile is an exact window aggregate over the product's daily rows
    (bounded by the number of days), so no threshold table is shuffled back.
    """
    w = Window.partitionBy(product)
    return (daily.withColumn("_qcut", F.percentile(F.col(value), q).over(w))
            .where(F.col(value) < F.col("_qcut")).drop("_qcut"))


def iqr_clean(daily: DataFrame, value: str = "y", product: str = PRODUCT,
              report: bool = False) -> DataFrame:
    """drop rows with any null, keep value > 0, then keep
    Q1 − 1.5·IQR ≤ value ≤ Q3 + 1.5·IQR per product.  With ``report`` the
    per-product count of removed rows is returned instead."""
    base = drop_missing(daily).where(F.col(value) > 0)
    w = Window.partitionBy(product)
    qs = F.percentile(F.col(value), [0.25, 0.75]).over(w)
    tagged = base.withColumn("_q", qs).withColumn("_iqr", F.col("_q")[1] - F.col("_q")[0])
    keep = (F.col(value) >= F.col("_q")[0] - 1.5 * F.col("_iqr")) & (F.col(value) <= F.col("_q")[1] + 1.5 * F.col("_iqr"))
    if report:
        return tagged.groupBy(product).agg(F.count_if(~keep).alias("removed"), F.count("*").alias("rows"))
    return tagged.where(keep).drop("_q", "_iqr")


def drop_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """drop rows with a null in ``cols`` (or in any column)."""
    return df.na.drop(subset=list(cols)) if cols else df.na.drop()


def min_history(daily: DataFrame, n: int = 30, product: str = PRODUCT) -> DataFrame:
    """keep products with at least ``n`` rows."""
    w = Window.partitionBy(product)
    return daily.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= n).drop("_n")


def sample_n(df: DataFrame, n: int, seed: str = "42", key: str = ROW_ID) -> DataFrame:
    """deterministic sample of at most ``n`` rows: smallest md5(seed‖key).

    The limit is the feature here (scatter samples).  Spark plans it as a
    per-partition top-n followed by a merge of n rows per partition
    (TakeOrderedAndProject), so only n × partitions rows ever move.
    """
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key))), F.col(key)).limit(n)


def future_rows(forecast: DataFrame, history: DataFrame, date: str = "ds", product: str = PRODUCT) -> DataFrame:
    """forecast rows after each product's last history day."""
    last = history.groupBy(product).agg(F.max(date).alias("_last"))
    return forecast.join(last, product).where(F.col(date) > F.col("_last")).drop("_last")


def bin_equals(col: str | Column, value) -> Column:
    """rows of one bin / status."""
    return (F.col(col) if isinstance(col, str) else col) == F.lit(value)
