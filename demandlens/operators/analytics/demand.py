"""Demand page (A8–A17, W1 on the daily total).

Every operator groups the fact rows first (partial aggregation runs
map-side, so a product or week holding a third of all rows costs one
pre-aggregated row per task), and windows only run on those small results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.aggs import argmax, dmean, dsum, r6, std
from ...sources.demand import CAMPAIGN, DATE, DEMAND, PRICE, PRODUCT, SEASON
from ..filters import FilterParams
from .overview import box, prepare

WEEKS = list(range(1, 54))


def kpi_demand(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A8 + A9 + A10: max, min, sum of Demand, peak ISO week (ties → smallest
    week) and volatility std/mean·100, as one row.  The week totals come from
    a grouped aggregate of ≤ 53 rows, joined to the one-row KPIs."""
    d = prepare(df, filters)
    kpis = d.agg(F.max(DEMAND).cast("double").alias("max_demand"), F.min(DEMAND).cast("double").alias("min_demand"),
                 dsum(DEMAND).alias("total_demand"),
                 r6(std(DEMAND) / dmean(DEMAND) * 100).alias("volatility_pct"))
    weeks = d.groupBy(F.weekofyear(DATE).alias("week")).agg(F.sum(DEMAND).alias("w"))
    peak = weeks.agg(argmax("week", F.col("w")).cast("bigint").alias("peak_week"))
    return kpis.crossJoin(peak)


def daily_demand(df: DataFrame, filters: FilterParams | None = None, by_product: bool = False) -> DataFrame:
    """Sum of Demand per day (all products) or per (product, day)."""
    d = prepare(df, filters)
    keys = [PRODUCT, DATE] if by_product else [DATE]
    return d.groupBy(*keys).agg(dsum(DEMAND).alias("demand"))


def daily_moving_average(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A11 + W1: daily total with its 7-row trailing mean (``min_periods=1``).

    The window runs on the daily totals: one row per calendar day, so its
    size is bounded by the date range, not by the number of sales rows.
    """
    daily = daily_demand(df, filters)
    w = Window.orderBy(DATE).rowsBetween(-6, 0)
    return daily.withColumn("ma7", r6(F.avg("demand").over(w)))


def seasonal_distribution(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Demand box per season."""
    return box(prepare(df, filters).withColumn("season", F.col(SEASON)), "season")


def yearly_demand(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A13."""
    d = prepare(df, filters)
    return d.groupBy(F.year(DATE).cast("bigint").alias("year")).agg(dsum(DEMAND).alias("demand")).orderBy("year")


def product_performance(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Sum Demand, avg Price and the treemap revenue sum × avg (Q10)."""
    d = prepare(df, filters)
    out = d.groupBy(PRODUCT).agg(dsum(DEMAND).alias("demand"), dmean(PRICE).alias("_p"))
    return (out.select(PRODUCT, "demand", r6(F.col("_p")).alias("avg_price"),
                       r6(F.col("demand") * F.col("_p")).alias("revenue"))
            .orderBy(F.desc("demand"), PRODUCT))


def campaign_demand_share(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Demand per campaign (null campaigns dropped, Q5) and percent of
    the total; the share window runs on the per-campaign rows only."""
    d = prepare(df, filters).where(F.col(CAMPAIGN).isNotNull())
    per = d.groupBy(CAMPAIGN).agg(dsum(DEMAND).alias("demand"))
    return (per.withColumn("share_pct", r6(F.col("demand") / F.sum("demand").over(Window.partitionBy()) * 100))
            .orderBy(F.desc("demand"), CAMPAIGN))


def _np_round2(c):
    """numpy ``round(x, 2)``: rint(x·100)/100 (half to even on the scaled double)."""
    return F.rint(c * 100) / 100


def weekly_variation(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """By ISO week (years merged, Q13): sum, mean, sample std rounded to
    2 first (Q12), then std/mean·100 with null → 0."""
    d = prepare(df, filters)
    out = d.groupBy(F.weekofyear(DATE).cast("bigint").alias("week")).agg(
        _np_round2(dsum(DEMAND)).alias("total"), _np_round2(dmean(DEMAND)).alias("mean"),
        _np_round2(std(DEMAND)).alias("std"))
    return out.withColumn("variation_pct", r6(F.coalesce(F.col("std") / F.col("mean") * 100, F.lit(0.0)))) \
              .orderBy("week")


def week_product_matrix(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Product × ISO week matrix of summed Demand, 0-filled.

    Pivot values are given explicitly (weeks 1..53), so Spark needs no extra
    job to discover them and plans one partial/final aggregation.
    """
    d = prepare(df, filters)
    wide = (d.withColumn("week", F.weekofyear(DATE)).groupBy(PRODUCT)
            .pivot("week", WEEKS).agg(F.sum(DEMAND)).na.fill(0.0))
    return wide.select(PRODUCT, *[F.col(str(w)).cast("double").alias(f"w{w:02d}") for w in WEEKS])


def week_product_long(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A17 long form with J2: every (observed week × product) cell, missing = 0.

    The observed ISO weeks are gathered into one array of at most 53 values
    (a bound fixed by the calendar), attached to each distinct product as a
    one-row scalar and exploded; the sums are then left-joined on
    (product, week).  No pairwise join of two data-sized sides is formed.
    """
    d = prepare(df, filters).withColumn("week", F.weekofyear(DATE).cast("bigint"))
    sums = d.groupBy(PRODUCT, "week").agg(dsum(DEMAND).alias("demand"))
    weeks = sums.agg(F.array_sort(F.collect_set("week")).alias("_weeks"))
    grid = (sums.select(PRODUCT).distinct().crossJoin(F.broadcast(weeks))
            .select(PRODUCT, F.explode("_weeks").alias("week")))
    return (grid.join(sums, [PRODUCT, "week"], "left")
            .select(PRODUCT, "week", F.coalesce("demand", F.lit(0.0)).alias("demand")))
