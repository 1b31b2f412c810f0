"""Campaign & discount page (A23–A29, A35 on the sample, A38)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import bins
from ...functions.aggs import argmax, dmean, dsum, r6
from ...functions.derive import (campaign_effectiveness, campaign_roi, discount_amount, revenue,
                                 week_start)
from ...session import cut_lineage
from ...sources.demand import CAMPAIGN, DEMAND, DISCOUNT, EFFECT, PRICE, PRODUCT, SEASON
from ..filters import FilterParams, sample_n
from .overview import prepare


def _campaign_rows(df: DataFrame, filters: FilterParams | None) -> DataFrame:
    """Grouping by campaign drops null campaigns (Q5)."""
    return prepare(df, filters).where(F.col(CAMPAIGN).isNotNull())


def campaign_performance(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Per campaign sum Demand, sum Revenue, avg effect, avg Discount; by Revenue."""
    d = _campaign_rows(df, filters)
    return (d.groupBy(CAMPAIGN).agg(dsum(DEMAND).alias("demand"), dsum(revenue()).alias("revenue"),
                                    r6(dmean(EFFECT)).alias("avg_effect"), r6(dmean(DISCOUNT)).alias("avg_discount"))
            .orderBy("revenue", CAMPAIGN))


def _minmax_0_100(c: str, w: Window) -> F.Column:
    """(v − min)/(max − min)·100 across campaigns; constant → 50."""
    mn, mx = F.min(c).over(w), F.max(c).over(w)
    return F.when(mx == mn, F.lit(50.0)).otherwise(F.coalesce((F.col(c) - mn) / (mx - mn) * 100, F.lit(50.0)))


def campaign_radar(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Five per-campaign measures scaled to 0–100, discount inverted.
    The scaling window runs over the per-campaign rows (a handful)."""
    d = _campaign_rows(df, filters)
    per = d.groupBy(CAMPAIGN).agg(dsum(DEMAND).alias("demand"), dsum(revenue()).alias("revenue"),
                                  dmean(EFFECT).alias("effect"), dmean(campaign_roi()).alias("roi"),
                                  dmean(DISCOUNT).alias("discount"))
    w = Window.partitionBy()
    return per.select(CAMPAIGN,
                      r6(_minmax_0_100("demand", w)).alias("demand_score"),
                      r6(_minmax_0_100("revenue", w)).alias("revenue_score"),
                      r6(_minmax_0_100("effect", w)).alias("effect_score"),
                      r6(_minmax_0_100("roi", w)).alias("roi_score"),
                      r6(100 - _minmax_0_100("discount", w)).alias("discount_score"))


def campaign_discount_flow(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Row counts per (campaign, discount level B11) over rows where the
    campaign, B11 and B12 are all present; node numbers: campaigns 0..c−1 in
    name order, then the three discount levels."""
    # edges and bands read one copy of three columns
    d = bins.level_bands(cut_lineage(prepare(df, filters).select(CAMPAIGN, DISCOUNT, DEMAND)))
    d = d.where(F.col(CAMPAIGN).isNotNull() & F.col("discount_level").isNotNull() & F.col("sales_level").isNotNull())
    per = d.groupBy(CAMPAIGN, "discount_level").agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    per = per.withColumn("source", F.dense_rank().over(Window.orderBy(CAMPAIGN)) - 1)
    n_campaigns = F.max("source").over(w) + 1
    return per.select(CAMPAIGN, F.col("discount_level").cast("bigint").alias("discount_level"),
                      bins.label_of(F.col("discount_level"), bins.part_labels(3)).alias("level_label"),
                      "n", F.col("source").cast("bigint").alias("source"),
                      (n_campaigns + F.col("discount_level") - 1).cast("bigint").alias("target"))


def campaign_weekly_timeline(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Per (week start, campaign) sum Demand and Revenue."""
    d = _campaign_rows(df, filters)
    return (d.groupBy(week_start().alias("week_start"), CAMPAIGN)
            .agg(dsum(DEMAND).alias("demand"), dsum(revenue()).alias("revenue")))


def campaign_roi_summary(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Avg ROI, sum Revenue, sum discount amount and net; by ROI."""
    d = _campaign_rows(df, filters)
    per = d.groupBy(CAMPAIGN).agg(r6(dmean(campaign_roi())).alias("avg_roi"), F.sum(revenue()).alias("_r"),
                                  F.sum(discount_amount()).alias("_a"))
    return per.select(CAMPAIGN, "avg_roi", F.col("_r").cast("double").alias("revenue"),
                      F.col("_a").cast("double").alias("discount_amount"),
                      (F.col("_r") - F.col("_a")).cast("double").alias("net_profit")).orderBy("avg_roi", CAMPAIGN)


def seasonal_campaign_rollup(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """(season, campaign) sums plus the season parents and the grand
    total a sunburst shows: ``rollup`` with ``grouping_id`` as the level."""
    d = _campaign_rows(df, filters)
    return (d.rollup(F.col(SEASON).alias("season"), F.col(CAMPAIGN).alias("campaign"))
            .agg(dsum(DEMAND).alias("demand"), dsum(revenue()).alias("revenue"),
                 F.grouping_id().cast("bigint").alias("level")))


def kpi_campaign(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Avg Discount·100, total discount amount, campaign with the greatest
    total effectiveness, avg ROI; defaults when nothing is selected.

    One scan: per-campaign partial sums (the null campaign is its own group),
    then one global fold over those few rows."""
    d = prepare(df, filters)
    per = d.groupBy(CAMPAIGN).agg(
        F.sum(DISCOUNT).alias("_ds"), F.count(DISCOUNT).alias("_dn"), F.sum(discount_amount()).alias("_amt"),
        F.sum(campaign_effectiveness()).alias("_eff"), F.sum(campaign_roi()).alias("_roi"),
        F.count(campaign_roi()).alias("_rn"))
    named = F.when(F.col(CAMPAIGN).isNotNull(), F.col("_eff"))
    best = F.min_by(F.col(CAMPAIGN), F.struct(F.when(named.isNull(), 1).otherwise(0), -named, F.col(CAMPAIGN)))
    out = per.agg(F.sum("_ds").cast("double").alias("_ds"), F.sum("_dn").alias("_dn"),
                  F.sum("_amt").cast("double").alias("_amt"), best.alias("_best"),
                  F.sum("_roi").alias("_roi"), F.sum("_rn").alias("_rn"))
    return out.select(
        r6(F.coalesce(F.col("_ds") / F.col("_dn") * 100, F.lit(0.0))).alias("avg_discount_pct"),
        F.coalesce(F.col("_amt"), F.lit(0.0)).alias("total_discount"),
        F.coalesce(F.col("_best"), F.lit("no data")).alias("best_campaign"),
        r6(F.coalesce(F.col("_roi") / F.col("_rn"), F.lit(0.0))).alias("avg_roi"))


def discount_points(df: DataFrame, filters: FilterParams | None = None, n: int = 1000,
                    seed: str = "42") -> DataFrame:
    """A38 (campaign page): seeded sample of ``n`` rows."""
    s = sample_n(prepare(df, filters), n, seed)
    return s.select("Row_ID", PRODUCT, F.col(DISCOUNT).cast("double").alias("discount"),
                    F.col(DEMAND).alias("demand"), F.col(PRICE).cast("double").alias("price"),
                    F.col(CAMPAIGN).alias("campaign"), revenue().cast("double").alias("revenue"))


def discount_demand_trend(df: DataFrame, filters: FilterParams | None = None, n: int = 1000,
                          seed: str = "42") -> DataFrame:
    """A35 (campaign page): least-squares line Demand ~ Discount on the sample."""
    s = discount_points(df, filters, n, seed)
    return s.agg(r6(F.regr_slope("demand", "discount")).alias("slope"),
                 r6(F.regr_intercept("demand", "discount")).alias("intercept"),
                 r6(F.regr_r2("demand", "discount")).alias("r2"), F.regr_count("demand", "discount").alias("n"))
