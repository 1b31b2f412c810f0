"""A2, A11, A13, A15, A16, A26, A28 and A36 from the stored daily roll-up.

Same columns and values as the operators over the facts; each is one grouped sum of states.
The filter bar's product, campaign and date filters apply to the states (and dates prune
month partitions); price and discount are not keys of the roll-up, so those two filters need
the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.aggs import r6
from ...functions.derive import holiday_int, month_label, week_start
from ...sources.demand import CAMPAIGN, DATE, DEMAND, DISCOUNT, EFFECT, HOLIDAY, PRICE, PRODUCT, SEASON, STOCK
from ...sources.rollup import MONTH
from ..filters import FilterParams, where_campaigns, where_dates, where_products
from .demand import _np_round2


def rows(states: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """States of positive demand (F7) within the filters."""
    out = states.where("positive")
    if filters is None:
        return out
    if filters.price_range or filters.discount_range_pct:
        raise ValueError("price and discount filters need the facts")
    if filters.start_date and filters.end_date:
        first, last = (int(str(d)[:4]) * 100 + int(str(d)[5:7]) for d in (filters.start_date, filters.end_date))
        out = out.where(F.col(MONTH).between(first, last))
    for condition in (where_products(filters.products), where_campaigns(filters.campaigns), where_dates(filters.start_date, filters.end_date)):
        if condition is not None:
            out = out.where(condition)
    return out


def _sum(c: str) -> Column:
    return F.sum(c).cast("double")


def _mean(c: str) -> Column:
    return F.sum(c).cast("double") / F.sum("demand_n" if c == "demand" else f"{c}_n")


def monthly_performance(states: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A2."""
    return (rows(states, filters).groupBy(F.month(DATE).cast("bigint").alias("month"))
            .agg(_sum("demand").alias("demand"), _sum("revenue").alias("revenue"), r6(_mean("price")).alias("avg_price"))
            .withColumn("month_name", month_label("month")).orderBy("month"))


def daily_demand(states: DataFrame, filters: FilterParams | None = None, by_product: bool = False) -> DataFrame:
    """A11."""
    return rows(states, filters).groupBy(*([PRODUCT] if by_product else []), DATE).agg(_sum("demand").alias("demand"))


def yearly_demand(states: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A13."""
    return rows(states, filters).groupBy(F.year(DATE).cast("bigint").alias("year")).agg(_sum("demand").alias("demand")).orderBy("year")


def campaign_demand_share(states: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A15."""
    per = rows(states, filters).where(F.col(CAMPAIGN).isNotNull()).groupBy(CAMPAIGN).agg(_sum("demand").alias("demand"))
    return per.withColumn("share_pct", r6(F.col("demand") / F.sum("demand").over(Window.partitionBy()) * 100)).orderBy(F.desc("demand"), CAMPAIGN)


def weekly_variation(states: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A16; the sample deviation comes from the sums of squares."""
    n, total = F.sum("demand_n"), F.sum("demand")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.sum("demand_sq") - total * total / n, F.lit(0.0)) / (n - 1)))
    out = rows(states, filters).groupBy(F.weekofyear(DATE).cast("bigint").alias("week")).agg(
        _np_round2(_sum("demand")).alias("total"), _np_round2(_mean("demand")).alias("mean"), _np_round2(spread).alias("std"))
    return out.withColumn("variation_pct", r6(F.coalesce(F.col("std") / F.col("mean") * 100, F.lit(0.0)))).orderBy("week")


def campaign_weekly_timeline(states: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A26."""
    own = rows(states, filters).where(F.col(CAMPAIGN).isNotNull())
    return own.groupBy(week_start().alias("week_start"), CAMPAIGN).agg(_sum("demand").alias("demand"), _sum("revenue").alias("revenue"))


def seasonal_campaign_rollup(states: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A28."""
    own = rows(states, filters).where(F.col(CAMPAIGN).isNotNull())
    return own.rollup(F.col(SEASON).alias("season"), F.col(CAMPAIGN).alias("campaign")).agg(
        _sum("demand").alias("demand"), _sum("revenue").alias("revenue"), F.grouping_id().cast("bigint").alias("level"))


def daily_features(states: DataFrame) -> DataFrame:
    """A36, over all rows (the model pages don't ask for positive demand)."""
    return states.groupBy(PRODUCT, DATE).agg(_sum("demand").alias(DEMAND), holiday_int(F.max(HOLIDAY)).alias(HOLIDAY),
                                             *[_mean(m).alias(c) for m, c in (("effect", EFFECT), ("price", PRICE), ("discount", DISCOUNT), ("stock", STOCK))])
