"""Overview page: KPIs, monthly performance, holiday distribution, top
products, feature profile with outliers, describe (A1–A7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions import bins
from ...functions.aggs import bround2, dmean, dsum, r6, std
from ...functions.derive import holiday_label, month_label, revenue
from ...functions.quantiles import exact_quantiles
from ...session import cut_lineage
from ...sources.demand import (COMPETITOR, DATE, DEMAND, DISCOUNT, EFFECT, HOLIDAY, PRICE, PRODUCT)
from ..filters import FilterParams, apply_filters, positive_demand


def prepare(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Analysis input: positive demand (F7) and the filter bar."""
    return apply_filters(positive_demand(df), filters)


def kpi_overview(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A1: avg Demand, avg Price, avg Discount × 100 (one row)."""
    d = prepare(df, filters)
    return d.agg(r6(dmean(DEMAND)).alias("avg_demand"),
                 r6(dmean(PRICE)).alias("avg_price"),
                 r6(dmean(DISCOUNT) * 100).alias("avg_discount_pct"))


def monthly_performance(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A2: per calendar month (all years together, Q13)."""
    d = prepare(df, filters)
    return (d.groupBy(F.month(DATE).cast("bigint").alias("month"))
            .agg(dsum(DEMAND).alias("demand"), dsum(revenue()).alias("revenue"),
                 r6(dmean(PRICE)).alias("avg_price"))
            .withColumn("month_name", month_label("month"))
            .orderBy("month"))


def box(df: DataFrame, key: str, y: str = DEMAND) -> DataFrame:
    """Count, mean, quartiles, smallest and largest value of ``y`` per value of ``key``.

    The two columns are written once, so that the input is not read again for the quartiles."""
    df = cut_lineage(df.select(key, y))
    stats = df.groupBy(key).agg(F.count(y).alias("n"), r6(dmean(y)).alias("mean"),
                                F.min(y).cast("double").alias("min"), F.max(y).cast("double").alias("max"))
    quartiles = exact_quantiles(df, [key], y, [0.25, 0.5, 0.75], "_q")
    return stats.join(quartiles, key, "left").select(
        key, "n", "mean", *[r6(F.col("_q")[i]).alias(c) for i, c in enumerate(("q25", "median", "q75"))], "min", "max")


def holiday_distribution(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """A3: Demand box (quartiles, whisker range) and mean per holiday flag."""
    out = box(prepare(df, filters).withColumn("holiday", F.col(HOLIDAY).cast("bigint")), "holiday")
    return out.withColumn("status", holiday_label("holiday")).orderBy("holiday")


def top_products(df: DataFrame, filters: FilterParams | None = None, n: int = 10) -> DataFrame:
    """A4: per product sum Demand, sum Revenue (rounded half-even to 2), avg
    Price; the ``n`` best by Demand, ties by product.  The top-n is planned as
    TakeOrderedAndProject over the (small) per-product aggregate."""
    d = prepare(df, filters)
    agg = d.groupBy(PRODUCT).agg(
        dsum(DEMAND).alias("demand"),
        bround2(F.sum(revenue())).cast("double").alias("revenue"),
        r6(dmean(PRICE)).alias("avg_price"))
    return agg.orderBy(F.desc("demand"), F.asc(PRODUCT)).limit(n)


# A5 / A6 ------------------------------------------------------------------
FEATURES = ("Price", "Discount", "Marketing_Effect", "Competitor_Price")


def feature_bands(df: DataFrame, feature: str) -> DataFrame:
    """Band of each row for the chosen feature: B4 (Price), B5 (Discount),
    B6 (Marketing_Effect), B7 (Competitor_Price), else B8/B9 tertiles.
    Rows without a band are dropped (Q1)."""
    if feature == PRICE:
        out = bins.price_quartile_band(df)
    elif feature == DISCOUNT:
        out = df.withColumn("band", bins.discount_pct_band()) \
                .withColumn("band_label", bins.label_of(F.col("band"), bins.interval_labels(bins.DISCOUNT_PCT_EDGES)))
    elif feature == EFFECT:
        out = df.withColumn("band", bins.marketing_effect_band()) \
                .withColumn("band_label", bins.label_of(F.col("band"), bins.interval_labels(bins.EFFECT_EDGES)))
    elif feature == COMPETITOR:
        out = bins.competitor_band(df)
    else:
        out = bins.tertile_band(df, feature)
    return out.where(F.col("band").isNotNull())


def feature_demand_profile(df: DataFrame, feature: str = PRICE,
                           filters: FilterParams | None = None) -> DataFrame:
    """A5: per band count, mean, median, sample std, q25, q75 of Demand, with
    the totals (rows, bands, overall mean) as columns of every band row.
    A single band or no rows at all come out as one row or none."""
    # banding, sums and quartiles all read this copy of two columns
    rows = cut_lineage(prepare(df, filters).select(*{feature: 0, DEMAND: 0}))
    banded = feature_bands(rows, feature)
    per = banded.groupBy("band", "band_label").agg(
        F.count("*").alias("n"), r6(dmean(DEMAND)).alias("mean"), r6(std(DEMAND)).alias("std"),
        F.sum(DEMAND).alias("_sum"))
    per = per.join(exact_quantiles(banded, ["band"], DEMAND, [0.25, 0.5, 0.75], "_q"), "band")
    per = per.select("band", "band_label", "n", "mean", r6(F.col("_q")[1]).alias("median"), "std",
                     r6(F.col("_q")[0]).alias("q25"), r6(F.col("_q")[2]).alias("q75"), "_sum")
    # totals over the per-band rows (at most 4 rows, so a global window is cheap)
    w = Window.partitionBy()
    return (per.withColumn("total_n", F.sum("n").over(w))
            .withColumn("n_bands", F.count("*").over(w))
            .withColumn("overall_mean", r6(F.sum("_sum").over(w) / F.sum("n").over(w)))
            .drop("_sum").orderBy("band"))


def box_outliers(df: DataFrame, feature: str = PRICE, filters: FilterParams | None = None,
                 measure: Column | None = None) -> DataFrame:
    """Rows outside the 1.5·IQR fences of their band's box of Demand (or of ``measure``)."""
    y = (F.col(DEMAND) if measure is None else measure).cast("double")
    rows = cut_lineage(prepare(df, filters).withColumn("_y", y).select(*{feature: 0, DEMAND: 0, PRODUCT: 0, DATE: 0, "_y": 0}))
    banded = feature_bands(rows, feature)
    # one row per band (≤ 4): bounded, broadcast to the fact rows
    joined = banded.join(F.broadcast(exact_quantiles(banded, ["band"], "_y", [0.25, 0.75], "_q")), "band")
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    out = joined.where((F.col("_y") < q1 - 1.5 * (q3 - q1)) | (F.col("_y") > q3 + 1.5 * (q3 - q1)))
    return out.select("band", "band_label", PRODUCT, DATE, F.col(DEMAND).alias("demand"), *([] if measure is None else [F.col("_y").alias("measure")]))


def describe(df: DataFrame, column: str = PRICE, filters: FilterParams | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max (exact quartiles)."""
    d = cut_lineage(prepare(df, filters).select(column))
    x = F.col(column).cast("double")
    one = d.agg(F.count(x).alias("count"), r6(dmean(column)).alias("mean"), r6(std(column)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    quartiles = exact_quantiles(d, [], x, [0.25, 0.5, 0.75], "_q")
    return one.join(F.broadcast(quartiles), how="left", on=F.lit(True)).select(
        "count", "mean", "std", "min", *[r6(F.col("_q")[i]).alias(c) for i, c in enumerate(("q25", "q50", "q75"))], "max")
