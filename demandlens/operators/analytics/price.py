"""Price page (A30–A34, A38) and the price × discount surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions import bins
from ...functions.aggs import argmax, dmean, dsum, r6
from ...functions.derive import revenue, week_start
from ...sources.demand import CAMPAIGN, COMPETITOR, DEMAND, DISCOUNT, PRICE, PRODUCT
from ..filters import FilterParams, sample_n
from .overview import prepare


def price_funnel(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Per B10 band sum Demand and Revenue, from high to low price, with
    the percent of the previous stage (null for the first)."""
    d = bins.price_third_band(prepare(df, filters)).where(F.col("band").isNotNull())
    per = d.groupBy("band", "band_label").agg(dsum(DEMAND).alias("demand"), dsum(revenue()).alias("revenue"))
    w = Window.orderBy(F.desc("band"))  # ≤ 3 rows
    return (per.withColumn("pct_previous", r6(F.col("demand") / F.lag("demand").over(w) * 100))
            .orderBy(F.desc("band")))


def competitor_comparison(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Per product avg Price, avg competitor price, sum Revenue; by Revenue."""
    d = prepare(df, filters)
    return (d.groupBy(PRODUCT).agg(r6(dmean(PRICE)).alias("avg_price"),
                                   r6(dmean(COMPETITOR)).alias("avg_competitor_price"),
                                   dsum(revenue()).alias("revenue"))
            .orderBy(F.desc("revenue"), PRODUCT))


def weekly_price_trend(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Per week (Monday start) avg Price and avg competitor price."""
    d = prepare(df, filters)
    return (d.groupBy(week_start().alias("week_start"))
            .agg(r6(dmean(PRICE)).alias("avg_price"), r6(dmean(COMPETITOR)).alias("avg_competitor_price"))
            .orderBy("week_start"))


def kpi_price(df: DataFrame, filters: FilterParams | None = None) -> DataFrame:
    """Avg Price, product with the greatest Revenue, total Revenue.

    One scan: a per-product aggregate, then a global fold over it."""
    d = prepare(df, filters)
    per = d.groupBy(PRODUCT).agg(F.sum(PRICE).alias("_ps"), F.count(PRICE).alias("_pn"),
                                 F.sum(revenue()).alias("_rev"))
    return per.agg(r6(F.sum("_ps").cast("double") / F.sum("_pn")).alias("avg_price"),
                   argmax(PRODUCT, F.col("_rev")).alias("top_product"),
                   F.sum("_rev").cast("double").alias("total_revenue"))


def price_demand_points(df: DataFrame, filters: FilterParams | None = None, n: int = 500,
                        seed: str = "42") -> DataFrame:
    """A38 (price page): seeded sample of ``n`` rows for the scatter."""
    d = prepare(df, filters)
    s = sample_n(d, n, seed)
    return s.select("Row_ID", PRODUCT, F.col(PRICE).cast("double").alias("price"), F.col(DEMAND).alias("demand"),
                    F.col(CAMPAIGN).alias("campaign"), revenue().cast("double").alias("revenue"))


# J3 / A34 -------------------------------------------------------------------
GRID = 20


def price_discount_surface(df: DataFrame, filters: FilterParams | None = None, k: int = GRID) -> DataFrame:
    """A34 with the J3 range join: for each point of a k×k grid over
    [min,max] price × [min,max] discount, mean Demand of rows within
    ±range/10 on both axes; no neighbour → the global mean.

    Instead of a nested-loop join of grid × rows, each distinct (price,
    discount) pair, already summed up, computes the bounded set of grid indices it can reach on each axis (about 2k/10 + 2),
    explodes to those candidate cells, applies the exact predicate and
    aggregates per cell with a map-side partial sum.  The only broadcast is
    the one-row min/max/mean aggregate.
    """
    d = prepare(df, filters).select(F.col(PRICE).cast("double").alias("p"),
                                    F.col(DISCOUNT).cast("double").alias("d"), DEMAND)
    s = d.agg(F.min("p").alias("pmin"), F.max("p").alias("pmax"), F.min("d").alias("dmin"),
              F.max("d").alias("dmax"), F.avg(DEMAND).alias("gmean"))
    # rows of equal price and discount reach the same cells: summed up before they fan out
    own = d.where(F.col("p").isNotNull() & F.col("d").isNotNull()).groupBy("p", "d").agg(F.sum(DEMAND).alias("_s"), F.count(DEMAND).alias("_n"))
    x = own.crossJoin(F.broadcast(s))

    def axis(v, lo, hi, name):
        step = (F.col(hi) - F.col(lo)) / (k - 1)
        rad = (F.col(hi) - F.col(lo)) / 10
        first = F.when(step > 0, F.greatest(F.lit(0), F.ceil((F.col(v) - rad - F.col(lo)) / step).cast("int") - 1)) \
            .otherwise(F.lit(0))
        last = F.when(step > 0, F.least(F.lit(k - 1), F.floor((F.col(v) + rad - F.col(lo)) / step).cast("int") + 1)) \
            .otherwise(F.lit(k - 1))
        return F.explode(F.sequence(first, last)).alias(name)

    def grid_value(idx, lo, hi):
        # numpy.linspace: start + i·step, the last point exactly the stop
        step = (F.col(hi) - F.col(lo)) / (k - 1)
        return F.when(F.col(idx) == k - 1, F.col(hi)).otherwise(F.col(idx) * step + F.col(lo))

    pr = (F.col("pmax") - F.col("pmin")) / 10
    dr = (F.col("dmax") - F.col("dmin")) / 10
    # explode and filter one axis at a time so at most ~4 cells survive per axis
    cand = (x.select("*", axis("p", "pmin", "pmax", "j")).withColumn("pv", grid_value("j", "pmin", "pmax"))
            .where(F.abs(F.col("p") - F.col("pv")) <= pr))
    hit = (cand.select("*", axis("d", "dmin", "dmax", "i")).withColumn("dv", grid_value("i", "dmin", "dmax"))
           .where(F.abs(F.col("d") - F.col("dv")) <= dr))
    cells = hit.groupBy("i", "j").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    grid = (s.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
            .withColumn("price", grid_value("j", "pmin", "pmax"))
            .withColumn("discount", grid_value("i", "dmin", "dmax")))
    out = grid.join(cells, ["i", "j"], "left")
    return out.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"),
                      r6(F.col("price")).alias("price"), r6(F.col("discount")).alias("discount"),
                      r6(F.coalesce(F.col("_s") / F.col("_n"), F.col("gmean"))).alias("demand"))
