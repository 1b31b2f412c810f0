"""M1 ``trend_forecast``: log-linear trend per product, in pure Spark SQL.

daily sum (A11) → drop days at or above the product's 99th percentile (F8)
→ least squares of log1p(Demand) on the day number (``regr_slope``) →
fitted values and ``horizon`` future days through ``expm1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.derive import date_ordinal, exp_demand, log_demand
from ..operators.filters import below_quantile
from ..sources.demand import DATE, DEMAND, PRODUCT
from . import evaluate as ev
from .series import daily_checkpoint

P, D, Y = PRODUCT, DATE, DEMAND
#: Days that a product needs for a line.
MIN_DAYS = 2


def _fit(daily: DataFrame, q: float) -> tuple[DataFrame, DataFrame]:
    d = below_quantile(daily, q).withColumn("x", date_ordinal(D)).withColumn("ly", log_demand(Y))
    coef = d.groupBy(P).agg(F.regr_slope("ly", "x").alias("slope"), F.avg("ly").alias("ybar"),
                            F.avg("x").alias("xbar"), F.max(D).alias("last_date"))
    return d, coef


def _predict_log(x: F.Column) -> F.Column:
    # centred form ȳ + b·(x − x̄): avoids the large intercept at day numbers ≈ 7·10⁵
    return F.col("ybar") + F.coalesce(F.col("slope"), F.lit(0.0)) * (x - F.col("xbar"))


def trend_fit(df: DataFrame, q: float = 0.99) -> DataFrame:
    """Per-product coefficients: slope per day, mean log demand and day."""
    return _fit(daily_checkpoint(df), q)[1]


def trend_forecast(df: DataFrame, horizon: int = 30, q: float = 0.99) -> DataFrame:
    """``(Product_ID, Date, kind, value, status)``: fitted history and forecasts, and a row of kind "none" for each product
    that has neither.

    The per-product coefficients (one row per product) are joined back on
    the product key; the future days come from ``sequence(1, horizon)``.
    """
    daily = daily_checkpoint(df)
    d, coef = _fit(daily, q)
    fitted = d.join(coef, P).select(P, D, F.lit("fitted").alias("kind"),
                                    exp_demand(_predict_log(F.col("x"))).alias("value"))
    ahead = future(_listed(coef), horizon).drop("status")
    return ev.with_status(fitted.unionByName(ahead), daily, MIN_DAYS)


def _listed(coef: DataFrame) -> DataFrame:
    numbers = F.create_map(*[x for c in ("slope", "ybar", "xbar") for x in (F.lit(c), F.array(F.coalesce(F.col(c), F.lit(0.0))))])
    return coef.select(P, F.col("last_date").alias("through"), F.lit("ok").alias("status"), numbers.alias("values"))


def coefficients(df: DataFrame, q: float = 0.99) -> DataFrame:
    """One row per product: through (last day of the fit), status, and ``values``, a map of number lists."""
    daily = daily_checkpoint(df)
    rows = _listed(_fit(daily, q)[1])
    return rows.unionByName(ev.missing_rows(rows, daily, MIN_DAYS).drop("kind"), allowMissingColumns=True)


def future(coefs: DataFrame, horizon: int = 30) -> DataFrame:
    """Forecast rows from rows of :func:`coefficients`; products without coefficients keep one row with their status."""
    numbers = [F.col("values")[c][0].alias(c) for c in ("slope", "ybar", "xbar")]
    fut = coefs.where("status = 'ok'").select(P, *numbers, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"), "through")
    out = fut.withColumn(D, F.date_add("through", F.col("h"))).select(
        P, D, F.lit("forecast").alias("kind"), exp_demand(_predict_log(date_ordinal(D))).alias("value"), F.lit("ok").alias("status"))
    return out.unionByName(coefs.where("status <> 'ok'").select(P, F.lit("none").alias("kind"), "status"), allowMissingColumns=True)


def trend_pairs(df: DataFrame, q: float = 0.99) -> DataFrame:
    """J5 for M1: (product, day, actual, fitted, log actual, log fitted)."""
    d, coef = _fit(daily_checkpoint(df), q)
    pairs = d.join(coef, P).select(P, D, F.col(Y).alias("actual"), F.col("ly"),
                                   _predict_log(F.col("x")).alias("pl"))
    return pairs.withColumn("fitted", exp_demand("pl"))


def trend_metrics(df: DataFrame, q: float = 0.99) -> DataFrame:
    """M10 for M1: errors on the natural scale, R² on the log scale (Q16)."""
    return ev.forecast_metrics(trend_pairs(df, q), "actual", "fitted", "ly", "pl")
