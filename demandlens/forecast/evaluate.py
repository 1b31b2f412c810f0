"""Accuracy metrics (M10), grades (M11), residual summary (M12), model
comparison (M13) and rolling back-tests (M14).

All are grouped aggregates over (product, actual, predicted) pairs; nothing
is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.demand import PRODUCT

P = PRODUCT


def forecast_metrics(pairs: DataFrame, y: str = "actual", f: str = "fitted",
                     r2_y: str | None = None, r2_f: str | None = None, skip_zero_mape: bool = False,
                     keys: Sequence[str] = (P,)) -> DataFrame:
    """M10 per product: RMSE, RMSE/mean %, MAPE %, R², mean of the actuals.

    R² is computed on ``r2_y``/``r2_f`` when given (the log scale of M1, M3,
    M4, Q16), else on y/f, with a centred total sum of squares (the series
    mean comes from a window over that series' pairs).  With
    ``skip_zero_mape`` days with y = 0 are left out of MAPE and counted in
    ``zero_days`` (Q20).
    """
    ry, rf = (r2_y or y), (r2_f or f)
    x = pairs.withColumn("_my", F.avg(ry).over(Window.partitionBy(*keys)))
    err = F.col(y) - F.col(f)
    # try_divide: a zero actual gives null (left out of the mean) instead of
    # an error under ANSI mode; with skip_zero_mape such days are also counted
    ape = F.abs(F.try_divide(err, F.col(y)))
    if skip_zero_mape:
        ape = F.when(F.col(y) != 0, ape)
    agg = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(ape) * 100).alias("mape"),
        F.sum((F.col(ry) - F.col(rf)) ** 2).alias("_sse"), F.sum((F.col(ry) - F.col("_my")) ** 2).alias("_sst"),
        F.count_if(F.col(y) == 0).alias("zero_days"))
    out = (agg.withColumn("rmse_pct", F.try_divide(F.col("rmse"), F.col("mean")) * 100)
           .withColumn("r2", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))))
    cols = [*keys, "n", "mean", "rmse", "rmse_pct", "mape", "r2"] + (["zero_days"] if skip_zero_mape else [])
    return out.select(*cols)


def round_metrics(m: DataFrame, digits: int = 6) -> DataFrame:
    return m.select(*[F.round(F.col(c), digits).alias(c) if c in ("mean", "rmse", "rmse_pct", "mape", "r2")
                      else F.col(c) for c in m.columns])


@dataclass(frozen=True)
class Thresholds:
    """M11 grade limits: errors below ``good`` are good, below ``fair`` fair;
    R² at or above ``r2_good`` good, at or above ``r2_fair`` fair (Q27)."""
    rmse_good: float = 20.0
    rmse_fair: float = 40.0
    mape_good: float = 10.0
    mape_fair: float = 20.0
    r2_good: float = 0.7
    r2_fair: float = 0.5


# The seasonal model page uses tighter limits.
SEASONAL_THRESHOLDS = Thresholds(15.0, 30.0, 10.0, 20.0, 0.8, 0.6)


def _grade_low(c: Column, good: float, fair: float) -> Column:
    return F.when(c.isNull(), F.lit(None)).when(c < good, "good").when(c < fair, "fair").otherwise("poor")


def _grade_high(c: Column, good: float, fair: float) -> Column:
    return F.when(c.isNull(), F.lit(None)).when(c >= good, "good").when(c >= fair, "fair").otherwise("poor")


def grade_metrics(metrics: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Text grades next to the metrics."""
    return metrics.withColumns({
        "rmse_grade": _grade_low(F.col("rmse_pct"), t.rmse_good, t.rmse_fair),
        "mape_grade": _grade_low(F.col("mape"), t.mape_good, t.mape_fair),
        "r2_grade": _grade_high(F.col("r2"), t.r2_good, t.r2_fair),
    })


def residual_summary(pairs: DataFrame, y: str = "actual", f: str = "fitted", bias_limit: float = 0.1,
                     keys: Sequence[str] = (P,)) -> DataFrame:
    """Mean and population std of the residuals; unbiased when
    |mean| < ``bias_limit``."""
    r = F.col(y) - F.col(f)
    out = pairs.groupBy(*keys).agg(F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"))
    return out.withColumn("unbiased", F.abs(F.col("residual_mean")) < bias_limit)


def compare_models(metrics_by_model: dict[str, DataFrame]) -> DataFrame:
    """Metrics of all models side by side; ``rank`` 1 is the lowest
    RMSE % per product (ties by model name)."""
    parts = [m.select(P, F.lit(name).alias("model"), "rmse", "rmse_pct", "mape", "r2")
             for name, m in metrics_by_model.items()]
    allm = parts[0]
    for p in parts[1:]:
        allm = allm.unionByName(p)
    w = Window.partitionBy(P).orderBy(F.asc_nulls_last("rmse_pct"), "model")
    return allm.withColumn("rank", F.row_number().over(w))


def chart_series(actual: DataFrame, forecast: DataFrame, value: str = "Demand") -> DataFrame:
    """Actual history, fitted values and future forecast as one series
    with a ``kind`` column (``unionByName``, no join)."""
    from ..sources.demand import DATE
    a = actual.select(P, DATE, F.lit("actual").alias("kind"), F.col(value).cast("double").alias("value"))
    return a.unionByName(forecast.select(P, DATE, "kind", "value"))


def with_status(forecast: DataFrame, daily: DataFrame, needed: int, value: str = "Demand") -> DataFrame:
    """``forecast`` with a ``status`` column ("ok") and one row of kind "none" for every product of ``daily`` that it lacks.

    The reason: ``too_short`` (fewer than ``needed`` days), ``constant`` (one value only), else ``no_clean_days`` (the
    model's cleaning leaves too little).
    """
    return forecast.withColumn("status", F.lit("ok")).unionByName(missing_rows(forecast, daily, needed, value), allowMissingColumns=True)


def missing_rows(known: DataFrame, daily: DataFrame, needed: int, value: str = "Demand") -> DataFrame:
    """(product, kind "none", status) of the products of ``daily`` without a row in ``known``."""
    days = daily.groupBy(P).agg(F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    reason = F.when(F.col("_n") < needed, "too_short").when(F.col("_low").eqNullSafe(F.col("_high")), "constant").otherwise("no_clean_days")
    return days.join(known.select(P).distinct(), P, "left_anti").select(P, F.lit("none").alias("kind"), reason.alias("status"))


def status_rows(df: DataFrame, forecast: DataFrame) -> DataFrame:
    """One row per product of ``df``: its forecast rows in ``forecast`` and ``status`` ("ok", or "no_forecast" for
    products whose series is too short, or left empty by the outlier cut)."""
    known = forecast.where("kind <> 'none'").groupBy(P).agg(F.count("*").alias("rows"))
    return df.select(P).distinct().join(known, P, "left").select(
        P, F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("rows") > 0, "ok").otherwise("no_forecast").alias("status"))
