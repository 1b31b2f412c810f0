"""M3 ``recursive_linear_forecast``: multi-feature regression on the smoothed
log series, rolled forward one day at a time.

daily sum (A11) → drop days at or above the product's 95th percentile (F8)
→ strict 7-row mean (W2) → calendar features (P14, month), lags 1 and 7 and
the 7-row mean of the smoothed series (W3, W2) → OLS of log1p(smoothed) on
[day number, weekday, month, weekend, lag1, lag7, mean7] (G + solve) →
30-step recursion.

The recursion is a Spark ``aggregate`` fold over ``sequence(1, horizon)``
whose state is the last 7 smoothed values (an array of 7), so it runs inside
one projection per product: no loop on the driver, no shuffle.  In training
the 7-row mean includes the current day; in the recursion it is the mean of
the previous 7 (Q15).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.derive import date_ordinal, day_of_week, exp_demand, is_weekend, log_demand
from ..operators.filters import below_quantile, drop_missing
from ..sources.demand import DATE, DEMAND, PRODUCT
from . import evaluate as ev
from .gram import as_matrix, gram, lstsq_from_gram, solve_table
from .series import by_product, daily_checkpoint

P, D, Y = PRODUCT, DATE, DEMAND
# Day numbers are shifted before the Gram sums (conditioning).
ORDINAL_SHIFT = 730000
#: Days that a product needs, the outlier cut left aside: 7 for the first smoothed value, 7 more for its lag 7, and as many
#: training rows as the regression has coefficients.
MIN_DAYS = 21
FEATURES = ["x", "dow", "month", "weekend", "lag1", "lag7", "mean7"]


def smoothed_features(daily: DataFrame, q: float | None = 0.95, with_x: bool = True) -> DataFrame:
    """The training frame of M3 (``q=0.95``) and M4 (``q=None``)."""
    d = below_quantile(daily, q) if q is not None else daily
    w7 = by_product().rowsBetween(-6, 0)
    d = d.withColumn("smoothed", F.when(F.count(Y).over(w7) == 7, F.avg(Y).over(w7))).where(F.col("smoothed").isNotNull())
    # second pass over the rows that survived (positions shift, Q14)
    d = d.withColumns({
        "dow": day_of_week(D).cast("double"), "month": F.month(D).cast("double"),
        "weekend": is_weekend(D).cast("double"),
        "lag1": F.lag("smoothed", 1).over(by_product()), "lag7": F.lag("smoothed", 7).over(by_product()),
        "mean7": F.when(F.count("smoothed").over(w7) == 7, F.avg("smoothed").over(w7)),
    })
    d = drop_missing(d, ["lag1", "lag7", "mean7"]).withColumn("ly", log_demand("smoothed"))
    if with_x:
        d = d.withColumn("x", (date_ordinal(D) - ORDINAL_SHIFT).cast("double"))
    return d


def fit(d: DataFrame) -> DataFrame:
    """OLS per product from the Gram matrix of [1, FEATURES, ly]."""
    return solve(gram(d, [P], FEATURES + ["ly"]), [P])


def solve(grams: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the coefficients; none with fewer rows than coefficients, which would only interpolate."""
    k = len(FEATURES) + 2

    def one(row):
        beta, _ = lstsq_from_gram(as_matrix(row["g"], k), range(k - 1), k - 1)
        return {**{c: row[c] for c in keys}, "beta": [float(v) for v in beta]}

    return solve_table(grams.where(F.col("n") > len(FEATURES)), one, T.StructType([*(grams.schema[c] for c in keys), T.StructField("beta", T.ArrayType(T.DoubleType()))]))


def linear(beta: str, feats: list[Column]) -> Column:
    out = F.element_at(beta, 1)
    for i, f in enumerate(feats):
        out = out + F.element_at(beta, i + 2) * f
    return out


def _last7(d: DataFrame) -> DataFrame:
    """Per product: last day and the last 7 smoothed values in date order."""
    w = Window.partitionBy(P).orderBy(F.desc(D))
    tail = d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 7)
    return tail.groupBy(P).agg(
        F.max(D).alias("last_date"),
        F.expr("transform(sort_array(collect_list(struct(Date, smoothed))), s -> s.smoothed)").alias("hist"))


def rollout(state: DataFrame, horizon: int, predict: callable, held: int = 7) -> DataFrame:
    """Fold ``horizon`` steps over the ``hist`` array of each row, which keeps its last ``held`` values.

    ``predict(h, hist)`` returns the next value as a Column from the step
    number ``h`` (1-based) and the current state array.
    """
    init = F.struct(F.col("hist").alias("hist"), F.array().cast("array<double>").alias("out"))

    def step(acc, h):
        p = predict(h, acc["hist"])
        return F.struct(F.slice(F.concat(acc["hist"], F.array(p)), -held, held).alias("hist"),
                        F.concat(acc["out"], F.array(p)).alias("out"))

    folded = state.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step))
    return folded.select("*", F.posexplode(F.col("_f")["out"]).alias("_pos", "value")) \
        .withColumn(D, F.date_add("last_date", F.col("_pos") + 1)).drop("_f", "_pos")


def step_features(day: Column, hist: Column, with_x: bool = True) -> list[Column]:
    """Features of one recursion step: calendar of ``day``, lag1 = last,
    lag7 = first of the last 7 (lag1 if fewer), mean of the last 7."""
    lag1 = F.element_at(hist, -1)
    lag7 = F.when(F.size(hist) >= 7, F.element_at(hist, 1)).otherwise(lag1)
    mean7 = F.aggregate(hist, F.lit(0.0), lambda a, v: a + v) / F.size(hist)
    cal = [day_of_week(day).cast("double"), F.month(day).cast("double"), is_weekend(day).cast("double")]
    x = [(date_ordinal_col(day) - ORDINAL_SHIFT).cast("double")] if with_x else []
    return x + cal + [lag1, lag7, mean7]


def date_ordinal_col(day: Column) -> Column:
    return F.unix_date(day) + F.lit(719163)


def recursive_forecast(df: DataFrame, horizon: int = 30, q: float = 0.95) -> DataFrame:
    """``(Product_ID, Date, kind, value, status)``: fitted smoothed history and the
    30-step recursive forecast, and a row of kind "none" for each product that has neither."""
    daily = daily_checkpoint(df)
    d = smoothed_features(daily, q)
    coef = fit(d)
    fitted = d.join(coef, P).select(P, D, F.lit("fitted").alias("kind"),
                                    exp_demand(linear("beta", [F.col(c) for c in FEATURES])).alias("value"))
    ahead = future(_listed(d, coef), horizon).drop("status")
    return ev.with_status(fitted.unionByName(ahead), daily, MIN_DAYS)


def _listed(d: DataFrame, coef: DataFrame) -> DataFrame:
    numbers = F.create_map(F.lit("beta"), F.col("beta"), F.lit("last_smoothed"), F.col("hist"))
    return _last7(d).join(coef, P).select(P, F.col("last_date").alias("through"), F.lit("ok").alias("status"), numbers.alias("values"))


def coefficients(df: DataFrame, q: float = 0.95) -> DataFrame:
    """One row per product: through (last day of the fit), status, and ``values``, a map of number lists."""
    daily = daily_checkpoint(df)
    d = smoothed_features(daily, q)
    rows = _listed(d, fit(d))
    return rows.unionByName(ev.missing_rows(rows, daily, MIN_DAYS).drop("kind"), allowMissingColumns=True)


def future(coefs: DataFrame, horizon: int = 30) -> DataFrame:
    """Forecast rows from rows of :func:`coefficients`; products without coefficients keep one row with their status."""
    state = coefs.where("status = 'ok'").select(P, F.col("through").alias("last_date"), F.col("values")["beta"].alias("beta"),
                                                F.col("values")["last_smoothed"].alias("hist"))
    fut = rollout(state, horizon,
                  lambda h, hist: exp_demand(linear("beta", step_features(F.date_add("last_date", h), hist))))
    out = fut.select(P, D, F.lit("forecast").alias("kind"), "value", F.lit("ok").alias("status"))
    return out.unionByName(coefs.where("status <> 'ok'").select(P, F.lit("none").alias("kind"), "status"), allowMissingColumns=True)


def recursive_metrics(df: DataFrame, q: float = 0.95) -> DataFrame:
    """M10 for M3: errors on the smoothed natural scale, R² on the log scale."""
    d = smoothed_features(daily_checkpoint(df), q)
    coef = fit(d)
    pairs = d.join(coef, P).select(P, F.col("smoothed").alias("actual"), "ly",
                                   linear("beta", [F.col(c) for c in FEATURES]).alias("pl"))
    return ev.forecast_metrics(pairs.withColumn("fitted", exp_demand("pl")), "actual", "fitted", "ly", "pl")
