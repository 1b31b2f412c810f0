"""Spark ML forecasts pooled over all products (M4, M5) and model storage.

* M4 ``recursive_boosted_forecast``: the M3 features without the day number
  and without the outlier cut, plus the product's level and spread (mean and
  standard deviation of its log series), which tell products apart without a
  list of them on the driver, fitted by one ``GBTRegressor`` (100 trees, step 0.1, depth 6 by default) on the log of
  the smoothed series; the 30-day recursion calls the model once per day on
  a one-row-per-product state frame, and the state is checkpointed to the
  shared checkpoint folder every few steps so the plan stays short and a
  lost executor only repeats the last few steps.
* M5 ``lookback_forecast``: re-aimed from a stored per-product network to
  one pooled ``LinearRegression`` on the previous 30 min–max scaled values
  (W2 → W12 → W6); the rollout is an ``aggregate`` fold over the last-30
  array, then the scaling is undone.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.derive import exp_demand
from ..session import cut_lineage
from ..sources.demand import DATE, DEMAND, PRODUCT
from . import evaluate as ev
from .recursive import smoothed_features, step_features
from .series import by_product, daily_checkpoint, daily_series, lookback_windows, minmax_inverse

P, D, Y = PRODUCT, DATE, DEMAND
BOOST_FEATURES = ["dow", "month", "weekend", "lag1", "lag7", "mean7"]
PRODUCT_FEATURES = ["level", "spread"]
CHECKPOINT_EVERY = 5
#: Days that a product needs for M4's lag 7 of the smoothed values.
BOOST_DAYS = 14


# ------------------------------------------------------------------ M4
def boosted_frame(df: DataFrame) -> DataFrame:
    """Training rows of M4: the smoothed features, the log target and the product's level and spread."""
    w = Window.partitionBy(P)
    rows = smoothed_features(daily_series(df), None, with_x=False)
    return cut_lineage(rows.withColumns({"level": F.avg("ly").over(w), "spread": F.coalesce(F.stddev_pop("ly").over(w), F.lit(0.0))}))


def boosted_model(train: DataFrame, max_iter: int = 100, step: float = 0.1, depth: int = 6,
                  seed: int = 42) -> PipelineModel:
    """Assembler + GBT on ``ly``; one model for all products."""
    asm = VectorAssembler(inputCols=BOOST_FEATURES + PRODUCT_FEATURES, outputCol="features")
    gbt = GBTRegressor(featuresCol="features", labelCol="ly", maxIter=max_iter, stepSize=step,
                       maxDepth=depth, seed=seed)
    return Pipeline(stages=[asm, gbt]).fit(train)


def boosted_forecast(df: DataFrame, horizon: int = 30, max_iter: int = 100, step: float = 0.1,
                     depth: int = 6) -> DataFrame:
    """``(Product_ID, Date, kind, value, status)`` fitted and forecast rows of M4, and a row of kind "none" for each product
    that has neither."""
    daily = daily_checkpoint(df)
    train = boosted_frame(daily)
    return ev.with_status(boosted_rollout(train, boosted_model(train, max_iter, step, depth), horizon), daily, BOOST_DAYS)


def boosted_rollout(train: DataFrame, model: PipelineModel, horizon: int = 30) -> DataFrame:
    """Fitted rows of the training frame and the recursion from each product's last seven values."""
    fitted = model.transform(train).select(P, D, F.lit("fitted").alias("kind"),
                                             exp_demand("prediction").alias("value"))
    w = Window.partitionBy(P).orderBy(F.desc(D))
    state = (train.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 7).groupBy(P)
             .agg(F.max(D).alias("last_date"), *[F.first(c).alias(c) for c in PRODUCT_FEATURES],
                  F.expr("transform(sort_array(collect_list(struct(Date, smoothed))), s -> s.smoothed)").alias("hist"))
             .withColumn("out", F.array().cast("array<double>")))
    for h in range(1, horizon + 1):
        day = F.date_add("last_date", F.lit(h))
        feats = step_features(day, F.col("hist"), with_x=False)
        step_df = state.select("*", *[f.alias(n) for f, n in zip(feats, BOOST_FEATURES, strict=True)])
        pred = model.transform(step_df)
        p = exp_demand("prediction")
        state = pred.select(P, "last_date", *PRODUCT_FEATURES, F.slice(F.concat("hist", F.array(p)), -7, 7).alias("hist"),
                            F.concat("out", F.array(p)).alias("out"))
        if h % CHECKPOINT_EVERY == 0 and h < horizon:
            state = cut_lineage(state)
    fut = state.select(P, "last_date", F.posexplode("out").alias("_pos", "value")) \
        .select(P, F.date_add("last_date", F.col("_pos") + 1).alias(D), F.lit("forecast").alias("kind"), "value")
    return fitted.unionByName(fut)


def boosted_metrics(df: DataFrame, max_iter: int = 100, step: float = 0.1, depth: int = 6) -> DataFrame:
    """M10 for M4: natural-scale errors on the smoothed series, R² on the log scale."""
    train = boosted_frame(df)
    model = boosted_model(train, max_iter, step, depth)
    pairs = model.transform(train).select(P, F.col("smoothed").alias("actual"), "ly",
                                            F.col("prediction").alias("pl"))
    return ev.forecast_metrics(pairs.withColumn("fitted", exp_demand("pl")), "actual", "fitted", "ly", "pl")


# ------------------------------------------------------------------ M5
LOOK_BACK = 30


def _lookback_frame(df: DataFrame, n: int = LOOK_BACK) -> DataFrame:
    d = daily_series(df)
    w7 = by_product().rowsBetween(-6, 0)
    d = d.withColumn("smoothed", F.when(F.count(Y).over(w7) == 7, F.avg(Y).over(w7))).where(F.col("smoothed").isNotNull())
    wp = Window.partitionBy(P)
    d = d.withColumn("_mn", F.min("smoothed").over(wp)).withColumn("_mx", F.max("smoothed").over(wp))
    d = d.withColumn("scaled", F.when(F.col("_mx") > F.col("_mn"),
                                      (F.col("smoothed") - F.col("_mn")) / (F.col("_mx") - F.col("_mn")))
                     .otherwise(F.lit(0.0)))
    return d


def lookback_model(frame: DataFrame, n: int = LOOK_BACK):
    train = lookback_windows(frame, "scaled", n, out="lookback").withColumn("features", array_to_vector("lookback"))
    lr = LinearRegression(featuresCol="features", labelCol="scaled", regParam=0.0, elasticNetParam=0.0,
                          standardization=False)
    return lr.fit(train), train


def _dot(coef: list[float], hist: Column, intercept: float) -> Column:
    arr = F.array(*[F.lit(float(c)) for c in coef])
    return F.lit(float(intercept)) + F.aggregate(F.zip_with(hist, arr, lambda a, b: a * b), F.lit(0.0),
                                                 lambda acc, v: acc + v)


def lookback_forecast(df: DataFrame, horizon: int = 30, n: int = LOOK_BACK) -> DataFrame:
    """``(Product_ID, Date, kind, value, status)`` of M5 on the natural scale, and a row of kind "none" for each product
    that has neither fitted nor forecast days."""
    daily = daily_checkpoint(df)
    frame = cut_lineage(_lookback_frame(daily, n))
    model, train = lookback_model(frame, n)
    coef, b = list(model.coefficients.toArray()), float(model.intercept)  # n + 1 numbers
    fitted = model.transform(train).select(
        P, D, F.lit("fitted").alias("kind"),
        minmax_inverse(F.col("prediction"), F.col("_mn"), F.col("_mx")).alias("value"))
    w = Window.partitionBy(P).orderBy(F.desc(D))
    state = (frame.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).groupBy(P)
             .agg(F.max(D).alias("last_date"), F.first("_mn").alias("_mn"), F.first("_mx").alias("_mx"),
                  F.expr("transform(sort_array(collect_list(struct(Date, scaled))), s -> s.scaled)").alias("hist"))
             .where(F.size("hist") == n))
    init = F.struct(F.col("hist").alias("hist"), F.array().cast("array<double>").alias("out"))

    def step(acc, _h):
        p = _dot(coef, acc["hist"], b)
        return F.struct(F.slice(F.concat(acc["hist"], F.array(p)), -n, n).alias("hist"),
                        F.concat(acc["out"], F.array(p)).alias("out"))

    folded = state.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step))
    fut = folded.select(P, "last_date", "_mn", "_mx", F.posexplode(F.col("_f")["out"]).alias("_pos", "s"))
    fut = fut.select(P, F.date_add("last_date", F.col("_pos") + 1).alias(D), F.lit("forecast").alias("kind"),
                     minmax_inverse(F.col("s"), F.col("_mn"), F.col("_mx")).alias("value"))
    return ev.with_status(fitted.unionByName(fut), daily, n + 6)


def lookback_metrics(df: DataFrame, n: int = LOOK_BACK) -> DataFrame:
    """M10 for M5 on the natural scale (inverse-scaled target and prediction)."""
    frame = cut_lineage(_lookback_frame(df, n))
    model, train = lookback_model(frame, n)
    pred = model.transform(train)
    pairs = pred.select(P, minmax_inverse(F.col("scaled"), F.col("_mn"), F.col("_mx")).alias("actual"),
                        minmax_inverse(F.col("prediction"), F.col("_mn"), F.col("_mx")).alias("fitted"))
    return ev.forecast_metrics(pairs)


# ------------------------------------------------------------------ S6
def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model (or pipeline) under ``path``."""
    model.write().overwrite().save(path)


def load_model(path: str, kind=PipelineModel):
    """Load a model saved by :func:`save_model` (``kind`` is the model
    class, e.g. ``PipelineModel`` or ``LinearRegressionModel``); ``None``
    when nothing is stored there.  Any other failure is raised."""
    sc = SparkSession.active().sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(sc._jsc.hadoopConfiguration()).exists(where):
        return None
    return kind.load(path)
