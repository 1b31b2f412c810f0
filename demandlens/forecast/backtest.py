"""M13 ``compare_models`` and M14 ``rolling_backtest``.

The back-test scores models out of sample: fold k of a product trains on its days up to the
cut-off, the product's last day minus k·horizon, and is scored on the next ``horizon`` days.

No row is copied per fold.  The cut-offs part a product's days into intervals; each interval
gives one Gram block, and a window over the intervals sums the blocks up to every cut-off, so
any number of cut-offs costs one pass over the days and one small solve per product and fold.
For that, what shapes the training rows must not depend on the fold: outlier cuts, scalings,
change points and regressor spreads come from the days up to the *oldest* cut-off (no fold
sees later days).  M1 keeps each fold's own 99 % cut: days below all of a product's cuts are
summed by interval, and only the few in between are listed per fold.

What a recursion starts from (the last values before a cut-off) is picked by interval, too.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.derive import date_ordinal, exp_demand, log_demand
from ..operators.filters import drop_missing
from ..session import cut_lineage
from ..sources.demand import DATE, DEMAND, HOLIDAY, PRODUCT
from . import evaluate as ev
from . import recursive as rc
from . import ridge as rg
from . import seasonal as sn
from .gram import as_matrix, gram, gram_blocks, lstsq_from_gram, solve_table
from .series import REGRESSORS, by_product, daily_checkpoint, daily_features, ewma, lookback_windows, minmax_inverse

P, D, Y = PRODUCT, DATE, DEMAND
LOOK_BACK = 30


# ------------------------------------------------------------------ intervals and prefixes
def with_intervals(daily: DataFrame, folds: int, horizon: int, date: str = D) -> DataFrame:
    """``daily`` with ``seg``, the interval of a day: 0 up to the oldest cut-off, ``folds`` after the newest; and ``fold``,
    the fold that tests the day (null: none).  Fold k trains on intervals up to ``folds`` − k."""
    last = F.max(date).over(Window.partitionBy(P))
    m = F.floor(F.datediff(last, F.col(date)) / horizon).cast("int")
    return daily.withColumn("seg", F.lit(folds) - F.least(m, F.lit(folds))).withColumn("fold", F.when(m < folds, m + 1)).withColumn(
        "_last", last)


def _valid_folds(rows: DataFrame, keys: Sequence[str], folds: int) -> DataFrame:
    """A row (keys, seg) for each fold whose training days end in that interval, or in later ones without a row."""
    after = F.coalesce(F.lead("seg").over(Window.partitionBy(*keys).orderBy("seg")), F.lit(folds))
    spans = rows.withColumn("_after", after)
    return spans.select("*", F.explode(F.sequence(F.lit(folds) - F.col("_after") + 1, F.lit(folds) - F.col("seg"))).alias("fold")).drop("_after", "seg")


def prefix_grams(blocks: DataFrame, keys: Sequence[str], folds: int) -> DataFrame:
    """(keys, fold, n, g) from Gram blocks (keys, seg, n, g) of the training intervals: running sums over the intervals."""
    keys = list(keys)
    cells = blocks.select(*keys, "seg", "n", F.posexplode("g").alias("_i", "_x"))
    upto = Window.partitionBy(*keys, "_i").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.select(*keys, "seg", "_i", F.sum("n").over(upto).alias("n"), F.sum("_x").over(upto).alias("_x"))
    whole = sums.groupBy(*keys, "seg").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("_i", "_x"))).alias("_s"))
    return _valid_folds(whole.select(*keys, "seg", "n", F.col("_s")["_x"].alias("g")), keys, folds)


def as_of(rows: DataFrame, folds: int, cols: Sequence[str], date: str = D) -> DataFrame:
    """(product, fold, cols): the last row up to each cut-off."""
    latest = rows.where(F.col("seg") < folds).groupBy(P, "seg").agg(F.max_by(F.struct(*cols), date).alias("_r"))
    return _valid_folds(latest, [P], folds).select(P, "fold", *[F.col("_r")[c].alias(c) for c in cols])


def _up_to_oldest(rows: DataFrame, value: Column) -> Column:
    """``value`` of the days up to the oldest cut-off, over a product."""
    return F.when(F.col("seg") == 0, value)


def _cutoffs(daily: DataFrame, folds: int, horizon: int) -> DataFrame:
    return daily.groupBy(P).agg(F.max("_last").alias("_last")).select(P, "_last", F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")).withColumn(
        "cutoff", F.expr(f"date_sub(_last, fold * {horizon})")).drop("_last")


# ------------------------------------------------------------------ the models
def trend_pairs(x: DataFrame, folds: int) -> DataFrame:
    """M1: (product, fold, actual, fitted, la, lf) of the tested days."""
    cuts = x.groupBy(P).agg(F.array(*[F.percentile(F.when(F.col("seg") <= folds - k, F.col(Y)), 0.99) for k in range(1, folds + 1)]).alias("_cuts"))
    x = x.join(cuts, P).withColumns({"x": -F.datediff("_last", D).cast("double"), "ly": log_demand(Y)})
    low = F.array_min("_cuts")
    common = gram(x.where((F.col("seg") < folds) & (F.col(Y) < low)), [P, "seg"], ["x", "ly"])
    some = x.where((F.col("seg") < folds) & (F.col(Y) >= low)).select(P, "x", "ly", Y, "_cuts", F.explode(F.sequence(F.lit(1), F.lit(folds) - F.col("seg"))).alias("fold"))
    some = gram(some.where(F.col(Y) < F.element_at("_cuts", F.col("fold"))), [P, "fold"], ["x", "ly"])
    both = prefix_grams(common, [P], folds).select(P, "fold", "g").unionByName(some.select(P, "fold", "g"))
    at = {"n": 0, "sx": 1, "sy": 2, "sxx": 4, "sxy": 5}
    sums = both.groupBy(P, "fold").agg(*[F.sum(F.col("g")[i]).alias(c) for c, i in at.items()])
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread).otherwise(0.0)
    coef = sums.where("n > 0").select(P, "fold", slope.alias("slope"), (F.col("sy") / F.col("n")).alias("ybar"), (F.col("sx") / F.col("n")).alias("xbar"))
    lf = F.col("ybar") + F.col("slope") * (F.col("x") - F.col("xbar"))
    return x.where("fold IS NOT NULL").join(coef, [P, "fold"]).select(P, "fold", F.col(Y).alias("actual"), exp_demand(lf).alias("fitted"), F.col("ly").alias("la"), lf.alias("lf"))


def ridge_rows(x: DataFrame) -> DataFrame:
    """M2's smoothed demand and powers of the day, standardised by the days up to the oldest cut-off."""
    d = ewma(x, Y, 5.0, out="smoothed").withColumn("ordinal", date_ordinal(D).cast("double"))
    old = d.groupBy(P).agg(F.avg(_up_to_oldest(d, F.col("ordinal"))).alias("_mu"), F.stddev_pop(_up_to_oldest(d, F.col("ordinal"))).alias("_sd"))
    z = (F.col("ordinal") - F.col("_mu")) / F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    d = d.join(old, P).where("_mu IS NOT NULL").withColumn("z", z)
    return d.withColumns({f"z{k}": F.pow(F.col("z"), k) for k in range(1, rg.DEGREE + 1)})


RIDGE_COLS = [f"z{k}" for k in range(1, rg.DEGREE + 1)] + ["smoothed"]


def ridge_pairs(x: DataFrame, folds: int) -> DataFrame:
    """M2: the smoothed demand of the tested days against the refitted polynomial."""
    d = ridge_rows(x)
    coef = rg.solve(prefix_grams(gram(d.where(F.col("seg") < folds), [P, "seg"], RIDGE_COLS), [P], folds), [P, "fold"])
    return d.where("fold IS NOT NULL").join(coef, [P, "fold"]).select(P, "fold", F.col("smoothed").alias("actual"), rg.poly("beta", F.col("z")).alias("fitted"))


def recursive_rows(x: DataFrame) -> DataFrame:
    """M3's features, with the outlier cut of the days up to the oldest cut-off."""
    cut = x.groupBy(P).agg(F.percentile(_up_to_oldest(x, F.col(Y)), 0.95).alias("_cut"))
    d = rc.smoothed_features(x.join(cut, P).where(F.col(Y) < F.col("_cut")), None)
    return d.withColumn("hist", F.collect_list("smoothed").over(by_product().rowsBetween(-6, 0)))


def recursive_pairs(x: DataFrame, folds: int, horizon: int) -> DataFrame:
    """M3: the 7-row means of the tested days against the recursion from each cut-off."""
    d = recursive_rows(x)
    coef = rc.solve(prefix_grams(gram(d.where(F.col("seg") < folds), [P, "seg"], rc.FEATURES + ["ly"]), [P], folds), [P, "fold"])
    start = as_of(d, folds, ["hist"]).join(coef, [P, "fold"]).join(_cutoffs(x, folds, horizon), [P, "fold"]).withColumnRenamed("cutoff", "last_date")
    fut = rc.rollout(start, horizon, lambda h, hist: exp_demand(rc.linear("beta", rc.step_features(F.date_add("last_date", h), hist))))
    w7 = by_product().rowsBetween(-6, 0)
    real = x.withColumn("actual", F.when(F.count(Y).over(w7) == 7, F.avg(Y).over(w7))).where("fold IS NOT NULL AND actual IS NOT NULL")
    pairs = real.select(P, "fold", D, "actual").join(fut.select(P, "fold", D, F.col("value").alias("fitted")), [P, "fold", D])
    return pairs.withColumns({"la": log_demand("actual"), "lf": log_demand(F.greatest("fitted", F.lit(0.0)))})


def lookback_rows(x: DataFrame) -> DataFrame:
    """M5's smoothed demand, scaled by the days up to the oldest cut-off, with the values before each day."""
    w7 = by_product().rowsBetween(-6, 0)
    d = x.withColumn("smoothed", F.when(F.count(Y).over(w7) == 7, F.avg(Y).over(w7))).where("smoothed IS NOT NULL")
    old = d.groupBy(P).agg(F.min(_up_to_oldest(d, F.col("smoothed"))).alias("_mn"), F.max(_up_to_oldest(d, F.col("smoothed"))).alias("_mx"))
    d = d.join(old, P).where("_mn IS NOT NULL")
    scaled = F.when(F.col("_mx") > F.col("_mn"), (F.col("smoothed") - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).otherwise(0.0)
    d = d.withColumn("scaled", scaled).withColumn("hist", F.collect_list("scaled").over(by_product().rowsBetween(1 - LOOK_BACK, 0)))
    return lookback_windows(d, "scaled", LOOK_BACK, out="back")


LOOKBACK_COLS = [f"l{k}" for k in range(1, LOOK_BACK + 1)] + ["scaled"]


def lookback_grams(d: DataFrame, folds: int) -> DataFrame:
    """One matrix per fold, of all products together."""
    rows = d.where(F.col("seg") < folds).select(F.lit("all").alias("one"), "seg", *[F.col("back")[k - 1].alias(f"l{k}") for k in range(1, LOOK_BACK + 1)], "scaled")
    return prefix_grams(gram_blocks(rows, ["one", "seg"], LOOKBACK_COLS), ["one"], folds)


def lookback_pairs(x: DataFrame, folds: int, horizon: int) -> DataFrame:
    """M5: the smoothed demand of the tested days against the pooled model's rollout from each cut-off."""
    d = cut_lineage(lookback_rows(x))
    k = len(LOOKBACK_COLS) + 1

    def solve(row):
        beta, _ = lstsq_from_gram(as_matrix(row["g"], k), range(k - 1), k - 1)
        return {"fold": row["fold"], "beta": [float(v) for v in beta]}

    coef = solve_table(lookback_grams(d, folds), solve, T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("beta", T.ArrayType(T.DoubleType()))]))
    start = as_of(d, folds, ["hist", "_mn", "_mx"]).where(F.size("hist") == LOOK_BACK)
    start = start.join(F.broadcast(coef), "fold").join(_cutoffs(x, folds, horizon), [P, "fold"]).withColumnRenamed("cutoff", "last_date")

    def predict(_h: Column, hist: Column) -> Column:
        return F.col("beta")[0] + F.aggregate(F.zip_with(hist, F.slice("beta", 2, LOOK_BACK), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)

    fut = rc.rollout(start, horizon, predict, LOOK_BACK)
    fut = fut.select(P, "fold", D, minmax_inverse(F.col("value"), F.col("_mn"), F.col("_mx")).alias("fitted"))
    return d.where("fold IS NOT NULL").select(P, "fold", D, F.col("smoothed").alias("actual")).join(fut, [P, "fold", D])


def seasonal_rows(df: DataFrame, folds: int, horizon: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """M9's clean rows with their design, the scaling, the holiday flags and all daily rows; cleaning and scaling are those of
    the days up to the oldest cut-off."""
    base = cut_lineage(with_intervals(daily_features(df), folds, horizon)).withColumnRenamed(D, "ds").withColumnRenamed(Y, "y")
    flags = cut_lineage(sn.holiday_flags(base.withColumnRenamed("ds", D)))
    sound = drop_missing(base.drop(HOLIDAY), ["y", *REGRESSORS]).where("y > 0")
    old = sound.where("seg = 0").groupBy(P).agg(F.percentile("y", [0.25, 0.75]).alias("_q"))
    low, high = F.col("_q")[0] - 1.5 * (F.col("_q")[1] - F.col("_q")[0]), F.col("_q")[1] + 1.5 * (F.col("_q")[1] - F.col("_q")[0])
    clean = sound.join(old, P).where(F.col("y").between(low, high)).drop("_q")
    enough = clean.where("seg = 0").groupBy(P).agg(F.count("*").alias("_n")).where(F.col("_n") >= sn.MIN_DAYS).select(P)
    clean = cut_lineage(clean.join(enough, P))
    scale = cut_lineage(sn.scaling(clean.where("seg = 0")))
    rows = sn.add_design(clean.join(scale, P).join(flags, "ds", "left").na.fill(0, subset=sn.HOLIDAY_COLS)).withColumn("ly", F.log("y"))
    return rows, scale, flags, base


def seasonal_grams(rows: DataFrame, folds: int) -> DataFrame:
    return prefix_grams(gram_blocks(rows.where(F.col("seg") < folds), [P, "seg"], sn.DESIGN + ["ly"]), [P], folds)


def seasonal_pairs(df: DataFrame, folds: int, horizon: int) -> DataFrame:
    """M9: the daily demand of the tested days against the model refitted up to each cut-off."""
    rows, scale, flags, base = seasonal_rows(df, folds, horizon)
    coef = sn.solve(seasonal_grams(rows, folds), [P, "fold"])
    w = Window.partitionBy(P).orderBy("ds").rowsBetween(-29, 0)
    means = rows.select(P, "ds", "seg", *[F.avg(c).over(w).alias(c) for c in REGRESSORS])
    start = as_of(means, folds, REGRESSORS, "ds").join(coef, [P, "fold"]).join(scale, P)
    tested = base.where("fold IS NOT NULL").select(P, "fold", "ds", F.col("y").alias("actual"))
    x = tested.join(start, [P, "fold"]).join(flags, "ds", "left").na.fill(0, subset=sn.HOLIDAY_COLS)
    return sn.components(sn.add_design(x)).select(P, "fold", "actual", F.col("yhat").alias("fitted"))


def rolling_backtest(df: DataFrame, folds: int = 3, horizon: int = 30, models: Sequence[str] | None = None) -> DataFrame:
    """Out-of-sample M10 per (product, model, fold): M1 on the demand, M2 on the smoothed demand, M3 and M5 on 7-row means,
    M9 on the demand; R² of M1 and M3 on the log scale (Q16)."""
    x = cut_lineage(with_intervals(daily_checkpoint(df), folds, horizon))
    logs = ("la", "lf")
    known = {"trend": (lambda: trend_pairs(x, folds), logs), "poly_ridge": (lambda: ridge_pairs(x, folds), ()),
             "recursive_linear": (lambda: recursive_pairs(x, folds, horizon), logs), "lookback": (lambda: lookback_pairs(x, folds, horizon), ()),
             "seasonal_regression": (lambda: seasonal_pairs(df, folds, horizon), ())}
    out = None
    for name in models or known:
        pairs, log_scale = known[name]
        scores = ev.forecast_metrics(pairs(), "actual", "fitted", *log_scale, keys=(P, "fold")).withColumn("model", F.lit(name))
        out = scores if out is None else out.unionByName(scores)
    return out


def compare_models(df: DataFrame, include_boosted: bool = True, models: Sequence[str] | None = None) -> DataFrame:
    """In-sample metrics of every model (or of ``models``) side by side, ranked per product.

    All models but the seasonal one read the daily sums only; those are
    computed once, so the fact tables are joined twice and not once per model.
    """
    from . import arima, pooled, trend
    daily = daily_checkpoint(df)
    known = {
        "trend": lambda: trend.trend_metrics(daily), "poly_ridge": lambda: rg.ridge_metrics(daily),
        "recursive_linear": lambda: rc.recursive_metrics(daily), "lookback": lambda: pooled.lookback_metrics(daily),
        "arima": lambda: arima.arima_metrics(daily), "seasonal_regression": lambda: sn.seasonal_metrics(df),
        "recursive_boosted": lambda: pooled.boosted_metrics(daily),
    }
    if models is None:
        models = [m for m in known if include_boosted or m != "recursive_boosted"]
    return ev.compare_models({m: known[m]() for m in models})
