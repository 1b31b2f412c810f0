"""Unit-root test (M6), ARIMA order search (M7) and ARIMA forecast (M8).

Every product's zero-filled daily series (J1) is handled at once, as rows: lags are windows
over a product's days, regressions are Gram sums (:func:`.gram.gram_lists` for designs whose
width follows the length of the series), and only the small solves, a row per product, run in
Python.  Every input product gives at least one row with a ``status``.

* M6 ``adf_test``: augmented Dickey–Fuller with a constant; the lag order is
  chosen by AIC over 0..maxlag on a common sample (maxlag =
  ⌈12·(n/100)^¼⌉): all lags are leading blocks of one Gram matrix.  The
  statistic comes from a second regression with the chosen lag; p-value from
  MacKinnon's (1994) response surface, critical values from MacKinnon (2010).
  Status: ``ok``, ``too_short``, ``constant``, ``singular`` (the regressors
  are linearly dependent) or ``exact_fit`` (no residual is left, so there is
  no statistic).
* M7 ``ar_order_search``: re-aimed from 48 maximum-likelihood fits to the
  Hannan–Rissanen (1982) two-stage regression: a long AR gives innovation
  estimates, then ARMA(p, q) for all p, q ≤ 3 are sub-blocks of one Gram matrix per
  product and d, over one sample per product, the same for d = 0, 1, 2 (Q19).
  Orders whose AR part is not stationary, whose MA part is not invertible, or
  whose regressors are dependent are left out; the lowest Gaussian AIC wins
  (``min_by``), ties to the first (p, d, q).  Products for which none is left
  get (1, 1, 1) with zero coefficients, a random walk, and status ``fallback``.
* M8 ``arima_forecast``: fitted values and a 30-day forecast from the chosen
  model; both use the first-stage innovations.  The forecast is a fold over the
  last three differences, three innovations and two levels.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..sources.demand import DATE, DEMAND, PRODUCT
from . import evaluate as ev
from .gram import as_matrix, from_upper, gram, gram_lists, regress, solve_rows, solve_table
from .series import by_product, daily_series, fill_calendar

P, D, Y = PRODUCT, DATE, DEMAND
MAX_P, MAX_D, MAX_Q = 3, 2, 3
#: Share of the squares below which a residual is none (Gram sums leave rounding of about 1e-14).
NOTHING = 1e-11

# MacKinnon (1994) response surface, constant only, one series.
TAU_STAR, TAU_MIN, TAU_MAX = -1.61, -18.83, 2.74
TAU_SMALLP = [2.1659, 1.4412, 0.038269]
TAU_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]
# MacKinnon (2010) critical values, constant only: c0 + c1/n + c2/n² + c3/n³.
CRIT_2010 = {"1%": [-3.43035, -6.5393, -16.786, -79.433],
             "5%": [-2.86154, -2.8903, -4.234, -40.04],
             "10%": [-2.56677, -1.5384, -2.809, 0.0]}


def _norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def mackinnon_p(tau: float) -> float:
    if tau is None or not np.isfinite(tau):
        return float("nan")
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    coef = TAU_SMALLP if tau <= TAU_STAR else TAU_LARGEP
    return _norm_cdf(sum(c * tau ** i for i, c in enumerate(coef)))


def mackinnon_crit(nobs: int) -> dict[str, float]:
    return {k: sum(c / nobs ** i for i, c in enumerate(v)) for k, v in CRIT_2010.items()}


def gaussian_aic(ssr: float, n: int, k: int) -> float:
    return n * (math.log(2 * math.pi * ssr / n) + 1) + 2 * k


def _filled(df: DataFrame, value: str) -> DataFrame:
    """J1 series written once to the checkpoint folder: product, day, v, its number _t from 0 and the series' length _n."""
    filled = fill_calendar(daily_series(df), value)
    return cut_lineage(_numbered(filled, value))


def _numbered(filled: DataFrame, value: str) -> DataFrame:
    return filled.select(P, D, F.col(value).cast("double").alias("v"), (F.row_number().over(by_product()) - 1).alias("_t"),
                         F.count(F.lit(1)).over(Window.partitionBy(P)).alias("_n"))


def _lags(c: str, w: Window, longest: int, n: Column) -> Column:
    """The last ``n`` values before a row, newest first; ``longest``: the greatest ``n``."""
    before = F.collect_list(c).over(w.rowsBetween(-max(longest, 1), -1))
    return F.slice(F.reverse(before), F.lit(1), n)


# ------------------------------------------------------------------ M6
_ADF_OUT = ["adf_statistic double", "p_value double", "crit_1 double", "crit_5 double", "crit_10 double", "used_lag int", "nobs int", "is_stationary boolean", "status string"]


def _choice(row: dict) -> dict:
    """The lag with the lowest AIC on the common sample."""
    g, n = from_upper(row["u"]), int(row["n"])
    target = len(g) - 1
    best = None
    for lag in range(target - 1):
        found = regress(g, range(lag + 2), target)
        if found and found[1] <= NOTHING * g[target, target]:
            return {**{k: row[k] for k in (P, "series")}, "used_lag": None, "status": "exact_fit"}
        if found:
            aic = gaussian_aic(found[1], n, lag + 2)
            if best is None or aic < best[0]:
                best = (aic, lag)
    return {**{k: row[k] for k in (P, "series")}, "used_lag": best and best[1], "status": "ok" if best else "singular"}


def _statistic(row: dict) -> dict:
    """The test from the Gram matrix of the chosen lag."""
    g, n = from_upper(row["u"]), int(row["n"])
    target = len(g) - 1
    out = {P: row[P], "series": row["series"], **dict.fromkeys(x.split()[0] for x in _ADF_OUT)}
    found, free = regress(g, range(target), target), n - target
    if found is None or free <= 0:
        return out | {"status": "singular" if found is None else "too_short"}
    if found[1] <= NOTHING * g[target, target]:
        return out | {"status": "exact_fit"}
    tau = float(found[0][1] / math.sqrt(found[1] / free * found[2][1, 1]))
    crit, p = mackinnon_crit(n), mackinnon_p(tau)
    return out | {"adf_statistic": tau, "p_value": p, "crit_1": crit["1%"], "crit_5": crit["5%"], "crit_10": crit["10%"], "used_lag": target - 2, "nobs": n,
                  "is_stationary": bool(p < 0.05), "status": "ok"}


def _adf(x: DataFrame, max_lag: int | None) -> DataFrame:
    keys = [P, "series"]
    w = Window.partitionBy(P).orderBy("_t")
    level = x.select(P, F.lit("level").alias("series"), "_t", "v", "_n")
    change = x.select(P, F.lit("difference").alias("series"), (F.col("_t") - 1).alias("_t"), (F.col("v") - F.lag("v").over(w)).alias("v"), (F.col("_n") - 1).alias("_n"))
    rows = level.unionByName(change.where("_t >= 0"))
    n = F.col("_n")
    top = F.least(F.floor(n / 2) - 2, F.ceil(12 * F.pow(n / 100, F.lit(0.25)))) if max_lag is None else F.lit(max_lag)
    whole, w = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_t")
    rows = rows.withColumns({"_top": top.cast("int"), "_low": F.min("v").over(whole), "_high": F.max("v").over(whole), "_before": F.lag("v").over(w) - F.avg("v").over(whole),
                             "_dy": F.col("v") - F.lag("v").over(w)})
    known = F.when((F.col("_top") < 0) | (n < 4), "too_short").when(F.col("_low") == F.col("_high"), "constant")
    longest = x.agg(F.max("_n")).first()[0] or 1
    longest = math.ceil(12 * (longest / 100) ** 0.25) if max_lag is None else max_lag
    rows = rows.withColumn("_known", known)
    # the differences before a row, newest first: all that the longest lag of the series needs
    rows = cut_lineage(rows.withColumn("_lags", _lags("_dy", w, longest, F.greatest("_top", F.lit(0)))).drop("_low", "_high", "v"))
    tested = rows.where("_known IS NULL AND _dy IS NOT NULL")

    def design(lag: Column) -> Column:
        return F.concat(F.array(F.lit(1.0), F.col("_before")), F.slice("_lags", F.lit(1), lag), F.array("_dy"))

    field = {f: T.StructField(f, T.StringType()) for f in (P, "series", "status")}
    common = gram_lists(tested.where(F.col("_t") > F.col("_top")).select(*keys, design(F.col("_top")).alias("_z")), keys, "_z")
    chosen = solve_table(common, _choice, T.StructType([field[P], field["series"], T.StructField("used_lag", T.IntegerType()), field["status"]]))
    chosen = cut_lineage(chosen)
    lags = chosen.where("status = 'ok'").select(*keys, F.col("used_lag").alias("_lag"))
    final = gram_lists(tested.join(lags, keys).where(F.col("_t") > F.col("_lag")).select(*keys, design(F.col("_lag")).alias("_z")), keys, "_z")
    schema = T.StructType([field[P], field["series"], *(T.StructField(a, {"double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "string": T.StringType()}[b])
                                                        for a, b in map(str.split, _ADF_OUT))])
    done = solve_table(final, _statistic, schema)
    # series without a test keep a row with the reason
    every = rows.groupBy(*keys).agg(F.first("_known").alias("_known"))
    single = x.where("_n = 1").select(P, F.lit("difference").alias("series"), F.lit("too_short").alias("_known"))
    every = every.unionByName(single).join(chosen.select(*keys, F.col("status").alias("_chosen")), keys, "left").join(done, keys, "left")
    return every.withColumn("status", F.coalesce("_known", "status", "_chosen", F.lit("singular"))).select(*keys, *(x.split()[0] for x in _ADF_OUT))


def adf_on_series(filled: DataFrame, value: str = Y, max_lag: int | None = None) -> DataFrame:
    """ADF of every product's series and of its first difference, a row each; ``max_lag`` overrides the usual bound."""
    return _adf(cut_lineage(_numbered(filled, value)), max_lag)


def adf_test(df: DataFrame, value: str = Y, max_lag: int | None = None) -> DataFrame:
    """M6 on every product's zero-filled series and on its first difference."""
    return _adf(_filled(df, value), max_lag)


# ------------------------------------------------------------------ M7
def _differenced(filled: DataFrame, value: str) -> DataFrame:
    """Rows ``(Product_ID, d, Date, y, w)`` for d = 0, 1, 2 (w = Δ^d y)."""
    x = _with_orders(_numbered(filled, value))
    return x.where(F.col("_t") >= F.col("d")).select(P, "d", D, F.col("v").alias("y"), "w")


def _with_orders(x: DataFrame) -> DataFrame:
    """Each row for d = 0, 1, 2, with ``w``, the d-th difference (0 where it does not exist), and the levels before."""
    w = by_product()
    x = x.withColumns({"_y1": F.lag("v", 1).over(w), "_y2": F.lag("v", 2).over(w)}).withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(MAX_D))))
    y = F.col("v")
    diff = F.when(F.col("d") == 0, y).when(F.col("d") == 1, y - F.col("_y1")).otherwise(y - 2 * F.col("_y1") + F.col("_y2"))
    return x.withColumn("w", F.when(F.col("_t") >= F.col("d"), diff).otherwise(0.0))


def long_ar_order(n: int) -> int:
    """Order of the first stage: max(⌊ln(n)²⌋, 2·max(p, q)), kept below a third of the sample."""
    return int(min(max(math.floor(math.log(n) ** 2), 2 * max(MAX_P, MAX_Q)), max((n - 1) // 3, 1)))


def _long_ar(n: Column) -> Column:
    ln = F.log(n.cast("double"))
    return F.least(F.greatest(F.floor(ln * ln), F.lit(2 * max(MAX_P, MAX_Q))), F.greatest(F.floor((n - 1) / 3), F.lit(1))).cast("int")


def _stable(coef: np.ndarray) -> bool:
    """Whether 1 − c₁z − c₂z² − … has all roots outside the unit circle."""
    return not coef.any() or bool((np.abs(np.roots(np.concatenate([[1.0], -coef]))) < 1 - 1e-6).all())


def _first_stage(row: dict) -> dict:
    """Coefficients of the long autoregression (the smallest ones, if its columns are dependent)."""
    g = from_upper(row["u"])
    k = len(g) - 1
    found = regress(g, range(k), k) if row["n"] >= k else None
    if found is None:
        scale = np.sqrt(np.maximum(np.diag(g)[:k], 1e-300))
        beta = np.linalg.lstsq(g[:k, :k] / np.outer(scale, scale), g[:k, k] / scale, rcond=1e-10)[0] / scale
    else:
        beta = found[0]
    return {P: row[P], "d": row["d"], "beta": [float(b) for b in beta]}


def _orders(row: dict) -> list[dict]:
    """All (p, q) of one product and d: sub-blocks of one Gram matrix over [1, w₁..w₃, e₁..e₃, w]."""
    k = MAX_P + MAX_Q + 2
    g, n, d = as_matrix(row["g"], k), int(row["n"]), int(row["d"])
    out = []
    for p in range(MAX_P + 1):
        for q in range(MAX_Q + 1):
            use = [0] * (d == 0) + list(range(1, p + 1)) + list(range(1 + MAX_P, 1 + MAX_P + q))
            found = regress(g, use, k - 1) if n >= k else None
            # an exact fit (a constant or a straight line) has no likelihood
            if found is None or found[1] <= NOTHING * row["yy"]:
                continue
            coef = np.zeros(k - 1)
            coef[use] = found[0]
            if _stable(coef[1:1 + MAX_P]) and _stable(-coef[1 + MAX_P:]):
                out.append({P: row[P], "p": p, "d": d, "q": q, "aic": gaussian_aic(found[1], n, p + q + 1 + (d == 0)), "coef": coef.tolist()})
    return out


def _staged(x: DataFrame) -> DataFrame:
    """Rows (product, d, day) with ``w``, the first-stage innovation ``e``, the three of each before, and ``_first``, where the
    common sample begins."""
    longest = x.agg(F.max("_n")).first()[0] or 1
    w = Window.partitionBy(P, "d").orderBy("_t")
    rows = _with_orders(x).withColumn("_m", F.when(F.col("_n") > 1, _long_ar(F.col("_n"))).otherwise(1))
    rows = cut_lineage(rows.withColumn("_back", _lags("w", w, long_ar_order(longest) if longest > 1 else 1, F.col("_m"))))
    begun = F.col("_t") >= F.col("d") + F.col("_m")
    z = F.concat(F.array(F.lit(1.0)), F.col("_back"), F.array("w"))
    beta = solve_table(gram_lists(rows.where(begun).select(P, "d", z.alias("_z")), [P, "d"], "_z"), _first_stage,
                       T.StructType([T.StructField(P, T.StringType()), T.StructField("d", T.IntegerType()), T.StructField("beta", T.ArrayType(T.DoubleType()))]))
    told = F.aggregate(F.zip_with("_back", F.slice("beta", F.lit(2), F.col("_m")), lambda a, b: a * b), F.col("beta")[0], lambda s, v: s + v)
    rows = rows.join(beta, [P, "d"], "left").withColumn("e", F.when(begun & F.col("beta").isNotNull(), F.col("w") - told).otherwise(0.0)).drop("_back", "beta")
    lags = {f"{c}{k}": F.lag(c, k).over(w) for c in ("w", "e") for k in range(1, MAX_P + 1)}
    return cut_lineage(rows.withColumns(lags).withColumn("_first", F.lit(MAX_D + MAX_Q) + F.col("_m")))


def _candidates(staged: DataFrame) -> DataFrame:
    cols = [f"w{k}" for k in range(1, MAX_P + 1)] + [f"e{k}" for k in range(1, MAX_Q + 1)] + ["w"]
    sums = gram(staged.where(F.col("_t") >= F.col("_first")), [P, "d"], cols)
    squares = staged.where("d = 0").groupBy(P).agg(F.sum(F.col("v") * F.col("v")).alias("yy"))
    schema = T.StructType([T.StructField(P, T.StringType()), *(T.StructField(c, T.IntegerType()) for c in "pdq"), T.StructField("aic", T.DoubleType()),
                           T.StructField("coef", T.ArrayType(T.DoubleType()))])
    return solve_rows(sums.join(squares, P), _orders, schema)


def _best(staged: DataFrame) -> DataFrame:
    """Per product the lowest AIC, ties to the first (p, d, q); a random walk where nothing could be fitted."""
    best = _candidates(staged).groupBy(P).agg(F.min_by(F.struct("p", "d", "q", "aic", "coef"), F.struct("aic", "p", "d", "q")).alias("_b"))
    zero = F.array(*[F.lit(0.0)] * (1 + MAX_P + MAX_Q))
    one = staged.groupBy(P).agg(F.max("_n").alias("_n")).join(best, P, "left")
    return one.select(P, *[F.coalesce(F.col("_b")[c], F.lit(1)).alias(c) for c in "pdq"], F.col("_b")["aic"].alias("aic"), F.coalesce(F.col("_b")["coef"], zero).alias("coef"),
                      F.when(F.col("_b").isNull(), "fallback").otherwise("ok").alias("status"))


def order_candidates(filled: DataFrame, value: str = Y) -> DataFrame:
    """Every candidate that could be fitted: product, p, d, q, aic, coef ([c, φ1..3, θ1..3])."""
    return _candidates(_staged(cut_lineage(_numbered(filled, value))))


def ar_order_search(df: DataFrame, value: str = Y) -> DataFrame:
    """M7: per product the (p, d, q) with the lowest AIC, one row for every product."""
    return _best(_staged(_filled(df, value))).select(P, "p", "d", "q", "aic", "coef", "status")


# ------------------------------------------------------------------ M8
def _runs(df: DataFrame, horizon: int, value: str) -> DataFrame:
    """Fitted and forecast rows of every product from its best order."""
    staged = _staged(_filled(df, value))
    best = cut_lineage(_best(staged))
    rows = staged.join(best, [P, "d"])
    coef = [F.col("coef")[i] for i in range(1 + MAX_P + MAX_Q)]
    step = coef[0]
    for k in range(1, MAX_P + 1):
        step = step + coef[k] * F.coalesce(f"w{k}", F.lit(0.0)) + coef[MAX_P + k] * F.coalesce(f"e{k}", F.lit(0.0))
    level = F.when(F.col("d") == 0, 0.0).when(F.col("d") == 1, F.col("_y1")).otherwise(2 * F.col("_y1") - F.col("_y2"))
    order = ["p", "d", "q", "aic", "status"]
    start = F.when(F.col("status") == "ok", F.col("_first")).otherwise(F.col("d"))
    fitted = rows.where(F.col("_t") >= start).select(P, D, F.lit("fitted").alias("kind"), (step + level).alias("value"), F.col("v").alias("actual"), *order)

    w = Window.partitionBy(P, "d").orderBy("_t")
    last3 = {f"_{c}": F.collect_list(c).over(w.rowsBetween(1 - MAX_P, 0)) for c in ("w", "e")}
    ends = staged.withColumns({**last3, "_y": F.collect_list("v").over(w.rowsBetween(-1, 0))}).where(F.col("_t") == F.col("_n") - 1).join(best, [P, "d"])
    pad = lambda c, n: F.slice(F.concat(F.array(*[F.lit(0.0)] * n), F.col(c)), -n, n)
    state = F.struct(pad("_w", MAX_P).alias("w"), pad("_e", MAX_Q).alias("e"), pad("_y", 2).alias("y"), F.array().cast("array<double>").alias("out"))

    def ahead(s: Column, _h: Column) -> Column:
        nxt = coef[0]
        for k in range(1, MAX_P + 1):
            nxt = nxt + coef[k] * F.element_at(s["w"], -k) + coef[MAX_P + k] * F.element_at(s["e"], -k)
        y1, y2 = F.element_at(s["y"], -1), F.element_at(s["y"], -2)
        value = nxt + F.when(F.col("d") == 0, 0.0).when(F.col("d") == 1, y1).otherwise(2 * y1 - y2)
        shift = lambda a, x: F.concat(F.slice(a, 2, F.size(a) - 1), F.array(x))
        return F.struct(shift(s["w"], nxt).alias("w"), shift(s["e"], F.lit(0.0)).alias("e"), shift(s["y"], value).alias("y"), F.concat(s["out"], F.array(value)).alias("out"))

    folded = ends.withColumn("_f", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), state, ahead)["out"])
    future = folded.select(P, F.posexplode("_f").alias("_h", "value"), F.col(D).alias("_last"), *order).select(
        P, F.date_add("_last", F.col("_h") + 1).alias(D), F.lit("forecast").alias("kind"), "value", F.lit(None).cast("double").alias("actual"), *order)
    return fitted.unionByName(future)


def arima_forecast(df: DataFrame, horizon: int = 30, value: str = Y) -> DataFrame:
    """M8: ``(Product_ID, Date, kind, value)`` fitted and forecast rows, with the chosen order in ``order`` and ``status``."""
    order = F.concat_ws(",", F.col("p").cast("string"), F.col("d").cast("string"), F.col("q").cast("string"))
    return _runs(df, horizon, value).select(P, D, "kind", "value", order.alias("order"), "status")


def arima_metrics(df: DataFrame, value: str = Y) -> DataFrame:
    """M10 for M8 on the zero-filled series; MAPE skips zero days (Q20).  Products with one day have no fitted value: no metrics, but a row."""
    rows = cut_lineage(_runs(df, 1, value))
    pairs = rows.where("kind = 'fitted'").select(P, "actual", F.col("value").alias("fitted"))
    best = rows.where("kind = 'forecast'").select(P, "p", "d", "q", "aic", "status")
    return best.join(ev.forecast_metrics(pairs, skip_zero_mape=True), P, "left")
