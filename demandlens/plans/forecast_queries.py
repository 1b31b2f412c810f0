"""Registered forecast queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..forecast import evaluate as ev
from ..forecast import trend
from ..sources.demand import DATE, PRODUCT
from . import model_sql as sql
from .registry import ORACLES, register, with_demand

DAILY = "daily AS (SELECT Product_ID, Date, CAST(SUM(Demand) AS DOUBLE) AS Demand FROM demand GROUP BY 1, 2)"
ORD = "(CAST(Date - DATE '1970-01-01' AS BIGINT) + 719163)"

M1_FIT = f""", {DAILY}
, t AS (SELECT *, quantile_cont(Demand, 0.99) OVER (PARTITION BY Product_ID) AS qc FROM daily)
, d AS (SELECT Product_ID, Date, Demand, {ORD} AS x, ln(1 + Demand) AS ly FROM t WHERE Demand < qc)
, c AS (SELECT Product_ID, regr_slope(ly, x) AS slope, avg(ly) AS ybar, avg(x) AS xbar, max(Date) AS last_date
        FROM d GROUP BY 1)
, f AS (SELECT d.*, c.ybar + coalesce(c.slope, 0) * (d.x - c.xbar) AS pl FROM d JOIN c USING (Product_ID))"""


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _r(c, digits):
    return F.round(F.col(c), digits).alias(c)


def missing_sql(known: str, needed: int, columns: str = "NULL AS Date, 'none' AS kind, NULL AS value", key: str = "Product_ID") -> str:
    """Rows of the products of ``daily`` that ``known`` lacks."""
    return f"""SELECT Product_ID, {columns}, CASE WHEN count(*) < {needed} THEN 'too_short' WHEN min(Demand) = max(Demand) THEN 'constant' ELSE 'no_clean_days' END AS status
FROM daily WHERE Product_ID NOT IN (SELECT {key} FROM {known}) GROUP BY Product_ID"""


@register("trend_forecast", M1_FIT + f"""
SELECT Product_ID, Date, 'fitted' AS kind, round(exp(pl) - 1, 6) AS value, 'ok' AS status FROM f
UNION ALL
SELECT Product_ID, CAST(last_date + INTERVAL (h) DAY AS DATE) AS Date, 'forecast' AS kind,
       round(exp(ybar + coalesce(slope, 0) * ((CAST(last_date - DATE '1970-01-01' AS BIGINT) + 719163 + h) - xbar)) - 1, 6)
         AS value, 'ok'
FROM c, range(1, 31) r(h)
UNION ALL
""" + missing_sql("c", 2))
def q_trend_forecast(df):
    """M1: fitted values and 30 forecast days per product; products without have a row that says why."""
    out = trend.trend_forecast(df, 30)
    return out.select(PRODUCT, DATE, "kind", _r6("value"), "status")


_METRICS_SQL = """
, m AS (SELECT Product_ID, COUNT(*) AS n, avg(actual) AS mean, sqrt(avg((actual - fitted) ^ 2)) AS rmse,
               avg(abs((actual - fitted) / actual)) * 100 AS mape,
               SUM((ry - rf) ^ 2) AS sse, SUM((ry - my) ^ 2) AS sst
        FROM (SELECT *, avg(ry) OVER (PARTITION BY Product_ID) AS my FROM pairs) GROUP BY 1)
, g AS (SELECT Product_ID, n, mean, rmse, rmse / mean * 100 AS rmse_pct, mape,
               CASE WHEN sst > 0 THEN 1 - sse / sst END AS r2 FROM m)
SELECT Product_ID, n, round(mean, 6) AS mean, round(rmse, 6) AS rmse, round(rmse_pct, 6) AS rmse_pct,
       round(mape, 6) AS mape, round(r2, 6) AS r2,
       CASE WHEN rmse_pct IS NULL THEN NULL WHEN rmse_pct < {rg} THEN 'good' WHEN rmse_pct < {rf} THEN 'fair'
            ELSE 'poor' END AS rmse_grade,
       CASE WHEN mape IS NULL THEN NULL WHEN mape < {mg} THEN 'good' WHEN mape < {mf} THEN 'fair'
            ELSE 'poor' END AS mape_grade,
       CASE WHEN r2 IS NULL THEN NULL WHEN r2 >= {r2g} THEN 'good' WHEN r2 >= {r2f} THEN 'fair'
            ELSE 'poor' END AS r2_grade
FROM g"""


# grade limits are written out here, apart from the engine's
def metrics_sql(limits=(20, 40, 10, 20, 0.7, 0.5)) -> str:
    return _METRICS_SQL.format(**dict(zip(("rg", "rf", "mg", "mf", "r2g", "r2f"), limits, strict=True)))


@register("trend_metrics", M1_FIT + """
, pairs AS (SELECT Product_ID, Demand AS actual, exp(pl) - 1 AS fitted, ly AS ry, pl AS rf FROM f)""" + metrics_sql())
def q_trend_metrics(df):
    """M10 + M11 for M1 (R² on the log scale)."""
    return ev.grade_metrics(ev.round_metrics(trend.trend_metrics(df)))


@register("trend_residuals", M1_FIT + """
SELECT Product_ID, round(avg(Demand - (exp(pl) - 1)), 6) AS residual_mean,
       round(stddev_pop(Demand - (exp(pl) - 1)), 6) AS residual_std,
       abs(avg(Demand - (exp(pl) - 1))) < 0.1 AS unbiased
FROM f GROUP BY 1""")
def q_trend_residuals(df):
    """M12 on the M1 fit."""
    r = ev.residual_summary(trend.trend_pairs(df))
    return r.select(PRODUCT, _r6("residual_mean"), _r6("residual_std"), "unbiased")


# ------------------------------------------------------------------ M2, M3 (rows-only; numpy-checked in tests)
from ..forecast import recursive as rc  # noqa: E402
from ..forecast import ridge as rg  # noqa: E402


# (values of solved models are rounded to 4 places, so that two solvers' last digits can't part them)
@register("poly_ridge_forecast", sql.RIDGE_FORECAST, raw_oracle=True)
def q_ridge_forecast(df):
    """M2: fitted smoothed history and 30 forecast days."""
    return rg.ridge_forecast(df, 30).select(PRODUCT, DATE, "kind", _r("value", 4), "status")


@register("poly_ridge_metrics", sql.PAIRS["poly_ridge"] + metrics_sql().replace("FROM g", ", alpha::DOUBLE AS alpha FROM g JOIN (SELECT DISTINCT Product_ID, alpha FROM pairs) USING (Product_ID)"), raw_oracle=True)
def q_ridge_metrics(df):
    """M10 + M11 for M2, with the chosen alpha."""
    return ev.grade_metrics(ev.round_metrics(rg.ridge_metrics(df)))


@register("recursive_linear_forecast", sql.RECURSIVE_FORECAST, raw_oracle=True)
def q_recursive_forecast(df):
    """M3: fitted smoothed history and the 30-step recursion; products without have a row that says why."""
    return rc.recursive_forecast(df, 30).select(PRODUCT, DATE, "kind", _r("value", 4), "status")


@register("recursive_linear_metrics", sql.PAIRS["recursive_linear"] + metrics_sql(), raw_oracle=True)
def q_recursive_metrics(df):
    """M10 + M11 for M3."""
    return ev.grade_metrics(ev.round_metrics(rc.recursive_metrics(df)))


@register("recursive_features", f""", {DAILY}
, t AS (SELECT *, quantile_cont(Demand, 0.95) OVER (PARTITION BY Product_ID) AS qc FROM daily)
, a AS (SELECT * FROM t WHERE Demand < qc)
, b AS (SELECT *, CASE WHEN count(Demand) OVER w7 = 7 THEN avg(Demand) OVER w7 END AS smoothed FROM a
        WINDOW w7 AS (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
, c AS (SELECT Product_ID, Date, smoothed,
          lag(smoothed, 1) OVER (PARTITION BY Product_ID ORDER BY Date) AS lag1,
          lag(smoothed, 7) OVER (PARTITION BY Product_ID ORDER BY Date) AS lag7,
          CASE WHEN count(smoothed) OVER w7 = 7 THEN avg(smoothed) OVER w7 END AS mean7
        FROM b WHERE smoothed IS NOT NULL
        WINDOW w7 AS (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT Product_ID, Date, round(smoothed, 6) AS smoothed, round(lag1, 6) AS lag1, round(lag7, 6) AS lag7,
       round(mean7, 6) AS mean7, CAST(isodow(Date) - 1 AS DOUBLE) AS dow, CAST(month(Date) AS DOUBLE) AS month,
       CAST(isodow(Date) >= 6 AS DOUBLE) AS weekend, round(ln(1 + smoothed), 6) AS ly
FROM c WHERE lag1 IS NOT NULL AND lag7 IS NOT NULL AND mean7 IS NOT NULL""")
def q_recursive_features(df):
    """The M3 training frame (F8 .95, W2, W3, P14): checked against SQL."""
    from ..forecast.series import daily_series
    d = rc.smoothed_features(daily_series(df), 0.95, with_x=False)
    return d.select(PRODUCT, DATE, *[_r6(c) for c in ("smoothed", "lag1", "lag7", "mean7")],
                    "dow", "month", "weekend", _r6("ly"))


# ------------------------------------------------------------------ M6–M8
from ..forecast import arima as ar  # noqa: E402


@register("adf_test", sql.ADF, raw_oracle=True)
def q_adf(df):
    """M6: ADF on each product's zero-filled series and on its difference."""
    out = ar.adf_test(df)
    return out.select(PRODUCT, "series", _r("adf_statistic", 4), *[_r6(c) for c in ("p_value", "crit_1", "crit_5", "crit_10")], "used_lag", "nobs", "is_stationary", "status")


@register("ar_order_search", sql.ORDERS, raw_oracle=True)
def q_order(df):
    """M7: chosen (p, d, q) per product by Hannan–Rissanen + AIC."""
    return ar.ar_order_search(df).select(PRODUCT, "p", "d", "q", _r("aic", 3))


@register("arima_forecast", sql.ARIMA_FORECAST, raw_oracle=True)
def q_arima_forecast(df):
    """M8: fitted values and 30 forecast days from the chosen order."""
    return ar.arima_forecast(df, 30).select(PRODUCT, DATE, "kind", _r("value", 4), "order", "status")


@register("arima_metrics", sql.PAIRS["arima"] + metrics_sql().replace("abs((actual - fitted) / actual)", "abs((actual - fitted) / nullif(actual, 0))").replace(
    "FROM g", """, p, d, q, round(aic, 3) AS aic, zero_days, 'ok' AS status FROM g JOIN (
  SELECT Product_ID, max(p) AS p, max(d) AS d, max(q) AS q, max(aic) AS aic, count(*) FILTER (WHERE actual = 0) AS zero_days FROM pairs GROUP BY 1) USING (Product_ID)"""), raw_oracle=True)
def q_arima_metrics(df):
    """M10 + M11 for M8."""
    m = ev.grade_metrics(ev.round_metrics(ar.arima_metrics(df)))
    return m.select(*[_r("aic", 3) if c == "aic" else c for c in m.columns])


# ------------------------------------------------------------------ M4, M5 (Spark ML, rows-only)
from ..forecast import pooled as pl  # noqa: E402


@register("recursive_boosted_forecast")
def q_boosted_forecast(df):
    """M4: pooled GBT (100 trees, step 0.1, depth 6), 30-step recursion."""
    return pl.boosted_forecast(df, 30).select(PRODUCT, DATE, "kind", _r6("value"), "status")


@register("recursive_boosted_metrics")
def q_boosted_metrics(df):
    """M10 + M11 for M4."""
    return ev.grade_metrics(ev.round_metrics(pl.boosted_metrics(df)))


@register("lookback_forecast", sql.LOOKBACK_FORECAST, raw_oracle=True)
def q_lookback_forecast(df):
    """M5: pooled linear model on 30 scaled look-back values, 30-step rollout; products without have a row that says why."""
    return pl.lookback_forecast(df, 30).select(PRODUCT, DATE, "kind", _r("value", 4), "status")


@register("lookback_metrics", sql.PAIRS["lookback"] + metrics_sql(), raw_oracle=True)
def q_lookback_metrics(df):
    """M10 + M11 for M5."""
    return ev.grade_metrics(ev.round_metrics(pl.lookback_metrics(df)))


# ------------------------------------------------------------------ M9
from ..forecast import seasonal as sn  # noqa: E402


@register("seasonal_regression_forecast", sql.SEASONAL_FORECAST, raw_oracle=True)
def q_seasonal_forecast(df):
    """M9: fitted and 30 forecast days with 80 % band and components; products without have a row that says why."""
    out = sn.seasonal_forecast(df, 30)
    return out.select(PRODUCT, DATE, "kind", *[_r(c, 3) for c in ["value"] + sn.OUT_COLS[1:]], "status")


@register("seasonal_optimality", sql.SEASONAL_OPTIMALITY, raw_oracle=True)
def q_seasonal_optimality(df):
    """M9: slope changes of each product and whether the conditions of the optimum hold."""
    out = sn.optimality(df)
    return out.select(PRODUCT, "n", _r("weight", 4), "slope_changes", _r("total_change", 4), "free_at_rest", "hinges_at_rest")


@register("seasonal_regression_metrics", sql.PAIRS["seasonal_regression"] + metrics_sql((15, 30, 10, 20, 0.8, 0.6)).replace("FROM g", """, unbiased, residual_mean, residual_std
FROM g JOIN (SELECT Product_ID, round(avg(actual - fitted), 6) AS residual_mean, round(stddev_pop(actual - fitted), 6) AS residual_std, abs(avg(actual - fitted)) < 0.1 AS unbiased
             FROM pairs GROUP BY 1) USING (Product_ID)"""), raw_oracle=True)
def q_seasonal_metrics(df):
    """M10 + M11 (seasonal limits) + M12 for M9."""
    m = ev.grade_metrics(ev.round_metrics(sn.seasonal_metrics(df)), ev.SEASONAL_THRESHOLDS)
    return m.select(*[c for c in m.columns if c not in ("residual_mean", "residual_std")],
                    _r6("residual_mean"), _r6("residual_std"))


@register("iqr_cleaning_report", f""", feats AS (SELECT Product_ID, Date, CAST(SUM(Demand) AS DOUBLE) AS y,
          CAST(max(Public_Holiday) AS INTEGER) AS h,
          {', '.join(f'CAST(SUM({c}) AS DOUBLE) / COUNT({c}) AS {c}' for c in sn.REGRESSORS)}
        FROM demand GROUP BY 1, 2)
, b AS (SELECT * FROM feats WHERE y > 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in sn.REGRESSORS)})
, q AS (SELECT *, quantile_cont(y, 0.25) OVER (PARTITION BY Product_ID) AS q1,
               quantile_cont(y, 0.75) OVER (PARTITION BY Product_ID) AS q3 FROM b)
SELECT Product_ID, COUNT(*) FILTER (WHERE NOT (y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1))) AS removed,
       COUNT(*) AS rows
FROM q GROUP BY Product_ID""")
def q_iqr_report(df):
    """F9 report: per product rows removed by the IQR rule."""
    return sn.cleaning_report(df)


# ------------------------------------------------------------------ M13, M14 (rows-only)
from ..forecast import backtest as bt  # noqa: E402


def _r6all(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("compare_models")
def q_compare(df):
    """All models' in-sample metrics, rank 1 = lowest RMSE % per product."""
    return _r6all(bt.compare_models(df))


_RANKED = ("trend", "poly_ridge", "recursive_linear", "lookback", "arima", "seasonal_regression")


def _ranking_sql() -> str:
    """M13 from each model's own pairs: scores side by side, then ranks."""
    pairs = {**sql.PAIRS, "trend": with_demand(M1_FIT + ", pairs AS (SELECT Product_ID, Demand AS actual, exp(pl) - 1 AS fitted, ly AS ry, pl AS rf FROM f)")}
    scores = _METRICS_SQL[:_METRICS_SQL.index("SELECT Product_ID, n, round(mean")].replace("(actual - fitted) / actual", "(actual - fitted) / nullif(actual, 0)")
    parts = [f"SELECT * FROM ({pairs[m]}{scores} SELECT Product_ID, '{m}' AS model, rmse, rmse_pct, mape, r2 FROM g)" for m in _RANKED]
    return ("SELECT Product_ID, model, round(rmse, 6) AS rmse, round(rmse_pct, 6) AS rmse_pct, round(mape, 6) AS mape, round(r2, 6) AS r2,"
            " CAST(row_number() OVER (PARTITION BY Product_ID ORDER BY rmse_pct NULLS LAST, model) AS INTEGER) AS rank FROM (" + " UNION ALL ".join(parts) + ")")


@register("model_ranking", _ranking_sql(), raw_oracle=True)
def q_ranking(df):
    """M13 over the models that SQL can fit, too."""
    return _r6all(bt.compare_models(df, models=_RANKED))


@register("rolling_backtest", sql.BACKTEST_SCORES, raw_oracle=True)
def q_backtest(df):
    """Out-of-sample metrics of five models per product and fold (3 folds of 30 days)."""
    return _r6all(bt.rolling_backtest(df, 3, 30))


# ------------------------------------------------------------------ inputs of M2 and M5 (oracle)
from ..sources.demand import DEMAND_VIEW_SQL  # noqa: E402

_A5 = 2.0 / 6.0
RIDGE_DESIGN_SQL = f"""WITH RECURSIVE demand AS ({DEMAND_VIEW_SQL}), {DAILY}
, n AS (SELECT *, row_number() OVER (PARTITION BY Product_ID ORDER BY Date) AS rn, {ORD} AS x FROM daily)
, rec AS (SELECT Product_ID, Date, Demand, rn, x, Demand AS e FROM n WHERE rn = 1
          UNION ALL
          SELECT n.Product_ID, n.Date, n.Demand, n.rn, n.x, {_A5!r} * n.Demand + {1 - _A5!r} * rec.e
          FROM rec JOIN n ON n.Product_ID = rec.Product_ID AND n.rn = rec.rn + 1)
, s AS (SELECT *, avg(x) OVER (PARTITION BY Product_ID) AS mu, stddev_pop(x) OVER (PARTITION BY Product_ID) AS sd
        FROM rec)
SELECT Product_ID, Date, round(e, 6) AS smoothed,
       round((x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 6) AS z FROM s"""


@register("poly_ridge_design", RIDGE_DESIGN_SQL, raw_oracle=True)
def q_ridge_design(df):
    """Inputs of M2: EWMA-smoothed demand (W5) and the standardised day number."""
    d = rg._prepared(df)
    return d.select(PRODUCT, DATE, _r6("smoothed"), _r6("z"))


@register("lookback_design", f""", {DAILY}
, a AS (SELECT *, CASE WHEN count(Demand) OVER w7 = 7 THEN avg(Demand) OVER w7 END AS smoothed FROM daily
        WINDOW w7 AS (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
, b AS (SELECT *, min(smoothed) OVER (PARTITION BY Product_ID) AS mn, max(smoothed) OVER (PARTITION BY Product_ID) AS mx
        FROM a WHERE smoothed IS NOT NULL)
SELECT Product_ID, Date, round(smoothed, 6) AS smoothed,
       round(CASE WHEN mx > mn THEN (smoothed - mn) / (mx - mn) ELSE 0.0 END, 6) AS scaled FROM b""")
def q_lookback_design(df):
    """Inputs of M5: strict 7-row mean (W2) min–max scaled per product."""
    d = pl._lookback_frame(df)
    return d.select(PRODUCT, DATE, _r6("smoothed"), _r6("scaled"))


@register("arima_differenced", f""", {DAILY}
, span AS (SELECT Product_ID, min(Date) AS a, max(Date) AS b FROM daily GROUP BY 1)
, cal AS (SELECT Product_ID, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS Date FROM span)
, f AS (SELECT c.Product_ID, c.Date, coalesce(d.Demand, 0.0) AS y
        FROM cal c LEFT JOIN daily d ON c.Product_ID = d.Product_ID AND c.Date = d.Date)
, l AS (SELECT *, row_number() OVER (PARTITION BY Product_ID ORDER BY Date) - 1 AS t,
               lag(y, 1) OVER (PARTITION BY Product_ID ORDER BY Date) AS y1,
               lag(y, 2) OVER (PARTITION BY Product_ID ORDER BY Date) AS y2 FROM f)
SELECT Product_ID, CAST(d AS INTEGER) AS d, Date, y,
       CASE WHEN d = 0 THEN y WHEN d = 1 THEN y - y1 ELSE y - 2 * y1 + y2 END AS w
FROM l, range(0, 3) r(d) WHERE t >= d""")
def q_arima_differenced(df):
    """Inputs of M6–M8: the zero-filled series (J1) differenced d = 0, 1, 2 times."""
    from ..forecast.series import daily_series, fill_calendar
    x = ar._differenced(fill_calendar(daily_series(df)), "Demand")
    return x.select(PRODUCT, F.col("d").cast("int").alias("d"), DATE, "y", "w")


@register("trend_chart_series", M1_FIT + """
SELECT Product_ID, Date, 'actual' AS kind, Demand AS value FROM daily
UNION ALL
SELECT Product_ID, Date, 'fitted' AS kind, round(exp(pl) - 1, 6) AS value FROM f
UNION ALL
SELECT Product_ID, CAST(last_date + INTERVAL (h) DAY AS DATE) AS Date, 'forecast' AS kind,
       round(exp(ybar + coalesce(slope, 0) * ((CAST(last_date - DATE '1970-01-01' AS BIGINT) + 719163 + h) - xbar)) - 1, 6)
         AS value
FROM c, range(1, 31) r(h)""")
def q_trend_chart_series(df):
    """U2 over M1: actual, fitted and forecast rows in one frame."""
    from ..forecast.series import daily_series
    fc = trend.trend_forecast(df, 30).select(PRODUCT, DATE, "kind", _r6("value"))
    return ev.chart_series(daily_series(df), fc)


# ------------------------------------------------------------------ certificates of M6 and M7 (oracle)
FILLED = f""", {DAILY}
, span AS (SELECT Product_ID, min(Date) AS a, max(Date) AS b FROM daily GROUP BY 1)
, cal AS (SELECT Product_ID, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS Date FROM span)
, f AS (SELECT c.Product_ID, c.Date, coalesce(d.Demand, 0.0) AS y, row_number() OVER (PARTITION BY c.Product_ID ORDER BY c.Date) - 1 AS t,
               count(*) OVER (PARTITION BY c.Product_ID) AS n
        FROM cal c LEFT JOIN daily d ON c.Product_ID = d.Product_ID AND c.Date = d.Date)"""


@register("adf_lag0", FILLED + """
, x AS (SELECT Product_ID, 'level' AS series, Date, y AS v FROM f
        UNION ALL SELECT Product_ID, 'difference', Date, y - lag(y) OVER (PARTITION BY Product_ID ORDER BY Date) FROM f)
, l AS (SELECT Product_ID, series, lag(v) OVER w AS x, v - lag(v) OVER w AS dy FROM (SELECT * FROM x WHERE v IS NOT NULL)
        WINDOW w AS (PARTITION BY Product_ID, series ORDER BY Date))
, s AS (SELECT Product_ID, series, regr_slope(dy, x) AS b, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy, regr_sxy(dy, x) AS sxy, regr_count(dy, x) AS n
        FROM l WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT Product_ID, series, round(b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 4) AS adf_statistic, CAST(n AS INTEGER) AS nobs FROM s""")
def q_adf_lag0(df):
    """M6 with no lagged differences: the statistic is that of a simple regression."""
    return ar.adf_test(df, max_lag=0).select(PRODUCT, "series", F.round("adf_statistic", 4).alias("adf_statistic"), "nobs")


@register("arma_candidates", FILLED + """
, m AS (SELECT *, 2 + least(greatest(floor(pow(ln(n), 2)), 6), greatest(floor((n - 1) / 3), 1)) + 3 AS first FROM f)
, l AS (SELECT *, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, lag(y, 3) OVER w AS y3 FROM m WINDOW w AS (PARTITION BY Product_ID ORDER BY t))
, d AS (SELECT Product_ID, d, CASE d WHEN 0 THEN y WHEN 1 THEN y - y1 ELSE y - 2 * y1 + y2 END AS w,
               CASE d WHEN 0 THEN y1 WHEN 1 THEN y1 - y2 ELSE y1 - 2 * y2 + y3 END AS w1
        FROM l, range(0, 3) r(d) WHERE t >= first)
, s AS (SELECT Product_ID, d, count(*) AS n, sum(w * w) AS ww, sum(w * w1) AS w01, sum(w1 * w1) AS w11,
               regr_syy(w, w1) AS syy, regr_sxy(w, w1) AS sxy, regr_sxx(w, w1) AS sxx FROM d GROUP BY 1, 2)
, c AS (SELECT Product_ID, d, 0 AS p, n, CASE WHEN d = 0 THEN syy ELSE ww END AS ssr FROM s
        UNION ALL SELECT Product_ID, d, 1, n, CASE WHEN d = 0 THEN syy - sxy * sxy / sxx ELSE ww - w01 * w01 / w11 END FROM s)
SELECT Product_ID, CAST(p AS INTEGER) AS p, CAST(d AS INTEGER) AS d, round(n * (ln(2 * pi() * ssr / n) + 1) + 2 * (p + 1 + CASE WHEN d = 0 THEN 1 ELSE 0 END), 4) AS aic
FROM c""")
def q_arma_candidates(df):
    """M7: AIC of the orders (0, d, 0) and (1, d, 0) on the sample that all d share."""
    from ..forecast.series import daily_series, fill_calendar
    c = ar.order_candidates(fill_calendar(daily_series(df)))
    return c.where((F.col("q") == 0) & (F.col("p") <= 1)).select(PRODUCT, "p", "d", F.round("aic", 4).alias("aic"))


# ------------------------------------------------------------------ certificates of M2, M3, M5, M14 (oracle)
@register("rolling_backtest_trend", f""", {DAILY}
, last AS (SELECT *, max(Date) OVER (PARTITION BY Product_ID) AS last FROM daily)
, fold AS (SELECT Product_ID, Date, Demand, k AS fold, CAST(last - INTERVAL (k * 30) DAY AS DATE) AS cutoff,
                  (CAST(Date - DATE '1970-01-01' AS BIGINT) + 719163) AS x FROM last, range(1, 4) r(k))
, q AS (SELECT *, quantile_cont(Demand, 0.99) OVER (PARTITION BY Product_ID, fold) AS qc FROM fold WHERE Date <= cutoff)
, c AS (SELECT Product_ID, fold, regr_slope(ln(1 + Demand), x) AS b, avg(ln(1 + Demand)) AS ym, avg(x) AS xm FROM q WHERE Demand < qc GROUP BY 1, 2)
, t AS (SELECT f.Product_ID, f.fold, Demand AS a, ln(1 + Demand) AS la, ym + coalesce(b, 0) * (x - xm) AS lf
        FROM fold f JOIN c ON f.Product_ID = c.Product_ID AND f.fold = c.fold
        WHERE Date > cutoff AND Date <= cutoff + INTERVAL 30 DAY)
, m AS (SELECT *, avg(la) OVER (PARTITION BY Product_ID, fold) AS lm FROM t)
SELECT Product_ID, CAST(fold AS INTEGER) AS fold, count(*) AS n, round(sqrt(avg((a - (exp(lf) - 1)) ^ 2)), 5) AS rmse,
       round(avg(abs((a - (exp(lf) - 1)) / a)) * 100, 5) AS mape,
       round(CASE WHEN sum((la - lm) ^ 2) > 0 THEN 1 - sum((la - lf) ^ 2) / sum((la - lm) ^ 2) END, 5) AS r2
FROM m GROUP BY 1, 2""")
def q_backtest_trend(df):
    """M14 for M1: out-of-sample metrics of the refitted trend per fold."""
    m = bt.rolling_backtest(df, 3, 30, ["trend"])
    return m.select(PRODUCT, "fold", "n", *[F.round(c, 5).alias(c) for c in ("rmse", "mape", "r2")])


def _entries(g, cols):
    """Upper triangle of a Gram matrix as rows (product, a, b, value)."""
    names = ["1", *cols]
    k = len(names)
    rows = F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.round(F.col("g")[i * k + j], 3).alias("value"))
                     for i in range(k) for j in range(i, k)])
    return g.select(PRODUCT, F.inline(rows))


def _entries_sql(cols, source):
    """The same sums in SQL; ``cols`` name the columns of ``source``."""
    names = ["1", *cols]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    return " UNION ALL ".join(f"SELECT Product_ID, '{a}' AS a, '{b}' AS b, round(sum(CAST({a} AS DOUBLE) * {b}), 3) AS value FROM {source} GROUP BY 1" for a, b in pairs)


from ..forecast.gram import gram  # noqa: E402

_RIDGE_COLS = ["z", "z2", "z3", "z4", "y"]
_FULL = RIDGE_DESIGN_SQL.replace("round(e, 6) AS smoothed", "e AS y").replace("round((x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 6) AS z", "(x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END AS z")


@register("poly_ridge_gram", f"SELECT * FROM (WITH x AS ({_FULL}), d AS (SELECT Product_ID, y, z, z * z AS z2, z * z * z AS z3, z * z * z * z AS z4 FROM x) "
          + _entries_sql(_RIDGE_COLS, "d") + ")", raw_oracle=True)
def q_ridge_gram(df):
    """Sums that M2 is solved from: powers of the standardised day and the smoothed demand."""
    z = F.col("z")
    d = rg._prepared(df).select(PRODUCT, z, (z * z).alias("z2"), (z * z * z).alias("z3"), (z * z * z * z).alias("z4"), F.col("smoothed").alias("y"))
    return _entries(gram(d, [PRODUCT], _RIDGE_COLS), _RIDGE_COLS)


_REC_COLS = ["dow", "month", "weekend", "lag1", "lag7", "mean7", "ly"]


@register("recursive_linear_gram", None, raw_oracle=True)
def q_recursive_gram(df):
    """Sums that M3 is solved from."""
    from ..forecast.series import daily_series
    d = rc.smoothed_features(daily_series(df), 0.95, with_x=False)
    return _entries(gram(d, [PRODUCT], _REC_COLS), _REC_COLS)


ORACLES["recursive_linear_gram"] = "SELECT * FROM (WITH d AS (" + re.sub(r"round\(([a-z0-9()+ ]+), 6\)", r"\1", ORACLES["recursive_features"]) + ") " + _entries_sql(_REC_COLS, "d") + ")"


_LAGS = (1, 2, 7, 14, 30)


@register("lookback_gram", None, raw_oracle=True)
def q_lookback_gram(df):
    """Sums over M5's windows: the target with some of its 30 look-back values, all products together."""
    from ..forecast.series import lookback_windows
    d = lookback_windows(pl._lookback_frame(df), "scaled", 30, out="look")
    return d.agg(F.count("*").alias("n"), *[F.round(F.sum(F.col("scaled") * F.element_at("look", -k)), 3).alias(f"lag{k}") for k in _LAGS])


ORACLES["lookback_gram"] = ("SELECT count(*) AS n, " + ", ".join(f"round(sum(s * l{k}), 3) AS lag{k}" for k in _LAGS) + " FROM (SELECT s, "
                            + ", ".join(f"lag(s, {k}) OVER w AS l{k}" for k in _LAGS) + " FROM (SELECT Product_ID, Date, scaled AS s FROM ("
                            + re.sub(r"round\(CASE WHEN (.*?) END, 6\) AS scaled", r"CASE WHEN \1 END AS scaled", ORACLES["lookback_design"]) + "))"
                            " WINDOW w AS (PARTITION BY Product_ID ORDER BY Date)) WHERE l30 IS NOT NULL")


@register("trend_status", M1_FIT + """
, r AS (SELECT f.Product_ID, count(*) + 30 AS rows FROM f GROUP BY 1)
SELECT p.Product_ID, coalesce(rows, 0) AS rows, CASE WHEN rows > 0 THEN 'ok' ELSE 'no_forecast' END AS status
FROM (SELECT DISTINCT Product_ID FROM demand) p LEFT JOIN r ON p.Product_ID = r.Product_ID""")
def q_trend_status(df):
    """A row per input product: whether M1 has a forecast for it."""
    return ev.status_rows(df, trend.trend_forecast(df, 30))
