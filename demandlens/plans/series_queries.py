"""Registered daily-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..forecast import series as S
from ..sources.demand import DATE, DEMAND, DEMAND_VIEW_SQL, PRODUCT
from .registry import register

DAILY = "daily AS (SELECT Product_ID, Date, CAST(SUM(Demand) AS DOUBLE) AS Demand FROM demand GROUP BY 1, 2)"
FEATS = ("feats AS (SELECT Product_ID, Date, CAST(SUM(Demand) AS DOUBLE) AS Demand, "
         "CAST(max(Public_Holiday) AS INTEGER) AS Public_Holiday, "
         + ", ".join(f"CAST(SUM({c}) AS DOUBLE) / COUNT({c}) AS {c}" for c in S.REGRESSORS)
         + " FROM demand GROUP BY 1, 2)")
R6 = "round({x}, 6)"


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


@register("daily_features", f", {FEATS} SELECT Product_ID, Date, Demand, Public_Holiday, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in S.REGRESSORS) + " FROM feats")
def q_daily_features(df):
    """A36."""
    d = S.daily_features(df)
    return d.select(PRODUCT, DATE, DEMAND, "Public_Holiday", *[_r6(c) for c in S.REGRESSORS])


@register("last_30_mean", f""", {FEATS}
, t AS (SELECT *, row_number() OVER (PARTITION BY Product_ID ORDER BY Date DESC) AS rn FROM feats)
SELECT Product_ID, {', '.join(f'round(avg({c}), 6) AS {c}' for c in S.REGRESSORS)} FROM t WHERE rn <= 30
GROUP BY Product_ID""")
def q_last_30_mean(df):
    """A37 on the daily features."""
    m = S.last_n_mean(S.daily_features(df), S.REGRESSORS, 30)
    return m.select(PRODUCT, *[_r6(c) for c in S.REGRESSORS])


@register("fill_calendar", f""", {DAILY}
, span AS (SELECT Product_ID, min(Date) AS a, max(Date) AS b FROM daily GROUP BY 1)
, cal AS (SELECT Product_ID, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS Date FROM span)
SELECT c.Product_ID, c.Date, coalesce(d.Demand, 0.0) AS Demand
FROM cal c LEFT JOIN daily d ON c.Product_ID = d.Product_ID AND c.Date = d.Date""")
def q_fill_calendar(df):
    """J1."""
    return S.fill_calendar(S.daily_series(df))


@register("holiday_window", f""", {FEATS}
, h AS (SELECT DISTINCT Date FROM feats WHERE Public_Holiday = 1)
, o AS (SELECT CAST(h.Date + INTERVAL (k) DAY AS DATE) AS Date, k FROM h, range(-1, 2) t(k))
, f AS (SELECT Date, max(CASE WHEN k = -1 THEN 1 ELSE 0 END) AS hol_m1, max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS hol_0,
               max(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS hol_p1 FROM o GROUP BY Date)
SELECT x.Product_ID, x.Date, x.Public_Holiday, coalesce(f.hol_m1, 0) AS hol_m1, coalesce(f.hol_0, 0) AS hol_0,
       coalesce(f.hol_p1, 0) AS hol_p1
FROM feats x LEFT JOIN f ON x.Date = f.Date""")
def q_holiday_window(df):
    """J4 over the daily features."""
    h = S.holiday_window(S.daily_features(df))
    return h.select(PRODUCT, DATE, "Public_Holiday", *[F.col(c).cast("int").alias(c) for c in
                                                      ("hol_m1", "hol_0", "hol_p1")])


_W = "OVER (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
_O = "OVER (PARTITION BY Product_ID ORDER BY Date)"


@register("series_windows", f""", {DAILY}
SELECT Product_ID, Date, Demand, round(avg(Demand) {_W}, 6) AS ma7,
       round(CASE WHEN count(Demand) {_W} = 7 THEN avg(Demand) {_W} END, 6) AS ma7_strict,
       lag(Demand, 1) {_O} AS lag1, lag(Demand, 7) {_O} AS lag7, Demand - lag(Demand, 1) {_O} AS diff
FROM daily""")
def q_series_windows(df):
    """W1, W2, W3, W4 on the per-product daily series."""
    d = S.daily_series(df)
    return d.select(PRODUCT, DATE, DEMAND, F.round(S.moving_avg(DEMAND, 7), 6).alias("ma7"),
                    F.round(S.moving_avg(DEMAND, 7, strict=True), 6).alias("ma7_strict"),
                    S.lag_k(DEMAND, 1).alias("lag1"), S.lag_k(DEMAND, 7).alias("lag7"),
                    S.difference(DEMAND).alias("diff"))


_A, _R = 2.0 / 6.0, 1.0 - 2.0 / 6.0
EWMA_SQL = f"""WITH RECURSIVE demand AS ({DEMAND_VIEW_SQL}), {DAILY}
, n AS (SELECT *, row_number() OVER (PARTITION BY Product_ID ORDER BY Date) AS rn FROM daily)
, rec AS (SELECT Product_ID, Date, Demand, rn, Demand AS e FROM n WHERE rn = 1
          UNION ALL
          SELECT n.Product_ID, n.Date, n.Demand, n.rn, {_A!r} * n.Demand + {_R!r} * rec.e
          FROM rec JOIN n ON n.Product_ID = rec.Product_ID AND n.rn = rec.rn + 1)
SELECT Product_ID, Date, Demand, round(e, 6) AS ewma FROM rec"""


@register("ewma_span5", EWMA_SQL, raw_oracle=True)
def q_ewma(df):
    """Exponentially weighted mean, span 5, adjust=False."""
    e = S.ewma(S.daily_series(df), DEMAND, 5.0)
    return e.select(PRODUCT, DATE, DEMAND, F.round("ewma", 6).alias("ewma"))


@register("lookback_windows_30", f""", {DAILY}
, w AS (SELECT Product_ID, Date, Demand,
               list(Demand) OVER (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
                 AS lookback FROM daily)
SELECT * FROM w WHERE len(lookback) = 30""")
def q_lookback(df):
    """W6."""
    return S.lookback_windows(S.daily_series(df), DEMAND, 30, out="lookback")


@register("decompose_additive", f""", {DAILY}
, span AS (SELECT Product_ID, min(Date) AS a, max(Date) AS b FROM daily GROUP BY 1)
, cal AS (SELECT Product_ID, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS Date FROM span)
, f AS (SELECT c.Product_ID, c.Date, coalesce(d.Demand, 0.0) AS Demand
        FROM cal c LEFT JOIN daily d ON c.Product_ID = d.Product_ID AND c.Date = d.Date)
, x AS (SELECT *, CAST((row_number() OVER (PARTITION BY Product_ID ORDER BY Date) - 1) % 7 AS INTEGER) AS phase,
          CASE WHEN count(Demand) OVER (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7
               THEN avg(Demand) OVER (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
          END AS trend FROM f)
, ph AS (SELECT Product_ID, phase, avg(Demand - trend) AS pm FROM x GROUP BY 1, 2)
, s AS (SELECT Product_ID, phase, pm - avg(pm) OVER (PARTITION BY Product_ID) AS seasonal FROM ph)
SELECT x.Product_ID, x.Date, x.Demand, x.phase, round(x.trend, 6) AS trend, round(s.seasonal, 6) AS seasonal,
       round(x.Demand - x.trend - s.seasonal, 6) AS residual
FROM x JOIN s ON x.Product_ID = s.Product_ID AND x.phase = s.phase""")
def q_decompose(df):
    """W7 over the calendar-filled series."""
    d = S.decompose_additive(S.fill_calendar(S.daily_series(df)))
    return d.select(PRODUCT, DATE, DEMAND, "phase", _r6("trend"), _r6("seasonal"), _r6("residual"))


@register("tail_7", f""", {DAILY}
SELECT Product_ID, Date, Demand FROM
  (SELECT *, row_number() OVER (PARTITION BY Product_ID ORDER BY Date DESC) AS rn FROM daily) WHERE rn <= 7""")
def q_tail7(df):
    """Last 7 days of every series."""
    return S.tail_n(S.daily_series(df), 7)


@register("minmax_scale", f""", {DAILY}
, m AS (SELECT *, min(Demand) OVER (PARTITION BY Product_ID) AS mn, max(Demand) OVER (PARTITION BY Product_ID) AS mx
        FROM daily)
SELECT Product_ID, Date, Demand, round(CASE WHEN mx > mn THEN (Demand - mn) / (mx - mn) ELSE 0.0 END, 6) AS scaled,
       round(CASE WHEN mx > mn THEN ((Demand - mn) / (mx - mn)) * (mx - mn) + mn ELSE mn END, 6) AS restored
FROM m""")
def q_minmax(df):
    """W12 and its inverse."""
    d = S.minmax_scale(S.daily_series(df), DEMAND)
    return d.select(PRODUCT, DATE, DEMAND, _r6("scaled"),
                    F.round(S.minmax_inverse(F.col("scaled"), F.col("_mn"), F.col("_mx")), 6).alias("restored"))


@register("standardise", f""", {DAILY}
, m AS (SELECT *, avg(Demand) OVER (PARTITION BY Product_ID) AS mu, stddev_pop(Demand) OVER (PARTITION BY Product_ID) AS sd
        FROM daily)
SELECT Product_ID, Date, Demand, round((Demand - mu) / CASE WHEN sd > 0 THEN sd ELSE 1.0 END, 6) AS z FROM m""")
def q_standardise(df):
    """W13."""
    d = S.standardise(S.daily_series(df), DEMAND)
    return d.select(PRODUCT, DATE, DEMAND, _r6("z"))


@register("daily_features_stored", f", {FEATS} SELECT Product_ID, Date, Demand, Public_Holiday, "
          + ", ".join(f"round({c}, 6) AS {c}" for c in S.REGRESSORS) + " FROM feats")
def q_daily_features_stored(df):
    """A36 from the stored roll-up."""
    from ..operators.analytics import stored
    from ..sources.rollup import DailyRollup
    d = stored.daily_features(DailyRollup.build(df).load())
    return d.select(PRODUCT, DATE, DEMAND, "Public_Holiday", *[_r6(c) for c in S.REGRESSORS])
