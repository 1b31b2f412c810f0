"""Oracle SQL of the regression models (M2, M3, M5, M9): design, Gram sums, solve, forecast and metrics, all in DuckDB."""

from __future__ import annotations

import math

from ..sources.demand import DEMAND_VIEW_SQL
from .solve_sql import dot, eliminate, gram_rows, solution, sparse

HEAD = f"""WITH RECURSIVE demand AS ({DEMAND_VIEW_SQL})
, daily AS (SELECT Product_ID, Date, CAST(SUM(Demand) AS DOUBLE) AS Demand FROM demand GROUP BY 1, 2)"""
ORDINAL = "(CAST({d} - DATE '1970-01-01' AS BIGINT) + 719163)"
_SMOOTH = """CASE WHEN count({v}) OVER w7 = 7 THEN avg({v}) OVER w7 END"""
_W7 = "WINDOW w7 AS (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


def missing(known: str, needed: int, columns: str, key: str = "Product_ID", days: str = "daily", value: str = "Demand") -> str:
    """Rows of the products of ``days`` that ``known`` lacks, with the reason."""
    return f"""SELECT Product_ID, {columns}, CASE WHEN count(*) < {needed} THEN 'too_short' WHEN min({value}) = max({value}) THEN 'constant' ELSE 'no_clean_days' END AS status
FROM {days} WHERE Product_ID NOT IN (SELECT {key} FROM {known}) GROUP BY Product_ID"""


NO_ROWS = "NULL AS Date, 'none' AS kind, NULL AS value"

# ------------------------------------------------------------------ M2
_A5 = 2.0 / 6.0
_ALPHAS = [0.1, 1.0, 5.0, 10.0, 25.0, 50.0]
RIDGE = HEAD + f"""
, rn AS (SELECT *, row_number() OVER (PARTITION BY Product_ID ORDER BY Date) AS nr, {ORDINAL.format(d='Date')} AS ord FROM daily)
, rec AS (SELECT Product_ID, Date, nr, ord, Demand AS e FROM rn WHERE nr = 1
          UNION ALL
          SELECT rn.Product_ID, rn.Date, rn.nr, rn.ord, {_A5!r} * rn.Demand + {1 - _A5!r} * rec.e FROM rec JOIN rn ON rn.Product_ID = rec.Product_ID AND rn.nr = rec.nr + 1)
, ms AS (SELECT Product_ID, avg(ord) AS mu, CASE WHEN stddev_pop(ord) > 0 THEN stddev_pop(ord) ELSE 1.0 END AS sd, max(Date) AS last_date FROM rec GROUP BY 1)
, z AS (SELECT rec.Product_ID, Date, e, (ord - mu) / sd AS z FROM rec JOIN ms USING (Product_ID))
, rx AS (SELECT Product_ID, Date, [1.0, z, pow(z, 2), pow(z, 3), pow(z, 4), e] AS x FROM z)
, {gram_rows('rg', 'rx', 6)}
, ra AS (SELECT k || '|' || nr AS k, i, j, v + CASE WHEN i = j AND i BETWEEN 1 AND 4 THEN alpha ELSE 0 END AS v
         FROM rg, (SELECT unnest({_ALPHAS}) AS alpha, unnest(range({len(_ALPHAS)})) AS nr))
, {eliminate('rs', 'ra', 5)}
, {solution('rb', 'rs', 5, 5)}
, rl AS (SELECT k, list(list_row ORDER BY i) AS g FROM (SELECT k, i, list(v ORDER BY j) AS list_row FROM rg GROUP BY k, i) GROUP BY k)
, rc AS (SELECT split_part(rb.k, '|', 1) AS k, CAST(split_part(rb.k, '|', 2) AS INTEGER) AS nr, b, g,
                list_sum(list_transform(range(1, 6), lambda i: b[i] * list_dot_product(g[i][1:5], b))) AS bab
         FROM rb JOIN rl ON split_part(rb.k, '|', 1) = rl.k)
, rq AS (SELECT k, nr, b, sqrt(greatest(g[6][6] - 2 * list_dot_product(g[6][1:5], b) + bab, 0) / g[1][1]) / (g[1][6] / g[1][1]) * 100 AS score FROM rc)
, best AS (SELECT k, b, {_ALPHAS}[nr + 1] AS alpha FROM rq QUALIFY row_number() OVER (PARTITION BY k ORDER BY score, nr) = 1)
, fit AS (SELECT Product_ID, Date, x[6] AS actual, list_dot_product(x[1:5], b) AS fitted, alpha FROM rx JOIN best ON Product_ID = k)"""
RIDGE_FORECAST = RIDGE + f"""
SELECT Product_ID, Date, 'fitted' AS kind, round(fitted, 4) AS value, 'ok' AS status FROM fit
UNION ALL
SELECT Product_ID, CAST(last_date + INTERVAL (h) DAY AS DATE), 'forecast', round(b[1] + b[2] * z + b[3] * pow(z, 2) + b[4] * pow(z, 3) + b[5] * pow(z, 4), 4), 'ok'
FROM (SELECT ms.*, b, h, ({ORDINAL.format(d='last_date')} + h - mu) / sd AS z FROM ms JOIN best ON Product_ID = k, range(1, 31) r(h))"""

# ------------------------------------------------------------------ M3
_FEATURES = ["x", "dow", "month", "weekend", "lag1", "lag7", "mean7"]
RECURSIVE = HEAD + f"""
, t AS (SELECT *, quantile_cont(Demand, 0.95) OVER (PARTITION BY Product_ID) AS qc FROM daily)
, a AS (SELECT * FROM t WHERE Demand < qc)
, s AS (SELECT *, {_SMOOTH.format(v='Demand')} AS smoothed FROM a {_W7})
, c AS (SELECT Product_ID, Date, smoothed, lag(smoothed, 1) OVER (PARTITION BY Product_ID ORDER BY Date) AS lag1, lag(smoothed, 7) OVER (PARTITION BY Product_ID ORDER BY Date) AS lag7,
               {_SMOOTH.format(v='smoothed')} AS mean7 FROM s WHERE smoothed IS NOT NULL {_W7})
, d AS (SELECT Product_ID, Date, smoothed, ({ORDINAL.format(d='Date')} - 730000)::DOUBLE AS x, CAST(isodow(Date) - 1 AS DOUBLE) AS dow, CAST(month(Date) AS DOUBLE) AS month,
               CAST(isodow(Date) >= 6 AS DOUBLE) AS weekend, lag1, lag7, mean7, ln(1 + smoothed) AS ly
        FROM c WHERE lag1 IS NOT NULL AND lag7 IS NOT NULL AND mean7 IS NOT NULL)
, rx AS (SELECT Product_ID, Date, smoothed, [1.0, {', '.join(_FEATURES)}, ly] AS x, count(*) OVER (PARTITION BY Product_ID) AS n FROM d QUALIFY n > 7)
, {gram_rows('rg', 'rx', 9)}
, {eliminate('rs', 'rg', 8)}
, {solution('rb', 'rs', 8, 8)}
, fit AS (SELECT Product_ID, Date, smoothed AS actual, x[9] AS ly, list_dot_product(x[1:8], b) AS pl FROM rx JOIN rb ON Product_ID = k)
, tail AS (SELECT Product_ID, max(Date) AS last_date, list(smoothed ORDER BY Date) AS hist FROM (
             SELECT * FROM rx QUALIFY row_number() OVER (PARTITION BY Product_ID ORDER BY Date DESC) <= 7) GROUP BY 1)
, fut AS (SELECT Product_ID, last_date, b, hist, 0 AS h, NULL::DOUBLE AS p FROM tail JOIN rb ON Product_ID = k
          UNION ALL
          SELECT Product_ID, last_date, b, CASE WHEN len(hist) >= 7 THEN list_append(hist[2:], q) ELSE list_append(hist, q) END, h, q
          FROM (SELECT Product_ID, last_date, b, hist, h + 1 AS h, exp(list_dot_product(b, [1.0, ({ORDINAL.format(d='last_date')} + h + 1 - 730000)::DOUBLE,
                       CAST(isodow(last_date + INTERVAL (h + 1) DAY) - 1 AS DOUBLE), CAST(month(last_date + INTERVAL (h + 1) DAY) AS DOUBLE),
                       CAST(isodow(last_date + INTERVAL (h + 1) DAY) >= 6 AS DOUBLE), hist[-1], CASE WHEN len(hist) >= 7 THEN hist[1] ELSE hist[-1] END, list_avg(hist)])) - 1 AS q
                FROM fut WHERE h < 30))"""
RECURSIVE_FORECAST = RECURSIVE + f"""
SELECT Product_ID, Date, 'fitted' AS kind, round(exp(pl) - 1, 4) AS value, 'ok' AS status FROM fit
UNION ALL
SELECT Product_ID, CAST(last_date + INTERVAL (h) DAY AS DATE), 'forecast', round(p, 4), 'ok' FROM fut WHERE h > 0
UNION ALL
{missing('tail', 21, NO_ROWS)}"""

# ------------------------------------------------------------------ M5
LOOKBACK = HEAD + f"""
, a AS (SELECT *, {_SMOOTH.format(v='Demand')} AS smoothed FROM daily {_W7})
, mm AS (SELECT Product_ID, Date, smoothed, min(smoothed) OVER (PARTITION BY Product_ID) AS mn, max(smoothed) OVER (PARTITION BY Product_ID) AS mx FROM a WHERE smoothed IS NOT NULL)
, sc AS (SELECT *, CASE WHEN mx > mn THEN (smoothed - mn) / (mx - mn) ELSE 0.0 END AS s FROM mm)
, lb AS (SELECT *, list(s) OVER (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS back FROM sc)
, rx AS (SELECT 'all' AS one, Product_ID, Date, mn, mx, s, list_concat([1.0], list_append(back, s)) AS x FROM lb WHERE len(back) = 30)
, {gram_rows('rg', 'rx', 32, 'one')}
, {eliminate('rs', 'rg', 31)}
, {solution('rb', 'rs', 31, 31)}
, fit AS (SELECT Product_ID, Date, mn, mx, s, list_dot_product(x[1:31], b) AS p FROM rx, rb)
, tail AS (SELECT Product_ID, max(Date) AS last_date, max(mn) AS mn, max(mx) AS mx, list(s ORDER BY Date) AS hist FROM (
             SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY Product_ID ORDER BY Date DESC) <= 30) GROUP BY 1 HAVING count(*) = 30)
, fut AS (SELECT Product_ID, last_date, mn, mx, b, hist, 0 AS h, NULL::DOUBLE AS p FROM tail, rb
          UNION ALL
          SELECT Product_ID, last_date, mn, mx, b, list_append(hist[2:], q), h, q
          FROM (SELECT Product_ID, last_date, mn, mx, b, hist, h + 1 AS h, b[1] + list_dot_product(b[2:31], hist) AS q FROM fut WHERE h < 30))
, known AS (SELECT Product_ID FROM fit UNION SELECT Product_ID FROM tail)"""
_INVERSE = "CASE WHEN mx > mn THEN {v} * (mx - mn) + mn ELSE mn END"
LOOKBACK_FORECAST = LOOKBACK + f"""
SELECT Product_ID, Date, 'fitted' AS kind, round({_INVERSE.format(v='p')}, 4) AS value, 'ok' AS status FROM fit
UNION ALL
SELECT Product_ID, CAST(last_date + INTERVAL (h) DAY AS DATE), 'forecast', round({_INVERSE.format(v='p')}, 4), 'ok' FROM fut WHERE h > 0
UNION ALL
{missing('known', 36, NO_ROWS)}"""

# ------------------------------------------------------------------ M9
_REGRESSORS = ["Marketing_Effect", "Price", "Discount", "Stock_Availability"]
_SEASONS = [("yearly", 365.25, 10), ("weekly", 7.0, 3), ("monthly", 30.5, 3), ("quarterly", 365.25 / 4, 2)]
_N_CP = 15
_DAYS = "CAST({d} - DATE '1970-01-01' AS DOUBLE)"


def _waves(day: str) -> list[str]:
    out = []
    for _, period, order in _SEASONS:
        for k in range(1, order + 1):
            out += [f"{fn}({2 * math.pi * k / period!r} * {_DAYS.format(d=day)})" for fn in ("sin", "cos")]
    return out


def _design(day: str, t: str, regressors: list[str]) -> str:
    """The list [1, t, waves, holidays, regressors, hinges] of a day; scaling columns and flags are in the row."""
    scaled = [f"CASE WHEN sd[{j}] > 0 THEN ({c} - mu[{j}]) / sd[{j}] ELSE 0.0 END" for j, c in enumerate(regressors, 1)]
    hinges = [f"coalesce(greatest({t} - cp[{j}], 0.0), 0.0)" for j in range(1, _N_CP + 1)]
    return ", ".join(["1.0", t, *_waves(day), *[f"coalesce({h}, 0)::DOUBLE" for h in ("hm", "h0", "hp")], *scaled, *hinges])


_N_WAVES = 2 * sum(o for _, _, o in _SEASONS)
_FREE = 2 + _N_WAVES + 3 + len(_REGRESSORS)
_ALL = _FREE + _N_CP


def _parts(x: str, b: str) -> dict[str, str]:
    """Each component as a sum over its columns."""
    out = {"trend": f"({dot(x, b, 1, 2)} + {dot(x, b, _FREE + 1, _ALL)})"}
    at = 3
    for name, _, order in _SEASONS:
        out[name] = dot(x, b, at, at + 2 * order - 1)
        at += 2 * order
    out["holidays"] = dot(x, b, at, at + 2)
    out["regressors"] = dot(x, b, at + 3, at + 2 + len(_REGRESSORS))
    return out


def seasonal_scale(clean: str) -> str:
    """CTEs from ``clean`` (product, ds, regressors; its days are counted from 0 in rn, n) to ``scale`` and, from all features,
    to the holiday ``flags``."""
    spots = ", ".join(f"CAST(round((floor(n * 0.8) - 1) * {j} / {_N_CP}) AS INTEGER)" for j in range(1, _N_CP + 1))
    return f"""
, scale0 AS (SELECT Product_ID, min(ds) AS first_day, max(ds) AS last_day, list(ds ORDER BY ds) FILTER (WHERE list_contains([{spots}], rn)) AS cps,
                    [{', '.join(f'avg({c})' for c in _REGRESSORS)}] AS mu, [{', '.join(f'coalesce(stddev_samp({c}), 0)' for c in _REGRESSORS)}] AS sd FROM {clean} GROUP BY 1)
, scale AS (SELECT Product_ID, first_day, last_day, mu, sd, span, list_transform(cps, lambda d: CAST(d - first_day AS DOUBLE) / span) AS cp
            FROM (SELECT *, greatest(last_day - first_day, 1)::DOUBLE AS span FROM scale0))
, days AS (SELECT DISTINCT Date AS ds FROM feats WHERE h = 1)
, flags AS (SELECT CAST(ds + INTERVAL (o) DAY AS DATE) AS ds, max(CASE WHEN o = -1 THEN 1 ELSE 0 END) AS hm, max(CASE WHEN o = 0 THEN 1 ELSE 0 END) AS h0, max(CASE WHEN o = 1 THEN 1 ELSE 0 END) AS hp
            FROM days, (SELECT unnest([-1, 0, 1]) AS o) GROUP BY 1)"""


def seasonal_solve(train: str, key: str) -> str:
    """CTEs from ``train`` (its key, design list x, log demand last) to ``beta`` (k, b, d, n, w, sigma)."""
    return f"""
, {gram_rows('gm', train, _ALL + 1, key)}
, gp AS (SELECT k, i, j, v + CASE WHEN i = j AND i BETWEEN 2 AND {_FREE - 1} THEN 100.0 ELSE 0.0 END AS v FROM gm)
, {eliminate('ge', 'gp', _FREE)}
, counts AS (SELECT {key} AS k, count(*) AS n FROM {train} GROUP BY 1)
, lam AS (SELECT k, n, greatest(v, 0) / greatest(n - 1, 1) / 0.01 AS w FROM ge JOIN counts USING (k) WHERE i = {_ALL} AND j = {_ALL})
, rows_s AS (SELECT k, i, list(v ORDER BY j) AS r FROM ge WHERE i BETWEEN {_FREE} AND {_ALL - 1} AND j BETWEEN {_FREE} AND {_ALL - 1} GROUP BY k, i)
, prob AS (SELECT k, s, c, w FROM (SELECT k, list(r ORDER BY i) AS s FROM rows_s GROUP BY k)
           JOIN (SELECT k, list(v ORDER BY i) AS c FROM ge WHERE i BETWEEN {_FREE} AND {_ALL - 1} AND j = {_ALL} GROUP BY k) USING (k) JOIN lam USING (k))
, {sparse('hinge', 'prob', _N_CP)}
, free AS (SELECT k, list(v ORDER BY i) AS b FROM (
             SELECT ge.k, i, sum(CASE WHEN j = {_ALL} THEN v ELSE -v * d[j - {_FREE - 1}] END) AS v FROM ge JOIN hinge USING (k) WHERE i < {_FREE} AND j >= {_FREE} GROUP BY ge.k, i) GROUP BY k)
, both_b AS (SELECT k, list_concat(b, d) AS b, d, n, w FROM free JOIN hinge USING (k) JOIN lam USING (k))
, sse AS (SELECT k, greatest(sum(v * CASE WHEN i = {_ALL} THEN -1 ELSE b[i + 1] END * CASE WHEN j = {_ALL} THEN -1 ELSE b[j + 1] END), 0) AS sse FROM gm JOIN both_b USING (k) GROUP BY k)
, beta AS (SELECT k, b, d, n, w, sqrt(sse / greatest(n - 1, 1)) AS sigma FROM both_b JOIN sse USING (k))"""


FEATS = HEAD + f"""
, feats AS (SELECT Product_ID, Date, CAST(SUM(Demand) AS DOUBLE) AS y, CAST(max(Public_Holiday) AS INTEGER) AS h,
                   {', '.join(f'CAST(SUM({c}) AS DOUBLE) / COUNT({c}) AS {c}' for c in _REGRESSORS)} FROM demand GROUP BY 1, 2)
, pos AS (SELECT *, quantile_cont(y, 0.25) OVER (PARTITION BY Product_ID) AS q1, quantile_cont(y, 0.75) OVER (PARTITION BY Product_ID) AS q3
          FROM feats WHERE y > 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in _REGRESSORS)})
, kept AS (SELECT *, count(*) OVER (PARTITION BY Product_ID) AS n, row_number() OVER (PARTITION BY Product_ID ORDER BY Date) - 1 AS rn
           FROM pos WHERE y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1))
, clean AS (SELECT Product_ID, Date AS ds, y, {', '.join(_REGRESSORS)}, n, rn FROM kept WHERE n >= 30)"""
SEASONAL = FEATS + seasonal_scale("clean") + f"""
, train AS (SELECT Product_ID, ds, y, [{_design('ds', 'CAST(ds - first_day AS DOUBLE) / span', _REGRESSORS)}, ln(y)] AS x
            FROM clean JOIN scale USING (Product_ID) LEFT JOIN flags USING (ds))""" + seasonal_solve("train", "Product_ID") + f"""
, fit AS (SELECT Product_ID, ds, y, x, b, sigma, list_dot_product(x[1:{_ALL}], b) AS ly FROM train JOIN beta ON Product_ID = k)"""

_U = "(('0x' || substr({m}, {at}, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
_P = _parts("x", "b")
_OUT = ", ".join(f"round({v}, 3) AS {n}" for n, v in _P.items())
SEASONAL_FORECAST = SEASONAL + f"""
, last AS (SELECT Product_ID, [{', '.join(f'avg({c})' for c in _REGRESSORS)}] AS means FROM (
             SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY Product_ID ORDER BY ds DESC) <= 30) GROUP BY 1)
, ahead AS (SELECT Product_ID, step, CAST(last_day + INTERVAL (step) DAY AS DATE) AS ds, first_day, span, mu, sd, cp, means FROM scale JOIN last USING (Product_ID), range(1, 31) r(step))
, fut AS (SELECT Product_ID, step, ds, span, b, d, sigma, x, list_dot_product(x, b) AS ly
          FROM (SELECT a.Product_ID, step, ds, span, [{_design('ds', 'CAST(ds - first_day AS DOUBLE) / span', [f'means[{j}]' for j in range(1, len(_REGRESSORS) + 1)])}] AS x
                FROM ahead a LEFT JOIN flags USING (ds)) f JOIN beta ON Product_ID = k)
, draws AS (SELECT Product_ID, step, s, span, sigma, ly, list_sum(list_transform(d, lambda v: abs(v))) / {_N_CP} AS change,
                   md5('42|change|' || Product_ID || '|' || s || '|' || step) AS mc, md5('42|noise|' || Product_ID || '|' || s || '|' || step) AS mn FROM fut, range(1, 501) r(s))
, jumps AS (SELECT *, CASE WHEN {_U.format(m='mc', at=1)} < least({float(_N_CP)!r} / span, 1.0)
                           THEN -change * sign({_U.format(m='mc', at=14)} - 0.5) * ln(1 - 2 * abs({_U.format(m='mc', at=14)} - 0.5)) ELSE 0.0 END AS jump,
                   sqrt(-2 * ln({_U.format(m='mn', at=1)})) * cos({2 * math.pi!r} * ({_U.format(m='mn', at=14)})) AS noise FROM draws)
, paths AS (SELECT Product_ID, step, ly + (step * sum(jump) OVER w - sum(step * jump) OVER w) / span + sigma * noise AS path FROM jumps
            WINDOW w AS (PARTITION BY Product_ID, s ORDER BY step ROWS UNBOUNDED PRECEDING))
, band AS (SELECT Product_ID, step, quantile_cont(path, 0.1) AS low, quantile_cont(path, 0.9) AS high FROM paths GROUP BY 1, 2)
SELECT Product_ID, ds AS Date, 'fitted' AS kind, round(exp(ly + 0.5 * sigma * sigma), 3) AS value, round(exp(ly - 1.2815515655446004 * sigma), 3) AS yhat_lower,
       round(exp(ly + 1.2815515655446004 * sigma), 3) AS yhat_upper, {_OUT}, 'ok' AS status FROM fit
UNION ALL
SELECT Product_ID, ds, 'forecast', round(exp(ly + 0.5 * sigma * sigma), 3), round(exp(low), 3), round(exp(high), 3), {_OUT}, 'ok' FROM fut JOIN band USING (Product_ID, step)
UNION ALL
{missing('beta', 30, NO_ROWS + ', ' + ', '.join(['NULL'] * (2 + len(_P))), 'k', 'feats', 'y')}"""

#: Slopes of the smooth part of the objective at the solution, from the Gram sums: 0 in free columns, within the weight in hinges.
SEASONAL_OPTIMALITY = SEASONAL + f"""
, slopes AS (SELECT gm.k, i, sum(CASE WHEN j = {_ALL} THEN v ELSE -v * b[j + 1] END) - CASE WHEN i BETWEEN 2 AND {_FREE - 1} THEN 100.0 * any_value(b)[i + 1] ELSE 0 END AS slope
             FROM gm JOIN both_b USING (k) WHERE i < {_ALL} GROUP BY gm.k, i)
SELECT k AS Product_ID, CAST(any_value(n) AS BIGINT) AS n, round(any_value(w), 4) AS weight, CAST(len(list_filter(any_value(d), lambda v: v <> 0)) AS INTEGER) AS slope_changes,
       round(list_sum(list_transform(any_value(d), lambda v: abs(v))), 4) AS total_change, max(CASE WHEN i < {_FREE} THEN abs(slope) ELSE 0 END) < 1e-5 AS free_at_rest,
       bool_and(CASE WHEN i < {_FREE} THEN true WHEN d[i - {_FREE - 1}] = 0 THEN abs(slope) <= w + 1e-5 ELSE abs(slope - w * sign(d[i - {_FREE - 1}])) < 1e-5 END) AS hinges_at_rest
FROM slopes JOIN both_b USING (k) GROUP BY k"""

# ------------------------------------------------------------------ metrics
PAIRS = {
    "poly_ridge": RIDGE + ", pairs AS (SELECT Product_ID, actual, fitted, actual AS ry, fitted AS rf, alpha FROM fit)",
    "recursive_linear": RECURSIVE + ", pairs AS (SELECT Product_ID, actual, exp(pl) - 1 AS fitted, ly AS ry, pl AS rf FROM fit)",
    "lookback": LOOKBACK + f", pairs AS (SELECT Product_ID, actual, fitted, actual AS ry, fitted AS rf FROM (SELECT Product_ID, {_INVERSE.format(v='s')} AS actual, {_INVERSE.format(v='p')} AS fitted FROM fit))",
    "seasonal_regression": SEASONAL + ", pairs AS (SELECT Product_ID, y AS actual, exp(ly + 0.5 * sigma * sigma) AS fitted, y AS ry, exp(ly + 0.5 * sigma * sigma) AS rf FROM fit)",
}

# ------------------------------------------------------------------ M14: three folds of 30 days
_FOLDS = "(SELECT unnest([1, 2, 3]) AS f) folds"
_LAST = ", lastd AS (SELECT Product_ID, max(Date) AS last FROM daily GROUP BY 1)"
_M = "CAST(floor((last - {d}) / 30.0) AS INTEGER)"
BACKTEST = {
    "poly_ridge": HEAD + _LAST + f"""
, rn AS (SELECT daily.*, {_M.format(d='Date')} AS m, row_number() OVER (PARTITION BY Product_ID ORDER BY Date) AS nr, {ORDINAL.format(d='Date')} AS ord FROM daily JOIN lastd USING (Product_ID))
, rec AS (SELECT Product_ID, Date, m, nr, ord, Demand AS e FROM rn WHERE nr = 1
          UNION ALL
          SELECT rn.Product_ID, rn.Date, rn.m, rn.nr, rn.ord, {_A5!r} * rn.Demand + {1 - _A5!r} * rec.e FROM rec JOIN rn ON rn.Product_ID = rec.Product_ID AND rn.nr = rec.nr + 1)
, ms AS (SELECT Product_ID, avg(ord) AS mu, CASE WHEN stddev_pop(ord) > 0 THEN stddev_pop(ord) ELSE 1.0 END AS sd FROM rec WHERE m >= 3 GROUP BY 1)
, z AS (SELECT rec.Product_ID, m, e, (ord - mu) / sd AS z FROM rec JOIN ms USING (Product_ID))
, rx AS (SELECT Product_ID, m, [1.0, z, pow(z, 2), pow(z, 3), pow(z, 4), e] AS x FROM z)
, rf AS (SELECT Product_ID || '|' || f AS pk, x FROM rx, {_FOLDS} WHERE m >= f)
, {gram_rows('rg', 'rf', 6, 'pk')}
, ra AS (SELECT k || '|' || nr AS k, i, j, v + CASE WHEN i = j AND i BETWEEN 1 AND 4 THEN alpha ELSE 0 END AS v
         FROM rg, (SELECT unnest({_ALPHAS}) AS alpha, unnest(range({len(_ALPHAS)})) AS nr))
, {eliminate('rs', 'ra', 5)}
, {solution('rb', 'rs', 5, 5)}
, rl AS (SELECT k, list(list_row ORDER BY i) AS g FROM (SELECT k, i, list(v ORDER BY j) AS list_row FROM rg GROUP BY k, i) GROUP BY k)
, rc AS (SELECT rl.k, CAST(split_part(rb.k, '|', 3) AS INTEGER) AS nr, b, g, list_sum(list_transform(range(1, 6), lambda i: b[i] * list_dot_product(g[i][1:5], b))) AS bab
         FROM rb JOIN rl ON split_part(rb.k, '|', 1) || '|' || split_part(rb.k, '|', 2) = rl.k)
, best AS (SELECT k, b FROM rc QUALIFY row_number() OVER (PARTITION BY k ORDER BY sqrt(greatest(g[6][6] - 2 * list_dot_product(g[6][1:5], b) + bab, 0) / g[1][1]) / g[1][6], nr) = 1)
, pairs AS (SELECT Product_ID, m + 1 AS fold, x[6] AS actual, list_dot_product(x[1:5], b) AS fitted, x[6] AS ry, list_dot_product(x[1:5], b) AS rf
            FROM rx JOIN best ON k = Product_ID || '|' || (m + 1) WHERE m < 3)""",
    "recursive_linear": HEAD + _LAST + f"""
, dm AS (SELECT daily.*, last, {_M.format(d='Date')} AS m FROM daily JOIN lastd USING (Product_ID))
, t AS (SELECT dm.*, qc FROM dm JOIN (SELECT Product_ID, quantile_cont(Demand, 0.95) AS qc FROM dm WHERE m >= 3 GROUP BY 1) USING (Product_ID))
, s AS (SELECT *, {_SMOOTH.format(v='Demand')} AS smoothed FROM t WHERE Demand < qc {_W7})
, c AS (SELECT Product_ID, Date, m, smoothed, lag(smoothed, 1) OVER (PARTITION BY Product_ID ORDER BY Date) AS lag1, lag(smoothed, 7) OVER (PARTITION BY Product_ID ORDER BY Date) AS lag7,
               {_SMOOTH.format(v='smoothed')} AS mean7 FROM s WHERE smoothed IS NOT NULL {_W7})
, rx AS (SELECT Product_ID, Date, m, smoothed, [1.0, ({ORDINAL.format(d='Date')} - 730000)::DOUBLE, CAST(isodow(Date) - 1 AS DOUBLE), CAST(month(Date) AS DOUBLE), CAST(isodow(Date) >= 6 AS DOUBLE),
               lag1, lag7, mean7, ln(1 + smoothed)] AS x FROM c WHERE lag1 IS NOT NULL AND lag7 IS NOT NULL AND mean7 IS NOT NULL)
, rf AS (SELECT Product_ID || '|' || f AS pk, Product_ID, f, Date, smoothed, x, count(*) OVER (PARTITION BY Product_ID, f) AS n FROM rx, {_FOLDS} WHERE m >= f QUALIFY n > 7)
, {gram_rows('rg', 'rf', 9, 'pk')}
, {eliminate('rs', 'rg', 8)}
, {solution('rb', 'rs', 8, 8)}
, tail AS (SELECT pk, Product_ID, f, list(smoothed ORDER BY Date) AS hist FROM (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY pk ORDER BY Date DESC) <= 7) GROUP BY 1, 2, 3)
, fut AS (SELECT Product_ID, f, CAST(last - INTERVAL (30 * f) DAY AS DATE) AS cut, b, hist, 0 AS h, NULL::DOUBLE AS p FROM tail JOIN rb ON pk = k JOIN lastd USING (Product_ID)
          UNION ALL
          SELECT Product_ID, f, cut, b, list_append(hist[2:], q), h, q
          FROM (SELECT Product_ID, f, cut, b, hist, h + 1 AS h, exp(list_dot_product(b, [1.0, ({ORDINAL.format(d='cut')} + h + 1 - 730000)::DOUBLE, CAST(isodow(cut + INTERVAL (h + 1) DAY) - 1 AS DOUBLE),
                       CAST(month(cut + INTERVAL (h + 1) DAY) AS DOUBLE), CAST(isodow(cut + INTERVAL (h + 1) DAY) >= 6 AS DOUBLE), hist[-1], hist[1], list_avg(hist)])) - 1 AS q FROM fut WHERE h < 30))
, act AS (SELECT Product_ID, Date, m, {_SMOOTH.format(v='Demand')} AS actual FROM dm {_W7})
, pairs AS (SELECT fut.Product_ID, f AS fold, actual, p AS fitted, ln(1 + actual) AS ry, ln(1 + greatest(p, 0)) AS rf
            FROM fut JOIN act ON act.Product_ID = fut.Product_ID AND act.Date = CAST(cut + INTERVAL (h) DAY AS DATE) AND m = f - 1 WHERE h > 0 AND actual IS NOT NULL)""",
    "lookback": HEAD + _LAST + f"""
, dm AS (SELECT daily.*, last, {_M.format(d='Date')} AS m FROM daily JOIN lastd USING (Product_ID))
, a AS (SELECT *, {_SMOOTH.format(v='Demand')} AS smoothed FROM dm {_W7})
, mm AS (SELECT a.*, mn, mx FROM a JOIN (SELECT Product_ID, min(smoothed) AS mn, max(smoothed) AS mx FROM a WHERE m >= 3 GROUP BY 1) USING (Product_ID) WHERE smoothed IS NOT NULL AND mn IS NOT NULL)
, sc AS (SELECT *, CASE WHEN mx > mn THEN (smoothed - mn) / (mx - mn) ELSE 0.0 END AS s FROM mm)
, lb AS (SELECT *, list(s) OVER (PARTITION BY Product_ID ORDER BY Date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS back FROM sc)
, rx AS (SELECT Product_ID, Date, last, m, mn, mx, smoothed, s, back FROM lb WHERE len(back) = 30)
, rf AS (SELECT f::VARCHAR AS pk, list_concat([1.0], list_append(back, s)) AS x FROM rx, {_FOLDS} WHERE m >= f)
, {gram_rows('rg', 'rf', 32, 'pk')}
, {eliminate('rs', 'rg', 31)}
, {solution('rb', 'rs', 31, 31)}
, tail AS (SELECT Product_ID, f, last, mn, mx, list_append(back[2:], s) AS hist FROM rx, {_FOLDS} WHERE m >= f QUALIFY row_number() OVER (PARTITION BY Product_ID, f ORDER BY Date DESC) = 1)
, fut AS (SELECT Product_ID, f, CAST(last - INTERVAL (30 * f) DAY AS DATE) AS cut, mn, mx, b, hist, 0 AS h, NULL::DOUBLE AS p FROM tail JOIN rb ON k = f::VARCHAR
          UNION ALL
          SELECT Product_ID, f, cut, mn, mx, b, list_append(hist[2:], q), h, q
          FROM (SELECT Product_ID, f, cut, mn, mx, b, hist, h + 1 AS h, b[1] + list_dot_product(b[2:31], hist) AS q FROM fut WHERE h < 30))
, pairs AS (SELECT Product_ID, fold, actual, fitted, actual AS ry, fitted AS rf FROM (
              SELECT fut.Product_ID, f AS fold, smoothed AS actual, CASE WHEN fut.mx > fut.mn THEN p * (fut.mx - fut.mn) + fut.mn ELSE fut.mn END AS fitted
              FROM fut JOIN rx ON rx.Product_ID = fut.Product_ID AND rx.Date = CAST(cut + INTERVAL (h) DAY AS DATE) AND m = f - 1 WHERE h > 0))""",
    "seasonal_regression": FEATS[:FEATS.index(", pos AS")] + _LAST + f"""
, fm AS (SELECT feats.*, last, {_M.format(d='Date')} AS m FROM feats JOIN lastd USING (Product_ID))
, pos AS (SELECT * FROM fm WHERE y > 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in _REGRESSORS)})
, qs AS (SELECT Product_ID, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM pos WHERE m >= 3 GROUP BY 1)
, kept AS (SELECT pos.*, Date AS ds FROM pos JOIN qs USING (Product_ID) WHERE y >= q1 - 1.5 * (q3 - q1) AND y <= q3 + 1.5 * (q3 - q1))
, clean0 AS (SELECT *, count(*) OVER (PARTITION BY Product_ID) AS n, row_number() OVER (PARTITION BY Product_ID ORDER BY ds) - 1 AS rn FROM kept WHERE m >= 3 QUALIFY n >= 30)
, clean AS (SELECT * FROM kept WHERE Product_ID IN (SELECT Product_ID FROM clean0))""" + seasonal_scale("clean0") + f"""
, rows_m AS (SELECT Product_ID, ds, m, [{_design('ds', 'CAST(ds - first_day AS DOUBLE) / span', _REGRESSORS)}, ln(y)] AS x
             FROM clean JOIN scale USING (Product_ID) LEFT JOIN flags USING (ds))
, train AS (SELECT Product_ID || '|' || f AS pk, x FROM rows_m, {_FOLDS} WHERE m >= f)""" + seasonal_solve("train", "pk") + f"""
, last30 AS (SELECT Product_ID, f, {', '.join(f'avg({c}) AS {c}' for c in _REGRESSORS)} FROM (
               SELECT Product_ID, f, {', '.join(_REGRESSORS)} FROM clean, {_FOLDS} WHERE m >= f QUALIFY row_number() OVER (PARTITION BY Product_ID, f ORDER BY ds DESC) <= 30) GROUP BY 1, 2)
, tested AS (SELECT fm.Product_ID, m + 1 AS fold, Date AS ds, y FROM fm WHERE m < 3)
, tx AS (SELECT t.Product_ID, fold, y, [{_design('ds', 'CAST(ds - first_day AS DOUBLE) / span', [f'l.{c}' for c in _REGRESSORS])}] AS x
         FROM tested t JOIN scale USING (Product_ID) JOIN last30 l ON l.Product_ID = t.Product_ID AND l.f = fold LEFT JOIN flags USING (ds))
, pairs AS (SELECT Product_ID, fold, y AS actual, exp(list_dot_product(x, b) + 0.5 * sigma * sigma) AS fitted, y AS ry, exp(list_dot_product(x, b) + 0.5 * sigma * sigma) AS rf
            FROM tx JOIN beta ON k = Product_ID || '|' || fold)""",
    "trend": HEAD + _LAST + f"""
, fm AS (SELECT Product_ID, f, Demand, {_M.format(d='Date')} AS m, {ORDINAL.format(d='Date')} AS x FROM daily JOIN lastd USING (Product_ID), {_FOLDS})
, cut AS (SELECT *, quantile_cont(Demand, 0.99) OVER (PARTITION BY Product_ID, f) AS qc FROM fm WHERE m >= f)
, line AS (SELECT Product_ID, f, regr_slope(ln(1 + Demand), x) AS b, avg(ln(1 + Demand)) AS ym, avg(x) AS xm FROM cut WHERE Demand < qc GROUP BY 1, 2)
, pairs AS (SELECT Product_ID, f AS fold, Demand AS actual, exp(ym + coalesce(b, 0) * (x - xm)) - 1 AS fitted, ln(1 + Demand) AS ry, ym + coalesce(b, 0) * (x - xm) AS rf
            FROM fm JOIN line USING (Product_ID, f) WHERE m = f - 1)""",
}
_SCORE = """, scored AS (SELECT Product_ID, fold, count(*) AS n, avg(actual) AS mean, sqrt(avg((actual - fitted) ^ 2)) AS rmse, avg(abs((actual - fitted) / nullif(actual, 0))) * 100 AS mape,
                       sum((ry - rf) ^ 2) AS sse, sum((ry - my) ^ 2) AS sst FROM (SELECT *, avg(ry) OVER (PARTITION BY Product_ID, fold) AS my FROM pairs) GROUP BY 1, 2)
SELECT Product_ID, CAST(fold AS INTEGER) AS fold, n, round(mean, 6) AS mean, round(rmse, 6) AS rmse, round(rmse / mean * 100, 6) AS rmse_pct, round(mape, 6) AS mape,
       round(CASE WHEN sst > 0 THEN 1 - sse / sst END, 6) AS r2, '{model}' AS model FROM scored"""
BACKTEST_SCORES = " UNION ALL ".join(f"SELECT * FROM ({text}{_SCORE.format(model=model)})" for model, text in BACKTEST.items())

# ------------------------------------------------------------------ M6–M8
_ADF_TOP, _AR_TOP = 32, 64  # the longest lags that the solves below provide for (series of up to about 2,900 days)
FILLED = HEAD + """
, span AS (SELECT Product_ID, min(Date) AS a, max(Date) AS b FROM daily GROUP BY 1)
, cal AS (SELECT Product_ID, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS Date FROM span)
, f AS (SELECT c.Product_ID, c.Date, coalesce(d.Demand, 0.0) AS y, row_number() OVER (PARTITION BY c.Product_ID ORDER BY c.Date) - 1 AS t, count(*) OVER (PARTITION BY c.Product_ID) AS n
        FROM cal c LEFT JOIN daily d ON c.Product_ID = d.Product_ID AND c.Date = d.Date)"""


def _padded(values: str, n: str, size: int) -> str:
    """A list of ``size`` numbers: the first ``n`` of ``values``, then zeros."""
    return f"list_concat({values}[1:{n}], list_transform(range({size} - {n}), lambda i: 0.0::DOUBLE))"


def _filled_up(name: str, source: str, size: int) -> str:
    """CTE: a matrix with 1 on the diagonal where a padded column has none, so that it is a pivot without effect."""
    return f"{name} AS (SELECT k, i, j, CASE WHEN i = j AND v = 0 AND i < {size} THEN 1.0 ELSE v END AS v FROM {source})"


_ADF_ALL = 2 + _ADF_TOP
_CRIT = {"crit_1": [-3.43035, -6.5393, -16.786, -79.433], "crit_5": [-2.86154, -2.8903, -4.234, -40.04], "crit_10": [-2.56677, -1.5384, -2.809, 0.0]}
_PHI = ("0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 90), lambda i: pow(z, 2 * i + 1) / list_product(list_transform(range(0, i + 1), lambda m: (2 * m + 1)::DOUBLE))))")
ADF = FILLED + f"""
, x AS (SELECT Product_ID, 'level' AS series, t, y AS v, n FROM f
        UNION ALL SELECT Product_ID, 'difference', t - 1, v, n - 1 FROM (SELECT Product_ID, t, n, y - lag(y) OVER (PARTITION BY Product_ID ORDER BY t) AS v FROM f) WHERE t > 0)
, l AS (SELECT *, Product_ID || '|' || series AS k, CAST(least(floor(n / 2) - 2, ceil(12 * pow(n / 100, 0.25))) AS INTEGER) AS top, lag(v) OVER w - avg(v) OVER (PARTITION BY Product_ID, series) AS b,
               v - lag(v) OVER w AS dy FROM x WINDOW w AS (PARTITION BY Product_ID, series ORDER BY t))
, g AS (SELECT *, list_reverse(list(dy) FILTER (WHERE dy IS NOT NULL) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN {_ADF_TOP} PRECEDING AND 1 PRECEDING)) AS dys FROM l)
, r1 AS (SELECT k, list_append(list_concat([1.0, b], {_padded('dys', 'top', _ADF_TOP)}), dy) AS x FROM g WHERE t > top)
, {gram_rows('g1', 'r1', _ADF_ALL + 1, 'k')}
, {_filled_up('p1', 'g1', _ADF_ALL)}
, {eliminate('e1', 'p1', _ADF_ALL)}
, c1 AS (SELECT k, max(top) AS top, count(*) FILTER (WHERE t > top) AS m FROM g GROUP BY k)
, chosen AS (SELECT k, step - 2 AS lag FROM e1_e JOIN c1 USING (k) WHERE i = {_ADF_ALL} AND j = {_ADF_ALL} AND step BETWEEN 2 AND top + 2
             QUALIFY row_number() OVER (PARTITION BY k ORDER BY m * (ln(2 * pi() * v / m) + 1) + 2 * step, step) = 1)
, r2 AS (SELECT k, list_concat(list_concat([1.0], {_padded('dys', 'lag', _ADF_TOP)}), [b, dy]) AS x FROM g JOIN chosen USING (k) WHERE t > lag)
, {gram_rows('g2', 'r2', _ADF_ALL + 1, 'k')}
, {_filled_up('p2', 'g2', _ADF_ALL - 1)}
, {eliminate('e2', 'p2', _ADF_ALL - 1)}
, s AS (SELECT k, max(CASE WHEN i = {_ADF_ALL - 1} AND j = i THEN v END) AS vv, max(CASE WHEN i = {_ADF_ALL - 1} AND j = {_ADF_ALL} THEN v END) AS vy, max(CASE WHEN i = {_ADF_ALL} AND j = i THEN v END) AS yy
        FROM e2 GROUP BY k)
, c2 AS (SELECT k, lag, count(*) AS m FROM g JOIN chosen USING (k) WHERE t > lag GROUP BY k, lag)
, tau AS (SELECT k, lag, m, vy / vv / sqrt((yy - vy * vy / vv) / (m - lag - 2) / vv) AS tau FROM s JOIN c2 USING (k))
, pz AS (SELECT *, CASE WHEN tau <= -1.61 THEN 2.1659 + 1.4412 * tau + 0.038269 * tau * tau ELSE 1.7339 + 0.93202 * tau - 0.12745 * tau * tau - 0.010368 * tau * tau * tau END AS z FROM tau)
, p AS (SELECT *, CASE WHEN tau > 2.74 THEN 1.0 WHEN tau < -18.83 OR z < -8 THEN 0.0 ELSE {_PHI} END AS p FROM pz)
SELECT split_part(k, '|', 1) AS Product_ID, split_part(k, '|', 2) AS series, round(tau, 4) AS adf_statistic, round(p, 6) AS p_value,
       {', '.join(f"round({c[0]} + {c[1]} / m + {c[2]} / pow(m, 2) + {c[3]} / pow(m, 3), 6) AS {n}" for n, c in _CRIT.items())},
       CAST(lag AS INTEGER) AS used_lag, CAST(m AS INTEGER) AS nobs, p < 0.05 AS is_stationary, 'ok' AS status FROM p"""

_INNER = 8  # columns 1, w1..w3, e1..e3 and the target


def _steps(c: str, sign: str = "") -> str:
    """Whether 1 - c1 z - c2 z² - c3 z³ has its roots outside the unit circle, by stepping down its reflection coefficients."""
    one, two, three = (f"({sign}{c}[{i}])" for i in (1, 2, 3))
    low = [f"(({a} + {three} * {b}) / (1 - {three} * {three}))" for a, b in ((one, two), (two, one))]
    return f"(abs({three}) < 1 AND abs({low[1]}) < 1 AND abs({low[0]} / (1 - {low[1]})) < 1)"


ARIMA = FILLED + f"""
, sq AS (SELECT Product_ID, sum(y * y) AS yy FROM f GROUP BY 1)
, l AS (SELECT *, lag(y, 1) OVER w AS y1, lag(y, 2) OVER w AS y2, CAST(least(greatest(floor(ln(n) * ln(n)), 6), greatest(floor((n - 1) / 3), 1)) AS INTEGER) AS m
        FROM f WINDOW w AS (PARTITION BY Product_ID ORDER BY t))
, wd AS (SELECT Product_ID, d, Product_ID || '|' || d AS k, Date, t, n, m, y, y1, y2, CASE WHEN t < d THEN 0.0 WHEN d = 0 THEN y WHEN d = 1 THEN y - y1 ELSE y - 2 * y1 + y2 END AS w
         FROM l, (SELECT unnest([0, 1, 2]) AS d))
, wl AS (SELECT *, list_reverse(list(w) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN {_AR_TOP} PRECEDING AND 1 PRECEDING)) AS back FROM wd)
, r1 AS (SELECT k, list_append(list_concat([1.0], {_padded('back', 'm', _AR_TOP)}), w) AS x FROM wl WHERE t >= d + m)
, {gram_rows('g1', 'r1', _AR_TOP + 2, 'k')}
, {_filled_up('p1', 'g1', _AR_TOP + 1)}
, {eliminate('e1', 'p1', _AR_TOP + 1)}
, {solution('b1', 'e1', _AR_TOP + 1, _AR_TOP + 1)}
, we AS (SELECT wl.* EXCLUDE (back), CASE WHEN t >= d + m THEN w - b[1] - list_dot_product(back[1:m], b[2:m + 1]) ELSE 0.0 END AS e FROM wl JOIN b1 USING (k))
, lg AS (SELECT *, {', '.join(f'lag({c}, {i}) OVER q AS {c}{i}' for c in 'we' for i in (1, 2, 3))} FROM we WINDOW q AS (PARTITION BY k ORDER BY t))
, r2 AS (SELECT k, [1.0, w1, w2, w3, e1, e2, e3, w] AS x FROM lg WHERE t >= 5 + m)
, {gram_rows('g2', 'r2', _INNER, 'k')}
, tries AS (SELECT g2.k || '|' || p || '|' || q AS k, i, j,
                   CASE WHEN NOT (ui AND uj) THEN CASE WHEN i = j THEN 1.0 ELSE 0.0 END ELSE v END AS v
            FROM (SELECT g2.*, p, q, i = 7 OR (i = 0 AND k LIKE '%|0') OR i BETWEEN 1 AND p OR i BETWEEN 4 AND 3 + q AS ui, j = 7 OR (j = 0 AND k LIKE '%|0') OR j BETWEEN 1 AND p OR j BETWEEN 4 AND 3 + q AS uj
                  FROM g2, (SELECT unnest([0, 1, 2, 3]) AS p) a, (SELECT unnest([0, 1, 2, 3]) AS q) b) g2)
, {eliminate('e2', 'tries', 7)}
, {solution('b2', 'e2', 7, 7)}
, cnt AS (SELECT k, count(*) AS n FROM r2 GROUP BY k)
, cand AS (SELECT split_part(b2.k, '|', 1) AS Product_ID, CAST(split_part(b2.k, '|', 2) AS INTEGER) AS d, CAST(split_part(b2.k, '|', 3) AS INTEGER) AS p, CAST(split_part(b2.k, '|', 4) AS INTEGER) AS q,
                  b AS coef, v AS ssr, n, n * (ln(2 * pi() * v / n) + 1) + 2 * (CAST(split_part(b2.k, '|', 3) AS INTEGER) + CAST(split_part(b2.k, '|', 4) AS INTEGER) + 1 + CASE WHEN split_part(b2.k, '|', 2) = '0' THEN 1 ELSE 0 END) AS aic
           FROM b2 JOIN (SELECT k, v FROM e2 WHERE i = 7 AND j = 7) s USING (k) JOIN cnt ON cnt.k = split_part(b2.k, '|', 1) || '|' || split_part(b2.k, '|', 2))
, best AS (SELECT cand.* FROM cand JOIN sq USING (Product_ID) WHERE ssr > 1e-11 * yy AND {_steps('coef[2:4]')} AND {_steps('coef[5:7]', '-')}
           QUALIFY row_number() OVER (PARTITION BY Product_ID ORDER BY aic, p, d, q) = 1)
, fit AS (SELECT lg.Product_ID, Date, y, p, lg.d, q, aic, coef[1] + list_dot_product(coef[2:7], [w1, w2, w3, e1, e2, e3]) + CASE lg.d WHEN 0 THEN 0 WHEN 1 THEN y1 ELSE 2 * y1 - y2 END AS fitted
          FROM lg JOIN best ON lg.Product_ID = best.Product_ID AND lg.d = best.d WHERE t >= 5 + m)"""
ORDERS = ARIMA + """
SELECT Product_ID, p, d, q, round(aic, 3) AS aic FROM best"""
ARIMA_FORECAST = ARIMA + """
, fut AS (SELECT lg.Product_ID, Date AS last, p, lg.d, q, coef, [w2, w1, w] AS ws, [e2, e1, e] AS es, [y1, y] AS ys, 0 AS h, NULL::DOUBLE AS value
          FROM lg JOIN best ON lg.Product_ID = best.Product_ID AND lg.d = best.d WHERE t = lg.n - 1
          UNION ALL
          SELECT Product_ID, last, p, d, q, coef, list_append(ws[2:], s), list_append(es[2:], 0.0), list_append(ys[2:], s + a), h, s + a
          FROM (SELECT *, CASE d WHEN 0 THEN 0 WHEN 1 THEN ys[2] ELSE 2 * ys[2] - ys[1] END AS a
                FROM (SELECT Product_ID, last, p, d, q, coef, ws, es, ys, h + 1 AS h,
                             coef[1] + coef[2] * ws[3] + coef[3] * ws[2] + coef[4] * ws[1] + coef[5] * es[3] + coef[6] * es[2] + coef[7] * es[1] AS s FROM fut WHERE h < 30)))
SELECT Product_ID, Date, 'fitted' AS kind, round(fitted, 4) AS value, p || ',' || d || ',' || q AS "order", 'ok' AS status FROM fit
UNION ALL
SELECT Product_ID, CAST(last + INTERVAL (h) DAY AS DATE), 'forecast', round(value, 4), p || ',' || d || ',' || q, 'ok' FROM fut WHERE h > 0"""
PAIRS["arima"] = ARIMA + ", pairs AS (SELECT Product_ID, y AS actual, fitted, y AS ry, fitted AS rf, p, d, q, aic FROM fit)"
