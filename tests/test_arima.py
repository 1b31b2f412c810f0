"""ADF and Hannan–Rissanen on simulated series (FIXTURES: ar1, random walk)."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.forecast import arima as ar
from tests import arima_reference as ref


def _frame(spark, series: dict[str, np.ndarray]):
    start = dt.date(2020, 1, 1)
    rows = [(k, start + dt.timedelta(days=i), float(v)) for k, s in series.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "Product_ID string, Date date, Demand double")


def _sim(n=1000, phi=0.6, seed=7):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=n)
    ar1 = np.zeros(n)
    for t in range(1, n):
        ar1[t] = phi * ar1[t - 1] + e[t]
    return ar1, np.cumsum(e)


def _adf_numpy(x):
    """Reference implementation of the same ADF (constant, AIC lag)."""
    n = len(x)
    maxlag = min(n // 2 - 2, int(math.ceil(12 * (n / 100) ** 0.25)))
    dx = np.diff(x)

    def design(L):
        rows = len(dx) - L
        X = [np.ones(rows), x[L:-1]] + [dx[L - k:len(dx) - k] for k in range(1, L + 1)]
        return np.column_stack(X), dx[L:]

    best = None
    for L in range(0, maxlag + 1):
        X, y = design(maxlag)
        X = X[:, :L + 2]
        beta = np.linalg.lstsq(X, y, rcond=None)[0]
        ssr = float(((y - X @ beta) ** 2).sum())
        m = len(y)
        aic = -2 * (-m / 2 * (math.log(2 * math.pi) + math.log(ssr / m) + 1)) + 2 * (L + 2)
        if best is None or aic < best[0]:
            best = (aic, L)
    L = best[1]
    X, y = design(L)
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    res = y - X @ beta
    s2 = res @ res / (len(y) - X.shape[1])
    cov = s2 * np.linalg.inv(X.T @ X)
    return beta[1] / math.sqrt(cov[1, 1]), L


def test_mackinnon_surface():
    assert ar.mackinnon_p(-2.86) == pytest.approx(0.05, abs=0.003)
    assert ar.mackinnon_crit(10**9)["5%"] == pytest.approx(-2.86154, abs=1e-4)
    assert ar.mackinnon_p(5.0) == 1.0 and ar.mackinnon_p(-30.0) == 0.0


def test_adf_matches_numpy_and_separates(spark):
    ar1, rw = _sim()
    res = {r.Product_ID: r for r in ar.adf_on_series(_frame(spark, {"ar1": ar1, "rw": rw})).where("series = 'level'").collect()}
    for name, s in (("ar1", ar1), ("rw", rw)):
        tau, lag = _adf_numpy(s)
        assert res[name].used_lag == lag
        assert res[name].adf_statistic == pytest.approx(tau, rel=1e-6)
    assert res["ar1"].is_stationary and res["ar1"].p_value < 0.01
    assert not res["rw"].is_stationary


def test_hannan_rissanen_recovers_ar1(spark):
    ar1, _ = _sim(n=2000, seed=11)
    cands = ar.order_candidates(_frame(spark, {"ar1": ar1 + 50.0}))
    c = cands.where((F.col("p") == 1) & (F.col("d") == 0) & (F.col("q") == 0)).collect()[0]
    assert c.coef[1] == pytest.approx(0.6, abs=0.05)
    assert ref.Fits(ar1 + 50.0).best()[2] == 0


def test_candidates_share_one_sample():
    y = np.arange(200.0) % 7 + np.sin(np.arange(200.0) ** 2)
    fits = ref.Fits(y)
    first = fits.first
    assert first == ar.MAX_D + ar.long_ar_order(200) + ar.MAX_Q
    for d in range(3):
        w = np.diff(y, d)[first - d:]
        aic = {(p, q): a for a, p, dd, q, _ in fits.table if dd == d}[0, 0]
        rest = w - w.mean() if d == 0 else w
        assert aic == pytest.approx(ar.gaussian_aic(float(rest @ rest), len(w), 1 + (d == 0)))


def test_every_product_gets_rows(spark):
    series = {"one": [3.0], "three": [1.0, 2.0, 4.0], "five": [1.0, 2.0, 1.0, 3.0, 2.0], "twelve": list(range(12)), "const": [5.0] * 60,
              "line": [float(i) for i in range(60)], "week": [float(i % 7) for i in range(90)], "long": list(_sim(400)[0] + 20), "walk": list(_sim(400)[1] + 90)}
    df = _frame(spark, {k: np.array(v, dtype=float) for k, v in series.items()})
    orders = {r.Product_ID: r for r in ar.ar_order_search(df).collect()}
    assert orders.keys() == series.keys()
    assert all((orders[k].p, orders[k].d, orders[k].q, orders[k].status) == (1, 1, 1, "fallback") for k in ("one", "three", "five", "const"))
    tests = {(r.Product_ID, r.series): r for r in ar.adf_test(df).collect()}
    assert len(tests) == 2 * len(series)
    assert tests["one", "level"].status == "too_short" and tests["const", "level"].status == "constant"
    assert tests["line", "difference"].status == "constant" and tests["long", "level"].status == "ok"
    assert all(r.adf_statistic is None or abs(r.adf_statistic) < 1e6 for r in tests.values())
    ahead = {}
    for r in ar.arima_forecast(df, 30).where("kind = 'forecast'").collect():
        ahead.setdefault(r.Product_ID, []).append(r.value)
    assert ahead.keys() == series.keys() and all(len(v) == 30 and np.isfinite(v).all() for v in ahead.values())
    assert ahead["const"] == [5.0] * 30 and ahead["one"] == [3.0] * 30
    assert {r.Product_ID for r in ar.arima_metrics(df).collect()} == series.keys()


def test_forecast_continues_the_fitted_recursion():
    y = _sim(300, seed=3)[0] + 10
    fits = ref.Fits(y)
    _, _, d, _, coef = fits.best()
    fitted, ahead = fits.run(2)
    w = [y, np.diff(y), np.diff(y, 2)][d]
    e = fits.innovations[d]
    step = coef[0] + sum(coef[k] * w[-k] + coef[3 + k] * e[-k] for k in (1, 2, 3))
    assert ahead[0] == pytest.approx(step + [0, y[-1], 2 * y[-1] - y[-2]][d])
    assert np.isnan(fitted[:fits.first]).all() and np.isfinite(fitted[fits.first:]).all()


SERIES = {"one": [3.0], "two": [1.0, 4.0], "three": [1.0, 2.0, 4.0], "four": [1.0, 2.0, 4.0, 3.0], "five": [1.0, 2.0, 1.0, 3.0, 2.0], "twelve": list(range(12)), "const": [5.0] * 60,
          "line": [float(i) for i in range(60)], "week": [float(i % 7) for i in range(90)], "long": list(_sim(400)[0] + 20), "walk": list(_sim(400)[1] + 90),
          "zeros": [float(i % 5 == 0) * (i % 13) for i in range(150)], "short": list(_sim(30, seed=2)[0] + 5)}


def test_spark_equals_the_series_by_series_reference(spark):
    series = {k: np.array(v, dtype=float) for k, v in SERIES.items()}
    df = _frame(spark, series)
    tests = {(r.Product_ID, r.series): r for r in ar.adf_test(df).collect()}
    assert len(tests) == 2 * len(series)
    for name, y in series.items():
        for kind, v in (("level", y), ("difference", np.diff(y))):
            want, got = ref.adf(v), tests[name, kind]
            assert (got.status, got.used_lag, got.nobs, got.is_stationary) == (want["status"], want["used_lag"], want["nobs"], want["is_stationary"]), (name, kind)
            if want["adf_statistic"] is not None:
                assert got.adf_statistic == pytest.approx(want["adf_statistic"], rel=1e-6) and got.p_value == pytest.approx(want["p_value"], abs=1e-6)
    found = {}
    for r in ar.order_candidates(df.withColumn("Demand", F.col("Demand"))).collect():
        found.setdefault(r.Product_ID, []).append(r)
    orders = {r.Product_ID: r for r in ar.ar_order_search(df).collect()}
    ahead = {}
    for r in ar.arima_forecast(df, 30).collect():
        ahead.setdefault((r.Product_ID, r.kind), []).append((r.Date, r.value))
    for name, y in series.items():
        fits = ref.Fits(y)
        assert {(r.p, r.d, r.q) for r in found.get(name, [])} == {c[1:4] for c in fits.table}, name
        aic = {c[1:4]: c[0] for c in fits.table}
        assert all(r.aic == pytest.approx(aic[r.p, r.d, r.q], rel=1e-6, abs=1e-4) for r in found.get(name, []))
        best = fits.best()
        assert (orders[name].p, orders[name].d, orders[name].q) == best[1:4] and orders[name].status == ("ok" if fits.table else "fallback")
        assert orders[name].coef == pytest.approx(best[4].tolist(), abs=1e-5)
        fitted, future = fits.run(30)
        assert [v for _, v in sorted(ahead[name, "forecast"])] == pytest.approx(future.tolist(), rel=1e-5, abs=1e-5), name
        assert [v for _, v in sorted(ahead.get((name, "fitted"), []))] == pytest.approx(fitted[~np.isnan(fitted)].tolist(), rel=1e-5, abs=1e-5), name
