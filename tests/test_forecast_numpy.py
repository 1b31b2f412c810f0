"""Gram-based models against direct numpy / pandas computations on one product."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandlens.forecast import recursive as rc
from demandlens.forecast import ridge as rg
from demandlens.forecast.series import daily_series


@pytest.fixture(scope="module")
def daily_pd(demand_small):
    return daily_series(demand_small).toPandas()


def _one(daily_pd):
    prod = sorted(daily_pd.Product_ID.unique())[0]
    d = daily_pd[daily_pd.Product_ID == prod].sort_values("Date").reset_index(drop=True)
    return prod, d


def test_ridge_matches_numpy(demand_small, daily_pd):
    prod, d = _one(daily_pd)
    y = d.Demand.ewm(span=5, adjust=False).mean().to_numpy()
    x = np.array([pd.Timestamp(v).toordinal() for v in d.Date], dtype=float)
    z = (x - x.mean()) / x.std()
    X = np.column_stack([z ** k for k in range(1, 5)])
    best = None
    for a in rg.ALPHAS:
        Xc, yc = X - X.mean(0), y - y.mean()
        w = np.linalg.solve(Xc.T @ Xc + a * np.eye(4), Xc.T @ yc)
        b = y.mean() - X.mean(0) @ w
        pred = b + X @ w
        score = np.sqrt(np.mean((y - pred) ** 2)) / y.mean() * 100
        if best is None or score < best[0]:
            best = (score, a, np.r_[b, w], pred)
    coef = rg.ridge_fit(demand_small).where(F.col("Product_ID") == prod).collect()[0]
    assert coef.alpha == best[1]
    np.testing.assert_allclose(coef.beta, best[2], rtol=1e-6, atol=1e-8)
    fc = (rg.ridge_forecast(demand_small).where((F.col("Product_ID") == prod) & (F.col("kind") == "fitted"))
          .orderBy("Date").toPandas())
    np.testing.assert_allclose(fc.value.to_numpy(), best[3], rtol=1e-6, atol=1e-6)


def test_recursive_linear_matches_numpy(demand_small, daily_pd):
    prod, d = _one(daily_pd)
    d = d[d.Demand < d.Demand.quantile(0.95)].copy()
    d["S"] = d.Demand.rolling(7).mean()
    d = d.dropna().copy()
    d["dow"] = pd.to_datetime(d.Date).dt.dayofweek
    d["month"] = pd.to_datetime(d.Date).dt.month
    d["we"] = (d.dow >= 5).astype(int)
    d["l1"] = d.S.shift(1)
    d["l7"] = d.S.shift(7)
    d["m7"] = d.S.rolling(7).mean()
    d = d.dropna()
    x = np.array([pd.Timestamp(v).toordinal() for v in d.Date], dtype=float)
    X = np.column_stack([np.ones(len(d)), x, d.dow, d.month, d.we, d.l1, d.l7, d.m7])
    yl = np.log1p(d.S.to_numpy())
    beta = np.linalg.lstsq(X, yl, rcond=None)[0]
    fitted = np.expm1(X @ beta)
    hist = list(d.S.to_numpy()[-7:])
    last = pd.Timestamp(d.Date.max())
    fut = []
    for h in range(1, 31):
        day = last + pd.Timedelta(days=h)
        r = hist[-7:]
        f = np.array([1, day.toordinal(), day.dayofweek, day.month, int(day.dayofweek >= 5), r[-1],
                      r[0] if len(r) >= 7 else r[-1], np.mean(r)])
        p = float(np.expm1(f @ beta))
        fut.append(p)
        hist.append(p)
    out = rc.recursive_forecast(demand_small).where(F.col("Product_ID") == prod).orderBy("Date").toPandas()
    np.testing.assert_allclose(out[out.kind == "fitted"].value.to_numpy(), fitted, rtol=1e-6)
    np.testing.assert_allclose(out[out.kind == "forecast"].value.to_numpy(), fut, rtol=1e-6)
