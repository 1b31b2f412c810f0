"""M9: sparse change points, widening band, and the solver under both."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.forecast import seasonal, sparse
from tests.test_operators import demand_frame

D0 = dt.date(2021, 1, 1)


def test_solver_meets_the_optimality_conditions():
    draw = np.random.default_rng(3)
    n, k = 400, 12
    sp, ridge = np.arange(2, 8), np.r_[0, 0, np.zeros(6), np.full(4, 5.0)]
    a, c, yy = [], [], []
    for _ in range(9):
        x = np.column_stack([np.ones(n), np.arange(n) / n, draw.normal(size=(n, k - 2)).cumsum(0) / 20])
        y = x @ draw.normal(size=k) * draw.integers(0, 2) + draw.normal(size=n)
        a.append(x.T @ x), c.append(x.T @ y), yy.append(y @ y)
    a, c, yy = np.array(a), np.array(c), np.array(yy)
    beta, weight, sse = sparse.sparse_ridge(a, c, yy, np.full(9, n), ridge, sp, 0.05)
    slope = sparse.gradient(a, c, beta, ridge)
    free = np.setdiff1d(np.arange(k), sp)
    assert np.abs(slope[:, free]).max() < 1e-7
    on = beta[:, sp] != 0
    assert 0 < on.sum() < on.size
    assert (np.abs(slope[:, sp]) <= weight[:, None] + 1e-7).all()
    assert np.abs(slope[:, sp] - weight[:, None] * np.sign(beta[:, sp]))[on].max() < 1e-7
    assert sse == pytest.approx([y - 2 * b @ u + b @ m @ b for m, u, y, b in zip(a, c, yy, beta, strict=True)])
    none = sparse.sparse_ridge(a[:0], c[:0], yy[:0], np.empty(0), ridge, sp, 0.05)
    assert none[0].shape == (0, k)


@pytest.fixture(scope="module")
def kinked(spark):
    n = 600
    at = round((int(n * 0.8) - 1) * 9 / 15)  # the ninth change point
    draw = np.random.default_rng(0)
    rows = []
    for name, kink in (("kink", 2.0), ("line", 0.0)):
        for i in range(n):
            y = np.exp(3 + 0.3 * i / (n - 1) + kink * max(i - at, 0) / (n - 1) + 0.02 * draw.normal())
            rows.append({"Product_ID": name, "Date": D0 + dt.timedelta(days=i), "Demand": float(y)})
    return demand_frame(spark, rows).cache()


def test_one_kink_is_one_change_point(kinked):
    got = {r.Product_ID: r["values"] for r in seasonal.coefficients(kinked).collect()}
    hinges = {p: np.array(v["beta"][2:2 + seasonal.N_CHANGEPOINTS]) for p, v in got.items()}
    assert np.flatnonzero(hinges["kink"]).tolist() == [8] and 1 < hinges["kink"][8] < 2  # the prior shrinks the change
    assert np.abs(hinges["line"]).sum() < 0.05
    rest = {r.Product_ID: r for r in seasonal.optimality(kinked).collect()}
    assert all(r.free_at_rest and r.hinges_at_rest for r in rest.values()) and rest["kink"].slope_changes == 1


def test_band_widens_with_the_horizon(kinked):
    coefs = seasonal.coefficients(kinked, 300)
    out = seasonal.future(coefs, 300).orderBy("Product_ID", "Date").collect()
    wide = [np.log(r.yhat_upper / r.yhat_lower) for r in out if r.Product_ID == "kink"]
    flat = [np.log(r.yhat_upper / r.yhat_lower) for r in out if r.Product_ID == "line"]
    assert len(wide) == 300 and np.mean(wide[200:]) > 1.3 * np.mean(wide[100:200]) > 1.5 * np.mean(wide[:100])
    assert np.mean(flat[200:]) == pytest.approx(np.mean(flat[:100]), rel=0.05)  # without slope changes only noise is left
    again = seasonal.future(coefs.repartition(3), 300).orderBy("Product_ID", "Date").collect()
    assert [(r.Product_ID, r.Date, r.yhat_lower) for r in again] == [(r.Product_ID, r.Date, pytest.approx(r.yhat_lower)) for r in out]
    assert [s.yhat_upper for s in again] == pytest.approx([r.yhat_upper for r in out], rel=1e-12)


def test_future_holidays_follow_the_table(spark):
    rows = [{"Product_ID": "A", "Date": D0 + dt.timedelta(days=i), "Public_Holiday": int(i == 40)} for i in range(41)]
    flags = {r.ds: (r.hol_m1, r.hol_0, r.hol_p1) for r in seasonal.holiday_flags(demand_frame(spark, rows)).collect()}
    assert flags == {D0 + dt.timedelta(days=39): (1, 0, 0), D0 + dt.timedelta(days=40): (0, 1, 0), D0 + dt.timedelta(days=41): (0, 0, 1)}


def test_no_regressors_and_no_products(spark):
    rows = [{"Product_ID": "A", "Date": D0 + dt.timedelta(days=i), "Demand": 10.0 + i % 7} for i in range(60)]
    bare = demand_frame(spark, rows).select("Date", "Product_ID", "Demand")
    assert seasonal.seasonal_forecast(bare).where("kind = 'forecast'").count() == 30
    assert seasonal.seasonal_forecast(bare.where(F.lit(False))).count() == 0
