"""Every product of the input has a row of every model."""

import datetime as dt

import numpy as np
import pytest

from demandlens.forecast import pooled, recursive, ridge, seasonal, trend
from tests.test_operators import demand_frame

D0 = dt.date(2023, 1, 2)


@pytest.fixture(scope="module")
def seven(spark):
    draw = np.random.default_rng(1)
    rows = [{"Product_ID": f"d{n}", "Date": D0 + dt.timedelta(days=i), "Demand": float(draw.integers(20, 90))} for n in (1, 5, 12, 20, 35, 90) for i in range(n)]
    rows += [{"Product_ID": "same", "Date": D0 + dt.timedelta(days=i), "Demand": 7.0} for i in range(60)]
    return demand_frame(spark, rows).cache()


@pytest.mark.parametrize(("name", "missing"), [
    ("trend", {"d1": "too_short", "same": "constant"}),
    ("ridge", {}),
    ("recursive", {"d1": "too_short", "d5": "too_short", "d12": "too_short", "d20": "too_short", "same": "constant"}),
    ("boosted", {"d1": "too_short", "d5": "too_short", "d12": "too_short"}),
    ("lookback", {"d1": "too_short", "d5": "too_short", "d12": "too_short", "d20": "too_short", "d35": "too_short"}),
    ("seasonal", {"d1": "too_short", "d5": "too_short", "d12": "too_short", "d20": "too_short"})])
def test_each_product_has_a_row(seven, name, missing):
    model = {"trend": trend.trend_forecast, "ridge": ridge.ridge_forecast, "recursive": recursive.recursive_forecast, "lookback": pooled.lookback_forecast,
             "seasonal": seasonal.seasonal_forecast, "boosted": lambda df: pooled.boosted_forecast(df, max_iter=2, depth=2)}[name]
    rows = model(seven).collect()
    assert {r.Product_ID for r in rows} == {"d1", "d5", "d12", "d20", "d35", "d90", "same"}
    none = [r for r in rows if r.kind == "none"]
    assert {r.Product_ID: r.status for r in none} == missing and len(none) == len(missing) and all(r.Date is None and r.value is None for r in none)
    ok = {p: [r for r in rows if r.Product_ID == p and r.kind == "forecast"] for p in {r.Product_ID for r in rows} - set(missing)}
    assert all(len(own) == 30 and all(r.status == "ok" and np.isfinite(r.value) for r in own) for own in ok.values())


def test_boosted_recursion_follows_the_model(seven):
    """M4's forecast days equal a plain loop over the fitted trees, and the fit beats the mean."""
    from pyspark.ml.linalg import Vectors

    from demandlens.forecast.series import daily_checkpoint

    train = pooled.boosted_frame(daily_checkpoint(seven))
    model = pooled.boosted_model(train, max_iter=5, depth=3)
    trees = model.stages[1]
    got = {}
    for r in pooled.boosted_rollout(train, model, 12).where("kind = 'forecast'").collect():
        got.setdefault(r.Product_ID, []).append((r.Date, r.value))
    own = {}
    for r in train.collect():
        own.setdefault(r.Product_ID, []).append(r)
    assert got.keys() == own.keys() == {"d20", "d35", "d90", "same"}
    for name, rows in own.items():
        rows.sort(key=lambda r: r.Date)
        hist, day = [r.smoothed for r in rows][-7:], rows[-1].Date
        for at, value in sorted(got[name]):
            day += dt.timedelta(days=1)
            last = hist[-7:]
            x = [float(day.weekday()), float(day.month), float(day.weekday() >= 5), last[-1], last[0] if len(last) >= 7 else last[-1], sum(last) / len(last),
                 rows[0].level, rows[0].spread]
            hist.append(float(np.expm1(trees.predict(Vectors.dense(x)))))
            assert at == day and value == pytest.approx(hist[-1], rel=1e-9)
    fitted = model.transform(train).select("ly", "prediction").toPandas()
    assert ((fitted.ly - fitted.prediction) ** 2).mean() < 0.6 * fitted.ly.var()
