"""Stored coefficients give the direct forecast; versions, replacement by key, missing products."""

import pytest
from pyspark.sql import functions as F

from demandlens.forecast import pooled, recursive, ridge, seasonal, store, trend

DIRECT = {"trend": trend.trend_forecast, "poly_ridge": ridge.ridge_forecast, "recursive_linear": recursive.recursive_forecast, "seasonal_regression": seasonal.seasonal_forecast}


@pytest.fixture(scope="module")
def some(demand_small):
    return demand_small.where("Product_ID IN ('Brand#11', 'Brand#12', 'Brand#13')").cache()


def rows(df):
    df = df.where("kind <> 'fitted'")
    value = "value" if "value" in df.columns else "yhat"
    return {(r.Product_ID, r.Date): (r[value], r.status) for r in df.collect()}


@pytest.mark.parametrize("model", sorted(store.MODELS))
def test_stored_forecast_equals_the_direct_one(spark, some, tmp_path, model):
    kept = store.CoefficientStore(spark, str(tmp_path / "coefficients"))
    assert kept.version() == 0 and kept.load().count() == 0
    assert kept.fit(model, some) == 1
    asked = some.select("Product_ID").union(spark.createDataFrame([("Brand#none",)], "Product_ID string"))
    got, want = rows(kept.forecast(model, products=asked)), rows(DIRECT[model](some))
    assert got.pop(("Brand#none", None)) == (None, "missing")
    assert got.keys() == want.keys() and len(got) == 90
    for key, (value, status) in want.items():
        assert got[key] == (pytest.approx(value, rel=1e-12), status)
    if model == "seasonal_regression":
        band = {(r.Product_ID, r.Date): (r.yhat_lower, r.yhat_upper) for r in kept.forecast(model).collect()}
        direct = {(r.Product_ID, r.Date): (r.yhat_lower, r.yhat_upper) for r in DIRECT[model](some).where("kind = 'forecast'").collect()}
        assert band.keys() == direct.keys() and all(band[k] == pytest.approx(direct[k], rel=1e-9) for k in band)


def test_saving_replaces_by_key(spark, some, tmp_path):
    kept = store.CoefficientStore(spark, str(tmp_path / "coefficients"))
    kept.fit("trend", some)
    old = {r.Product_ID: r["values"]["slope"][0] for r in kept.load("trend").collect()}
    kept.fit("poly_ridge", some)
    changed = some.where("Product_ID = 'Brand#12'").withColumn("Demand", F.col("Demand") * F.datediff("Date", F.lit("1990-01-01")))
    assert kept.fit("trend", changed) == 3
    new = {r.Product_ID: (r["values"]["slope"][0], r.version) for r in kept.load("trend").collect()}
    assert new["Brand#11"] == (old["Brand#11"], 1) and new["Brand#12"][1] == 3 and new["Brand#12"][0] != old["Brand#12"]
    assert {r.Product_ID: r["values"]["slope"][0] for r in kept.load("trend", version=2).collect()} == old
    packed = kept.compact(str(tmp_path / "packed"))
    assert packed.version() == 1 and packed.load().count() == 6
    assert {r.Product_ID: r["values"]["slope"][0] for r in packed.load("trend").collect()} == {k: v[0] for k, v in new.items()}
    with pytest.raises(ValueError, match="no stored form"):
        kept.save("arima", some)
    with pytest.raises(FileExistsError):
        kept.compact(str(tmp_path / "packed"))


def test_only_an_absent_model_is_missing(spark, tmp_path):
    assert pooled.load_model(str(tmp_path / "none")) is None
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception, match=r"."):
        pooled.load_model(str(tmp_path / "broken"))
