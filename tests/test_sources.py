"""Sources and sinks (S1–S6), derived columns and small helpers (P, F13, J5, W8)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from demandlens.forecast import evaluate as ev
from demandlens.forecast import pooled
from demandlens.forecast import series as S
from demandlens.functions import derive
from demandlens.operators.filters import bin_equals, future_rows
from demandlens.sources import demand as src

CSV = """Date,Product_ID,Demand,Price,Discount,Marketing_Campaign,Marketing_Effect,Seasonal_Trend,Stock_Availability,Public_Holiday,Competitor_Price,Row_ID
2024-01-01,P1,5,10.50,0.10,Spring Sale,0.300,Winter,40,1,9.99,a
2024-01-02,P1,,11.00,0.00,,0.100,Winter,10,0,10.10,b
2024-01-03,P2,-1,12.00,0.20,Spring Sale,0.500,Winter,95,0,12.50,c
"""


def _tmp():
    return tempfile.mkdtemp(prefix="demandlens-test-")


def test_load_csv_typed(spark):
    path = os.path.join(_tmp(), "demand.csv")
    with open(path, "w") as fh:
        fh.write(CSV)
    df = src.load_demand(spark, path)
    assert dict(df.dtypes)["Date"] == "date" and dict(df.dtypes)["Price"] == "double"
    rows = df.orderBy("Row_ID").collect()
    assert rows[0].Date == dt.date(2024, 1, 1) and rows[1].Demand is None and rows[1].Marketing_Campaign is None


def test_cleaned_copy_roundtrip(spark):
    path = os.path.join(_tmp(), "demand.csv")
    with open(path, "w") as fh:
        fh.write(CSV)
    out = os.path.join(_tmp(), "clean")
    src.write_cleaned(src.load_demand(spark, path), out)
    back = src.load_cleaned(spark, out)
    assert [r.Row_ID for r in back.collect()] == ["a"]


def test_normalise_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0)], "` Demand ` double, `Price ` double, Public_Holiday int")
    out, present = src.normalise_columns(df)
    assert out.columns == ["Demand", "Price", "Public_Holiday"]
    assert present == {"Demand": "sum", "Price": "mean", "Public_Holiday": "max"}


def test_filter_domain(demand_small):
    opts = demand_small.transform(src.filter_options).collect()
    kinds = {r.kind for r in opts}
    assert kinds == {"product", "campaign"}
    lim = src.filter_limits(demand_small).collect()[0]
    assert lim.min_date <= lim.max_date and lim.max_price > 0


def test_result_records_stream(demand_small):
    recs = src.result_records(demand_small)
    assert "Product_ID" in next(recs)
    assert sum(1 for _ in recs) == demand_small.count() - 1


def test_columns_by_name_and_rejected_rows(spark):
    path = os.path.join(_tmp(), "demand.csv")
    with open(path, "w") as fh:
        fh.write("Discount, Price ,Product_ID,Demand,Date,Marketing_Campaign,Marketing_Effect,Seasonal_Trend,Stock_Availability,"
                 "Public_Holiday,Competitor_Price,Extra\n"
                 "0.1499,10.559,P1,5,2024-01-01,,0.3,Winter,40,1,9.99,x\n"
                 "0.2,11,P2,x5,2024-01-02,,0.1,Winter,10,0,10.1,y\n"
                 "0.2,11,P3,7,2024-13-02,,0.1,Winter,10,zero,10.1,y\n")
    good = src.load_demand(spark, path).collect()
    assert [(r.Price, r.Discount, r.Demand) for r in good] == [(10.559, 0.1499, 5.0)] and good[0].Row_ID
    bad = {r.Product_ID: r.bad_columns for r in src.rejected_demand(spark, path).collect()}
    assert bad == {"P2": ["Demand"], "P3": ["Date", "Public_Holiday"]}
    with open(path, "w") as fh:
        fh.write("Date,Product_ID\n2024-01-01,P1\n")
    with pytest.raises(ValueError, match="Demand"):
        src.load_demand(spark, path)


def test_model_store_roundtrip(spark, demand_small):
    frame = pooled._lookback_frame(demand_small)
    model, _ = pooled.lookback_model(frame)
    path = os.path.join(_tmp(), "lookback")
    pooled.save_model(model, path)
    back = pooled.load_model(path, LinearRegressionModel)
    assert list(back.coefficients) == pytest.approx(list(model.coefficients))
    assert pooled.load_model(os.path.join(_tmp(), "missing"), LinearRegressionModel) is None


def test_calendar_and_labels(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30), 1, 3.0, 50.0)],
                               "Date date, Public_Holiday int, Demand double, Stock_Availability double")
    r = derive.with_calendar_parts(df).select(
        "Year", "Week", "Month", "Quarter", "Month_Name", "Weekday",
        derive.month_label("Month").alias("tr"), derive.holiday_label().alias("hl"),
        derive.day_of_week().alias("dow"), derive.is_weekend().alias("we"),
        derive.date_ordinal().alias("ord"), derive.week_start().alias("ws"),
        derive.stock_efficiency().alias("eff")).collect()[0]
    assert (r.Year, r.Week, r.Month, r.Quarter) == (2024, 1, 12, 4)
    assert (r.Month_Name, r.Weekday, r.tr, r.hl) == ("December", "Monday", "Aralık", "Holiday")
    assert (r.dow, r.we, r.ord, r.ws) == (0, 0, dt.date(2024, 12, 30).toordinal(), dt.date(2024, 12, 30))
    assert r.eff == "excess"  # 50 / (3 + 1) > 2


def test_ds_y_future_rows_and_align(spark):
    hist = spark.createDataFrame([("A", dt.date(2024, 1, d), float(d)) for d in (1, 2, 3)],
                                 "Product_ID string, Date date, Demand double")
    fc = spark.createDataFrame([("A", dt.date(2024, 1, d), 1.0) for d in (2, 3, 4, 5)],
                               "Product_ID string, Date date, value double")
    renamed = derive.to_ds_y(hist)
    assert renamed.columns == ["Product_ID", "ds", "y"]
    fut = future_rows(fc.withColumnRenamed("Date", "ds"), renamed)
    assert sorted(r.ds.day for r in fut.collect()) == [4, 5]
    pairs = S.align_actual_fitted(hist, fc)
    assert pairs.count() == 2
    assert fc.where(bin_equals("value", 1.0)).count() == 4


def test_head_and_tail(spark):
    daily = spark.createDataFrame([("A", dt.date(2024, 1, d), float(d)) for d in range(1, 11)],
                                  "Product_ID string, Date date, Demand double")
    assert sorted(r.Demand for r in S.tail_n(daily, 7, last=False).collect()) == [float(i) for i in range(1, 8)]
    assert sorted(r.Demand for r in S.tail_n(daily, 7).collect()) == [float(i) for i in range(4, 11)]


def test_grades(spark):
    m = spark.createDataFrame([("A", 10.0, 5.0, 0.75), ("B", 30.0, 15.0, 0.6), ("C", 50.0, 25.0, 0.1)],
                              "Product_ID string, rmse_pct double, mape double, r2 double")
    g = {r.Product_ID: (r.rmse_grade, r.mape_grade, r.r2_grade) for r in ev.grade_metrics(m).collect()}
    assert g == {"A": ("good", "good", "good"), "B": ("fair", "fair", "fair"), "C": ("poor", "poor", "poor")}
    gs = {r.Product_ID: r.r2_grade for r in ev.grade_metrics(m, ev.SEASONAL_THRESHOLDS).collect()}
    assert gs["A"] == "fair"


def test_checkpoint_dir_from_session(spark):
    from demandlens.session import checkpoint_dir
    assert checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_backtest_keys_restored(demand_small):
    from demandlens.forecast import backtest as bt
    out = bt.rolling_backtest(demand_small, 2, 30).select("Product_ID", "fold", "model").collect()
    assert {r.fold for r in out} <= {1, 2}
    assert all("|" not in r.Product_ID for r in out)
    assert {r.model for r in out} == {"trend", "poly_ridge", "recursive_linear", "lookback", "seasonal_regression"}
