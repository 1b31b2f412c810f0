"""Hand-made frames for the edge cases of SURVEY §2.12 (FIXTURES §4)."""

import datetime as dt
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.forecast import series as S
from demandlens.forecast import trend
from demandlens.functions import bins
from demandlens.operators.analytics import campaign as cp
from demandlens.operators.analytics import demand as dm
from demandlens.operators.analytics import overview as ov
from demandlens.operators.analytics import price as pr
from demandlens.operators.analytics import stock as st
from demandlens.operators.filters import FilterParams, apply_filters, below_quantile

D0 = dt.date(2024, 1, 1)


def _dec(v, scale):
    return None if v is None else decimal.Decimal(str(round(v, scale)))


def demand_frame(spark, rows):
    """Rows as dicts; missing fields get neutral defaults."""
    out = []
    for i, r in enumerate(rows):
        out.append((
            r.get("Date", D0), r.get("Product_ID", "A"), r.get("Demand", 10.0),
            _dec(r.get("Price", 60.0), 2), _dec(r.get("Discount", 0.1), 2), r.get("Marketing_Campaign", "C1"),
            _dec(r.get("Marketing_Effect", 0.5), 3), r.get("Seasonal_Trend", "Winter"),
            r.get("Stock_Availability", 50.0), r.get("Public_Holiday", 0), _dec(r.get("Competitor_Price", 55.0), 2),
            r.get("Row_ID", f"r{i}")))
    return spark.createDataFrame(
        out, "Date date, Product_ID string, Demand double, Price decimal(12,2), Discount decimal(4,2), Marketing_Campaign string, Marketing_Effect decimal(5,3),"
             " Seasonal_Trend string, Stock_Availability double, Public_Holiday int, Competitor_Price decimal(12,2), Row_ID string")


def test_cut_right_closed_and_lowest(spark):
    vals = [0.0, 5.0, 15.0, 30.0, 50.0, 90.0, 100.0, 200.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select("x", bins.cut(F.col("x"), bins.PRICE_EDGES, False).alias("a"),
                    bins.cut(F.col("x"), bins.PRICE_EDGES, True).alias("b"),
                    bins.cut(F.col("x"), bins.STOCK_EDGES, True).alias("s")).collect()
    by = {r.x: r for r in got}
    assert by[0.0].a is None and by[0.0].b == 1          # Q1: 0 only with include_lowest
    assert by[50.0].a == 1 and by[100.0].a == 2 and by[200.0].a == 3
    assert by[30.0].s == 1 and by[90.0].s == 3 and by[100.0].s == 4
    assert by[None].a is None


def test_zero_discount_vanishes_from_pct_band(spark):
    df = demand_frame(spark, [{"Discount": 0.0}, {"Discount": 0.05}, {"Discount": 0.3}])
    prof = ov.feature_demand_profile(df, "Discount").collect()
    assert sum(r.n for r in prof) == 2


def test_equal_quartiles_do_not_fail(spark):
    df = demand_frame(spark, [{"Price": 80.0, "Demand": float(i + 1)} for i in range(6)])
    prof = ov.feature_demand_profile(df, "Price").collect()
    assert len(prof) == 1 and prof[0].n == 6 and prof[0].n_bands == 1


def test_tertile_falls_back_to_equal_width(spark):
    df = demand_frame(spark, [{"Stock_Availability": 50.0, "Demand": 1.0 + i} for i in range(5)])
    out = bins.tertile_band(df, "Stock_Availability").collect()
    assert {r.band for r in out} == {2}  # constant column: widened range, middle bin


def test_null_campaign_dropped_from_groupings(spark):
    df = demand_frame(spark, [{"Marketing_Campaign": "X", "Demand": 2.0},
                              {"Marketing_Campaign": "Y", "Demand": 3.0},
                              {"Marketing_Campaign": None, "Demand": 5.0}])
    share = {r.Marketing_Campaign: r.share_pct for r in dm.campaign_demand_share(df).collect()}
    assert share == {"Y": 60.0, "X": 40.0}
    roll = cp.seasonal_campaign_rollup(df).collect()
    total = [r for r in roll if r.level == 3][0]
    assert total.demand == 5.0
    kpi = cp.kpi_campaign(df).collect()[0]
    assert kpi.best_campaign in ("X", "Y")


def test_null_price_dropped_by_range_filter(spark):
    df = demand_frame(spark, [{"Price": None}, {"Price": 10.0}, {"Discount": None}])
    out = apply_filters(df, FilterParams(price_range=(0, 100), discount_range_pct=(0, 100)))
    assert out.count() == 1


def test_ties_go_to_smallest_key(spark):
    rows = [{"Date": D0 + dt.timedelta(days=7 * w), "Demand": 10.0} for w in range(3)]
    rows += [{"Date": D0 + dt.timedelta(days=7), "Demand": 0.5}]  # week 2 only slightly larger
    df = demand_frame(spark, rows[:3])
    assert dm.kpi_demand(df).collect()[0].peak_week == 1
    df2 = demand_frame(spark, [{"Product_ID": "B", "Demand": 5.0}, {"Product_ID": "A", "Demand": 5.0}])
    assert pr.kpi_price(df2.withColumn("Price", F.lit(decimal.Decimal("1.00")).cast("decimal(12,2)"))) \
        .collect()[0].top_product == "A"


def test_year_turn_iso_week(spark):
    days = [dt.date(2023, 12, 30) + dt.timedelta(days=i) for i in range(5)]
    df = demand_frame(spark, [{"Date": d} for d in days] + [{"Date": dt.date(2025, 1, 2)}])
    weeks = {r.week: r.total for r in dm.weekly_variation(df).collect()}
    # 2024-01-01 … 2024-01-03 and 2025-01-02 are ISO week 1; 2023-12-30/31 are week 52
    assert weeks[1] == 40.0 and weeks[52] == 20.0


def test_moving_averages_short_series(spark):
    daily = spark.createDataFrame([("A", D0 + dt.timedelta(days=i), float(i + 1)) for i in range(5)],
                                  "Product_ID string, Date date, Demand double")
    out = daily.select("Date", S.moving_avg("Demand", 7).alias("m"),
                       S.moving_avg("Demand", 7, strict=True).alias("s")).orderBy("Date").collect()
    assert [r.m for r in out] == [1.0, 1.5, 2.0, 2.5, 3.0]
    assert all(r.s is None for r in out)


def test_gappy_series_calendar_fill(spark):
    days = [D0 + dt.timedelta(days=2 * i) for i in range(20)]
    daily = spark.createDataFrame([("A", d, 1.0) for d in days], "Product_ID string, Date date, Demand double")
    filled = S.fill_calendar(daily)
    assert filled.count() == 39 and filled.where("Demand = 0").count() == 19


def test_strict_quantile_cut(spark):
    daily = spark.createDataFrame([("A", D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate([1] * 10 + [100])],
                                  "Product_ID string, Date date, Demand double")
    assert below_quantile(daily, 0.99).count() == 10


def test_exact_line_recovered(spark):
    rows = [{"Date": D0 + dt.timedelta(days=i), "Demand": float(np.expm1(0.5 + 0.01 * i))} for i in range(60)]
    rows.append({"Date": D0 + dt.timedelta(days=60), "Demand": 1e6})  # the 99 % cut removes this day
    df = demand_frame(spark, rows)
    m = trend.trend_metrics(df).collect()[0]
    assert m.r2 == pytest.approx(1.0, abs=1e-9)
    coef = trend.trend_fit(df).collect()[0]
    assert coef.slope == pytest.approx(0.01, rel=1e-9)


def test_weekly_pattern_decomposes(spark):
    pattern = [3, -1, 0, 2, -2, 1, -3]
    daily = spark.createDataFrame([("A", D0 + dt.timedelta(days=i), 10 + 0.1 * i + pattern[i % 7])
                                   for i in range(70)], "Product_ID string, Date date, Demand double")
    out = S.decompose_additive(daily).where(F.col("trend").isNotNull()).collect()
    assert max(abs(r.residual) for r in out) < 1e-9
    assert sum(r.Demand for r in out) == pytest.approx(sum(r.trend + r.seasonal + r.residual for r in out))


def test_holiday_window_all_products(spark):
    rows = [("A", D0 + dt.timedelta(days=i), 1.0, 1 if i == 5 else 0) for i in range(10)]
    rows += [("B", D0 + dt.timedelta(days=i), 1.0, 0) for i in range(10)]
    daily = spark.createDataFrame(rows, "Product_ID string, Date date, Demand double, Public_Holiday int")
    out = S.holiday_window(daily).where("Product_ID = 'B'").orderBy("Date").collect()
    assert [r.hol_m1 for r in out][4] == 1 and [r.hol_0 for r in out][5] == 1 and [r.hol_p1 for r in out][6] == 1
    assert sum(r.hol_0 for r in out) == 1


def test_surface_global_mean_fallback(spark):
    corners = [(10.0, 0.0), (10.0, 0.5), (200.0, 0.0), (200.0, 0.5)]
    df = demand_frame(spark, [{"Price": p, "Discount": d, "Demand": float(i + 1)} for i, (p, d) in enumerate(corners)])
    out = {(r.i, r.j): r.demand for r in pr.price_discount_surface(df).collect()}
    assert len(out) == 400
    assert out[(0, 0)] == 1.0 and out[(19, 19)] == 4.0
    assert out[(10, 10)] == 2.5  # no neighbour → global mean


def test_radar_constant_is_50(spark):
    df = demand_frame(spark, [{"Marketing_Campaign": c, "Demand": 4.0} for c in ("X", "Y")])
    r = cp.campaign_radar(df).collect()
    assert all(x.demand_score == 50.0 for x in r)


def test_shares_sum_to_100(spark, demand_small):
    assert sum(r.share_pct for r in st.stock_category_counts(demand_small).collect()) == pytest.approx(100.0)
    roll = cp.seasonal_campaign_rollup(demand_small).collect()
    total = [r.demand for r in roll if r.level == 3][0]
    assert sum(r.demand for r in roll if r.level == 1) == pytest.approx(total)


def test_ewma_matches_pandas(spark, demand_small):
    d = S.daily_series(demand_small)
    got = S.ewma(d, "Demand", 5.0).toPandas().sort_values(["Product_ID", "Date"])
    exp = got.groupby("Product_ID")["Demand"].transform(lambda s: s.ewm(span=5, adjust=False).mean())
    np.testing.assert_allclose(got["ewma"].to_numpy(), exp.to_numpy(), rtol=1e-10)


def test_scale_inverse_identity(spark, demand_small):
    d = S.minmax_scale(S.daily_series(demand_small), "Demand")
    back = d.select((S.minmax_inverse(F.col("scaled"), F.col("_mn"), F.col("_mx")) - F.col("Demand")).alias("e"))
    assert back.agg(F.max(F.abs("e"))).collect()[0][0] < 1e-9
