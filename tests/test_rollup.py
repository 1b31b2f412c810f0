"""The stored roll-up: equal answers, and updates that touch only their months."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from demandlens.operators.analytics import campaign, demand, overview, stored
from demandlens.operators.filters import FilterParams
from demandlens.sources.rollup import DailyRollup
from tests.test_operators import demand_frame


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def answers(states):
    return [sorted(map(tuple, df.collect()), key=str) for df in (
        stored.monthly_performance(states), stored.daily_demand(states, by_product=True), stored.weekly_variation(states), stored.campaign_weekly_timeline(states),
        stored.seasonal_campaign_rollup(states), stored.campaign_demand_share(states), stored.yearly_demand(states), stored.daily_features(states))]


@pytest.fixture(scope="module")
def facts(demand_small):
    return demand_small.where("Date < '1996-07-01'").cache()


def test_one_new_day_touches_one_partition(spark, facts, tmp_path):
    day = dt.date(1995, 11, 3)
    kept = DailyRollup.build(facts.where(F.col("Date") != day), str(tmp_path / "rollup"))
    before = files(kept.path)
    assert kept.merge(facts.where(F.col("Date") == day)) == [199511]
    changed = before ^ files(kept.path)
    assert changed and all("month_of_day=199511" in f for f in changed)
    whole = DailyRollup.build(facts, str(tmp_path / "whole"))
    assert answers(kept.load()) == answers(whole.load())
    assert kept.merge(facts.limit(0)) == []


def test_new_rows_of_known_and_new_months(spark, facts, tmp_path):
    first, rest = facts.where("xxhash64(Row_ID) % 2 = 0 AND Date < '1996-03-01'"), facts.where("NOT (xxhash64(Row_ID) % 2 = 0 AND Date < '1996-03-01')")
    kept = DailyRollup.build(first, str(tmp_path / "rollup"))
    kept.merge(rest)
    assert answers(kept.load()) == answers(DailyRollup.build(facts, str(tmp_path / "whole")).load())


def test_rebuilt_months_forget_old_rows(spark, facts, tmp_path):
    kept = DailyRollup.build(facts, str(tmp_path / "rollup"))
    fewer = facts.where("Date NOT BETWEEN '1995-05-10' AND '1995-06-30'")
    before = files(kept.path)
    kept.rebuild(fewer, [199505, 199506])
    assert all("199505" in f or "199506" in f for f in before ^ files(kept.path))
    assert answers(kept.load()) == answers(DailyRollup.build(fewer, str(tmp_path / "whole")).load())


def test_filters_reach_the_states(spark, facts, tmp_path):
    states = DailyRollup.build(facts, str(tmp_path / "rollup")).load()
    bar = FilterParams(products=["Brand#11", "Brand#12", "Brand#23"], campaigns=["1-URGENT", "5-LOW"], start_date="1995-02-10", end_date="1995-08-20")
    for of_states, of_facts in ((stored.monthly_performance, overview.monthly_performance), (stored.daily_demand, demand.daily_demand),
                                (stored.seasonal_campaign_rollup, campaign.seasonal_campaign_rollup)):
        assert sorted(map(tuple, of_states(states, bar).collect()), key=str) == sorted(map(tuple, of_facts(facts, bar).collect()), key=str)
    plan = stored.daily_demand(states, bar)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_of_day" in plan
    with pytest.raises(ValueError, match="need the facts"):
        stored.daily_demand(states, FilterParams(price_range=(0, 10)))


def test_odd_rows(spark, tmp_path):
    rows = demand_frame(spark, [{"Demand": None}, {"Demand": -1.0}, {"Demand": 3.0}, {"Demand": 3.0, "Marketing_Campaign": None}, {"Demand": 5.0, "Price": None}])
    states = DailyRollup.build(rows, str(tmp_path / "rollup")).load()
    assert stored.daily_demand(states).first().demand == 11.0 and stored.daily_features(states).first().Demand == 10.0
    week = stored.weekly_variation(states).first()
    assert (week.total, week["mean"], week["std"]) == (11.0, 3.67, 1.15)
    empty = DailyRollup.build(rows.limit(0), str(tmp_path / "none"))
    assert empty.merge(rows) == [202401] and stored.daily_demand(empty.load()).first().demand == 11.0
