"""The rank index: balanced ranges whatever the values, several columns at once, few exchanges."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandlens.functions.quantiles import quantile_table, rank_index
from demandlens.operators.analytics import overview


def test_an_extreme_value_leaves_ranges_balanced(spark):
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select((F.col("id") / 7).alias("v")).union(spark.createDataFrame([(1e12,)], "v double"))
        sizes = [r["count"] for r in rank_index(rows, [], [F.col("v")]).groupBy("_part").count().collect()]
        assert len(sizes) > 4 and max(sizes) < 0.4 * sum(sizes)
        got = quantile_table(rows, [], {"q": ("v", [0.0, 0.25, 0.5, 1.0])}).first().q
        want = np.quantile(np.r_[np.arange(20_000) / 7, 1e12], [0.0, 0.25, 0.5, 1.0])
        assert got == pytest.approx(want.tolist(), rel=1e-12)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


def test_several_columns_share_an_index(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", 5.0, 2.0), (None, 7.0, 4.0), (None, 7.0, 4.0), ("c", None, None)], "g string, x double, y double")
    got = {r.g: (r.x, r.y) for r in quantile_table(rows, ["g"], {"x": ("x", [0.5]), "y": (F.col("y") * 2, [0.0, 1.0])}).collect()}
    assert got == {"a": ([2.0], [None, None]), "b": ([5.0], [4.0, 4.0]), None: ([7.0], [8.0, 8.0])}


def test_the_price_profile_needs_few_exchanges(demand_small):
    plan = overview.feature_demand_profile(demand_small, "Price")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\b(?:Broadcast)?Exchange\b", plan)) <= 12
    assert "lineitem" not in plan and "SortMergeJoin" not in plan.replace("ReusedExchange", "")
