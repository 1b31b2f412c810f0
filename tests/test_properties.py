"""Property tests: banding equals pandas ``cut``; shares and rollups add up."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from demandlens.functions import bins

values = st.lists(st.one_of(st.none(), st.floats(min_value=-10, max_value=300, allow_nan=False).map(lambda v: round(v, 2)),
                            st.sampled_from([0.0, 50.0, 100.0, 200.0])), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(values, st.booleans())
def test_cut_equals_pandas(spark, xs, lowest):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.b for r in df.select("i", bins.cut(F.col("x"), bins.PRICE_EDGES, lowest).alias("b")).collect()}
    exp = pd.cut(pd.Series(xs, dtype=float), bins=bins.PRICE_EDGES, labels=False, include_lowest=lowest, right=True)
    for i, e in enumerate(exp):
        want = None if (e is None or (isinstance(e, float) and math.isnan(e))) else int(e) + 1
        assert got[i] == want, (xs[i], got[i], want)


def _quantile(sorted_xs, q):
    """Linear interpolation at position (n − 1)·q (the SQL engines' formula;
    numpy's formula can land one ulp lower on the same data)."""
    pos = (len(sorted_xs) - 1) * q
    lo, hi = math.floor(pos), math.ceil(pos)
    return sorted_xs[lo] + (sorted_xs[hi] - sorted_xs[lo]) * (pos - lo)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1000, allow_nan=False), min_size=2, max_size=60))
def test_tertiles_equal_pandas_cut_on_quantile_edges(spark, xs):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.band for r in bins.tertile_band(df, "x").collect()}
    s = pd.Series(xs, dtype=float)
    srt = sorted(xs)
    edges = sorted(set(_quantile(srt, q) for q in (0.0, 1 / 3, 2 / 3, 1.0)))
    if len(edges) == 4:   # qcut with three labels
        exp = pd.cut(s, bins=edges, labels=False, include_lowest=True)
    else:                 # labels no longer fit: three equal widths
        exp = pd.cut(s, bins=3, labels=False)
    for i, e in enumerate(exp):
        want = None if e is None or (isinstance(e, (float, np.floating)) and math.isnan(e)) else int(e) + 1
        assert got[i] == want, (xs[i], got[i], want)


def test_exact_quantiles_match_numpy(spark):
    from demandlens.functions.quantiles import exact_quantiles
    draw = np.random.default_rng(4)
    groups = {"one": [3.0], "same": [2.5] * 50, "two": [1.0, 2.0], "whole": draw.integers(0, 9, 3000).astype(float), "wide": draw.normal(0, 1e6, 3000),
              "lumpy": np.concatenate([np.full(900, 5.0), draw.random(100) * 1e-6, [1e9]])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None), ("whole", None)]
    probs = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "v", probs, "q").collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(np.asarray(vs, dtype=float), probs)), rel=1e-12, abs=1e-12)
    assert exact_quantiles(df.where("g = 'none'"), [], "v", probs).count() == 0
