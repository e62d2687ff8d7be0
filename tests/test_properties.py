"""Property tests: distributed operators equal pandas on random data."""

import math

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.operators import profile
from tabulon.operators.ranking import exact_quantiles

values = st.lists(st.one_of(st.none(), st.integers(-50, 50).map(float),
                            st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60)


@settings(max_examples=12, deadline=None)
@given(values, st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]))
def test_quantile_equals_pandas(spark, xs, p):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = exact_quantiles(df, ["x"], [p]).collect()
    s = pd.Series(xs, dtype="float64").dropna()
    if s.empty:
        assert got == []
    else:
        assert math.isclose(got[0]["value"], s.quantile(p), rel_tol=1e-9, abs_tol=1e-9)


@settings(max_examples=10, deadline=None)
@given(values)
def test_describe_equals_pandas(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = profile.describe(df).first()
    s = pd.Series(xs, dtype="float64").dropna()
    assert r["count"] == len(s)
    if len(s):
        assert math.isclose(r["mean"], s.mean(), rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(r["q50"], s.median(), rel_tol=1e-9, abs_tol=1e-9)
    if len(s) > 1:
        assert math.isclose(r["std"], s.std(), rel_tol=1e-6, abs_tol=1e-6)
