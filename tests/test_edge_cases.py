"""FIXTURES §4 edge cases through every per-column operator."""

import math

import pytest

from tabulon.operators import charts, clean, profile, stats, trend

SCHEMA = "x double, c double, z double, t string"


def frames(spark):
    rows = [(1.0, 5.0, None, "a"), (float("nan"), 5.0, None, " a"), (3.0, 5.0, None, None),
            (None, 5.0, None, "b"), (10.0, 5.0, None, "b")]
    return {
        "mixed": spark.createDataFrame(rows, SCHEMA),
        "one": spark.createDataFrame(rows[:1], SCHEMA),
        "empty": spark.createDataFrame([], SCHEMA),
    }


OPS = {
    "describe": profile.describe, "skew": profile.skew_kurtosis,
    "profile": profile.profile_columns, "summary": profile.basic_summary,
    "top": profile.top_values, "unique": profile.unique_counts,
    "outliers": profile.outliers_iqr, "bytes": profile.column_bytes,
    "corr": stats.correlation_matrix, "dist": stats.distribution,
    "hist": charts.histogram, "box": charts.box_plot, "kde": charts.kde,
    "bar": charts.bar_chart, "fill": clean.fill_missing, "z": clean.zscore,
    "encode": clean.encode_categorical, "money": clean.text_to_number,
    "clean": clean.clean_data,
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_operator_survives_edge_frames(spark, name):
    for kind, df in frames(spark).items():
        out = OPS[name](df)
        out.collect()  # runs; results checked below for the interesting ones


def test_edge_values(spark):
    df = frames(spark)["mixed"]
    d = {r["column"]: r for r in profile.describe(df).collect()}
    assert d["x"]["count"] == 3 and d["x"]["q50"] == 3.0  # NaN and NULL both missing
    assert d["c"]["std"] == 0.0 and d["z"]["count"] == 0 and d["z"]["mean"] is None
    s = {r["column"]: r for r in profile.skew_kurtosis(df).collect()}
    assert s["c"]["skewness"] == 0.0 and s["z"]["skewness"] is None
    m = {(r["var1"], r["var2"]): r["r"] for r in stats.correlation_matrix(df).collect()}
    assert m[("x", "c")] is None and m[("x", "z")] is None and math.isclose(m[("x", "x")], 1.0)
    filled = clean.fill_missing(df).collect()
    assert {r["x"] for r in filled} == {1.0, 3.0, 10.0}
    assert all(r["z"] is None for r in filled)        # all-missing numeric stays missing
    assert {r["t"] for r in filled} == {"a", " a", "b"}
    assert clean.clean_data(df).columns == ["x", "c", "t"]  # all-NULL z dropped
    one = profile.describe(frames(spark)["one"]).collect()
    assert {r["column"]: r["std"] for r in one}["x"] is None  # n = 1
    assert profile.basic_summary(frames(spark)["empty"]).first()["total_rows"] == 0
    empty = frames(spark)["empty"]
    assert trend.trends(empty.withColumn("d", empty["x"].cast("timestamp"))).count() == 0
