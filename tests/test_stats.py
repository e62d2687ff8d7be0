import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabulon.operators import stats


def xyz(spark):
    return spark.createDataFrame([(x, 2 * x, 11 - x) for x in range(1, 11)],
                                 "x bigint, y bigint, z bigint")


def test_correlation_matrix_and_strong(spark):
    m = {(r["var1"], r["var2"]): r["r"] for r in stats.correlation_matrix(xyz(spark)).collect()}
    assert len(m) == 9
    assert math.isclose(m[("x", "y")], 1.0) and math.isclose(m[("x", "z")], -1.0)
    assert math.isclose(m[("z", "x")], -1.0)
    s = stats.strong_correlations(xyz(spark)).collect()
    assert sorted((r["var1"], r["var2"]) for r in s) == [("x", "y"), ("x", "z"), ("y", "z")]


def test_pairwise_complete_and_constant(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, None, 4.0, 5.0, 7.0],
                        "b": [2.0, 1.0, 3.0, None, 6.0, 5.0],
                        "c": [1.0] * 6})
    df = spark.createDataFrame(pdf)
    m = {(r["var1"], r["var2"]): r["r"] for r in stats.correlation_matrix(df).collect()}
    assert math.isclose(m[("a", "b")], pdf["a"].corr(pdf["b"]), rel_tol=1e-12)
    assert m[("a", "c")] is None  # constant column: pandas gives NaN


def test_normality_normal_vs_uniform(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"normal_data": rng.normal(100, 15, 1000),
                        "uniform_data": rng.uniform(0, 100, 1000)})
    d = {r["column"]: r for r in stats.distribution(spark.createDataFrame(pdf)).collect()}
    assert d["normal_data"]["is_normal"] and d["normal_data"]["p_value"] > 0.05
    assert not d["uniform_data"]["is_normal"] and d["uniform_data"]["p_value"] < 1e-6
    assert math.isclose(d["normal_data"]["median"], float(np.median(pdf["normal_data"])))


def test_normality_small_n(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    r = stats.distribution(df).first()
    assert r["p_value"] is None and r["is_normal"] is False


def test_blocks_equal_pandas_for_many_columns_gaps_and_layouts(spark):
    rng = np.random.default_rng(5)
    n, k = 400, 60
    x = rng.normal(size=(n, k)) + rng.normal(size=(n, 1)) + 1e6 * np.arange(k)
    x[rng.random((n, k)) < 0.3] = np.nan
    x[:, 7] = 0.1  # constant
    x[:, 8] = np.nan
    x[1:, 9] = np.nan  # one value
    pdf = pd.DataFrame(x, columns=[f"c {i}.x" for i in range(k)])
    want = pdf.corr()
    df = spark.createDataFrame(pdf)
    assert df.count() == n
    for parts in (1, 7):
        got = stats.correlation_matrix(df.repartition(parts)).collect()
        assert len(got) == k * k
        for r in got:
            w = want.loc[r["var1"], r["var2"]]
            assert r["r"] is None if math.isnan(w) else math.isclose(r["r"], w, rel_tol=1e-7, abs_tol=1e-9)


def test_one_scan_whatever_the_number_of_columns(spark):
    df = spark.range(100).select(*[(F.col("id") * i % 7).cast("double").alias(f"c{i}") for i in range(50)])
    plan = stats.co_moments(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("MapInArrow") == 1


def test_far_means_merge_without_loss(spark):
    rows = [(1e9 + i % 5, -1e9 + (i % 5) * 2.0) for i in range(1000)]
    cells = stats.co_moments(spark.createDataFrame(rows, "a double, b double").repartition(9), ["a", "b"]).collect()
    c = next(r for r in cells if (r["i"], r["j"]) == (0, 1))
    assert c["n"] == 1000 and math.isclose(c["cxy"], 4000.0) and math.isclose(c["cxx"], 2000.0)


def test_infinite_values_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, float("inf")), (2.0, 5.0, 1.0), (3.0, 1.0, 2.0)], "a double, b double, c double")
    m = {(r["var1"], r["var2"]): r["r"] for r in stats.correlation_matrix(df).collect()}
    assert m["a", "c"] is None and m["c", "c"] is None and m["a", "b"] is not None
    assert {r["r"] for r in stats.correlation_matrix(df.limit(0)).collect()} == {None}
