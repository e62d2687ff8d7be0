import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tabulon.operators import profile, ranking
from tabulon.operators.ranking import exact_quantiles, global_index, top_values


def people(spark):
    return spark.createDataFrame([(25, 50000), (30, 60000), (35, 70000), (40, 80000),
                                  (45, 90000)], "age bigint, salary bigint")


def test_describe_matches_pandas(spark):
    d = {r["column"]: r for r in profile.describe(people(spark)).collect()}
    a = d["age"]
    assert a["count"] == 5 and a["mean"] == 35.0
    assert math.isclose(a["std"], 7.905694150420948)
    assert (a["min"], a["q25"], a["q50"], a["q75"], a["max"]) == (25, 30, 35, 40, 45)
    assert d["salary"]["q25"] == 60000


def test_quantiles_interpolate_and_ignore_missing(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (4.0,), (10.0,)],
                               "x double")
    q = {r["prob"]: r["value"] for r in exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 1.0]).collect()}
    # pandas: [1,2,4,10].quantile(.1) = 1.3, median 3.0
    assert math.isclose(q[0.1], 1.3) and q[0.5] == 3.0 and q[0.0] == 1.0 and q[1.0] == 10.0


def test_quantiles_same_for_1_and_7_partitions(spark):
    base = spark.range(0, 5000).select((F.col("id") * 7919 % 1000).cast("double").alias("x"))
    one = exact_quantiles(base.coalesce(1), ["x"], [0.25, 0.5, 0.9]).collect()
    seven = exact_quantiles(base.repartition(7), ["x"], [0.25, 0.5, 0.9]).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, seven))


def test_quantiles_with_hot_value(spark):
    # a third of all rows hold one value; pre-aggregation keeps it one row
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("x"))
    vals = sorted(r["x"] for r in df.collect())
    q = exact_quantiles(df, ["x"], [0.5]).first()["value"]
    n = len(vals)
    assert q == (vals[(n - 1) // 2] + vals[n // 2]) / 2


def test_empty_and_no_numeric(spark):
    empty = spark.createDataFrame([], "a string")
    s = profile.basic_summary(empty).first()
    assert s["total_rows"] == 0 and s["numeric_columns"] == 0 and s["missing_pct"] is None
    assert profile.describe(empty).count() == 0
    nothing = spark.range(0).select()
    assert profile.basic_summary(nothing).first()["total_columns"] == 0


def test_profile_missing_and_summary(spark):
    df = spark.createDataFrame([("a", 1, 2.0), (None, 2, None), ("c", 3, 1.0)],
                               "name string, age bigint, salary double")
    m = {r["column"]: r["missing"] for r in profile.profile_columns(df).collect()}
    assert m == {"name": 1, "age": 0, "salary": 1}
    s = profile.basic_summary(df).first()
    assert s["missing_values_total"] == 2 and math.isclose(s["missing_pct"], 200 / 9)


def test_skew_kurtosis_bias_corrected_and_degenerate(spark):
    df = spark.createDataFrame([(float(v), 1.0, float(v) if v < 3 else None)
                                for v in [1, 2, 3, 4, 10]], "x double, c double, s double")
    r = {x["column"]: x for x in profile.skew_kurtosis(df).collect()}
    # pandas: Series([1,2,3,4,10]).skew() / .kurt()
    assert math.isclose(r["x"]["skewness"], 1.697056274847714, rel_tol=1e-9)
    assert math.isclose(r["x"]["kurtosis"], 3.1519999999999992, rel_tol=1e-9)
    assert r["c"]["skewness"] == 0.0 and r["c"]["kurtosis"] == 0.0
    assert r["s"]["skewness"] is None  # n = 2 < 3


def test_top_values_ties_and_missing(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "b", "c", "a", None, "d"]], "t string")
    got = rows(top_values(df, ["t"], 2), "value", "cnt", "rank")
    assert got == [("a", 2, 1), ("b", 2, 2)]


def test_unique_counts_and_outliers(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 10)] + [(10, 100)],
                               "normal_data bigint, with_outlier bigint")
    o = {r["column"]: r for r in profile.outliers_iqr(df).collect()}
    assert o["with_outlier"]["count"] == 1 and o["normal_data"]["count"] == 0
    assert o["with_outlier"]["percentage"] == 10.0


def test_global_index_dense_and_partition_independent(spark):
    df = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("k"))
    a = global_index(df.repartition(7), ["k"]).select("k", "idx").collect()
    assert sorted((r["k"], r["idx"]) for r in a) == [(i, i) for i in range(1000)]
    grouped = global_index(df.withColumn("g", F.col("k") % 3), ["k"], group="g")
    for g in range(3):
        idx = sorted(r["idx"] for r in grouped.where(F.col("g") == g).collect())
        assert idx == list(range(len(idx)))


def test_column_bytes_and_first_mean(spark):
    df = spark.createDataFrame([("ab", 1, 2.0), ("é", 2, None)], "s string, i int, d double")
    b = {r["column"]: r["bytes"] for r in profile.column_bytes(df).collect()}
    assert b == {"s": 4, "i": 8, "d": 8}
    assert profile.first_numeric_mean(df).first()["mean"] == 1.5
    assert profile.first_numeric_mean(df.select("s")).first()["mean"] is None


@pytest.mark.parametrize("sketch", [20, 300, 10_000])
def test_quantiles_are_exact_however_coarse_the_sketch(spark, monkeypatch, sketch):
    monkeypatch.setattr(ranking, "SKETCH", sketch)
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise((F.col("id") * 7919 % 997).cast("double"))
        .alias("a"), (F.col("id") % 13).cast("double").alias("b"),
        F.when(F.col("id") % 5 == 0, F.exp(F.col("id") / 20.0)).when(F.col("id") % 5 == 1, float("nan")).alias("c"),
        F.lit(None).cast("double").alias("d")).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = [tuple(r) for r in exact_quantiles(df, ["a", "b", "c", "d"], probs).collect()]
    assert len(got) == 18
    pdf = df.toPandas()
    for c, p, v in got:
        assert math.isclose(v, pdf[c].quantile(p), rel_tol=1e-12)


def test_global_index_hot_duplicate_group(spark):
    # a third of all rows identical on the order key: still a dense 0..n-1 index
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k")).repartition(5)
    idx = global_index(df, ["k"]).collect()
    assert sorted(r["idx"] for r in idx) == list(range(3000))
    hot = sorted(r["idx"] for r in idx if r["k"] == -1)
    assert hot == list(range(1000))
