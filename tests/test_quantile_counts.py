from pyspark.sql import functions as F

from tabulon.operators import ranking, stats
from tabulon.plans import runner


def test_counts_of_a_scan(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (2.0, 5.0), (None, 7.0)], "x0 double, x1 double")
    got = ranking._rows_up_to(df, [[1.5, 2.0], [5.0]])
    assert got == {(0, 1.5): (1, 1), (0, 2.0): (1, 3), (1, 5.0): (0, 2)}


def test_quantiles_of_many_rows_with_missing_values(spark):
    df = spark.range(60001).select(F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("a"),
                                   F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id") % 5).alias("b"))
    rows = df.toPandas()
    for r in ranking.exact_quantiles(df, ["a", "b"], [0.1, 0.25, 0.5, 0.99]).collect():
        assert r["value"] == rows[r["column"]].quantile(r["prob"])


def test_steps_share_quantiles_and_correlations(spark, monkeypatch):
    seen = []
    for module, name in ((stats, "co_moments"), (ranking, "_order_statistics")):
        monkeypatch.setattr(module, name, lambda *a, fn=getattr(module, name), name=name: seen.append(name) or fn(*a))
    df = spark.range(40).select((F.col("id") * 1.0).alias("a"), (F.col("id") % 7).alias("b"))
    out = runner.run_steps(df, ["summary_statistics", "correlation_analysis", "distribution_analysis"])
    assert sorted(seen) == ["_order_statistics", "co_moments"]
    assert {r["column"]: r["median"] for r in out["distribution_analysis"].collect()} == {"a": 19.5, "b": 3.0}
