import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabulon.operators import charts, trend


def test_histogram_numpy_bins(spark):
    vals = [0.0, 1.0, 2.5, 3.0, 10.0, 10.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = charts.histogram(df, bins=4).orderBy("bin").collect()
    counts, edges = np.histogram([v for v in vals if v is not None], bins=4)
    assert [r["cnt"] for r in h] == list(counts)
    assert [r["lo"] for r in h] == list(edges[:-1])
    const = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    c = charts.histogram(const, bins=2).orderBy("bin").collect()
    assert [r["cnt"] for r in c] == list(np.histogram([5.0, 5.0], bins=2)[0])


def test_box_plot_whiskers(spark):
    vals = list(range(1, 10)) + [100]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = charts.box_plot(df).first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert (r["q1"], r["med"], r["q3"]) == (q1, med, q3)
    assert r["whisker_lo"] == 1.0 and r["whisker_hi"] == 9.0 and r["n_fliers"] == 1


def test_bar_chart_top_and_ties(spark):
    df = spark.createDataFrame([(c, i) for i, c in enumerate("aabbbcdd")], "category string, v int")
    got = [(r["value"], r["cnt"]) for r in charts.bar_chart(df, k=3).orderBy("rank").collect()]
    assert got == [("b", 3), ("a", 2), ("d", 2)]


def test_scatter_fit_is_least_squares(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, 4.5, "b"), (3, 5.5, "c"), (4, None, "d"),
                                (5, 10.0, "e")], "x bigint, y double, category string")
    out = charts.scatter_fit(df).orderBy("x").collect()
    assert len(out) == 4
    slope, icpt = np.polyfit([1, 2, 3, 5], [2.0, 4.5, 5.5, 10.0], 1)
    for r in out:
        assert math.isclose(r["fit"], icpt + slope * r["x"], rel_tol=1e-9)


def test_kde_integrates_to_one(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.normal(0, 1, 2000)}))
    k = charts.kde(df, grid=200).orderBy("point").toPandas()
    area = np.trapezoid(k["density"], k["x"])
    assert 0.95 < area < 1.0


def test_trends_match_linregress(spark):
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=6, freq="D"),
                        "sales": [3.0, None, 5.0, 4.0, 8.0, 9.0], "flat": [1.0] * 6})
    df = spark.createDataFrame(pdf)
    t = {r["column"]: r for r in trend.trends(df, "date").collect()}
    y = np.array([3.0, 5.0, 4.0, 8.0, 9.0])
    slope, icpt = np.polyfit(np.arange(5), y, 1)
    assert math.isclose(t["sales"]["slope"], slope) and t["sales"]["n"] == 5
    r2 = np.corrcoef(np.arange(5), y)[0, 1] ** 2
    assert math.isclose(t["sales"]["r_squared"], r2)
    assert t["flat"]["r_squared"] == 0.0 and t["flat"]["trend"] == "decreasing"
    s = trend.trend_summary(df, "date").first()
    assert s["start"] == "2024-01-01T00:00:00" and s["total_periods"] == 6


def test_trend_text_dates_and_line_chart(spark):
    df = spark.createDataFrame([("2024-01-03", 3.0), ("2024-01-01", 1.0), ("2024-01-02", 2.0)],
                               "order_date string, v double")
    t = trend.trends(df).first()
    assert t["column"] == "v" and math.isclose(t["slope"], 1.0)
    lc = trend.line_chart(df, ["order_date"]).orderBy("idx").collect()
    assert [(r["idx"], r["value"]) for r in lc] == [(0, 1.0), (1, 2.0), (2, 3.0)]
    big = spark.range(0, 100).select(F.col("id"), F.col("id").cast("double").alias("v"))
    pts = trend.line_chart(big, ["id"], "v", max_points=10).collect()
    assert len(pts) == 10


def test_partition_invariance_trend_and_top(spark):
    from tabulon.operators.profile import top_values
    base = spark.range(0, 2000).select(
        F.col("id"), F.expr("timestamp_seconds(id * 60)").alias("ts"),
        ((F.col("id") * 7919) % 101).cast("double").alias("v"),
        F.concat(F.lit("k"), (F.col("id") % 17).cast("string")).alias("t"))
    one, seven = base.coalesce(1), base.repartition(7)
    t1 = trend.trends(one, "ts", ["ts", "id"], ["v"]).first()
    t7 = trend.trends(seven, "ts", ["ts", "id"], ["v"]).first()
    assert t1["n"] == t7["n"] and t1["trend"] == t7["trend"]
    for k in ["slope", "intercept", "r_squared"]:  # equal up to summation order
        assert math.isclose(t1[k], t7[k], rel_tol=1e-9)
    assert sorted(map(tuple, top_values(one, ["t"], 3).collect())) == \
        sorted(map(tuple, top_values(seven, ["t"], 3).collect()))


def test_trend_sums_across_partitions_match_numpy(spark):
    n = 5000
    rng = np.random.default_rng(3)
    ts = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 300, n), unit="h")
    y = rng.normal(10, 3, n) + np.arange(n) * 0.001
    gaps = np.where(rng.random(n) < 0.2, np.nan, y)
    pdf = pd.DataFrame({"id": np.arange(n), "ts": ts, "y": y, "g": gaps})
    df = spark.createDataFrame(pdf).repartition(6)
    t = {r["column"]: r for r in trend.trends(df, "ts", ["ts", "id"], ["y", "g"]).collect()}
    srt = pdf.sort_values(["ts", "id"])
    for c in ["y", "g"]:
        s = srt[c].dropna().to_numpy()
        slope, icpt = np.polyfit(np.arange(len(s)), s, 1)
        r2 = np.corrcoef(np.arange(len(s)), s)[0, 1] ** 2
        assert t[c]["n"] == len(s)
        assert math.isclose(t[c]["slope"], slope, rel_tol=1e-7)
        assert math.isclose(t[c]["intercept"], icpt, rel_tol=1e-9)
        assert math.isclose(t[c]["r_squared"], r2, rel_tol=1e-7)
