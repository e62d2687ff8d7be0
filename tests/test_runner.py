import json
import os
import tempfile

import numpy as np
import pandas as pd

from tabulon.plans.runner import chart_data, run_steps
from tabulon.sources import files


def mixed4(spark):
    rng = np.random.default_rng(42)
    age = rng.integers(20, 65, 100)
    pdf = pd.DataFrame({"rid": np.arange(100), "age": age,
                        "income": age * 1000.0 + rng.normal(0, 500, 100),
                        "experience": np.clip(age - 22, 0, None),
                        "education_score": rng.normal(70, 10, 100),
                        "day": pd.date_range("2024-01-01", periods=100, freq="D"),
                        "segment": rng.choice(["a", "b", "c"], 100)})
    return spark.createDataFrame(pdf)


def test_run_steps_all(spark):
    df = mixed4(spark)
    steps = ["summary_statistics", "correlation_analysis", "distribution_analysis",
             "regression_analysis", "clustering_analysis", "time_series_analysis", "unknown"]
    out = run_steps(df, steps, key=["rid"])
    for name in ["data_summary", "summary_statistics", "correlation_analysis",
                 "strong_correlations", "distribution_analysis", "regression_coefficients",
                 "regression_analysis", "feature_importance", "random_forest",
                 "clustering_elbow", "clustering_analysis", "time_series_range",
                 "time_series_analysis", "insights"]:
        assert name in out, name
        assert out[name].count() >= 0
    text = [r["text"] for r in out["insights"].orderBy("ord").collect()]
    assert any("strong correlations" in t for t in text)
    assert out["data_summary"].first()["numeric_columns"] == 5
    ts = {r["column"] for r in out["time_series_analysis"].collect()}
    assert "income" in ts


def test_run_steps_guards(spark):
    only_text = spark.createDataFrame([("a", "x")], "category string, text string")
    out = run_steps(only_text, ["summary_statistics", "correlation_analysis"])
    text = [r["text"] for r in out["insights"].collect()]
    assert "No numeric columns found for summary statistics" in text
    assert "Need at least 2 numeric columns for correlation analysis" in text


def test_chart_data_all(spark):
    df = mixed4(spark)
    charts = ["histogram", "correlation_heatmap", "scatter_plot", "box_plot", "bar_chart",
              "line_chart", "distribution_plot", "unknown"]
    out = chart_data(df, charts, order_by=["day", "rid"])
    assert set(out) == {"histogram", "correlation_heatmap", "scatter_plot", "box_plot",
                        "bar_chart", "line_chart", "distribution_plot", "distribution_histogram"}
    assert out["histogram"].count() == 5 * 30
    assert out["line_chart"].count() == 100
    assert out["bar_chart"].count() == 3


def test_request_log_and_preview(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="tabulon-log-", dir="/tmp"), "log")
    recs = spark.createDataFrame(
        [("2024-01-02 10:00:00", "a1", "q?"), ("2024-01-03 11:00:00", "a2", "r?")],
        "timestamp string, analysis_id string, questions string")
    files.write_request_log(recs.withColumn("timestamp", recs.timestamp.cast("timestamp")), path)
    files.write_request_log(recs.withColumn("timestamp", recs.timestamp.cast("timestamp")), path)
    back = spark.read.json(path)
    assert back.count() == 4 and sorted(r["date"] for r in back.select("date").distinct()
                                        .collect())[0].isoformat() == "2024-01-02"
    pv = files.sample_preview(spark.range(10).toDF("id"), ["id"], 3).first()
    assert pv["sample_size"] == 3 and pv["total_size"] == 10
    assert [r["id"] for r in json.loads(pv["sample_json"])] == [0, 1, 2]
