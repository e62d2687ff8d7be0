"""Named-step runners.

A plan is two lists of operator names, as in the reference.  Unknown names
are ignored.  Each step is a DataFrame -> DataFrame function; the runners
only sequence them and collect a short text log from aggregates the steps
compute anyway.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tabulon.functions import messages
from tabulon.functions.columns import nan_to_null, numeric_columns, string_columns
from tabulon.functions.messages import NotPossible
from tabulon.operators import charts, clean, models, profile, stats, trend
from tabulon.operators.ranking import exact_quantiles

DEFAULT_OPERATIONS = ["clean_data", "handle_missing", "basic_stats"]
DEFAULT_STEPS = ["summary_statistics", "correlation_analysis"]
STRONG_R = 0.7


def run_operations(df: DataFrame, operations: Sequence[str] = DEFAULT_OPERATIONS,
                   with_log: bool = True) -> tuple[DataFrame, list[str]]:
    """Apply ``clean_data``, ``handle_missing``, ``normalize``,
    ``encode_categorical``, ``detect_outliers`` in list order.

    ``detect_outliers`` does not change the table; its result goes to the log.
    ``with_log=False`` skips the counts that only the log needs.
    """
    log: list[str] = []
    known = {"clean_data", "handle_missing", "normalize", "encode_categorical",
             "detect_outliers"}
    for i, op in enumerate(operations):
        if op == "clean_data":
            empty = clean.empty_columns(df)
            before, after = Observation(), Observation()
            kept = with_log or any(o in known for o in operations[i + 1:])
            df = clean.clean_data(df.observe(before, F.count(F.lit(1)).alias("n")) if with_log else df, empty)
            if kept:
                # every later step reads the de-duplicated table several times;
                # freeze it once in the shared checkpoint folder instead of
                # re-running the de-duplicating shuffle for each of them; the
                # same job counts the rows before and after
                df = (df.observe(after, F.count(F.lit(1)).alias("n")) if with_log else df).checkpoint(eager=True)
            if with_log:
                removed = before.get["n"] - after.get["n"]
                if removed:
                    log.append(messages.REMOVED_DUPLICATES.format(n=removed))
                if empty:
                    log.append(messages.REMOVED_EMPTY.format(columns=empty))
                log.append(messages.CLEANED)
        elif op == "handle_missing":
            if with_log:
                miss = profile.profile_columns(df).where("missing > 0").orderBy("position").collect()
                for r in miss:
                    how = "median" if r["kind"] == "numeric" else "mode"
                    log.append(messages.FILLED.format(n=r["missing"], column=r["column"], how=how))
            df = clean.fill_missing(df)
        elif op == "normalize":
            nums = numeric_columns(df)
            df = clean.zscore(df)
            if nums:
                log.append(messages.NORMALIZED.format(columns=nums))
        elif op == "encode_categorical":
            before = set(df.columns)
            df = clean.encode_categorical(df)
            for c in df.columns:
                if c not in before:
                    log.append(messages.ENCODED.format(column=c[:-len("_encoded")]))
        elif op == "detect_outliers":
            rows = profile.outliers_iqr(df).collect()
            info = {r["column"]: {"count": r["count"], "percentage": r["percentage"],
                                  "bounds": {"lower": r["lower"], "upper": r["upper"]}}
                    for r in rows}
            log.append(messages.OUTLIERS.format(info=info))
    return df, log


def run_steps(df: DataFrame, steps: Sequence[str] = DEFAULT_STEPS,
              key: Sequence[str] | None = None,
              max_depth: int = models.MAX_DEPTH) -> dict[str, DataFrame]:
    """M0: always ``data_summary`` first and ``insights`` last; then the named
    steps.  A step that cannot run (too few columns or rows) is left out and
    its message appears in ``insights``.  ``key`` (a unique row key) fixes
    the regression split; by default all columns are hashed.  ``max_depth``
    bounds the forest's trees."""
    out: dict[str, DataFrame] = {"data_summary": profile.basic_summary(df)}
    notes: list[str] = []

    @cache
    def quartiles() -> DataFrame:  # of two steps
        return exact_quantiles(nan_to_null(df), numeric_columns(df), [0.25, 0.5, 0.75])

    for step in steps:
        try:
            if step == "summary_statistics":
                if not numeric_columns(df):
                    raise NotPossible(messages.NO_NUMERIC_SUMMARY)
                out["summary_statistics"] = profile.describe(df, quartiles=quartiles()).join(
                    profile.skew_kurtosis(df).drop("position"), "column")
            elif step == "correlation_analysis":
                if len(numeric_columns(df)) < 2:
                    raise NotPossible(messages.FEW_FOR_CORRELATION)
                out["correlation_analysis"] = stats.correlation_matrix(df)
                out["strong_correlations"] = stats.strong_correlations(
                    df, STRONG_R, matrix=out["correlation_analysis"])
            elif step == "distribution_analysis":
                if not numeric_columns(df):
                    raise NotPossible(messages.NO_NUMERIC_DISTRIBUTION)
                out["distribution_analysis"] = stats.distribution(df, quartiles=quartiles())
            elif step == "regression_analysis":
                coefs, metrics = models.linear_regression(df, key or df.columns)
                imps, rf = models.random_forest(df, key or df.columns, max_depth=max_depth)
                out["regression_coefficients"] = coefs
                out["regression_analysis"] = metrics
                out["feature_importance"] = imps
                out["random_forest"] = rf
            elif step == "clustering_analysis":
                elbow, clusters, _k = models.kmeans_elbow(df)
                out["clustering_elbow"] = elbow
                out["clustering_analysis"] = clusters
            elif step == "time_series_analysis":
                if trend.find_datetime_column(df) is None:
                    raise NotPossible(messages.NO_DATETIME)
                if not numeric_columns(df):
                    raise NotPossible(messages.NO_NUMERIC_SERIES)
                t = trend.trends(df)
                out["time_series_range"] = trend.trend_summary(df)
                out["time_series_analysis"] = t
        except NotPossible as e:
            notes.append(str(e))
    out["insights"] = insights(df, out, notes)
    return out


def insights(df: DataFrame, results: dict[str, DataFrame],
             notes: Sequence[str] = ()) -> DataFrame:
    """M7: ``(ord, text)`` -- missing share, strong correlations, normal
    columns, strong regression fit; built from the small result tables."""
    lines: list[str] = []
    s = results.get("data_summary")
    if s is not None:
        r = s.first()
        if r and r["missing_values_total"]:
            lines.append(messages.MISSING_SHARE.format(pct=r["missing_pct"]))
    if "strong_correlations" in results:
        n = results["strong_correlations"].count()
        if n:
            lines.append(messages.STRONG_PAIRS.format(n=n))
    if "distribution_analysis" in results:
        normal = [r["column"] for r in results["distribution_analysis"]
                  .where("is_normal").orderBy("position").collect()]
        if normal:
            lines.append(messages.NORMAL_COLUMNS.format(columns=normal))
    if "regression_analysis" in results:
        r2 = results["regression_analysis"].first()["r2"]
        if r2 is not None and r2 > 0.7:
            lines.append(messages.STRONG_FIT.format(r2=r2))
    lines.extend(notes)
    return df.sparkSession.createDataFrame(list(enumerate(lines)), "ord int, text string")


def chart_data(df: DataFrame, chart_names: Sequence[str],
               order_by: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """V8: chart name -> chart table; a chart that the table has no column for, or
    whose name is unknown, is left out."""
    nums, texts = numeric_columns(df), string_columns(df)
    makers = {
        "histogram": (nums, lambda: charts.histogram(df)),
        "correlation_heatmap": (len(nums) > 1, lambda: stats.correlation_matrix(df).withColumn(
            "r", F.round("r", 2))),
        "scatter_plot": (len(nums) > 1, lambda: charts.scatter_fit(df)),
        "box_plot": (nums, lambda: charts.box_plot(df)),
        "bar_chart": (texts, lambda: charts.bar_chart(df)),
        "line_chart": (nums, lambda: trend.line_chart(df, list(order_by or df.columns))),
        "distribution_plot": (nums, lambda: charts.kde(df)),
    }
    out: dict[str, DataFrame] = {}
    for name in chart_names:
        possible, make = makers.get(name, (False, None))
        if not possible:
            continue
        out[name] = make()
        if name == "distribution_plot":
            out["distribution_histogram"] = charts.histogram(df, 30, nums[:4])
    return out
