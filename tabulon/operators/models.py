"""Regression and clustering (M3-M5).

* The train/test split is an md5 hash of a row key, not a random draw, so
  it is the same for any partitioning, on a re-run after a lost executor
  (``randomSplit`` depends on partition layout) and in other engines.
* Linear regression uses the normal-equation solver: XᵀX is a tree-aggregate
  of features x features numbers, so rows never move.
* A forest grows all its trees a level a scan over the same binned rows
  (see ``forest``).
* K-means advances all k and starts in one scan per step over the same vectors,
  which are kept in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions import messages
from tabulon.functions.columns import nan_to_null, numeric_columns, qcol
from tabulon.functions.messages import NotPossible
from tabulon.operators import forest, kmeans
from tabulon.session import materialized

MIN_ROWS = 10
#: Depth bound of forest trees (a parameter of the analysis plan too).
MAX_DEPTH = 8


def split_flag(key_cols: Sequence[str], test_buckets: int = 1, buckets: int = 5):
    """``True`` for test rows: the first 8 hex digits of md5 of the key
    (columns joined with ``|``) modulo ``buckets``.  md5 is available in
    every SQL engine, so the same split can be reproduced outside Spark
    (use integer or text keys for that: their text form is the same
    everywhere)."""
    key = F.concat_ws("|", *[qcol(c).cast("string") for c in key_cols])
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(buckets)) < test_buckets


def _complete(df: DataFrame, key: Sequence[str], target: str | None, features: Sequence[str] | None,
              test_buckets: int) -> tuple[DataFrame, str, list[str]]:
    """The complete rows as (f0, f1, ..., label, test).  Columns are renamed, so any
    column name will do."""
    df = nan_to_null(df)
    nums = numeric_columns(df)
    if len(nums) < 2 and features is None:
        raise NotPossible(messages.FEW_FOR_REGRESSION)
    target = target or nums[-1]
    features = list(features) if features is not None else [c for c in nums if c != target]
    names = [f"f{i}" for i in range(len(features))]
    data = df.select(*[qcol(c).cast("double").alias(n) for c, n in zip(features, names)],
                     qcol(target).cast("double").alias("label"),
                     split_flag(key, test_buckets).alias("test")).dropna(subset=[*names, "label"])
    return data, target, features


def _prepare(df: DataFrame, key: Sequence[str], target: str | None, features: Sequence[str] | None,
             test_buckets: int) -> tuple[DataFrame, str, list[str]]:
    """The complete rows as (features vector, label, test), read once and kept in
    the shared checkpoint folder for the count, the fit and the metrics."""
    data, target, features = _complete(df, key, target, features, test_buckets)
    vec = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(data)
    vec = vec.select("features", "label", "test").checkpoint(eager=True)
    return vec, target, features


def ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """Single-feature least squares in one aggregate:
    ``(n, slope, intercept, r2)`` over complete pairs."""
    d = nan_to_null(df)
    yy, xx = qcol(y).cast("double"), qcol(x).cast("double")
    return d.agg(F.regr_count(yy, xx).alias("n"), F.regr_slope(yy, xx).alias("slope"),
                 F.regr_intercept(yy, xx).alias("intercept"), F.regr_r2(yy, xx).alias("r2"))


def _metrics(pred: DataFrame, target: str, n_train: int) -> DataFrame:
    err = F.col("prediction") - F.col("label")
    return pred.agg(F.count(F.lit(1)).alias("n_test"),
                    F.avg(err * err).alias("mse"),
                    (1 - F.sum(err * err) / F.nullif(
                        F.count(F.lit(1)) * F.var_pop("label"), F.lit(0.0))).alias("r2")) \
        .select(F.lit(target).alias("target"), F.lit(n_train).alias("n_train"), "n_test", "r2", "mse")


def _train(vec: DataFrame) -> tuple[DataFrame, int]:
    train = vec.where(~F.col("test"))
    n = train.count()
    if n < MIN_ROWS:
        raise NotPossible(messages.LITTLE_FOR_REGRESSION)
    return train, n


def linear_regression(df: DataFrame, key: Sequence[str], target: str | None = None,
                      features: Sequence[str] | None = None, test_buckets: int = 1):
    """M3: ``(coefficients, metrics)`` -- coefficients ``(feature,
    coefficient)`` including ``(intercept)``; metrics ``(target, n_train,
    n_test, r2, mse)`` on the held-out rows.  Target: last numeric column;
    features: the others; rows with a missing value are dropped."""
    vec, target, features = _prepare(df, key, target, features, test_buckets)
    train, n_train = _train(vec)
    model = LinearRegression(solver="normal", regParam=0.0, elasticNetParam=0.0).fit(train)
    coefs = df.sparkSession.createDataFrame(
        [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())]
        + [("(intercept)", float(model.intercept))], "feature string, coefficient double")
    return coefs, _metrics(model.transform(vec.where("test")), target, n_train)


def random_forest(df: DataFrame, key: Sequence[str], target: str | None = None,
                  features: Sequence[str] | None = None, num_trees: int = 100,
                  max_depth: int = MAX_DEPTH, seed: int = 42, test_buckets: int = 1):
    """M4: ``(importances, metrics)`` -- ``(feature, importance)`` summing to 1
    and ``(target, n_train, n_test, r2, mse)`` on the held-out rows.  Every
    split considers all features (scikit-learn's regressor default)."""
    data, target, features = _complete(df, key, target, features, test_buckets)
    data = materialized(data)
    train, n_train = _train(data)
    model = forest.fit(train, len(features), num_trees, max_depth, seed)
    imps = df.sparkSession.createDataFrame(
        [(f, float(v)) for f, v in zip(features, model.importances)], "feature string, importance double")
    return imps, _metrics(model.predict(data.where("test")), target, n_train)


def kmeans_elbow(df: DataFrame, cols: Sequence[str] | None = None, vector_col: str | None = None,
                 max_k: int = 10, n_init: int = 3, key: Sequence[str] | None = None,
                 max_iter: int = 20, tol: float = 1e-4):
    """M5: ``(elbow, clusters, chosen_k)``.

    ``elbow``: ``(k, inertia)`` for k in 2 .. min(max_k, n // 2) - 1;
    the chosen k is the one *before* the largest inertia drop (the reference's
    rule, kept); ``clusters``: ``(cluster, size, center array<double>)`` of
    the best of ``n_init`` starts.  All k and starts advance together, one scan a step
    (see ``kmeans``).  Starts come from a hash of the ``key`` columns (by default
    of the values), so the input's layout has no effect.  Rows with a
    missing value are dropped.  ``vector_col`` clusters an ``array<float|double>``
    column (e.g. embeddings) instead.
    """
    spark = df.sparkSession
    d = nan_to_null(df)
    if vector_col:
        values = qcol(vector_col).cast("array<double>")
        whole = values.isNotNull() & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v))
    else:
        cols = list(cols) if cols is not None else numeric_columns(d)
        if len(cols) < 2:
            raise NotPossible(messages.LITTLE_FOR_CLUSTERING)
        values = F.array(*[qcol(c).cast("double") for c in cols])
        whole = F.forall(values, lambda v: v.isNotNull())
    named = F.concat_ws("|", *[qcol(c).cast("string") for c in key]) if key else values.cast("string")
    data = materialized(d.where(whole).select(values.alias("features"), named.alias("key")))
    n = data.count()
    if n < MIN_ROWS:
        raise NotPossible(messages.LITTLE_FOR_CLUSTERING)
    ks = list(range(2, min(max_k, n // 2)))
    starts = kmeans.start_points(data, max(ks, default=2), n_init)
    wanted = [(k, s) for k in ks or [2] for s in range(n_init)]
    fits = kmeans.lloyd(data, [starts[s][:k] for k, s in wanted], max_iter, tol)
    best = {}
    for (k, _), fit in zip(wanted, fits):
        if k not in best or fit.inertia < best[k].inertia:
            best[k] = fit
    inertias = [best[k].inertia for k in ks]
    if len(ks) >= 2:
        drops = [b - a for a, b in zip(inertias, inertias[1:])]
        chosen = ks[drops.index(min(drops))]
    else:
        chosen = ks[0] if ks else 2
    final = best[chosen]
    elbow = spark.createDataFrame(list(zip(ks, inertias)), "k int, inertia double")
    clusters = spark.createDataFrame(
        [(i, int(s), [float(v) for v in c]) for i, (s, c) in enumerate(zip(final.sizes, final.centers))],
        "cluster int, size long, center array<double>")
    return elbow, clusters, chosen
