"""Profiling operators.

Every operator reads the table once: the columns are unpivoted into
``(column, value)`` rows and aggregated per column (partial aggregation on the
map side, one small row per column to the final task).  Quantiles come from
the distributed ``exact_quantiles``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import (
    as_double, kind_of, missing, nan_to_null, numeric_columns, qcol, string_columns,
)
from tabulon.operators.ranking import quantile_table, top_values as _top_values

Stat = Callable[[str], Column]


def wide_to_long(df: DataFrame, cols: Sequence[str], stats: dict[str, Stat],
                 value: Callable[[str], Column] | None = None) -> DataFrame:
    """Per-column statistics -> ``(position, column, <stat names>)``.

    The columns are unpivoted to ``(position, column, value)`` rows and
    aggregated with ``groupBy(column)``: one scan, and however many columns
    there are, each aggregate has only ``len(stats)`` functions, so it stays
    inside whole-stage codegen (a single wide aggregate with more than ~100
    buffer fields falls back to interpreted execution).  ``stats`` map a name
    to a function of the value column; ``value`` builds the value from a
    column name (default: cast to double, NaN -> NULL).
    """
    if not cols:
        raise ValueError("no columns")
    make = value or (lambda c: F.when(~F.isnan(as_double(c)), as_double(c)))
    recs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                     make(c).alias("value")) for i, c in enumerate(cols)]
    long = df.select(F.explode(F.array(*recs)).alias("r")).select("r.*")
    v = F.col("value")
    return long.groupBy("position", "column").agg(
        *[fn(v).alias(name) for name, fn in stats.items()])


# ---------------------------------------------------------------- P1, P2, P10
def profile_columns(df: DataFrame) -> DataFrame:
    """``(position, column, dtype, kind, missing)`` for every column."""
    names = df.columns
    if not names:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, dtype string, kind string, missing long")
    counts = wide_to_long(df, names, {"missing": lambda v: F.count_if(v)},
                          value=lambda c: missing(df, c))
    meta = df.sparkSession.createDataFrame(
        [(i, f.dataType.simpleString(), kind_of(f.dataType))
         for i, f in enumerate(df.schema.fields)],
        "position int, dtype string, kind string")
    return (counts.join(F.broadcast(meta), "position")
            .select("position", "column", "dtype", "kind",
                    F.col("missing").cast("long").alias("missing")))


def basic_summary(df: DataFrame) -> DataFrame:
    """P2 + P10: whole-table counters in one row.

    ``(total_rows, total_columns, numeric_columns, categorical_columns,
    missing_values_total, missing_pct)``.
    """
    k = len(df.columns)
    if k == 0:
        row = df.agg(F.count(F.lit(1)).alias("total_rows"),
                     F.lit(0).cast("long").alias("missing_values_total"))
    else:
        per_col = wide_to_long(df, df.columns,
                               {"missing": lambda v: F.count_if(v), "rows": F.count},
                               value=lambda c: missing(df, c))
        row = per_col.agg(F.coalesce(F.max("rows"), F.lit(0)).cast("long").alias("total_rows"),
                          F.coalesce(F.sum("missing"), F.lit(0)).cast("long")
                          .alias("missing_values_total"))
    return row.select(
        "total_rows",
        F.lit(k).alias("total_columns"),
        F.lit(len(numeric_columns(df))).alias("numeric_columns"),
        F.lit(len(string_columns(df))).alias("categorical_columns"),
        "missing_values_total",
        F.when((F.col("total_rows") > 0) & F.lit(k > 0),
               F.col("missing_values_total") * 100.0 / (F.col("total_rows") * F.lit(k))
               ).alias("missing_pct"))


def row_count(df: DataFrame) -> DataFrame:
    """``(row_count)``."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def first_numeric_mean(df: DataFrame, digits: int = 2) -> DataFrame:
    """Mean of the first numeric column, rounded -> ``(column, mean)``.

    No numeric column: one row with a NULL column name and mean.
    """
    nums = numeric_columns(nan_to_null(df))
    if not nums:
        return df.sparkSession.createDataFrame([(None, None)], "column string, mean double")
    c = nums[0]
    return nan_to_null(df).agg(F.lit(c).alias("column"),
                               F.round(F.avg(qcol(c)), digits).alias("mean"))


# ---------------------------------------------------------------- P3, P4
def describe(df: DataFrame, cols: Sequence[str] | None = None, approx_accuracy: int | None = None,
             quartiles: DataFrame | None = None) -> DataFrame:
    """``(position, column, count, mean, std, min, q25, q50, q75, max)``.

    Sample standard deviation and linearly interpolated quartiles, as pandas
    ``describe``.  NaN counts as missing.  ``quartiles``: the columns' exact
    quantiles, if they are known already.
    """
    df = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, count long, mean double, std double, "
                "min double, q25 double, q50 double, q75 double, max double")
    moments = wide_to_long(df, cols, {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    q = quantile_table(df, cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"], approx_accuracy, quartiles)
    return (moments.join(q, "column", "left")
            .select("position", "column", "count", "mean", "std", "min",
                    "q25", "q50", "q75", "max"))


# ---------------------------------------------------------------- P4
def skew_kurtosis(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness G1 and excess kurtosis G2 (pandas ``skew``/``kurt``).

    Spark's ``skewness``/``kurtosis`` are the population g1, g2:
    G1 = g1 sqrt(n(n-1))/(n-2) for n >= 3;
    G2 = (n-1)/((n-2)(n-3)) ((n+1) g2 + 6) for n >= 4.
    A constant column gives 0, as pandas does.
    """
    df = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, skewness double, kurtosis double")
    m = wide_to_long(df, cols, {
        "n": lambda v: F.count(v).cast("double"), "g1": F.skewness, "g2": F.kurtosis,
        "var": F.var_pop})
    n = F.col("n")
    const = F.col("var") == 0
    skew = F.when(n < 3, None).when(const, 0.0).otherwise(
        F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n < 4, None).when(const, 0.0).otherwise(
        (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return m.select("position", "column", skew.alias("skewness"), kurt.alias("kurtosis"))


# ---------------------------------------------------------------- P5
def top_values(df: DataFrame, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """P5: ``(column, value, cnt, rank)`` -- the ``k`` most frequent values per
    text column, count descending then value ascending; missing excluded."""
    cols = list(cols) if cols is not None else string_columns(df)
    return _top_values(df, cols, k)


def unique_counts(df: DataFrame, cols: Sequence[str] | None = None,
                  approx_rsd: float | None = None) -> DataFrame:
    """P5: ``(position, column, unique_count)``; ``approx_rsd`` uses HyperLogLog++."""
    cols = list(cols) if cols is not None else string_columns(df)
    if approx_rsd:
        fn = lambda v: F.approx_count_distinct(v, approx_rsd)
    else:
        fn = F.count_distinct
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, unique_count long")
    return wide_to_long(df, cols, {"unique_count": fn},
                        value=lambda c: qcol(c).cast("string"))


# ---------------------------------------------------------------- P6
def outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None,
                 approx_accuracy: int | None = None) -> DataFrame:
    """``(column, count, percentage, lower, upper)``.

    Bounds Q1 - 1.5 IQR and Q3 + 1.5 IQR, strict comparison; the percentage is
    taken over all rows, missing ones included.  The rows outside are counted
    in one aggregate with the bounds as literals.
    """
    df = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    schema = "column string, count long, percentage double, lower double, upper double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    bounds = fences(df, cols, approx_accuracy)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if((as_double(c) < F.lit(lo)) | (as_double(c) > F.lit(hi))).alias(f"o{i}")
        for i, c in enumerate(cols) if c in bounds for _, _, _, lo, hi in [bounds[c]]]).first()
    out = []
    for i, c in enumerate(cols):
        n = row[f"o{i}"] if c in bounds else 0
        lo, hi = bounds[c][3:] if c in bounds else (None, None)
        out.append((c, n, n * 100.0 / row["n"] if row["n"] else None, lo, hi))
    return df.sparkSession.createDataFrame(out, schema)


def fences(df: DataFrame, cols: Sequence[str], approx_accuracy: int | None = None) -> dict[str, tuple]:
    """``{column: (q1, median, q3, q1 - 1.5 IQR, q3 + 1.5 IQR)}`` of the columns
    that have a value."""
    q = quantile_table(df, cols, [0.25, 0.5, 0.75], ["q1", "med", "q3"], approx_accuracy)
    return {r["column"]: (r["q1"], r["med"], r["q3"], r["q1"] - 1.5 * (r["q3"] - r["q1"]),
                          r["q3"] + 1.5 * (r["q3"] - r["q1"])) for r in q.collect()}


def outlier_rows(df: DataFrame, col: str, lower: float, upper: float) -> DataFrame:
    """rows with ``col < lower OR col > upper`` (pushed into the scan)."""
    c = qcol(col)
    return df.where((c < F.lit(lower)) | (c > F.lit(upper)))


# ---------------------------------------------------------------- P9
_FIXED_WIDTH = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4,
                "double": 8, "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def column_bytes(df: DataFrame) -> DataFrame:
    """``(position, column, bytes)`` -- UTF-8 bytes of text columns and
    fixed width x non-missing count for the rest (a data-size profile)."""
    def size(c: str) -> Column:
        t = df.schema[c].dataType.simpleString()
        if t == "string":
            return F.octet_length(qcol(c)).cast("long")
        if t == "binary":
            return F.length(qcol(c)).cast("long")
        return F.when(qcol(c).isNotNull(), F.lit(_FIXED_WIDTH.get(t, 8)).cast("long"))
    return wide_to_long(df, df.columns,
                        {"bytes": lambda v: F.coalesce(F.sum(v), F.lit(0)).cast("long")},
                        value=size)
