"""Chart data (V1-V7): the aggregate tables behind the reference's charts.

The reference drew PNGs; here each chart is the table a plotting client
needs.  Every table is bounded by (columns x bins) or is the row set the
chart itself shows (scatter, line), and every pass is a partial aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import as_double, nan_to_null, numeric_columns, qcol, string_columns
from tabulon.operators.profile import fences, wide_to_long
from tabulon.operators.ranking import top_k_counts


def _ranges(df: DataFrame, cols: Sequence[str], spread: bool = True) -> dict[str, tuple]:
    """``column -> (min, max, count, sample std)`` from one long-format aggregate
    (no standard deviation without ``spread``)."""
    stats = {"lo": F.min, "hi": F.max, "n": F.count, **({"sd": F.stddev_samp} if spread else {})}
    got = {r["column"]: (r["lo"], r["hi"], r["n"], r["sd"] if spread else None)
           for r in wide_to_long(df, cols, stats).collect()}
    return {c: got[c] for c in cols if c in got}


def _edges(lo: float, hi: float) -> tuple[float, float]:
    # NumPy widens an empty range to lo - 0.5 .. hi + 0.5
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def _bin_counts(df: DataFrame, ranges: dict[str, tuple], bins: int, name: str) -> DataFrame:
    """``(column, <name>, cnt)``: equal-width bins, the last one closed.  Each
    column's bin is computed in its own place of the row; only (column, bin)
    pairs are unpivoted."""
    pairs = []
    for c, (lo, hi, *_rest) in ranges.items():
        a, b = _edges(lo, hi)
        x = as_double(c)
        at = F.least(F.floor((x - F.lit(a)) * F.lit(bins / (b - a))), F.lit(bins - 1)).cast("int")
        pairs.append(F.struct(F.lit(c).alias("column"),
                              F.when(x.isNotNull() & ~F.isnan(x), at).alias(name)))
    return (df.select(F.inline(F.array(*pairs))).where(F.col(name).isNotNull())
            .groupBy("column", name).agg(F.count(F.lit(1)).alias("cnt")))


def histogram(df: DataFrame, bins: int = 30, cols: Sequence[str] | None = None) -> DataFrame:
    """V1: ``(column, bin, lo, hi, cnt)`` for every numeric column, empty bins
    included (columns x bins rows)."""
    df = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    schema = "column string, bin int, lo double, hi double, cnt long"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    ranges = {c: r for c, r in _ranges(df, cols, spread=False).items() if r[0] is not None}
    if not ranges:
        return df.sparkSession.createDataFrame([], schema)
    counts = _bin_counts(df, ranges, bins, "bin")
    grid = df.sparkSession.createDataFrame(
        [(c, i, _edges(lo, hi)[0] + i * (_edges(lo, hi)[1] - _edges(lo, hi)[0]) / bins,
          _edges(lo, hi)[0] + (i + 1) * (_edges(lo, hi)[1] - _edges(lo, hi)[0]) / bins)
         for c, (lo, hi, _n, _sd) in ranges.items() for i in range(bins)],
        "column string, bin int, lo double, hi double")
    return (F.broadcast(grid).join(counts, ["column", "bin"], "left")
            .select("column", "bin", "lo", "hi",
                    F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt")))


def scatter_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """V3 fit: ``(n, slope, intercept)`` of y on x over complete pairs."""
    d = nan_to_null(df)
    return d.agg(F.regr_count(as_double(y), as_double(x)).alias("n"),
                 F.regr_slope(as_double(y), as_double(x)).alias("slope"),
                 F.regr_intercept(as_double(y), as_double(x)).alias("intercept"))


def scatter_fit(df: DataFrame, x: str | None = None, y: str | None = None) -> DataFrame:
    """V3: ``(x, y, fit)`` for every complete pair of the first two numeric
    columns (or ``x``, ``y``), with the degree-1 least-squares line."""
    d = nan_to_null(df)
    nums = numeric_columns(d)
    x = x or (nums[0] if len(nums) > 0 else None)
    y = y or (nums[1] if len(nums) > 1 else None)
    if x is None or y is None:
        return d.sparkSession.createDataFrame([], "x double, y double, fit double")
    line = scatter_line(d, x, y).first()  # two numbers to the driver
    slope, icpt = line["slope"], line["intercept"]
    xs, ys = as_double(x), as_double(y)
    fit = (F.lit(icpt) + F.lit(slope) * xs) if slope is not None else F.lit(None).cast("double")
    return (d.where(xs.isNotNull() & ys.isNotNull())
            .select(xs.alias("x"), ys.alias("y"), fit.alias("fit")))


def scatter_bins(df: DataFrame, x: str | None = None, y: str | None = None,
                 x_bins: int = 50, y_bins: int = 50) -> DataFrame:
    """V3 for large tables: ``(x_bin, y_bin, x_lo, x_hi, y_lo, y_hi, cnt, fit)``, the
    non-empty cells of a grid over the ranges of the first two numeric columns (or
    ``x``, ``y``), with the least-squares line at the middle of the cell's ``x``.

    Complete pairs only; the upper ends belong to the last bins; a constant column
    has one bin of no width.  One aggregate for ranges and line, one for the cells:
    ``x_bins * y_bins`` rows at most, per task and in the result.
    """
    schema = "x_bin int, y_bin int, x_lo double, x_hi double, y_lo double, y_hi double, cnt long, fit double"
    d = nan_to_null(df)
    nums = numeric_columns(d)
    x = x or (nums[0] if len(nums) > 0 else None)
    y = y or (nums[1] if len(nums) > 1 else None)
    if x is None or y is None:
        return d.sparkSession.createDataFrame([], schema)
    pairs = d.select(as_double(x).alias("x"), as_double(y).alias("y")).where("x is not null and y is not null")
    r = pairs.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))],
                  F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")).first()
    if r["lo_x"] is None:
        return d.sparkSession.createDataFrame([], schema)

    def cell(c: str, bins: int):
        lo, width = r[f"lo_{c}"], (r[f"hi_{c}"] - r[f"lo_{c}"]) / bins
        at = F.least(F.floor((F.col(c) - lo) / width), F.lit(bins - 1)).cast("int") if width > 0 else F.lit(0)
        edge = lambda i: F.lit(lo) + i * F.lit(width)
        return at.alias(f"{c}_bin"), edge(F.col(f"{c}_bin")), edge(F.col(f"{c}_bin") + 1)
    (x_at, x_lo, x_hi), (y_at, y_lo, y_hi) = cell("x", x_bins), cell("y", y_bins)
    fit = F.lit(None).cast("double") if r["slope"] is None else \
        F.lit(r["intercept"]) + F.lit(r["slope"]) * (F.col("x_lo") + F.col("x_hi")) / 2
    return pairs.select(x_at, y_at).groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("cnt")) \
        .select("x_bin", "y_bin", x_lo.alias("x_lo"), x_hi.alias("x_hi"), y_lo.alias("y_lo"), y_hi.alias("y_hi"), "cnt") \
        .withColumn("fit", fit)


def box_plot(df: DataFrame, cols: Sequence[str] | None = None, max_cols: int = 5,
             approx_accuracy: int | None = None) -> DataFrame:
    """V4: ``(column, q1, med, q3, whisker_lo, whisker_hi, n_fliers)`` for the
    first ``max_cols`` numeric columns.  Tukey whiskers: the most extreme data
    within 1.5 IQR of the box, from one aggregate with the bounds as literals."""
    df = nan_to_null(df)
    cols = (list(cols) if cols is not None else numeric_columns(df))[:max_cols]
    schema = ("column string, q1 double, med double, q3 double, whisker_lo double, "
              "whisker_hi double, n_fliers long")
    box = fences(df, cols, approx_accuracy) if cols else {}
    if not box:
        return df.sparkSession.createDataFrame([], schema)
    aggs = []
    for i, (c, (_q1, _med, _q3, lo, hi)) in enumerate(box.items()):
        x = as_double(c)
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        aggs += [F.min(F.when(inside, x)).alias(f"lo{i}"), F.max(F.when(inside, x)).alias(f"hi{i}"),
                 F.count_if(~inside).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    order = {c: i for i, c in enumerate(box)}
    return df.sparkSession.createDataFrame(
        [(c, *box[c][:3], row[f"lo{order[c]}"], row[f"hi{order[c]}"], row[f"n{order[c]}"])
         for c in cols if c in box], schema)


def bar_chart(df: DataFrame, col: str | None = None, k: int = 10) -> DataFrame:
    """V5: ``(value, cnt, rank)`` -- the ``k`` most frequent values of the first
    text column (count descending, value ascending)."""
    c = col or (string_columns(df) or [None])[0]
    if c is None:
        return df.sparkSession.createDataFrame([], "value string, cnt long, rank int")
    counts = (df.where(qcol(c).isNotNull())
              .groupBy(qcol(c).cast("string").alias("value"))
              .agg(F.count(F.lit(1)).alias("cnt"))
              .withColumn("column", F.lit(c)))
    return top_k_counts(counts, k).select("value", "cnt", "rank")


def kde(df: DataFrame, cols: Sequence[str] | None = None, max_cols: int = 4,
        grid: int = 200, bins: int = 2000) -> DataFrame:
    """V7: ``(column, point, x, density)`` -- Gaussian KDE with Scott's
    bandwidth h = std * n^(-1/5) on a ``grid``-point grid over [min, max].

    The data are first binned into ``bins`` equal cells per column (one
    partial aggregate), and the kernel sum runs over bin centres weighted by
    counts, so the kernel work is columns x bins x grid whatever the row
    count.  With 2,000 cells the shift of a point is at most range/4,000.
    """
    df = nan_to_null(df)
    cols = (list(cols) if cols is not None else numeric_columns(df))[:max_cols]
    schema = "column string, point int, x double, density double"
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    ranges = {c: r for c, r in _ranges(df, cols).items()
              if r[0] is not None and r[2] and r[2] > 1 and r[3]}
    if not ranges:
        return df.sparkSession.createDataFrame([], schema)
    cells = _bin_counts(df, ranges, bins, "cell")
    meta = df.sparkSession.createDataFrame(
        [(c, float(lo), float(hi), int(n), float(sd) * n ** -0.2)
         for c, (lo, hi, n, sd) in ranges.items()],
        "column string, lo double, hi double, n long, h double")
    centres = cells.join(F.broadcast(meta), "column").select(
        "column", "cnt", "n", "h",
        (F.col("lo") + (F.col("cell") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("c"))
    points = meta.select("column", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"),
                         "lo", "hi").select(
        "column", "point",
        (F.col("lo") + F.col("point") * (F.col("hi") - F.col("lo")) / (grid - 1)).alias("x"))
    z = (F.col("x") - F.col("c")) / F.col("h")
    # both sides bounded: columns x bins and columns x grid rows
    return (F.broadcast(points).join(centres, "column")
            .groupBy("column", "point", "x")
            .agg((F.sum(F.col("cnt") * F.exp(-0.5 * z * z))
                  / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density")))
