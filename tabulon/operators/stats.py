"""Correlation and distribution statistics.

Pearson r is taken over the rows where both columns are present (pandas'
pairwise-complete rule).  All pairs come from one scan: a task keeps, for every
pair of columns, the number of rows, both means and the three centred second
moments (a *co-moment block*), takes them from matrix products over Arrow batches
and merges them batch by batch; the blocks of the tasks are merged in Spark,
cell by cell and in two steps, by the same formula (Chan, Golub and LeVeque).
Per-column moments use the long-format aggregate of ``profile``.  A
constant column gives NULL (Spark's ``corr`` would raise DIVIDE_BY_ZERO under
ANSI).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import as_double, nan_to_null, numeric_columns
from tabulon.operators.profile import wide_to_long
from tabulon.operators.ranking import exact_quantiles

#: Groups in which the tasks' blocks are merged first.
MERGE_GROUPS = 64
#: Values of one Arrow slice, which bounds the memory of its matrix products.
SLICE_VALUES = 1 << 20
#: Moments of a pair: rows, both means, and centred sums of x*y, x*x and y*y.
CELL = "n double, mx double, my double, cxy double, cxx double, cyy double"


class CoMoments:
    """Moments of every ordered pair of columns over the rows where both are present."""

    def __init__(self, k: int):
        self.n, self.mean, self.cross, self.square = (np.zeros((k, k)) for _ in range(4))

    def add(self, x: np.ndarray) -> None:
        """Merge the moments of the rows of ``x`` (NaN: missing)."""
        here = ~np.isnan(x)
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            rows = here.sum(axis=0)
            first = x[here.argmax(axis=0), np.arange(x.shape[1])]  # keeps a constant column exact
            first = np.where(rows > 0, first, 0.0)
            middle = first + np.where(here, x - first, 0.0).sum(axis=0) / np.maximum(rows, 1)
            y, m = np.where(here, x - middle, 0.0), here.astype(float)
            n = m.T @ m
            least = np.maximum(n, 1)
            shift = y.T @ m / least  # [i, j]: mean of column i, less its middle, where j is present
            cross = y.T @ y - n * shift * shift.T
            square = (y * y).T @ m - n * shift * shift
            mean = middle[:, None] + shift
            total = self.n + n
            step = mean - self.mean
            part = np.where(total > 0, n / np.maximum(total, 1), 0.0)
            weight = self.n * part
            self.cross += cross + np.where(weight > 0, step * step.T * weight, 0.0)
            self.square += square + np.where(weight > 0, step * step * weight, 0.0)
            self.mean += np.where(n > 0, step * part, 0.0)
            self.n = total


def _blocks(k: int):
    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moments, seen = CoMoments(k), False
        rows = max(1, SLICE_VALUES // k)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                # a missing value becomes NaN
                moments.add(np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns], axis=1))
                seen = True
        if seen:
            i, j = np.triu_indices(k)
            m = moments
            cells = [m.n[i, j], m.mean[i, j], m.mean[j, i], m.cross[i, j], m.square[i, j], m.square[j, i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *map(pa.array, cells)],
                ["i", "j", "n", "mx", "my", "cxy", "cxx", "cyy"])
    return partial


def _merged(cells: Column) -> Column:
    """An array of one pair's blocks as one block."""
    def merge(a, b):
        n = a["n"] + b["n"]
        dx, dy = b["mx"] - a["mx"], b["my"] - a["my"]
        part = b["n"] / F.greatest(n, F.lit(1.0))
        both = a["n"] * part
        # an empty block has means of zero that say nothing
        moved = lambda m, d: F.when(a["n"] == 0, b[m]).when(b["n"] == 0, a[m]).otherwise(a[m] + d * part)
        gain = lambda d, e: F.when(both > 0, d * e * both).otherwise(0.0)
        return F.struct(n.alias("n"), moved("mx", dx).alias("mx"), moved("my", dy).alias("my"),
                        (a["cxy"] + b["cxy"] + gain(dx, dy)).alias("cxy"),
                        (a["cxx"] + b["cxx"] + gain(dx, dx)).alias("cxx"),
                        (a["cyy"] + b["cyy"] + gain(dy, dy)).alias("cyy"))
    zero = F.struct(*[F.lit(0.0).alias(c.split()[0]) for c in CELL.split(", ")])
    return F.aggregate(cells, zero, merge)


def co_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(i, j, n, mx, my, cxy, cxx, cyy)`` of every pair i <= j of ``cols`` (by
    position) over the rows where both are present: one scan of those columns,
    whatever their number; a task ships one row a pair."""
    names = [f"c{i}" for i in range(len(cols))]
    data = nan_to_null(df).select(*[as_double(c).alias(n) for c, n in zip(cols, names)])
    block = F.struct(*[F.col(c.split()[0]) for c in CELL.split(", ")])
    return data.mapInArrow(_blocks(len(cols)), f"i int, j int, {CELL}") \
        .groupBy("i", "j", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)).alias("g")) \
        .agg(_merged(F.collect_list(block)).alias("b")) \
        .groupBy("i", "j").agg(_merged(F.collect_list("b")).alias("b")).select("i", "j", "b.*")


def _pearson(cell) -> float | None:
    both = math.sqrt(cell["cxx"]) * math.sqrt(cell["cyy"]) if min(cell["cxx"], cell["cyy"]) > 0 else 0.0
    r = cell["cxy"] / both if both else math.nan
    return None if math.isnan(r) else max(-1.0, min(1.0, r))


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """M1: ``(var1, var2, r)`` for every ordered pair, diagonal included.

    Pairwise-complete, like pandas; a constant column gives NULL, and so does one
    with an infinite value.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    schema = "var1 string, var2 string, r double"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    found = {(c["i"], c["j"]): _pearson(c) for c in co_moments(df, cols).collect()}  # one row a pair
    return df.sparkSession.createDataFrame(
        [(a, b, found.get((min(i, j), max(i, j)))) for i, a in enumerate(cols) for j, b in enumerate(cols)], schema)


def strong_correlations(df: DataFrame, threshold: float = 0.7, cols: Sequence[str] | None = None,
                        matrix: DataFrame | None = None) -> DataFrame:
    """pairs with ``|r| > threshold``, upper triangle only (column order);
    ``matrix``: the columns' ``correlation_matrix``, if it is known already."""
    df = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    order = {c: i for i, c in enumerate(cols)}
    m = correlation_matrix(df, cols) if matrix is None else matrix
    pos = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))]) \
        if cols else None
    if pos is None:
        return m
    return m.where((pos[F.col("var1")] < pos[F.col("var2")]) & (F.abs("r") > threshold))


# ---------------------------------------------------------------- M2
def normality_p(n: int | None, g1: float | None, g2: float | None) -> float | None:
    """D'Agostino-Pearson K^2 p-value from count, population skewness and
    population excess kurtosis (D'Agostino 1970; Anscombe & Glynn 1983); none for
    n < 8 or an undefined moment."""
    if n is None or g1 is None or g2 is None or n < 8:
        return None
    try:
        n = float(n)
        b2 = g2 + 3.0
        y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
        beta2 = (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
                 / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))
        w2 = -1.0 + math.sqrt(2.0 * (beta2 - 1.0))
        delta = 1.0 / math.sqrt(0.5 * math.log(w2))
        alpha = math.sqrt(2.0 / (w2 - 1.0))
        ya = (1.0 if y == 0 else y) / alpha
        z1 = delta * math.log(ya + math.sqrt(ya * ya + 1.0))
        x = (b2 - 3.0 * (n - 1) / (n + 1)) / math.sqrt(
            24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
        sb = (6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
              * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
        a = 6.0 + 8.0 / sb * (2.0 / sb + math.sqrt(1.0 + 4.0 / (sb * sb)))
        d = 1.0 + x * math.sqrt(2.0 / (a - 4.0))
        if d == 0:
            return None
        t2 = math.copysign(1.0, d) * ((1.0 - 2.0 / a) / abs(d)) ** (1.0 / 3.0)
        z2 = ((1.0 - 2.0 / (9.0 * a)) - t2) / math.sqrt(2.0 / (9.0 * a))
        p = math.exp(-(z1 * z1 + z2 * z2) / 2.0)
    except (ValueError, ZeroDivisionError):
        return None
    return None if math.isnan(p) else p


def distribution(df: DataFrame, cols: Sequence[str] | None = None, alpha: float = 0.05,
                 approx_accuracy: int | None = None, quartiles: DataFrame | None = None) -> DataFrame:
    """M2: ``(position, column, mean, median, std, min, max, is_normal, p_value)``.

    ``is_normal`` is ``p_value > alpha``; an untestable column (n < 8, constant)
    has a NULL p-value and ``is_normal`` false.  ``quartiles``: the columns' exact
    quantiles, if they are known already.
    """
    df = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, mean double, median double, std double, "
                "min double, max double, is_normal boolean, p_value double")
    mom = wide_to_long(df, cols, {
        "n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
        "g1": F.skewness, "g2": F.kurtosis})
    medians = exact_quantiles(df, cols, [0.5], approx_accuracy) if quartiles is None else quartiles.where("prob = 0.5")
    med = {r["column"]: r["value"] for r in medians.collect()}
    rows = []  # one row per column is left: plain arithmetic
    for r in mom.orderBy("position").collect():
        p = normality_p(r["n"], r["g1"], r["g2"])
        rows.append((r["position"], r["column"], r["mean"], med.get(r["column"]), r["std"], r["min"], r["max"],
                     p is not None and p > alpha, p))
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, mean double, median double, std double, "
              "min double, max double, is_normal boolean, p_value double")
