"""Order statistics without a single-task step.

Spark's exact ``percentile`` and ``mode`` aggregates keep a value -> count map
per group and merge all of it in one task for a global aggregate; an
un-partitioned window moves every row to one task.  At 100 TB neither is
acceptable, so the operators here are built from shuffles that split the work:

* ``exact_quantiles`` -- bracket refinement: one scan gives, per column and
  probability, two neighbouring values from Spark's bounded quantile sketch;
  the next scan counts the rows below and inside that bracket (so the sketch's
  error does no harm) and sketches inside it, until a bracket is a single
  value.  A bracket shrinks by the sketch's accuracy (some thousand times) per
  scan: a few scans for any number of rows, each a few rows of partial
  aggregates, no shuffle of the data and no copy of it.  The two neighbouring
  ranks are linearly interpolated as pandas, NumPy's default and DuckDB
  ``quantile_cont`` do.
* ``column_modes`` -- most frequent value per column, smallest value on ties,
  with a partial ``min(struct(-cnt, value))`` aggregate.
* ``top_values`` -- top-k per column: ``row_number() <= k`` that Spark plans
  as a partial per-task limit before the shuffle and a final one after it.
* ``global_index`` -- 0-based row number in a total order, optionally
  restarting per group, from a range shuffle plus
  ``monotonically_increasing_id`` and broadcast offsets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol

#: Accuracy of the quantile sketch (rank error 1 / accuracy of the bracket's rows).
SKETCH = 10_000


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def long_values(df: DataFrame, cols: Sequence[str], cast: str = "double") -> DataFrame:
    """Unpivot ``cols`` into ``(column, value)`` rows, dropping NULL and NaN.

    A single generator projection: no shuffle, the scan reads ``cols`` only.
    """
    pairs = [F.struct(F.lit(c).alias("column"), qcol(c).cast(cast).alias("value"))
             for c in cols]
    out = df.select(F.explode(F.array(*pairs)).alias("kv")).select("kv.column", "kv.value")
    cond = F.col("value").isNotNull()
    if cast in ("double", "float"):
        cond = cond & ~F.isnan("value")
    return out.where(cond)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    approx_accuracy: int | None = None) -> DataFrame:
    """Quantiles of every column in ``cols`` -> ``(column, prob, value)``
    (columns x probabilities rows, returned materialised; columns without a
    value are left out).

    ``approx_accuracy`` takes the sketch's own answer instead (one scan, rank
    error about n / accuracy).
    """
    schema = "column string, prob double, value double"
    spark, cols, probs = df.sparkSession, list(cols), [float(p) for p in probs]
    if not cols or not probs:
        return spark.createDataFrame([], schema)
    data = df.select(*[F.when(~F.isnan(qcol(c).cast("double")), qcol(c).cast("double")).alias(f"x{i}")
                       for i, c in enumerate(cols)])
    if approx_accuracy:
        row = data.agg(*[F.percentile_approx(f"x{i}", probs, approx_accuracy).alias(f"q{i}")
                         for i in range(len(cols))]).first()
        got = [(c, p, v) for i, c in enumerate(cols) if row[f"q{i}"] for p, v in zip(probs, row[f"q{i}"])]
    else:
        found = _order_statistics(data, len(cols), probs)
        got = [(c, p, found[i, p]) for i, c in enumerate(cols) for p in probs if (i, p) in found]
    return spark.createDataFrame(got, schema)


class _Bracket:
    """Rank ``rank`` (from 0) of a column, known to lie among the ``inside`` rows
    with values strictly between a and b (none: no bound), ``below`` rows being
    smaller."""

    def __init__(self, col: int, rank: int, n: int):
        self.col, self.rank = col, rank
        self.a, self.b, self.below, self.inside = None, None, 0, n

    def around(self) -> list[float]:
        """Probabilities inside the bracket, a little below and above the rank."""
        gap = 2 * (self.inside / SKETCH + 1)
        return [min(max((self.rank - self.below + d + 0.5) / self.inside, 0.0), 1.0) for d in (-gap, gap)]

    def narrow(self, guess: tuple[float, float], counts: list[int]) -> float | None:
        """The value at the rank, if the counts (of the column's rows below and up
        to either guess) tell it.  Otherwise the bracket loses at least the values of
        the guess, whatever that was worth."""
        (a, z), (lt_a, le_a, lt_z, le_z) = guess, counts
        if lt_a <= self.rank < le_a:
            return a
        if lt_z <= self.rank < le_z:
            return z
        end = self.below + self.inside
        if self.rank < lt_a:
            self.b, end = a, lt_a
        elif self.rank >= le_z:
            self.a, self.below = z, le_z
        else:
            self.a, self.b, self.below, end = a, z, le_a, lt_z
        self.inside = end - self.below
        return None


def _order_statistics(data: DataFrame, k: int, probs: Sequence[float]) -> dict[tuple, float]:
    """Interpolated quantiles ``{(column, prob): value}`` of the columns x0 .. xk-1."""
    eps = 2.0 / SKETCH
    ends = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-eps, eps)]
    first = data.agg(*[e for i in range(k) for e in (
        F.count(f"x{i}").alias(f"n{i}"), F.percentile_approx(f"x{i}", ends, SKETCH).alias(f"q{i}"))]).first()
    ranks, open_, guess, values = {}, {}, {}, {}
    for i in range(k):
        n = first[f"n{i}"]
        for j, p in enumerate(probs if n else ()):
            lo = min(int((n - 1) * p), n - 1)
            ranks[i, p] = (lo, min(lo + ((n - 1) * p > lo), n - 1), (n - 1) * p - lo)
            for r in ranks[i, p][:2]:
                open_[i, r] = _Bracket(i, r, n)
                guess[i, r] = tuple(first[f"q{i}"][2 * j:2 * j + 2])
    while wide := [key for key, b in open_.items() if b.inside > SKETCH]:
        if any(key not in guess for key in wide):
            got = _members(data, [open_[key] for key in wide]).agg(*[
                F.percentile_approx(F.when(F.col("j") == j, F.col("value")), open_[key].around(), SKETCH)
                for j, key in enumerate(wide)]).first()
            guess = {key: tuple(got[j]) for j, key in enumerate(wide)}
        counts = _rows_up_to(data, [sorted({v for key in wide if key[0] == i for v in guess[key]}) for i in range(k)])
        for key in wide:
            a, z = guess.pop(key)
            found = open_[key].narrow((a, z), [*counts[key[0], a], *counts[key[0], z]])
            if found is not None:
                values[key] = found
                del open_[key]
    # what is left: at most SKETCH rows of each bracket
    keys = list(open_)
    if keys:
        for r in _members(data, [open_[key] for key in keys]).groupBy("j") \
                .agg(F.sort_array(F.collect_list("value")).alias("row")).collect():
            bracket = open_[keys[r["j"]]]
            values[keys[r["j"]]] = r["row"][bracket.rank - bracket.below]
    return {(i, p): values[i, lo] + (values[i, hi] - values[i, lo]) * frac
            for (i, p), (lo, hi, frac) in ranks.items()}


def _rows_up_to(data: DataFrame, bounds: Sequence[Sequence[float]]) -> dict[tuple[int, float], tuple[int, int]]:
    """``{(column, bound): (rows below, rows up to it)}`` of the columns x0 ..: one
    scan of the columns that have bounds, and one row a bound from each task."""
    cols = [i for i, b in enumerate(bounds) if b]
    edges = {i: np.array(bounds[i], dtype=float) for i in cols}

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros((2, len(edges[i]) + 1), dtype=np.int64) for i in cols}
        for batch in batches:
            for j, i in enumerate(cols):
                x = batch.column(j).drop_null().to_numpy(zero_copy_only=False)
                for row, side in enumerate(("right", "left")):
                    total[i][row] += np.bincount(np.searchsorted(edges[i], x, side), minlength=len(edges[i]) + 1)
        for i in cols:
            below, up_to = total[i].cumsum(axis=1)[:, :-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(below), i, np.int32)), pa.array(np.arange(len(below), dtype=np.int32)),
                 pa.array(below), pa.array(up_to)], ["i", "j", "below", "up_to"])

    found = data.select(*[f"x{i}" for i in cols]).mapInArrow(partial, "i int, j int, below long, up_to long") \
        .groupBy("i", "j").agg(F.sum("below").alias("below"), F.sum("up_to").alias("up_to")).collect()
    return {(r["i"], bounds[r["i"]][r["j"]]): (r["below"], r["up_to"]) for r in found}


def _members(data: DataFrame, brackets: Sequence[_Bracket]) -> DataFrame:
    """``(j, value)``: the rows inside the j-th bracket.  (As Spark expressions the
    brackets' bounds fill a method too long for the JVM to compile.)"""
    cols = sorted({b.col for b in brackets})

    def inside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {i: batch.column(n).drop_null().to_numpy(zero_copy_only=False) for n, i in enumerate(cols)}
            for j, b in enumerate(brackets):
                x = values[b.col]
                if b.a is not None:
                    x = x[x > b.a]
                if b.b is not None:
                    x = x[x < b.b]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), j, np.int32)), pa.array(x)], ["j", "value"])
    return data.select(*[f"x{i}" for i in cols]).mapInArrow(inside, "j int, value double")


def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str],
                   approx_accuracy: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """Quantiles pivoted to one row per column: ``(column, names...)``; ``known``:
    those that ``exact_quantiles`` has given already."""
    q = exact_quantiles(df, cols, probs, approx_accuracy) if known is None else known
    aggs = [F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(n)
            for p, n in zip(probs, names)]
    return q.groupBy("column").agg(*aggs)


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-NULL value per column -> ``(column, value, cnt)``.

    Ties go to the smallest value (pandas ``mode().iloc[0]``).  Values are
    compared as strings; callers pass string columns.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, cnt long")
    counts = (long_values(df, cols, cast="string")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value"))).alias("m"))
    return best.select("column", F.col("m.value").alias("value"),
                       (-F.col("m.neg")).alias("cnt"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Top-``k`` values per column by frequency -> ``(column, value, cnt, rank)``.

    Order: count descending, then value ascending (a total order, so the cut
    at ``k`` is deterministic).  See ``top_k_counts`` for why no task ever
    holds a whole column.
    """
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, cnt long, rank int")
    counts = (long_values(df, cols, cast="string")
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")))
    return top_k_counts(counts, k)


def top_k_counts(counts: DataFrame, k: int, group: str = "column", key: str = "value",
                 weight: str = "cnt") -> DataFrame:
    """Top-``k`` rows per ``group`` of an already aggregated table.

    ``row_number() <= k`` over ``partitionBy(group)`` is planned by Spark as a
    partial ``WindowGroupLimit`` in every map task before the shuffle, so
    each task ships at most k rows per group and the final window partition
    of a group holds at most k x map tasks rows -- never a whole column.
    """
    order = [F.col(weight).desc(), F.col(key).asc()]
    return (counts.withColumn("rank", F.row_number().over(
        Window.partitionBy(group).orderBy(*order)))
        .where(F.col("rank") <= k))


def global_index(df: DataFrame, order_by: Sequence[str | Column], group: str | None = None,
                 name: str = "idx") -> DataFrame:
    """Add a 0-based row number over ``order_by`` (restarting per ``group``).

    ``order_by`` must be a total order (end it with a unique key).  Rows are
    range-partitioned on ``(group, order_by)`` and sorted inside partitions;
    ``monotonically_increasing_id`` then numbers them inside each partition
    with no further shuffle, and a broadcast table of per-partition counts
    (at most partitions x groups rows) turns that into the global number.
    The numbered rows are checkpointed to ``spark.checkpoint.dir`` so both
    readers see the same partition ids even after a lost executor.
    Keep ``group`` to a column of few values (a column name, a series id).
    """
    # a per-row id as the last key: rows equal on every key (even a third of
    # all rows) can then be split over several range partitions; such rows
    # are interchangeable, so their relative order does not matter
    df = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = ([F.col(group)] if group else []) + [
        F.col(c) if isinstance(c, str) else c for c in order_by] + [F.col("_tie")]
    g = F.col(group) if group else F.lit(0)
    r = (df.repartitionByRange(_partitions(df), *keys)
         .sortWithinPartitions(*keys)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_g", g)
         .withColumn("_pos", F.monotonically_increasing_id()
                     - F.shiftleft(F.col("_pid").cast("long"), 33))
         .checkpoint(eager=True))  # ids are read twice below: freeze them
    parts = r.groupBy("_g", "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                         F.min("_pos").alias("_min"))
    w = Window.partitionBy("_g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = parts.select("_g", "_pid", "_min",
                        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = r.join(F.broadcast(offs), ["_g", "_pid"])
    return out.withColumn(name, F.col("_off") + F.col("_pos") - F.col("_min")).drop(
        "_g", "_pid", "_pos", "_min", "_off", "_tie")
