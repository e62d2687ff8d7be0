"""Trend analysis (M6) and the row-position line chart (V6).

The reference regresses each numeric column on its row position after sorting
by the date column and dropping that column's missing rows.  The regression
needs only sums over (position, value), so ``trends`` never numbers the rows
globally: one range shuffle of the rows, positions inside each sorted
partition and one small per-partition aggregate give the exact sums (see
``_position_regressions``); no un-partitioned window, no checkpoint.  The
line chart, which does need every row's position, uses ``global_index``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import nan_to_null, numeric_columns, qcol
from tabulon.operators.clean import find_datetime_column
from tabulon.operators.ranking import global_index

_COMPARABLE = (T.NumericType, T.StringType, T.DateType, T.TimestampType,
               T.TimestampNTZType, T.BooleanType)


def default_order(df: DataFrame, first: str) -> list[str]:
    """``first``, then every other comparable column: a total order up to
    identical rows, which are interchangeable in every operator here."""
    rest = [f.name for f in df.schema.fields
            if f.name != first and isinstance(f.dataType, _COMPARABLE)]
    return [first] + rest


def iso_text(c):
    """ISO-8601 text of a timestamp, with microseconds only when non-zero
    (Python ``isoformat``)."""
    micro = F.date_format(c, "SSSSSS")
    return F.when(micro == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")) \
        .otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def _datetime(df: DataFrame, date_col: str | None) -> tuple[DataFrame, str | None]:
    col = date_col or find_datetime_column(df)
    if col is None:
        return df, None
    if isinstance(df.schema[col].dataType, T.StringType):
        df = df.withColumn(col, F.try_to_timestamp(qcol(col)))
    return df, col


def trend_summary(df: DataFrame, date_col: str | None = None) -> DataFrame:
    """M6 header: ``(date_column, start, end, total_periods)``."""
    df, col = _datetime(df, date_col)
    if col is None:
        return df.sparkSession.createDataFrame(
            [], "date_column string, start string, end string, total_periods long")
    return df.agg(F.lit(col).alias("date_column"),
                  iso_text(F.min(qcol(col))).alias("start"),
                  iso_text(F.max(qcol(col))).alias("end"),
                  F.count(F.lit(1)).alias("total_periods"))


def trends(df: DataFrame, date_col: str | None = None,
           order_by: Sequence[str] | None = None,
           cols: Sequence[str] | None = None) -> DataFrame:
    """M6: ``(column, n, slope, intercept, r_squared, trend)`` per numeric column.

    Rows are ordered by ``order_by`` (default: the date column, then the other
    columns as tie-break); each column's rows with a missing date or value are
    dropped and the rest numbered 0..n-1.  Needs n > 2.  A constant series has
    r_squared 0 (SciPy's ``linregress``), not Spark's 1.
    """
    df = nan_to_null(df)
    df, col = _datetime(df, date_col)
    schema = ("column string, n long, slope double, intercept double, "
              "r_squared double, trend string")
    if col is None:
        return df.sparkSession.createDataFrame([], schema)
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], schema)
    order = list(order_by) if order_by else default_order(df, col)
    rows = df.where(qcol(col).isNotNull()).select(
        *[qcol(c).alias(f"_k{i}") for i, c in enumerate(order)],
        *[qcol(c).cast("double").alias(f"_y{i}") for i, c in enumerate(cols)])
    found = _position_regressions(rows, len(order), len(cols))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "cid int, column string")
    return found.where("n > 2").join(F.broadcast(names), "cid").select(
        "column", "n", "slope", "intercept", "r_squared",
        F.when(F.col("slope") > 0, "increasing").otherwise("decreasing").alias("trend"))


def _position_regressions(rows: DataFrame, n_keys: int, n_cols: int) -> DataFrame:
    """Least squares of each ``_y<i>`` on its 0-based position among the rows with
    a value, in order of the ``_k<i>``: ``(cid, n, slope, intercept, r_squared)``.

    The rows are range-partitioned and sorted once by their keys; only then
    are they unpivoted, to (column, partition, place, value) without keys.  A
    window inside one (column, partition) counts the places with a value, and
    partial sums per (column, partition) become exact global sums with the
    counts of the partitions before: sum(x y) = sum(offset * sum_y +
    sum(local * y)).  Values are centred on their column's mean first, so large
    offsets cost no digits; the sums of x and x^2 are closed forms.
    """
    mean = rows.agg(*[F.avg(f"_y{i}").alias(f"m{i}") for i in range(n_cols)]).first()
    keys = [F.col(f"_k{i}") for i in range(n_keys)] + [F.col("_tie")]
    placed = (rows.withColumn("_tie", F.monotonically_increasing_id())
              .repartitionByRange(_parts(rows), *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()))
    long = placed.select("_pid", "_pos", F.inline(F.array(*[
        F.struct(F.lit(i).alias("cid"), (F.col(f"_y{i}") - F.lit(mean[i] or 0.0)).alias("y"))
        for i in range(n_cols)]))).where("y is not null")
    local = F.row_number().over(Window.partitionBy("cid", "_pid").orderBy("_pos")) - 1
    parts = long.withColumn("x", local.cast("double")).groupBy("cid", "_pid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("y") * F.col("y")).alias("syy"))
    before = Window.partitionBy("cid").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(before), F.lit(0))
    whole = parts.withColumn("sxy", F.col("sxy") + offset * F.col("sy")).groupBy("cid").agg(
        *[F.sum(c).alias(c) for c in ("n", "sy", "sxy", "syy")])
    n, xbar = F.col("n").cast("double"), (F.col("n") - 1) / 2.0
    means = F.create_map(*[x for i in range(n_cols) for x in (F.lit(i), F.lit(mean[i]))])
    sums = whole.select("cid", "n", (n * (n * n - 1) / 12.0).alias("sxx"), xbar.alias("xbar"),
                        (F.col("sy") / n).alias("ybar"), (F.col("sxy") - xbar * F.col("sy")).alias("cxy"),
                        (F.col("syy") - F.col("sy") * F.col("sy") / n).alias("syy"))
    slope = F.when(F.col("sxx") > 0, F.col("cxy") / F.nullif(F.col("sxx"), F.lit(0.0)))
    r2 = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.least(F.lit(1.0), (
        F.col("cxy") * F.col("cxy") / F.nullif(F.col("sxx") * F.col("syy"), F.lit(0.0))))).otherwise(0.0)
    return sums.select("cid", "n", slope.alias("slope"), (means[F.col("cid")] + F.col("ybar")
                       - slope * F.col("xbar")).alias("intercept"), r2.alias("r_squared"))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def line_chart(df: DataFrame, order_by: Sequence[str], col: str | None = None,
               max_points: int | None = None) -> DataFrame:
    """V6: ``(idx, value)`` -- the first numeric column against row position
    in ``order_by`` order (a total order; the reference used the frame index).

    ``max_points`` averages consecutive rows into at most that many points
    for very long series; by default every row is kept.
    """
    df = nan_to_null(df)
    c = col or (numeric_columns(df) or [None])[0]
    if c is None:
        return df.sparkSession.createDataFrame([], "idx long, value double")
    keys = [F.col(f"_k{i}") for i in range(len(order_by))]
    base = df.select(*[qcol(o).alias(f"_k{i}") for i, o in enumerate(order_by)],
                     qcol(c).cast("double").alias("value"))
    idx = global_index(base, keys, name="idx").select("idx", "value")
    if not max_points:
        return idx
    n = df.count()
    width = max(1, -(-n // max_points))
    return (idx.groupBy((F.col("idx") / width).cast("long").alias("bucket"))
            .agg(F.min("idx").alias("idx"), F.avg("value").alias("value"))
            .select("idx", "value"))
