"""Cleaning operators.

Each is ``DataFrame -> DataFrame``.  Where a decision depends on the data
(which columns are empty, medians, category lists) one aggregate computes all
columns' facts at once; only that small row reaches the driver, then the
rewrite is a plain projection that stays lazy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.columns import (
    as_double, is_floating, nan_to_null, numeric_columns, qcol, quote, string_columns,
)
from tabulon.operators.profile import wide_to_long
from tabulon.operators.ranking import column_modes, quantile_table

# The whitespace pattern used for stripping text (Java regex,
# Unicode-aware so tabs, newlines and no-break spaces count as in Python).
STRIP_PATTERN = r"(?U)^\s+|\s+$"
# The currency symbols and thousands separator removed before a
# text value is read as a number, and the shape of a plain number.
MONEY_CHARS = "$£€,"
NUMBER_SHAPE = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
MONEY_SIGNS = "$£€"
ENCODE_MAX_DISTINCT = 10


def dedup(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop full-row duplicates (hash aggregate with map-side combine)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def empty_columns(df: DataFrame) -> list[str]:
    """Names of columns with no non-missing value (one aggregate, k numbers)."""
    if not df.columns:
        return []
    d = nan_to_null(df)
    got = {r["column"]: r["n"] for r in wide_to_long(
        d, d.columns, {"n": F.count}, value=lambda c: F.when(qcol(c).isNotNull(), F.lit(1))
    ).collect()}
    return [c for c in d.columns if got.get(c, 0) == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """drop all-missing columns."""
    empty = empty_columns(df)
    return df.drop(*empty) if empty else df


def strip_strings(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Strip leading/trailing whitespace of text columns; NULL stays NULL."""
    cols = list(cols) if cols is not None else string_columns(df)
    return df.withColumns({c: F.regexp_replace(qcol(c), STRIP_PATTERN, "") for c in cols})


def clean_data(df: DataFrame, empty: Sequence[str] | None = None) -> DataFrame:
    """De-duplicate, drop empty columns, strip text.  De-duplication runs
    first, so rows that differ only by whitespace both survive.

    Whether a column is empty does not change with de-duplication, so it is
    decided on the input (a scan) and the de-duplicating shuffle runs once.
    """
    empty = empty_columns(df) if empty is None else list(empty)
    return strip_strings(dedup(df).drop(*empty))


def fill_missing(df: DataFrame, approx_accuracy: int | None = None) -> DataFrame:
    """Numeric -> median, text -> mode (smallest value on ties),
    all-missing text -> 'Unknown', all-missing numeric stays missing.

    As in pandas, a numeric column with missing values comes back as double
    (its median may be fractional); a complete column keeps its type.  One
    pass counts the gaps, one distributed quantile job covers the numeric
    columns that have any, one mode job the text columns; the fill values
    are a few literals.
    """
    df = nan_to_null(df)
    nums = numeric_columns(df)
    texts = string_columns(df)
    if not nums and not texts:
        return df
    gaps = {r["column"]: r["missing"] for r in wide_to_long(
        df, nums + texts, {"missing": lambda v: F.count_if(v)},
        value=lambda c: qcol(c).isNull()).collect()}
    nums = [c for c in nums if gaps.get(c, 0) > 0]
    texts = [c for c in texts if gaps.get(c, 0) > 0]
    fills: dict[str, object] = {}
    if nums:
        for r in quantile_table(df, nums, [0.5], ["median"], approx_accuracy).collect():
            if r["median"] is not None:
                fills[r["column"]] = float(r["median"])
    if texts:
        found = {r["column"]: r["value"] for r in column_modes(df, texts).collect()}
        for c in texts:
            fills[c] = found.get(c, "Unknown")
    out = df.withColumns({c: as_double(c) for c in nums}) if nums else df
    exprs = {c: F.coalesce(qcol(c), F.lit(v)) for c, v in fills.items()}
    return out.withColumns(exprs) if exprs else out


def zscore(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """C4: ``(x - mean) / population std`` in place; zero variance -> 0,
    missing stays missing (scikit-learn ``StandardScaler`` semantics)."""
    df = nan_to_null(df)
    cols = list(cols) if cols is not None else numeric_columns(df)
    if not cols:
        return df
    m = {r["column"]: r for r in wide_to_long(
        df, cols, {"mean": F.avg, "sd": F.stddev_pop}).collect()}
    exprs = {}
    for c in cols:
        mu, sd = (m[c]["mean"], m[c]["sd"]) if c in m else (None, None)
        if mu is None:
            exprs[c] = as_double(c)
            continue
        scale = sd if sd else 1.0
        exprs[c] = (as_double(c) - F.lit(mu)) / F.lit(scale)
    return df.withColumns(exprs)


def _few_values(columns: int, most: int):
    """Per task the different values of each column, ``most`` at most."""
    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[set[str]] = [set() for _ in range(columns)]
        for batch in batches:
            for own, col in zip(found, batch.columns):
                if len(own) < most:
                    own.update(islice((v for v in pc.unique(col).to_pylist() if v is not None and v not in own),
                                      most - len(own)))
        rows = [(i, v) for i, own in enumerate(found) for v in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                          pa.array([r[1] for r in rows], pa.string())], ["column", "value"])
    return kept


def encode_categorical(df: DataFrame, max_distinct: int = ENCODE_MAX_DISTINCT,
                       cols: Sequence[str] | None = None) -> DataFrame:
    """Text columns with fewer than ``max_distinct`` distinct values get
    ``<col>_encoded`` = 0-based position of the value in ascending order.

    Every task keeps the different values of each column until it has
    ``max_distinct`` of them (such a column is out), so at most tasks x columns x
    ``max_distinct`` rows are shuffled and as many values of each column reach the
    driver.  The code is a literal array lookup, no join.  NULL stays NULL.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    if not cols:
        return df
    by_col: dict[str, list[str]] = {c: [] for c in cols}
    text = df.select(*[qcol(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    first = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    values = text.mapInArrow(_few_values(len(cols), max_distinct), "column int, value string").distinct()
    for r in values.withColumn("n", first).where(F.col("n") <= max_distinct).collect():
        by_col[cols[r["column"]]].append(r["value"])
    exprs = {}
    for c, found in by_col.items():
        if len(found) < max_distinct:
            arr = F.array(*[F.lit(v) for v in sorted(found, key=lambda v: v.encode())]) if found else \
                F.array().cast("array<string>")
            exprs[f"{c}_encoded"] = F.when(
                qcol(c).isNotNull(), F.array_position(arr, qcol(c)) - 1).cast("int")
    return df.withColumns(exprs) if exprs else df


def text_to_number(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Add ``<col>_numeric`` for text columns that look like numbers or money.

    A column qualifies when some non-missing value holds a currency symbol or
    starts with a digit (decided over all rows in one ``bool_or`` aggregate,
    not over a row-order-dependent first ten).  The value loses ``$ £ € ,``
    and is read as a double when it has the shape of a number, else NULL.
    Columns where nothing converts (dates, codes like ``12-ab``) are left out.
    """
    cols = list(cols) if cols is not None else string_columns(df)
    if not cols:
        return df
    facts = {r["column"]: r for r in wide_to_long(
        df, cols, {"hint": lambda v: F.bool_or(_looks_like_money(v)),
                   "n": lambda v: F.count(_to_number(v))},
        value=lambda c: qcol(c)).collect()}
    exprs = {f"{c}_numeric": _to_number(qcol(c)) for c in cols
             if c in facts and facts[c]["hint"] and facts[c]["n"] > 0}
    return df.withColumns(exprs) if exprs else df


def _looks_like_money(c):
    """A currency sign somewhere, or a digit first; no regular expression."""
    return (F.translate(c, MONEY_SIGNS, "") != c) | F.substring(c, 1, 1).between("0", "9")


def _to_number(c):
    s = F.translate(c, MONEY_CHARS, "")
    return F.when(s.rlike(NUMBER_SHAPE), F.trim(s).try_cast("double"))


def strip_column_names(df: DataFrame) -> DataFrame:
    """Column names as stripped strings."""
    return df.toDF(*[str(c).strip() for c in df.columns])


def parse_datetime(df: DataFrame, col: str, fmt: str | None = None,
                   name: str | None = None) -> DataFrame:
    """Text -> timestamp with ``try_to_timestamp`` (invalid -> NULL)."""
    c = qcol(col)
    parsed = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return df.withColumn(name or col, parsed)


def find_datetime_column(df: DataFrame, min_share: float = 0.5) -> str | None:
    """First datetime column, else the first text column whose name holds
    ``date`` or ``time`` and of which at least ``min_share`` parses."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return f.name
    cands = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.StringType)
             and ("date" in f.name.lower() or "time" in f.name.lower())]
    if not cands:
        return None
    share = {r["column"]: r["p"] for r in wide_to_long(
        df, cands, {"p": F.avg},
        value=lambda c: F.try_to_timestamp(qcol(c)).isNotNull().cast("double")).collect()}
    for c in cands:
        if share.get(c) is not None and share[c] >= min_share:
            return c
    return None


# Forms of dates in text, tried in this order (month before day, as pandas
# reads them); the first one is Spark's own reading of ISO dates and times.
DATE_FORMATS = ["", "MM/dd/yyyy", "dd/MM/yyyy", "MM-dd-yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "yyyyMMdd",
                "MMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss",
                "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss"]


def _as_time(text, fmt: str):
    return F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)


def convert_first_date(df: DataFrame, formats: Sequence[str] = DATE_FORMATS) -> tuple[DataFrame, str | None, str | None]:
    """The first datetime column as it is; else the text columns whose names hold
    ``date`` or ``time`` are tried in order, and the first of which one of ``formats``
    reads every non-missing value becomes a timestamp.

    Returns the table, the column's name and the format ("" for Spark's own; none
    without such a column).  One scan counts what every format reads of every candidate.
    """
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return df, f.name, None
    cands = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
             and ("date" in f.name.lower() or "time" in f.name.lower())]
    if not cands:
        return df, None, None
    read = {f"f{i}": (lambda fmt: lambda v: F.count(_as_time(F.trim(v), fmt)))(fmt) for i, fmt in enumerate(formats)}
    facts = {r["column"]: r for r in wide_to_long(df, cands, {"n": F.count, **read}, value=lambda c: qcol(c)).collect()}
    for c in cands:
        for i, fmt in enumerate(formats):
            if c in facts and 0 < facts[c]["n"] == facts[c][f"f{i}"]:
                return df.withColumn(c, _as_time(F.trim(qcol(c)), fmt)), c, fmt
    return df, None, None


def drop_incomplete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """listwise deletion over ``cols`` (NULL or NaN)."""
    d = nan_to_null(df)
    return d.dropna(subset=[quote(c) if "." in c else c for c in cols]) if cols else d


def is_float_column(df: DataFrame, c: str) -> bool:
    return is_floating(df.schema[c].dataType)
