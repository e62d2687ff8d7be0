"""Type classes of columns and missing-value normalisation.

A column is *numeric* when its Spark type is a ``NumericType`` (booleans are
not), *categorical* when it is a string, *datetime* for date and both
timestamp types.  Nested columns belong to no class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    return "other"


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str) -> Column:
    """Predicate: the cell is missing (NULL, or NaN for floating columns)."""
    c = F.col(quote(name))
    if is_floating(df.schema[name].dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in float/double columns.

    Spark aggregates treat NaN as a value (``avg`` and ``corr`` return NaN,
    ``count`` counts it); pandas treats it as missing.  Normalising once at the
    start keeps every later aggregate NULL-aware.  Pure projection, no shuffle.
    """
    fl = [f.name for f in df.schema.fields if is_floating(f.dataType)]
    if not fl:
        return df
    return df.withColumns({n: F.when(~F.isnan(F.col(quote(n))), F.col(quote(n)))
                           for n in fl})


def quote(name: str) -> str:
    """Back-quote a column name so dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    return F.col(quote(name))


def as_double(name: str) -> Column:
    return qcol(name).cast("double")
