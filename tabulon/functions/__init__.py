"""Column-level helpers: type classes, NaN handling, text expressions."""

from tabulon.functions.columns import (  # noqa: F401
    numeric_columns, string_columns, datetime_columns, kind_of, nan_to_null,
)
