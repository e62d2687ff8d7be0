"""Texts that logs, guards and insights give back.

Fixed values: clients compare these texts, so they stay as they are.
"""

from __future__ import annotations

# cleaning log
REMOVED_DUPLICATES = "Removed {n} duplicate rows"
REMOVED_EMPTY = "Removed empty columns: {columns}"
CLEANED = "Applied basic data cleaning"
FILLED = "Filled {n} missing values in {column} with {how}"
NORMALIZED = "Normalized columns: {columns}"
ENCODED = "Encoded categorical column: {column}"
OUTLIERS = "Detected outliers: {info}"
# guards
NO_NUMERIC_SUMMARY = "No numeric columns found for summary statistics"
NO_NUMERIC_DISTRIBUTION = "No numeric columns found for distribution analysis"
FEW_FOR_CORRELATION = "Need at least 2 numeric columns for correlation analysis"
FEW_FOR_REGRESSION = "Need at least 2 numeric columns for regression analysis"
LITTLE_FOR_REGRESSION = "Insufficient data for regression analysis"
LITTLE_FOR_CLUSTERING = "Insufficient data for clustering analysis"
NO_DATETIME = "No datetime columns found for time series analysis"
NO_NUMERIC_SERIES = "No numeric columns found for time series analysis"
# insights
MISSING_SHARE = "Dataset has {pct:.1f}% missing values"
STRONG_PAIRS = "Found {n} strong correlations between variables"
NORMAL_COLUMNS = "Variables {columns} follow normal distribution"
STRONG_FIT = "Strong predictive relationship found (R² = {r2:.3f})"


class NotPossible(ValueError):
    """An analysis that the table has too few columns or rows for."""
