"""Question-shaped queries (Q0-Q12).

The reference answered these with generated pandas code; they are plain
DataFrame queries here.  Each function takes the table(s) and the column
names, so the same query serves any data set.  Joins are left to Catalyst
(small dimension tables are broadcast by its size check); aggregates are
taken before joins where that shrinks the join input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol


def sql(spark: SparkSession, sources: dict[str, DataFrame], text: str) -> DataFrame:
    """Q0: ad-hoc SQL over named sources (temporary views)."""
    for name, df in sources.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)


def corr_with_day_of_month(df: DataFrame, value: str, date: str) -> DataFrame:
    """Q1: Pearson r of a value with the day of month of a date -> ``(r)``."""
    x = F.dayofmonth(qcol(date)).cast("double")
    y = qcol(value).cast("double")
    xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return df.agg((F.covar_pop(xm, ym) / F.nullif(F.stddev_pop(xm) * F.stddev_pop(ym),
                                                  F.lit(0.0))).alias("r"))


def grand_total(df: DataFrame, col: str) -> DataFrame:
    """Q2: ``(total)``."""
    return df.agg(F.sum(qcol(col)).alias("total"))


def top_group_by_mean(df: DataFrame, group: str, value: str, k: int = 1) -> DataFrame:
    """Q3: the ``k`` groups with the highest mean -> ``(group, mean)``; ties
    by group name.  The aggregate is partial; only groups reach the top-k."""
    return (df.groupBy(qcol(group).alias("group")).agg(F.avg(qcol(value)).alias("mean"))
            .orderBy(F.col("mean").desc(), F.col("group").asc()).limit(k))


def count_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Q4/Q12: ``(n)`` rows satisfying ``predicate`` (pushed into the scan)."""
    return df.where(predicate).agg(F.count(F.lit(1)).alias("n"))


def earliest_above(df: DataFrame, value: str, threshold: float, date: str,
                   key: str, cols: Sequence[str]) -> DataFrame:
    """Q5: the earliest row with ``value > threshold`` (ties by ``key``); no row
    if there is none.  A top-1 sort: each task keeps one row."""
    return (df.where(qcol(value) > F.lit(threshold))
            .orderBy(qcol(date).asc_nulls_last(), qcol(key).asc_nulls_last()).limit(1)
            .select(*[qcol(c) for c in cols]))


def extreme_record(df: DataFrame, by: str, cols: Sequence[str], largest: bool = True,
                   key: str | None = None) -> DataFrame:
    """Q12: the record with the largest (or smallest) ``by``, ties by the smallest
    ``key`` of any type; no row if every ``by`` is missing."""
    order = [qcol(by).desc() if largest else qcol(by).asc()] + ([qcol(key).asc()] if key else [])
    return df.where(qcol(by).isNotNull()).orderBy(*order).limit(1).select(*[qcol(c) for c in cols])


def most_frequent_in_range(df: DataFrame, category: str, date: str,
                           first_year: int, last_year: int) -> DataFrame:
    """Q8: the category with most rows whose year lies in a range ->
    ``(category, n)``; ties by category."""
    yr = F.year(qcol(date))
    return (df.where(yr.between(first_year, last_year) & qcol(category).isNotNull())
            .groupBy(qcol(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col("category").asc()).limit(1))


def yearly_delay_slope(df: DataFrame, start: str, end: str, year_of: str) -> DataFrame:
    """Q9: days from ``start`` to ``end``, mean per year of ``year_of``, and
    the least-squares slope of that mean over the years ->
    ``(years, slope)``.  ``start`` may be text in dd-MM-yyyy (parsed with
    ``try_to_date``)."""
    s = qcol(start)
    if dict(df.dtypes)[start] == "string":
        s = F.try_to_date(s, "dd-MM-yyyy")
    per_year = (df.select(F.year(qcol(year_of)).alias("year"),
                          F.datediff(qcol(end), s).alias("delay"))
                .where(F.col("delay").isNotNull())
                .groupBy("year").agg(F.avg("delay").alias("mean_delay")))
    return per_year.agg(F.count(F.lit(1)).alias("years"),
                        F.regr_slope("mean_delay", F.col("year").cast("double")).alias("slope"))


def slope_of_yearly_mean(df: DataFrame, year: str, total: str, count: str) -> DataFrame:
    """Q9 from pre-aggregated pieces: per year sum(total) / sum(count), then
    the least-squares slope over the years -> ``(years, slope)``.  Lets a
    fact table be aggregated per join key before the join."""
    per_year = (df.groupBy(qcol(year).alias("year"))
                .agg((F.sum(qcol(total)) / F.sum(qcol(count))).alias("mean_delay")))
    return per_year.agg(F.count(F.lit(1)).alias("years"),
                        F.regr_slope("mean_delay", F.col("year").cast("double")).alias("slope"))


def top_by_sum(df: DataFrame, key: str, value: Column, k: int = 5) -> DataFrame:
    """Q10/Q11: the ``k`` keys with the largest sum of ``value`` ->
    ``(key, total)``; ties by key."""
    return (df.groupBy(qcol(key).alias("key")).agg(F.sum(value).alias("total"))
            .orderBy(F.col("total").desc(), F.col("key").asc()).limit(k))


def monthly_totals(df: DataFrame, date: str, value: Column) -> DataFrame:
    """Q10: ``(month, total)`` -- the monthly trend of a measure."""
    return (df.groupBy(F.date_format(F.date_trunc("month", qcol(date)), "yyyy-MM").alias("month"))
            .agg(F.sum(value).alias("total")))


def top_n(df: DataFrame, by: str, cols: Sequence[str], n: int = 10,
          key: str | None = None) -> DataFrame:
    """Q11: the ``n`` rows with the largest ``by`` (a top-n sort; each task
    keeps n rows)."""
    order = [qcol(by).desc()] + ([qcol(key).asc()] if key else [])
    return df.orderBy(*order).limit(n).select(*[qcol(c) for c in cols])
