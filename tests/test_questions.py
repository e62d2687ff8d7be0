import datetime as dt
import math
import statistics

from pyspark.sql import functions as F

from tabulon.plans import questions as q

REGIONS, PRODUCTS = ("Harbour", "Hills", "Valley"), ("ink", "nib")


def sales(spark):
    """Own sales rows: every third day from 2023-05-03 on, amounts 100, 130, 160, ..."""
    day = dt.date(2023, 5, 3)
    rows = [(day + dt.timedelta(days=3 * i), 100 + 30 * (i * 5 % 12), REGIONS[i % 3], PRODUCTS[i % 5 % 2])
            for i in range(24)]
    return rows, spark.createDataFrame(rows, "date date, sales int, region string, product string")


def test_sales_questions(spark):
    rows, df = sales(spark)
    assert q.grand_total(df, "sales").first()["total"] == sum(r[1] for r in rows)
    means = {g: sum(r[1] for r in rows if r[2] == g) / 8 for g in REGIONS}
    top = q.top_group_by_mean(df, "region", "sales").first()
    best = min(means, key=lambda g: (-means[g], g))
    assert (top["group"], top["mean"]) == (best, means[best])
    x, y = [r[0].day for r in rows], [r[1] for r in rows]
    r = q.corr_with_day_of_month(df, "sales", "date").first()["r"]
    assert math.isclose(r, statistics.correlation(x, y), rel_tol=1e-9)
    assert q.count_where(df, F.col("sales") >= 400).first()["n"] == sum(r[1] >= 400 for r in rows)
    first = q.earliest_above(df, "sales", 400, "date", "sales", ["date", "sales"]).first()
    assert first["date"] == min(r[0] for r in rows if r[1] > 400)
    record = q.extreme_record(df, "sales", ["date", "region", "sales"], key="date").first()
    assert tuple(record) == min((r[0], r[2], r[1]) for r in rows if r[1] == max(y))
    assert q.most_frequent_in_range(df, "product", "date", 2023, 2023).first()["category"] == \
        max(PRODUCTS, key=[r[3] for r in rows].count)
    months = {r["month"]: r["total"] for r in q.monthly_totals(df, "date", F.col("sales")).collect()}
    assert months["2023-06"] == sum(r[1] for r in rows if r[0].month == 6)
    totals = {g: sum(r[1] for r in rows if r[2] == g) for g in REGIONS}
    assert [r["key"] for r in q.top_by_sum(df, "region", F.col("sales"), 2).collect()] == \
        sorted(REGIONS, key=lambda g: (-totals[g], g))[:2]
    views = q.sql(spark, {"sales": df}, "SELECT count(*) AS n FROM sales WHERE region = 'Hills'")
    assert views.first()["n"] == 8


def test_no_match_gives_no_row(spark):
    _rows, df = sales(spark)
    assert q.earliest_above(df, "sales", 10_000, "date", "region", ["date"]).collect() == []
    none = df.withColumn("sales", F.lit(None).cast("int"))
    assert q.extreme_record(none, "sales", ["region"], key="region").collect() == []
    assert q.extreme_record(df, "region", ["region"], key="product").first()["region"] == "Valley"


def test_delay_slope_row_level_equals_pre_aggregated(spark):
    rows = [("01-03-2020", dt.date(2020, 3, 11)), ("15-06-2020", dt.date(2020, 6, 20)),
            ("02-01-2021", dt.date(2021, 1, 30)), ("10-10-2021", dt.date(2021, 11, 1)),
            ("05-05-2022", dt.date(2022, 6, 30)), ("bad", dt.date(2022, 1, 1))]
    df = spark.createDataFrame(rows, "registered string, decided date")
    row = q.yearly_delay_slope(df, "registered", "decided", "decided").first()
    # per-year means 7.5, 26.5, 56 -> slope 24.25
    assert row["years"] == 3 and math.isclose(row["slope"], 24.25)
    parts = df.select(F.year("decided").alias("year"), F.lit(1).alias("n"),
                      F.datediff("decided", F.try_to_date("registered", "dd-MM-yyyy"))
                      .alias("delay")).where("delay IS NOT NULL")
    again = q.slope_of_yearly_mean(parts, "year", "delay", "n").first()
    assert math.isclose(again["slope"], row["slope"])
