import math

from pyspark.sql import functions as F

from tabulon.operators import clean
from tabulon.plans.runner import run_operations


def test_strip_whitespace_tabs_and_nulls(spark):
    df = spark.createDataFrame([(" John ", 25), ("Jane\t", 30), (None, 35)],
                               "name string, age bigint")
    got = sorted(((r["name"], r["age"]) for r in clean.clean_data(df).collect()),
                 key=lambda r: r[1])
    assert got == [("John", 25), ("Jane", 30), (None, 35)]


def test_clean_data_dedups_before_strip_and_drops_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (" a", None)],
                               "t string, e string")
    out = clean.clean_data(df)
    assert out.columns == ["t"]
    assert sorted(r["t"] for r in out.collect()) == ["a", "a"]


def test_fill_missing_median_mode_unknown(spark):
    df = spark.createDataFrame([("John", 25.0, 50000.0), ("Jane", None, 60000.0),
                                (None, 35.0, None)], "name string, age double, salary double")
    r = {x["name"]: x for x in clean.fill_missing(df).collect()}
    got = sorted(clean.fill_missing(df).collect(), key=lambda x: x["age"])
    assert [x["age"] for x in got] == [25.0, 30.0, 35.0]  # median of 25, 35
    assert got[2]["salary"] == 55000.0                      # median of 50000, 60000
    # mode of ['John', 'Jane'] is a tie -> the smallest value
    assert got[2]["name"] == "Jane"
    allnull = spark.createDataFrame([(None, None)], "t string, v double")
    a = clean.fill_missing(allnull).first()
    assert a["t"] == "Unknown" and a["v"] is None


def test_zscore_population_std(spark):
    df = spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (3, 30, "c"), (4, 40, "a"),
                                (5, 50, "b")], "feature1 bigint, feature2 bigint, category string")
    out = clean.zscore(df).toPandas()
    for c in ["feature1", "feature2"]:
        assert abs(out[c].mean()) < 1e-12
        assert math.isclose(out[c].std(ddof=0), 1.0)
    const = spark.createDataFrame([(3.0,), (3.0,)], "k double")
    assert [r["k"] for r in clean.zscore(const).collect()] == [0.0, 0.0]


def test_encode_categorical_under_ten(spark):
    data = [(["A", "B", "C"][i % 3], f"d{i % 5}", f"id{i}") for i in range(12)]
    df = spark.createDataFrame(data, "category string, description string, unique_id string")
    out = clean.encode_categorical(df)
    assert "category_encoded" in out.columns and "description_encoded" in out.columns
    assert "unique_id_encoded" not in out.columns
    codes = {r["category"]: r["category_encoded"] for r in out.collect()}
    assert codes == {"A": 0, "B": 1, "C": 2}


def test_text_to_number_money(spark):
    df = spark.createDataFrame([(1, "Product A", "$100", 1000), (2, "Product B", "$2,000.5", 2000),
                                (3, "Product C", "n/a", 1500)],
                               "ID bigint, Name string, Price string, Sales bigint")
    out = clean.text_to_number(df)
    assert "Price_numeric" in out.columns and "Name_numeric" not in out.columns
    assert [r["Price_numeric"] for r in out.orderBy("ID").collect()] == [100.0, 2000.5, None]
    dates = spark.createDataFrame([("2024-01-02",)], "d string")
    assert "d_numeric" not in clean.text_to_number(dates).columns


def test_run_operations_dup4(spark):
    df = spark.createDataFrame([("Alice", 25.0, "A"), ("Bob", None, "B"), ("Alice", 25.0, "A"),
                                ("Carol", 35.0, None)], "name string, age double, category string")
    out, log = run_operations(df, ["clean_data", "handle_missing", "encode_categorical",
                                   "detect_outliers", "unknown_op"])
    got = out.orderBy("name").collect()
    assert len(got) == 3
    assert got[1]["age"] == 30.0 and got[2]["category"] == "A"
    assert "category_encoded" in out.columns
    assert any("Removed 1 duplicate rows" in x for x in log)
    assert any(x.startswith("Detected outliers") for x in log)


def test_find_and_parse_datetime(spark):
    df = spark.createDataFrame([("2024-01-02 10:00:00", 1), ("bad", 2)], "event_time string, v int")
    assert clean.find_datetime_column(df) == "event_time"
    p = clean.parse_datetime(df, "event_time").orderBy("v").collect()
    assert p[0]["event_time"] is not None and p[1]["event_time"] is None
    assert clean.strip_column_names(df.toDF(" a ", "b ")).columns == ["a", "b"]
    assert clean.drop_incomplete(spark.createDataFrame([(1.0,), (float("nan"),)], "x double"),
                                 ["x"]).count() == 1
    assert clean.find_datetime_column(df.select("v")) is None
    assert F is not None


def test_fill_missing_types_follow_pandas(spark):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 40)], "full bigint, gappy bigint")
    out = clean.fill_missing(df)
    assert dict(out.dtypes) == {"full": "bigint", "gappy": "double"}
    assert sorted(r["gappy"] for r in out.collect()) == [10.0, 25.0, 40.0]


def test_first_date_column_by_trying_every_format(spark):
    df = spark.createDataFrame([("02/03/2021", "x", " 13-02-2020 ", 1), ("12/31/2021", "2020-01-01", None, 2), (None, None, "01-03-2020", 3)],
                               "note string, a_time string, b_date string, n int")
    out, col, fmt = clean.convert_first_date(df)
    assert (col, fmt) == ("b_date", "dd-MM-yyyy")
    assert [str(r[0]) for r in out.orderBy("n").select("b_date").collect()] == ["2020-02-13 00:00:00", "None", "2020-03-01 00:00:00"]
    own, col, fmt = clean.convert_first_date(df.withColumnRenamed("note", "x.date").drop("b_date"))
    assert (col, fmt) == ("x.date", "MM/dd/yyyy") and dict(own.dtypes)["x.date"] == "timestamp"
    assert clean.convert_first_date(out)[1:] == ("b_date", None)
    assert clean.convert_first_date(df.select("note", "n"))[1:] == (None, None)
    assert clean.convert_first_date(df.limit(0))[1:] == (None, None)
