import json
import os
import tempfile

import pytest

from tabulon.sources import files


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="tabulon-src-", dir="/tmp")


def write(folder, name, text):
    p = os.path.join(folder, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_csv_types_and_na_words(spark, folder):
    p = write(folder, "data.csv", "date,sales,region,price\n2024-01-02,1200,North,1.5\n"
              "2024-01-05,NA,South,n/a\n2024-01-08,1500, East ,2\n")
    df = files.load(spark, p)
    types = dict(df.dtypes)
    assert types == {"date": "date", "sales": "bigint", "region": "string", "price": "double"}
    rows = df.orderBy("date").collect()
    assert rows[1]["sales"] is None and rows[1]["price"] is None
    assert df.agg({"sales": "sum"}).first()[0] == 2700


def test_tsv_txt_pipe_and_json(spark, folder):
    t = write(folder, "a.tsv", "item\tvalue\nx\t1\ny\t2\n")
    assert files.load(spark, t).count() == 2
    pipe = write(folder, "b.txt", "item|value\nx|1\n")
    assert files.load(spark, pipe).columns == ["item", "value"]
    arr = write(folder, "products.json",
                json.dumps([{"product": "laptop", "price": 1200}, {"product": "mouse", "price": 25}]))
    j = files.load(spark, arr)
    assert sorted(r["price"] for r in j.collect()) == [25, 1200]
    nested = write(folder, "n.json", '{"a": 1, "b": {"c": 2, "d": {"e": "x"}}}\n')
    assert sorted(files.load(spark, nested).columns) == ["a", "b.c", "b.d.e"]


def test_errors_and_manifest(spark, folder):
    with pytest.raises(ValueError):
        files.load(spark, write(folder, "mystery.xyz", "?"))
    with pytest.raises(FileNotFoundError):
        files.load(spark, os.path.join(folder, "missing.csv"))
    write(folder, "notes.txt", "hello")
    write(folder, "img.png", "x" * 10)
    m = {r["name"]: r for r in files.file_manifest(spark, folder).collect()}
    assert m["img.png"]["category"] == "images" and m["img.png"]["bytes"] == 10
    assert m["notes.txt"]["category"] == "text"
    s = {r["category"]: r["files"] for r in files.manifest_summary(
        files.file_manifest(spark, folder)).collect()}
    assert s["images"] == 1


def test_load_sources_keeps_going(spark, folder):
    good = write(folder, "employees.csv", "name,age\nann,30\nbob,40\n")
    empty = write(folder, "small.csv", "a,b\n")
    frames, status = files.load_sources(spark, [good, empty, os.path.join(folder, "x.csv")])
    st = {r["index"]: r for r in status.collect()}
    assert st[0]["success"] and st[0]["n_rows"] == 2
    assert not st[1]["success"] and not st[2]["success"]
    assert list(frames) == [0]


def test_append_head_answers(spark):
    a = spark.createDataFrame([(1, "x")], "k bigint, v string")
    b = spark.createDataFrame([(2, "y")], "id bigint, name string")
    assert files.append_tables([a, b]).count() == 2
    assert files.append_tables([a, b.toDF("k", "v")], by_name=True).count() == 2
    head = files.sample_head(spark.range(100).toDF("id"), ["id"], 3).collect()
    assert [r["id"] for r in head] == [0, 1, 2]
    ans = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "id int, pos int, answer string")
    assert files.answers_json(ans, "id", "pos", "answer").first()["json"] == '["a","b"]'
    keys = spark.createDataFrame([(1, ["k1", "k2", "k3"])], "id int, keys array<string>")
    obj = json.loads(files.answers_json(ans, "id", "pos", "answer", keys).first()["json"])
    assert obj == {"k1": "a", "k2": "b", "k3": None}


def test_parse_json_column(spark):
    df = spark.createDataFrame([(1, '{"k": 69, "m": {"z": "a"}}'), (2, None)], "id int, props string")
    out = files.parse_json_column(df, "props").orderBy("id").collect()
    assert out[0]["props.k"] == 69 and out[0]["props.m.z"] == "a" and out[1]["props.k"] is None


def test_partitioned_parquet_and_object_paths(spark, folder):
    from pyspark.sql import functions as F
    out = os.path.join(folder, "court")
    spark.createDataFrame([(2019, "a", 1), (2020, "a", 2), (2020, "b", 3)],
                          "year int, court string, v int").write.partitionBy("year", "court") \
        .parquet(out)
    part = files.read_parquet(spark, os.path.join(out, "year=2020"), base_path=out)
    assert sorted(part.columns) == ["court", "v", "year"] and part.count() == 2
    pruned = files.read_parquet(spark, out).where(F.col("year") == 2019)
    assert pruned.count() == 1
    assert files.object_path("bucket", "/a/b.parquet") == "s3a://bucket/a/b.parquet"
