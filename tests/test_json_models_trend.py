"""JSON without lost rows or keys, models on any column name, trends with large offsets."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import models, trend
from tabulon.sources.files import parse_json_column, read_csv, read_delimited_text, read_json


def _file(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_json_lines_after_a_blank_line(spark, tmp_path):
    path = _file(tmp_path / "a", "x.json", "\n  \n{\"a\": 1}\n\n{\"a\": 2, \"b\": {\"c\": \"z\"}}\n{\"a\": 3}\n")
    rows = read_json(spark, path).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, None), (2, "z"), (3, None)]
    assert rows[0].__fields__ == ["a", "b.c"]


def test_lines_and_documents_in_one_folder(spark, tmp_path):
    _file(tmp_path / "m", "lines.json", "{\"a\": 1}\n[{\"a\": 2}, {\"a\": 3}]\n")
    _file(tmp_path / "m", "pretty.json", "[\n  {\"a\": 4},\n  {\"a\": 5,\n \"b\": true}\n]\n")
    path = _file(tmp_path / "m", "one.json", "{\n \"a\": 6\n}")
    assert sorted(r["a"] for r in read_json(spark, path).collect()) == [1, 2, 3, 4, 5, 6]


def test_documents_of_many_kinds_keep_types_and_rows(spark, tmp_path):
    folder = tmp_path / "k"
    rows = [{"i": i, "x": i / 4, "s": f"t{i}", "n": {"a b": [i, None], "deep": {"z": True}}} for i in range(50)]
    rows[7]["i"] = 2 ** 40
    rows[9]["extra"] = {}
    rows[11]["mixed"], rows[12]["mixed"], rows[13]["mixed"] = 1, "one", {"k": [1]}
    _file(folder, "lines.json", "\n".join(map(json.dumps, rows[:20])) + "\n\n")
    _file(folder, "array.json", json.dumps(rows[20:30]))
    _file(folder, "pretty.json", "\n\n" + json.dumps(rows[30:40], indent=2))
    for i in range(40, 50):
        path = _file(folder, f"one{i}.json", json.dumps(rows[i], indent=4))
    df = read_json(spark, path)
    got = {r["s"]: r for r in df.collect()}
    assert dict(df.dtypes) == {"extra": "map<string,string>", "i": "bigint", "mixed": "string", "n.a b": "array<bigint>",
                               "n.deep.z": "boolean", "s": "string", "x": "double"}
    assert len(got) == 50
    for r in rows:
        assert (got[r["s"]]["i"], got[r["s"]]["x"], got[r["s"]]["n.a b"]) == (r["i"], r["x"], r["n"]["a b"])
    assert [got[f"t{i}"]["mixed"] for i in (11, 12, 13)] == ["1", "one", '{"k":[1]}']
    own = read_json(spark, path, schema="i double, s string")
    assert own.columns == ["i", "s"] and sorted(r["i"] for r in own.collect())[-1] == 2.0 ** 40


@pytest.mark.parametrize("text", ["[1, 2]\n", "{\"a\": 1}\n[2]\n", "", "\n \n", "{\"a\": 1} {\"a\": 2}\n", "[\n{\"a\": 1}\n] 7\n"])
def test_values_that_are_no_objects_fail(spark, tmp_path, text):
    with pytest.raises(ValueError, match="Not a JSON table"):
        read_json(spark, _file(tmp_path / "v", "x.json", text))


def test_delimiter_of_every_file(spark, tmp_path):
    _file(tmp_path / "d", "a.txt", "\nid\tv\n1\tx|y\n")
    _file(tmp_path / "d", "b.txt", "id|v\n2|a,b\n")
    path = _file(tmp_path / "d", "c.txt", "v,id\nz,3\n")
    df = read_delimited_text(spark, path)
    assert sorted((r["id"], r["v"]) for r in df.collect()) == [(1, "x|y"), (2, "a,b"), (3, "z")]
    assert dict(df.dtypes)["id"] == "bigint"


def test_text_that_is_no_json_fails(spark, tmp_path):
    path = _file(tmp_path / "bad", "x.json", "{\"a\": 1}\n{\"a\": 2\n{\"a\": 3}\n")
    with pytest.raises(ValueError, match="Not a JSON table"):
        read_json(spark, path)


def test_json_column_has_the_keys_of_all_rows(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2, "b": {"x y": "t"}}'), (3, "no json"), (4, None),
                                (5, '{"c": 1.5, "d": [1], "e": null}'), (6, '{"c": "text", "e": {}}')], "id int, p string")
    for parts in (1, 6):
        got = {r["id"]: r.asDict() for r in parse_json_column(df.repartition(parts), "p").collect()}
        assert got[1]["p.a"] == 1 and got[2]["p.b.x y"] == "t" and got[2]["p.a"] == 2
        assert got[5]["p.c"] == "1.5" and got[6]["p.c"] == "text" and got[5]["p.d"] == [1]
        assert got[3]["p.a"] is None and got[4]["p.a"] is None


def test_missing_words_with_and_without_a_schema(spark, tmp_path):
    path = _file(tmp_path / "c", "x.csv", " a , b\n1,NA\nnull,x\n")
    want = [(None, "x"), (1, None)]
    for df in (read_csv(spark, path), read_csv(spark, path, schema="a bigint, b string")):
        assert df.columns == ["a", "b"]
        assert sorted((tuple(r) for r in df.collect()), key=str, reverse=True) == want


def test_models_on_dotted_names_in_any_layout(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    pdf = pd.DataFrame({"id": range(400), "a.b": x[:, 0], "c": x[:, 1], "label": 3 * x[:, 0] - x[:, 1] + 1})
    df = spark.createDataFrame(pdf)
    coefs = {r["feature"]: r["coefficient"] for r in models.linear_regression(df, ["id"], "label", ["a.b", "c"])[0].collect()}
    assert coefs == {"a.b": pytest.approx(3), "c": pytest.approx(-1), "(intercept)": pytest.approx(1)}
    fits = [models.kmeans_elbow(df.repartition(n), ["a.b", "c"], max_k=4) for n in (1, 7)]
    assert [r["inertia"] for r in fits[0][0].orderBy("k").collect()] == \
        pytest.approx([r["inertia"] for r in fits[1][0].orderBy("k").collect()])


def test_trend_with_a_large_offset_and_gaps(spark):
    n = 20_000
    df = spark.range(n).select(
        F.timestamp_seconds(F.col("id")).alias("t"), (F.lit(1e12) + F.col("id") * 0.001).alias("big"),
        F.when(F.col("id") % 3 != 0, F.col("id") * 2.0).alias("gaps"), F.lit(None).cast("double").alias("none"))
    got = {r["column"]: r for r in trend.trends(df.repartition(5), "t", ["t"]).collect()}
    y = 1e12 + np.arange(n) * 0.001
    x = np.arange(n) - (n - 1) / 2
    want = (x * (y - y.mean())).sum() / (x * x).sum()
    assert got["big"]["slope"] == pytest.approx(want, rel=1e-7) and got["big"]["r_squared"] > 0.999
    assert got["gaps"]["n"] == n - (n + 2) // 3 and got["gaps"]["slope"] == pytest.approx(3, rel=1e-3)
    assert "none" not in got
