import os
import tempfile

from tabulon.sources.files import append_to_table
from tabulon.streaming.ingest import append_stream, file_stream, request_log_stream, running_profile


def test_file_stream_profile_and_append(spark):
    base = tempfile.mkdtemp(prefix="tabulon-stream-", dir="/tmp")
    src = os.path.join(base, "in")
    schema = "id bigint, v double, t string"
    spark.createDataFrame([(1, 1.0, "a"), (2, None, None)], schema).write.parquet(src + "/p1")
    spark.createDataFrame([(3, float("nan"), "c")], schema).write.parquet(src + "/p2")
    stream = file_stream(spark, src + "/*", schema)
    q = (running_profile(stream).writeStream.format("memory").queryName("prof")
         .outputMode("complete").start())
    q.processAllAvailable()
    q.stop()
    got = {r["column"]: (r["rows"], r["missing"]) for r in spark.sql("select * from prof").collect()}
    assert got == {"id": (3, 0), "v": (3, 2), "t": (3, 1)}
    out = os.path.join(base, "out")
    a = append_stream(file_stream(spark, src + "/*", schema), out, os.path.join(base, "ck"),
                      trigger_once=True)
    a.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3


def test_request_log_once_across_restarts(spark):
    base = tempfile.mkdtemp(prefix="tabulon-stream-", dir="/tmp")
    src, out = os.path.join(base, "in"), os.path.join(base, "log")
    for day in (1, 2):
        spark.createDataFrame([(day, f"2024-01-0{day} 23:59:59", None), (day + 10, None, "x")],
                              "id bigint, timestamp string, q string").write.mode("append").parquet(src)
        stream = file_stream(spark, src, "id bigint, timestamp string, q string")
        assert request_log_stream(stream, out, os.path.join(base, "ck"), trigger_once=True).awaitTermination(120)
    rows = sorted((r["id"], str(r["date"])) for r in spark.read.json(out).collect())
    assert rows == [(1, "2024-01-01"), (2, "2024-01-02"), (11, "None"), (12, "None")]


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *v: spark.createDataFrame([(x, x % 2) for x in v], "id long, odd long")
    append_to_table(rows(1, 2), path, batch="a", partition_by=["odd"])
    append_to_table(rows(3), path, batch="b", partition_by=["odd"])
    append_to_table(rows(3, 4), path, batch="b", partition_by=["odd"])
    assert sorted((r["id"], r["batch"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "b")]
    append_to_table(rows(5), str(tmp_path / "u"))
    append_to_table(rows(5), str(tmp_path / "u"))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 2
