"""Structured Streaming form of the ingest path.

The reference loaded uploaded files one request at a time.  On a cluster the
same work is a file stream: new files in a folder are read incrementally,
appended to a table (S13) and profiled as they arrive.  The running profile
is a streaming aggregation keyed by column name, so its state holds one
small row per column, however many rows flow through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabulon.functions.columns import missing


def file_stream(spark: SparkSession, folder: str, schema: T.StructType | str,
                fmt: str = "parquet", max_files_per_trigger: int | None = None,
                **options) -> DataFrame:
    """New files of ``folder`` as a streaming DataFrame (explicit schema:
    a stream cannot infer one per batch)."""
    r = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(folder)


def running_profile(stream: DataFrame) -> DataFrame:
    """Running ``(position, column, rows, missing)`` per column of a stream
    (complete output mode; state = one row per column)."""
    recs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                     missing(stream, c).alias("m")) for i, c in enumerate(stream.columns)]
    long = stream.select(F.explode(F.array(*recs)).alias("r")).select("r.*")
    return long.groupBy("position", "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("m").alias("missing"))


def append_stream(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                  partition_by: list[str] | None = None,
                  trigger_once: bool = False) -> StreamingQuery:
    """S13 as a stream: append every micro-batch to a table folder; the
    checkpoint (a shared folder) makes it exactly-once across restarts."""
    w = (stream.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", path))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def request_log_stream(stream: DataFrame, path: str, checkpoint: str,
                       ts_col: str = "timestamp", trigger_once: bool = False) -> StreamingQuery:
    """S16 as a stream: JSON lines appended into one folder per day, each request
    once across restarts (``checkpoint`` is a shared folder)."""
    dated = stream.withColumn("date", F.to_date(F.col(ts_col)))
    w = (dated.writeStream.format("json").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", path).partitionBy("date"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
