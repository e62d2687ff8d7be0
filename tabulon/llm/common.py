"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.session import checkpoint_dir

#: Bytes of one Arrow batch handed to Python, when the session sets no bound.
BATCH_BYTES = 8 << 20


def text_or_empty(col: str) -> Column:
    return F.coalesce(qcol(col).cast("string"), F.lit(""))


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts never fill a worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: lineage ends there, later readers prune columns, and a lost executor
    costs no recomputation of what was written.  ``codec``: the files' compression."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tabulon-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def sha256_joined(spans: Column) -> Column:
    """``kind:start:end`` of an ordered array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(
        s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"),
        s["end"].cast("string"))), ",")


SPAN = "struct<start:int,ord:int,end:int,kind:string>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def match_spans(text: Column, pattern: str, kind: str, order: int, keep) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as spans in code points.

    The pieces between the matches and the matches themselves give every
    position by their lengths.  ``keep(match) -> Column`` drops failing
    matches; they still use up their text.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("pos"), no_spans().alias("out"))

    def step(acc, x):
        begin = acc["pos"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"),
                        F.lit(kind).alias("kind")).cast(SPAN)
        out = F.when(keep(x["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.when(x["hit"].isNull(), acc).otherwise(
            F.struct(end.alias("pos"), out.alias("out")))

    zipped = F.zip_with(matches, gaps,
                        lambda m, g: F.struct(m.alias("hit"), g.alias("gap")))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])
