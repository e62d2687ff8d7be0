"""Connected components of a table of links, by alternating stars.

Each round joins every node's neighbours to its smallest neighbour, once for
the larger neighbours (large star) and once for the smaller ones (small star),
until the links no longer change; then every node hangs directly on its root.
Rounds grow with the logarithm of the longest path.  Each round is written to
the shared checkpoint folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")) \
        .where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every linked node and the smallest node of its component."""
    now = materialize(links.select(F.col(a).alias("a"), F.col(b).alias("b"))
                      .where("a <> b").distinct())
    seen = None
    while True:
        now = materialize(_small_star(_large_star(now)))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select("b", "b")).distinct()
