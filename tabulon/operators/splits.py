"""Reproducible split search of a regression tree (M4).

Features are cut at exact quantiles into bins; a level of the tree is one
aggregate over (node, feature, bin), and the best cut of a node is the one with the
largest fall of the variance.  Nothing is drawn at random, so every engine finds the
same splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import nan_to_null, qcol
from tabulon.operators.ranking import exact_quantiles
from tabulon.session import materialized

SCHEMA = ("node long, depth int, feature string, threshold double, n long, mean double, "
          "gain double, n_left long, mean_left double, mean_right double")
#: Digits to which shares of the variance are compared, so that cuts that part the
#: rows alike (of strongly related features) are equal in every engine.
DIGITS = 9


def _bin(x: Column, cuts: list[float]) -> Column:
    """The number of cuts below ``x``: a row goes left of a cut that it does not exceed."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda t: t < x)) if cuts else F.lit(0)


def tree_splits(df: DataFrame, target: str, features: Sequence[str], depth: int = 2, bins: int = 32,
                min_rows: int = 1) -> DataFrame:
    """(node, depth, feature, threshold, n, mean, gain, n_left, mean_left, mean_right).

    Node 1 is the root, the children of node i are 2i (feature <= threshold) and
    2i + 1.  ``gain`` is the fall of the sum of squares over that of all rows; ties go to the
    earlier feature, then the lower threshold.  A node that no cut improves has no row.
    Rows with a missing value are dropped.  One scan for the cuts' quantiles and one
    aggregate per level; only the best cut of each node reaches the driver.
    """
    spark = df.sparkSession
    names = [f"f{i}" for i in range(len(features))]
    data = materialized(nan_to_null(df).select(
        *[qcol(c).cast("double").alias(n) for c, n in zip(features, names)],
        qcol(target).cast("double").alias("y")).dropna())
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var")).first()
    if not facts["n"] or not facts["var"]:
        return spark.createDataFrame([], SCHEMA)
    cuts: dict[str, list[float]] = {n: [] for n in names}
    for r in exact_quantiles(data, names, [i / bins for i in range(1, bins)]).collect():
        cuts[r["column"]].append(r["value"])
    cuts = {n: sorted(set(v)) for n, v in cuts.items()}
    rows = materialized(data.select((F.col("y") - facts["mean"]).alias("y"),
                                    F.array(*[_bin(F.col(n), cuts[n]) for n in names]).alias("bins")))
    total = facts["n"] * facts["var"]
    node, nodes, found = F.lit(1).cast("long"), [1], []
    up_to = Window.partitionBy("node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("node", "feature")
    for level in range(depth):
        cells = rows.select(node.alias("node"), "y", F.posexplode("bins").alias("feature", "bin")) \
            .where(F.col("node").isin(nodes)).groupBy("node", "feature", "bin") \
            .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
        sides = cells.select("node", "feature", "bin", F.sum("n").over(up_to).alias("nl"), F.sum("s").over(up_to).alias("sl"),
                             F.sum("n").over(whole).alias("n"), F.sum("s").over(whole).alias("s"))
        nr, sr = F.col("n") - F.col("nl"), F.col("s") - F.col("sl")
        gain = (F.col("sl") ** 2 / F.col("nl") + sr ** 2 / nr - F.col("s") ** 2 / F.col("n")) / total
        each = sides.where((F.col("nl") >= min_rows) & (nr >= min_rows) & (nr > 0)) \
            .withColumn("gain", F.round(gain, DIGITS)).where("gain > 0")
        best = each.groupBy("node").agg(F.max(F.struct(
            "gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "n", "s", "nl", "sl")).alias("b")).collect()
        here, nodes = node, []
        for r in sorted(best, key=lambda r: r["node"]):
            b = r["b"]
            f, cut = -b["f"], -b["b"]
            found.append((r["node"], level, features[f], float(cuts[names[f]][cut]), b["n"], b["s"] / b["n"] + facts["mean"],
                          b["gain"], b["nl"], b["sl"] / b["nl"] + facts["mean"],
                          (b["s"] - b["sl"]) / (b["n"] - b["nl"]) + facts["mean"]))
            node = F.when(here == r["node"], F.when(F.get("bins", F.lit(f)) <= cut, 2 * r["node"])
                          .otherwise(2 * r["node"] + 1)).otherwise(node)
            nodes += [2 * r["node"], 2 * r["node"] + 1]
        if not nodes:
            break
    return spark.createDataFrame(found, SCHEMA)


def split_importances(splits: DataFrame) -> DataFrame:
    """``(feature, importance)``: each feature's share of all gains."""
    per = splits.groupBy("feature").agg(F.sum("gain").alias("gain"))
    total = splits.agg(F.sum("gain").alias("total"))  # one row
    return per.crossJoin(F.broadcast(total)).select("feature", (F.col("gain") / F.col("total")).alias("importance"))
