"""Mixing sources to target weights by weighted fair queueing.

A source's documents stand in shuffled order (by digest), up to ``max_epochs``
times over.  A document's virtual finish time is its source's cumulative words
up to and including it, divided by the source's weight.  All documents are
range-sorted by finish time, and running totals over that order (partition totals
and sums inside each partition) find the moment at which the words served reach the
total budget: there the order is truncated.  Sources are served side by side, so
each one's document in service at that moment is taken in part.

A source's own running sums are taken in two levels: its documents fall into hash
buckets, bucket totals are summed per source, and a window runs inside one
(source, epoch, bucket) only, so a source with a third of all rows is spread over
16 ** ``BUCKET_DIGITS`` groups.

Defined cases: a null text has no words; a null source is a source of its own,
last; sizes of zero take nothing; texts of any length are counted whole, and only one
in service at the end is taken in part; repeated rows are documents of their own (equal
ones share their words in any order, the table of results is the same); ties of finish
time stand in order of row id and epoch; an empty table gives an empty result; all input
columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.llm.common import materialize, text_or_empty

#: Weights repeat over the sources in order.
WEIGHTS = (5, 2, 1)
#: Buckets of a source's shuffled order: leading hexadecimal digits of the digest.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_key(source: Column) -> Column:
    """Sources as non-null strings in code point order, null last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source))


def source_targets(sized: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, source_size, weight, level, target) from (source, size): shares
    of all words by weight, at most ``max_epochs`` times the source's size, the
    excess dealt anew.

    ``level`` is the virtual time at which the words served reach the budget:
    with the sources in order of words per weight, those before a point are
    used up and the others share what is left; the level is where that point
    agrees with itself.  One row per source, so the windows here are small.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")) \
        .withColumn("cap", F.col("source_size") * max_epochs)
    turn = F.row_number().over(Window.orderBy("source")) - 1
    per = per.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("full_at", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level_here", left / left_weight)
    # the first place that agrees has the largest level of those that do
    agrees = F.when(F.col("level_here") <= F.col("full_at"), F.col("level_here"))
    per = per.withColumn("level", F.max(agrees).over(every))
    target = F.when(F.col("full_at") <= F.col("level"), F.col("cap").cast("double")) \
        .otherwise(F.col("weight") * F.col("level"))
    return per.select("source", "source_size", "weight", "level", target.alias("target"))


def finish_order(sized: DataFrame, targets: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Every document as often as it may be served, range-sorted by virtual finish
    time and written: (part, rid, epoch, finish, earlier, size, weight, cap), ``part``
    the place of its partition and ``earlier`` its source's words before it."""
    turns = sized.where("size > 0").select(
        "rid", "source", "size", "digest",
        F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
    turns = turns.withColumn("digest", F.md5(F.concat_ws(":", "digest", F.col("epoch").cast("string")))) \
        .withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS))
    lane = ["source", "epoch", "bucket"]
    ahead = Window.partitionBy("source").orderBy("epoch", "bucket") \
        .rowsBetween(Window.unboundedPreceding, -1)
    caps = targets.select("source", "weight", (F.col("source_size") * max_epochs).alias("cap"))
    heads = turns.groupBy(*lane).agg(F.sum("size").alias("n")).select(
        *lane, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset")).join(caps, "source")
    in_lane = Window.partitionBy(*lane).orderBy("digest", "size", "rid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    queued = turns.withColumn("earlier", F.coalesce(F.sum("size").over(in_lane), F.lit(0))) \
        .join(heads, lane).withColumn("earlier", F.col("earlier") + F.col("offset"))
    queued = queued.select(
        "rid", "epoch", ((F.col("earlier") + F.col("size")) / F.col("weight")).alias("finish"),
        "earlier", "size", "weight", "cap")
    ordered = queued.repartitionByRange("finish", "rid", "epoch").sortWithinPartitions("finish", "rid", "epoch")
    return materialize(ordered.withColumn("part", F.spark_partition_id()), codec="zstd")


def truncation(order: DataFrame, targets: DataFrame) -> float:
    """The virtual time at which the words served reach the budget (the words of all
    sources), from running totals over the finish order; 0 if nothing is served.

    At a document's finish, sources that have served their last document have served
    all they may, the others their weight times that time.  So what the running totals
    sum are the words and weights of sources that end; the first document at whose
    finish the rest of the budget is used up by the weights left truncates the order.
    """
    ends = F.col("earlier") + F.col("size") == F.col("cap")
    steps = order.select("part", "finish", "rid", "epoch",
                         F.when(ends, F.col("cap")).otherwise(0).alias("words"),
                         F.when(ends, F.col("weight")).otherwise(0.0).alias("weight"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = steps.groupBy("part").agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).select(
        "part", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("words_ahead"),
        F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)).alias("weight_ahead"))
    inside = Window.partitionBy("part").orderBy("finish", "rid", "epoch").rowsBetween(Window.unboundedPreceding, -1)
    totals = targets.where("source_size > 0").agg(
        F.sum("source_size").alias("budget"), F.sum("weight").alias("weights"))
    steps = steps.withColumn("words", F.coalesce(F.sum("words").over(inside), F.lit(0))) \
        .withColumn("weight", F.coalesce(F.sum("weight").over(inside), F.lit(0.0))) \
        .join(parts, "part").join(F.broadcast(totals))
    time = (F.col("budget") - F.col("words") - F.col("words_ahead")) \
        / (F.col("weights") - F.col("weight") - F.col("weight_ahead"))
    first = steps.withColumn("time", time).where("time <= finish") \
        .agg(F.min_by("time", F.struct("finish", "rid", "epoch")).alias("time")).first()
    return first["time"] or 0.0


def schedule(sized: DataFrame, targets: DataFrame, max_epochs: int = 3) -> DataFrame:
    """The mix: (rid, epoch, finish, taken) for every document served, range-sorted
    by virtual finish time and truncated at the budget; ``sized`` has
    (rid, source, size, digest)."""
    order = finish_order(sized, targets, max_epochs)
    end = truncation(order, targets)
    served = F.round(F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(end))).cast("long")
    return order.select(
        "rid", "epoch", "finish",
        F.least("size", F.greatest(F.lit(0), served - F.col("earlier"))).cast("long").alias("taken")) \
        .where("taken > 0")


def sized_rows(docs: DataFrame, keep: list[str] | None, id_col: str, text_col: str,
               source_col: str) -> DataFrame:
    """``row`` (the kept columns), ``rid``, ``source``, ``size``, ``digest``, written once:
    the row ids stay the same for every reader."""
    text = text_or_empty(text_col)
    kept = F.struct(*[qcol(c) for c in keep]) if keep else F.struct("*")
    return materialize(codec="zstd", df=docs.select(
        kept.alias("row"), F.monotonically_increasing_id().alias("rid"),
        source_key(qcol(source_col).cast("string")).alias("source"),
        word_count(text).alias("size"),
        F.md5(F.concat_ws(":", qcol(id_col).cast("string"), F.md5(text))).alias("digest")))


def mix(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", weights=WEIGHTS,
        max_epochs: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns, or those in ``keep``),
    ``size``, ``source_size``, ``target`` and ``taken`` (words the mix takes)."""
    rows = sized_rows(docs, keep, id_col, text_col, source_col)
    targets = source_targets(rows, weights, max_epochs)
    taken = schedule(rows, targets, max_epochs).groupBy("rid").agg(F.sum("taken").alias("taken"))
    return rows.join(taken, "rid", "left").join(targets, "source", "left").select(
        "row", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """The mix itself: the rows of ``docs`` in order of virtual finish time, as
    often as they are served; the last document of a source, served in part,
    is there whole if at least half of it is."""
    rows = sized_rows(docs, None, id_col, text_col, source_col)
    served = schedule(rows, source_targets(rows, weights, max_epochs), max_epochs)
    whole = rows.select("rid", "row", "size").join(served, "rid").where("2 * taken >= size").drop("size", "taken")
    return whole.repartitionByRange("finish", "rid").sortWithinPartitions("finish", "rid").select("row.*")
