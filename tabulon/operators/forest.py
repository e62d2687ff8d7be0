"""Random forest regression (M4).

Features are cut at quantiles into bins once; the rows are kept as one byte a feature
with their label.  A level of all trees is one scan: a task adds up, per tree, open
node, feature and bin, the rows' weights and labels; Spark sums the tasks' cells and
finds each node's best cut, and only that reaches the driver.  Which rows a tree draws
(Poisson(1), the bootstrap of many rows) follows from a number kept with each row, so
nothing is held a row and tree: memory is that of the cells, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import materialized

BINS = 32
#: Accuracy of the cuts' quantiles (rank error 1 / accuracy of the rows).
ACCURACY = 10_000
#: Bytes of a task's cells; trees beyond it wait for another scan.
CELL_BYTES = 64 << 20
#: Rows of one slice.
SLICE_ROWS = 1 << 15
#: Digits to which a cut's share of its node's sum of squares is compared.
DIGITS = 9
#: No row goes right of this bin: the cut of a node that is not split.
ALL_LEFT = 127
#: Times that a row is drawn, by the upper 16 bits of a hash.
DRAWS = np.searchsorted(np.cumsum([exp(-1) / factorial(k) for k in range(12)]),
                        (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


@dataclass(frozen=True)
class Forest:
    """Trees (a row each) as full binary trees: the children of node i are 2i + 1
    (bin up to ``cut``) and 2i + 2."""

    cuts: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    importances: np.ndarray
    depth: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """``(prediction, label)`` of rows with columns f0 .. and ``label``."""
        def batches(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                codes, n = _codes(part, self.cuts), part.num_rows
                flat, total, every = np.concatenate(codes), np.zeros(n), np.arange(n)
                for feature, cut, value in zip(self.feature, self.cut, self.value):
                    total += value[_walk(flat, n, every, feature, cut, self.depth)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(total / len(self.value)), part.column(len(codes))], ["prediction", "label"])
        return rows.select(*_names(len(self.cuts)), "label").mapInArrow(batches, "prediction double, label double")


def _names(k: int) -> list[str]:
    return [f"f{i}" for i in range(k)]


def _codes(batch: pa.RecordBatch, cuts: list[np.ndarray]) -> list[np.ndarray]:
    """Of each feature (the first columns) the number of cuts below its values."""
    return [np.searchsorted(c, batch.column(i).to_numpy(zero_copy_only=False)).astype(np.int8)
            for i, c in enumerate(cuts)]


def _walk(flat: np.ndarray, n: int, at: np.ndarray, feature: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The nodes of the rows ``at`` of ``n`` after ``depth`` steps; ``flat``: bins, feature by feature."""
    node = np.zeros(len(at), dtype=np.int64)
    for _ in range(depth):
        right = flat.take(feature.take(node) * n + at) > cut.take(node)
        node *= 2
        node += 1
        node += right
    return node


def feature_cuts(rows: DataFrame, k: int) -> list[np.ndarray]:
    """Ascending cuts of the columns f0 ..: between all values of a column that has few, else quantiles."""
    names = _names(k)
    probs = [i / BINS for i in range(1, BINS)]
    found = rows.agg(*[e for c in names for e in (
        F.percentile_approx(c, probs, ACCURACY).alias(c), F.approx_count_distinct(c).alias(f"{c}_n"))]).first()
    few = [c for c in names if found[f"{c}_n"] <= 2 * BINS]
    sets = rows.agg(*[F.collect_set(c).alias(c) for c in few]).first() if few else {}
    return [np.array(sorted(sets[c])[:-1] if c in few and len(sets[c]) <= BINS else sorted(set(found[c])))
            for c in names]


def draws(h: np.ndarray, factor: np.uint64) -> np.ndarray:
    """How often a tree draws the rows of the numbers ``h``."""
    return DRAWS.take((h.view(np.uint64) * factor) >> np.uint64(48))


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= SLICE_ROWS:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def _cells(rows: DataFrame, k: int, depth: int, trees: list[tuple]) -> DataFrame:
    """``(tree, node, feature, bin, w, s)``: weights and sums of the labels in the open
    nodes of a level.  ``trees``: (tree, factor, feature, cut, open nodes)."""
    first = 2 ** depth - 1

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, sums = [], []
        for *_, nodes in trees:
            slot = np.full(2 ** depth, -1, dtype=np.int64)
            slot[nodes - first] = np.arange(len(nodes)) * BINS
            slots.append(slot)
            sums.append(np.zeros((2, k, len(nodes) * BINS)))
        for batch in _slices(batches):
            n = batch.num_rows
            codes = [batch.column(i).to_numpy() for i in range(k)]
            flat = np.concatenate(codes)
            y, h = batch.column(k).to_numpy(), batch.column(k + 1).to_numpy()
            for (_, factor, feature, cut, nodes), slot, out in zip(trees, slots, sums):
                times = draws(h, factor)
                at = np.flatnonzero(times > 0)
                own = slot.take(_walk(flat, n, at, feature, cut, depth) - first)
                if len(nodes) < len(slot):
                    at, own = at[own >= 0], own[own >= 0]
                w = times.take(at).astype(float)
                s = w * y.take(at)
                for f, code in enumerate(codes):
                    cell = own + code.take(at)
                    out[0, f] += np.bincount(cell, w, out.shape[2])
                    out[1, f] += np.bincount(cell, s, out.shape[2])
        for (tree, *_, nodes), out in zip(trees, sums):
            f, cell = np.nonzero(out[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(f), tree, np.int32)), pa.array(nodes[cell // BINS].astype(np.int32)),
                 pa.array(f.astype(np.int32)), pa.array((cell % BINS).astype(np.int32)),
                 pa.array(out[0, f, cell]), pa.array(out[1, f, cell])], ["tree", "node", "feature", "bin", "w", "s"])

    return rows.mapInArrow(partial, "tree int, node int, feature int, bin int, w double, s double") \
        .groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))


def _best(cells: DataFrame) -> DataFrame:
    """Each node's cut of the largest fall of the sum of squares; ties go to the earlier
    feature, then the lower cut.  A node that no cut improves has no row."""
    whole = Window.partitionBy("tree", "node", "feature")
    up_to = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = cells.select("tree", "node", "feature", "bin", F.sum("w").over(up_to).alias("wl"),
                         F.sum("s").over(up_to).alias("sl"), F.sum("w").over(whole).alias("w"),
                         F.sum("s").over(whole).alias("s"))
    wr, sr = F.col("w") - F.col("wl"), F.col("s") - F.col("sl")
    apart = F.col("sl") / F.col("wl") - sr / wr
    return sides.where((F.col("wl") > 0) & (wr > 0)).withColumn("gain", F.col("wl") * wr / F.col("w") * apart * apart) \
        .where("gain > 0").groupBy("tree", "node").agg(F.max(F.struct(
            F.round(F.col("gain"), DIGITS).alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"),
            "w", "s", "wl", "sl")).alias("b")).select("tree", "node", "b.*")


def fit(train: DataFrame, k: int, num_trees: int, max_depth: int, seed: int) -> Forest:
    """A forest over the columns f0 .. f(k-1) and ``label`` of ``train``; every split considers all features."""
    cuts = feature_cuts(train, k)
    facts = train.agg(F.avg("label").alias("mean"), F.stddev_pop("label").alias("std")).first()
    mean, scale = facts["mean"], facts["std"] or 1.0

    def binned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (batch.column(k).to_numpy(zero_copy_only=False) - mean) / scale
            yield pa.RecordBatch.from_arrays([*map(pa.array, _codes(batch, cuts)), pa.array(y), batch.column(k + 1)],
                                             [*_names(k), "y", "h"])

    numbered = train.select(*_names(k), "label", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)).alias("h"))
    rows = materialized(numbered.mapInArrow(binned, ", ".join(f"{c} byte" for c in _names(k)) + ", y double, h long"))
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, num_trees, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = 2 ** (max_depth + 1) - 1
    feature = np.zeros((num_trees, size), dtype=np.int64)
    cut = np.full((num_trees, size), ALL_LEFT, dtype=np.int8)
    value = np.zeros((num_trees, size))
    gains = np.zeros((num_trees, k))
    open_ = {t: [0] for t in range(num_trees)}
    for depth in range(max_depth):
        found, here, held = [], [], 0
        last = max(open_, default=None)
        for t, nodes in open_.items():
            here.append((t, factors[t], feature[t], cut[t], np.array(sorted(nodes), dtype=np.int64)))
            held += len(nodes) * BINS * k * 16
            if held >= CELL_BYTES or t == last:
                found += _best(_cells(rows, k, depth, here)).collect()
                here, held = [], 0
        open_ = {}
        for r in sorted(found, key=lambda r: (r["tree"], r["node"])):
            t, i, f = r["tree"], r["node"], -r["f"]
            feature[t, i], cut[t, i] = f, -r["b"]
            gains[t, f] += r["gain"]
            value[t, 2 * i + 1] = r["sl"] / r["wl"]
            value[t, 2 * i + 2] = (r["s"] - r["sl"]) / (r["w"] - r["wl"])
            open_.setdefault(t, []).extend((2 * i + 1, 2 * i + 2))
    for i in range(2 ** max_depth - 1):  # the value of a node that is not split goes down on its left
        whole = cut[:, i] == ALL_LEFT
        value[whole, 2 * i + 1] = value[whole, i]
    share = gains / np.where(gains.sum(axis=1) > 0, gains.sum(axis=1), 1.0)[:, None]
    total = share.sum()
    return Forest(cuts, feature, cut, value * scale + mean, share.sum(axis=0) / (total or 1.0), max_depth)
