"""K-means for many models at once (M5).

All models (every number of clusters, every start) advance in one scan per step: a task
takes the distances of its rows to the centres of all models from one matrix
product per Arrow batch and hands on, per centre, the number of its rows, their
sum and their cost.  The number of scans is that of the steps, whatever the number
of models; models that have come to rest are left out of later steps.

A start is stated by a row hash, so that any engine can repeat it: start ``s`` of
``k`` clusters are the ``k`` different points of smallest ``md5('s:key')``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups in which the tasks' sums are added up first.
SUM_GROUPS = 64
#: Distances of one slice of rows, which bounds a task's memory.
SLICE_VALUES = 1 << 20


@dataclass(frozen=True)
class Clustering:
    """Centres (a row each), the rows of each, and the sum of squared distances."""

    centers: np.ndarray
    sizes: np.ndarray
    inertia: float


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def start_points(points: DataFrame, count: int, starts: int) -> list[np.ndarray]:
    """For each start the ``count`` different points of smallest hash, in its order
    (all of them, if there are fewer).  ``points``: (features array<double>, key string).
    A task hands on ``count`` points of each start at most."""
    hashes = [F.md5(F.concat(F.lit(f"{s}:"), "key")).alias(f"h{s}") for s in range(starts)]

    def smallest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[bytes, str]] = [{} for _ in range(starts)]

        def cut(d: dict[bytes, str]) -> dict[bytes, str]:
            return dict(sorted(d.items(), key=lambda p: (p[1], p[0]))[:count])
        for batch in batches:
            x = _matrix(batch.column(0)) + 0.0  # one zero
            for s, own in enumerate(kept):
                h = batch.column(1 + s).to_pylist()
                most = max(own.values()) if len(own) >= count else None
                for i in range(len(h)) if most is None else [i for i, v in enumerate(h) if v < most]:
                    point = x[i].tobytes()
                    if point not in own or h[i] < own[point]:
                        own[point] = h[i]
                    if len(own) >= 4 * count:
                        own = kept[s] = cut(own)
                kept[s] = cut(own)
        rows = [(s, h, p) for s, own in enumerate(kept) for p, h in own.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.binary())], ["s", "h", "point"])

    found = points.select("features", *hashes).mapInArrow(smallest, "s int, h string, point binary") \
        .groupBy("s", "point").agg(F.min("h").alias("h"))
    out = []
    for s in range(starts):
        rows = found.where(F.col("s") == s).orderBy("h", "point").limit(count).collect()
        out.append(np.array([np.frombuffer(bytes(r["point"])) for r in rows]))
    return out


def _step(points: DataFrame, models: list[np.ndarray], exact: bool) -> dict[tuple[int, int], tuple]:
    """(model, cluster) -> (rows, sum of the rows' vectors, cost) in one scan."""
    origin = np.mean(models[0], axis=0)  # distances from a point near the data lose nothing
    near = [m - origin for m in models]
    every = np.concatenate(near)
    first = np.cumsum([0, *[len(m) for m in near]])
    size = every.shape[1]

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost = np.zeros(len(every), dtype=np.int64), np.zeros(len(every))
        total = np.zeros(every.shape)
        rows = max(1, SLICE_VALUES // max(len(every), size))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                x = _matrix(batch.column(0).slice(at, rows)) - origin
                apart = (every * every).sum(axis=1) - 2 * (x @ every.T)
                for m, centers in enumerate(near):
                    of = apart[:, first[m]:first[m + 1]].argmin(axis=1)
                    own = np.zeros((len(x), len(centers)))
                    own[np.arange(len(x)), of] = 1
                    here = slice(first[m], first[m + 1])
                    n[here] += own.sum(axis=0).astype(np.int64)
                    total[here] += own.T @ x
                    if exact:
                        cost[here] += own.T @ ((x - centers[of]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(every))), pa.array(n), pa.array(cost),
             pa.ListArray.from_arrays(pa.array(np.arange(len(every) + 1) * size, pa.int32()), pa.array(total.ravel()))],
            ["c", "n", "cost", "total"])

    zero = F.array_repeat(F.lit(0.0), size)
    added = F.aggregate(F.collect_list("total"), zero, lambda a, b: F.zip_with(a, b, lambda p, q: p + q)).alias("total")
    sums = [F.sum("n").alias("n"), F.sum("cost").alias("cost"), added]
    found = points.select("features").mapInArrow(partial, "c long, n long, cost double, total array<double>") \
        .groupBy("c", F.pmod(F.spark_partition_id(), F.lit(SUM_GROUPS)).alias("g")).agg(*sums) \
        .groupBy("c").agg(*sums).collect()
    model_of = np.repeat(np.arange(len(near)), np.diff(first))
    return {(int(model_of[r["c"]]), int(r["c"] - first[model_of[r["c"]]])):
            (r["n"], np.array(r["total"]) + r["n"] * origin, r["cost"]) for r in found}


def lloyd(points: DataFrame, starts: list[np.ndarray], max_iter: int = 20, tol: float = 1e-4) -> list[Clustering]:
    """Every start after Lloyd steps until no centre moves further than ``tol``, or
    ``max_iter`` of them; a centre without rows stays where it is, and rows as near to
    two centres go to the first.  ``points``: (features array<double>)."""
    centers = [np.array(s, dtype=float) for s in starts]
    moving = list(range(len(centers)))
    for _ in range(max_iter):
        found = _step(points, [centers[m] for m in moving], exact=False)
        still = []
        for i, m in enumerate(moving):
            new = centers[m].copy()
            for c in range(len(new)):
                n, total, _cost = found[i, c]
                if n:
                    new[c] = total / n
            if np.sqrt(((new - centers[m]) ** 2).sum(axis=1)).max() > tol:
                still.append(m)
            centers[m] = new
        moving = still
        if not moving:
            break
    found = _step(points, centers, exact=True)
    return [Clustering(c, np.array([found[m, i][0] for i in range(len(c))]),
                       float(sum(found[m, i][2] for i in range(len(c))))) for m, c in enumerate(centers)]
