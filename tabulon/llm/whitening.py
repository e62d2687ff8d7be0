"""Whitening of integer vectors by the covariance of their different values.

Equal vectors are grouped; a group's number of rows (or one) is its weight in the
fit.  The covariance is a sum of weighted products of centred blocks, one matrix
product per Arrow batch; its eigenvectors and eigenvalues (a matrix of dimension
x dimension) come from the driver.  Every different vector is whitened once and
joined back to its rows; both sides of that join are written or scanned tables,
so that adaptive execution can split a vector that very many rows share.

``n * x - S`` is computed in whole numbers (as Python integers where 64 bits could
overflow), so centring loses nothing, however far the mean lies from zero.

Defined cases: vectors that are null or empty, or hold null or non-finite
entries or entries of 2^52 and more after scaling take no part; neither do vectors of
another length than the most frequent one (ties: the smaller).  Components beyond
the rank (eigenvalue at most 1e-10 of the largest) are returned with ``whitened``
null and left out of ``identity_error``; with no variance at all every component
is.  ``deviation`` is null where it does not fit 64 bits.  Repeated ids keep
their rows, null ids too; an empty table gives an empty result; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.llm.common import materialize

#: Entries are exact in both doubles and 64-bit integers below this.
EXACT = 2.0 ** 52
#: Part of the largest eigenvalue below which a component has no variance.
RANK = 1e-10


def grid(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """``floor(scale * c) + offset`` of every entry as long; null if the vector takes no part."""
    inside = F.forall(vector, lambda c: F.coalesce(  # NaN and infinity are not below
        F.abs(c.cast("double") * scale) < EXACT, F.lit(False)))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + F.lit(offset).cast("long"))
    return F.when((F.size(vector) > 0) & inside, whole)


def _block(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """The vectors of a batch as a matrix."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _counts(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("w")).to_numpy(zero_copy_only=False)


def _small(x: np.ndarray, factor: int) -> bool:
    """Whether ``factor`` times any entry, summed over a row, stays well inside 64 bits."""
    most = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    return most * max(1, factor) * max(1, x.shape[1]) < 2 ** 62


@dataclass(frozen=True)
class Whitening:
    """n, the sums per dimension, the components (columns), their eigenvalues and shares."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` in whole numbers."""
        if _small(x, self.n) and max(map(abs, self.sums)) < 2 ** 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(np.float64)

    def squared(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of ``(n * x - S)^2``, exact."""
        d = self.deviations(x)
        most = max((abs(int(v)) for v in (d.max(), d.min())), default=0) if d.size else 0
        if most * most * d.shape[1] >= 2 ** 62:
            d = d.astype(object)
        return [int(s) if s < 2 ** 63 else None for s in (d * d).sum(axis=1)]

    def ranked(self) -> np.ndarray:
        return self.values > RANK * max(float(self.values.max(initial=0.0)), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Of the components that have variance; zero elsewhere."""
        scale = np.where(self.ranked(), 1 / np.sqrt(np.where(self.ranked(), self.values, 1)), 0)
        return self.centred(x) @ self.components * scale


def _products(table: DataFrame, block, size: int) -> np.ndarray:
    """Sum over the rows of w * b b', b being ``block``'s row; one matrix product per batch."""
    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            b = block(batch)
            total += (b * _counts(batch)[:, None]).T @ b
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i * size + j), pa.array(total[i, j])], ["cell", "v"])

    cells = table.mapInArrow(partial, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size * size)
    for r in cells:
        out[r["cell"]] = r["v"]
    out = out.reshape(size, size)
    return np.triu(out) + np.triu(out, 1).T


def _sums(table: DataFrame, size: int) -> list[int]:
    """Exact sum of w * x per dimension."""
    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * size
        for batch in batches:
            x, w = _block(batch), _counts(batch)
            part = w @ x if _small(x, int(w.sum())) else w.astype(object) @ x.astype(object)
            total = [a + int(b) for a, b in zip(total, part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["dim", "s"])

    found = table.mapInArrow(partial, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    at = {r["dim"]: int(r["s"]) for r in found}
    return [at.get(i, 0) for i in range(size)]


def distinct_vectors(rows: DataFrame, weight: str = "count") -> DataFrame:
    """(x, w): every different vector once, with its number of rows or one."""
    if weight not in ("count", "one"):
        raise ValueError("weight is 'count' or 'one'")
    w = F.count(F.lit(1)) if weight == "count" else F.max(F.lit(1).cast("long"))
    return rows.groupBy("x").agg(w.alias("w"))


def fit(distinct: DataFrame, size: int, keep: int = 32) -> Whitening:
    """The first ``keep`` components of the weighted covariance of (x, w)."""
    n = int(distinct.agg(F.sum("w")).first()[0] or 0)
    raw = Whitening(n, tuple(_sums(distinct, size)), np.zeros((size, 0)), np.zeros(0), np.zeros(0))
    cov = _products(distinct, lambda b: raw.centred(_block(b)), size) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values, kind="stable")[::-1][:keep]
    total = float(np.trace(cov))
    share = values[order] / total if total > 0 else np.zeros(len(order))
    return Whitening(n, raw.sums, vectors[:, order], values[order], np.maximum(share, 0.0))


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: int = 32,
           weight: str = "count", scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``id``, component (from 1), n, deviation, whitened, explained and identity_error
    of every vector that takes part."""
    rows = materialize(table.select(qcol(id_col).alias("id"), grid(qcol(vec_col), scale, offset).alias("x"))
                       .where("x is not null"))
    common = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else 1
    rows = rows.where(F.size("x") == size)
    distinct = materialize(distinct_vectors(rows, weight))
    schema = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = table.schema[id_col].dataType.simpleString()
    if not common:
        return table.sparkSession.createDataFrame([], schema.format(kind))
    model = fit(distinct, size, keep)

    def applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _block(batch)
            z = model.whitened(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(model.squared(x), pa.int64()), flat],
                ["x", "w", "deviation", "z"])

    done = materialize(distinct.select("x", "w").mapInArrow(
        applied, "x array<long>, w long, deviation long, z array<double>"))
    ranked = model.ranked()
    error = _products(done.select("w", "z"), lambda b: _block(b, "z"), len(ranked)) / model.n - np.diag(ranked * 1.0)
    error = float(np.abs(error).max(initial=0.0))
    parts = F.arrays_zip(F.array(*[F.lit(float(e)) for e in model.explained]).alias("explained"),
                         F.array(*[F.lit(bool(r)) for r in ranked]).alias("ranked"), F.col("z").alias("z"))
    return rows.join(done.drop("w"), "x") \
        .select("id", "deviation", F.posexplode(parts).alias("at", "part")) \
        .select("id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                F.when(F.col("part.ranked"), F.col("part.z")).alias("whitened"),
                F.col("part.explained").alias("explained"), F.lit(error).alias("identity_error"))
