"""Exact top-k by inner product with a dual-tree search over cover trees.

Vectors become integers, floor(scale * x).  Equal vectors are thinned to the
k + 1 smallest ids first, which is all that any answer can hold.  The top level of the
trees is common to all tasks: ``PIVOTS`` points at most, taken farthest-first from a
bounded sample, each with the rows nearest to it and their covering radius.  A
region of many rows is dealt over several blocks, and queries are grouped by region
too; every block and every group gets a cover tree of its own.  A pair of tree nodes, or
of a group and a region, is pruned when the largest inner product that their
centres and covering radii allow,

    <q, r> + |q| R_r + |r| R_q + R_q R_r,

is below the worst k-th score of the queries in the query node.  Scores come
from exact integer arithmetic; bounds have a margin for rounding.  A first search
of every group in the region that its centre favours gives a true k-th score to
start from; then groups go only to the blocks of the regions that are left (the
stated query set against all rows, in blocks).  A task holds one block's tree and one
query group at a time.  Blocks give at most k rows a query, merged by a window.

How much is pruned depends on the vectors: in many dimensions without clusters all
inner products fit the bounds, and every pair is scored.

Defined cases: vectors that are null or hold null or non-finite components
take no part, nor do null ids; a query meets vectors of its own length only;
rows with the query's id are its own and no candidates; exactly repeated rows
count once; fewer candidates than k give as many rows; an empty table gives an
empty result; a score beyond 64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.llm.common import bound_batches, materialize

#: Rows of a block and of a query group at most, on average.
BLOCK, QUERY_BLOCK = 4096, 256
#: Regions of one vector length, and rows that their centres are chosen from.
PIVOTS, SAMPLE = 512, 8192
#: Points up to which a node of rows, and of queries, is not divided; its most children;
#: the ratio of a level's radius to the next.
LEAF, QUERY_LEAF, FAN, SHRINK = 48, 8, 8, 0.7


@dataclass
class Node:
    """``centre`` with covering ``radius`` over the points at ``places``."""

    centre: np.ndarray
    radius: float
    places: np.ndarray
    children: list["Node"] = field(default_factory=list)


def farthest_first(points: np.ndarray, first: int, count: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, each as far as possible from those before, until all points lie
    within ``reach`` of one or there are ``count``; each point's nearest one and its distance."""
    centres = [first]
    away = np.sqrt(((points - points[first]) ** 2).sum(axis=1))
    near = np.zeros(len(points), dtype=np.int64)
    while len(centres) < count and away.max() > reach:
        centres.append(int(away.argmax()))
        new = np.sqrt(((points - points[centres[-1]]) ** 2).sum(axis=1))
        near[new < away] = len(centres) - 1
        away = np.minimum(away, new)
    return np.array(centres), near, away


def cover_tree(points: np.ndarray, leaf: int, places: np.ndarray | None = None, centre: int | None = None) -> Node:
    """A cover tree: the node's centre is its first child's too, children's centres
    are further apart than the radius that they cover, and each point is with its nearest."""
    places = np.arange(len(points)) if places is None else places
    own = points[places]
    if centre is None:
        centre = int(places[np.argmin(((own - own.mean(axis=0)) ** 2).sum(axis=1))])
    at = int(np.flatnonzero(places == centre)[0])
    away = np.sqrt(((own - points[centre]) ** 2).sum(axis=1))
    node = Node(points[centre], float(away.max()), places)
    if len(places) > leaf and node.radius > 0:
        centres, near, _ = farthest_first(own, at, FAN, node.radius * SHRINK)
        node.children = [cover_tree(points, leaf, places[near == c], int(places[i])) for c, i in enumerate(centres)]
    return node


class Search:
    """Top-k of packed queries in one block, both in cover trees."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.points = vectors.astype(np.float64)
        self.tree = cover_tree(self.points, LEAF)

    def __call__(self, q_ids: np.ndarray, q_vectors: np.ndarray, floor: np.ndarray):
        """Scores and ids, best first, of each query; absent: the least number and -1."""
        self.q_ids, self.q_vectors = q_ids, q_vectors
        self.q_points = q_vectors.astype(np.float64)
        peak = float(np.abs(self.q_points).max(initial=0)) * float(np.abs(self.points).max(initial=0)) \
            * max(1, self.points.shape[1])
        self.exact = "double" if peak < 2**53 else "long" if peak < 2**62 else "object"
        kind = object if self.exact == "object" else np.int64
        least = -2**63
        self.scores = np.full((len(q_ids), self.k), least, dtype=kind)
        self.found = np.full((len(q_ids), self.k), -1, dtype=np.int64)
        self.floor, self.scored = floor, 0
        self._visit(cover_tree(self.q_points, QUERY_LEAF), [self.tree])
        return self.scores, self.found

    def _worst(self, places: np.ndarray) -> float:
        """The worst k-th score of a query group, so far."""
        own = np.maximum(self.scores[places, -1].astype(np.float64), self.floor[places])
        return float(own.min())

    def _visit(self, q: Node, nodes: list[Node]):
        centres = np.stack([n.centre for n in nodes])
        radii = np.array([n.radius for n in nodes])
        dots = centres @ q.centre
        bound = dots + np.linalg.norm(q.centre) * radii \
            + (np.linalg.norm(centres, axis=1) + radii) * q.radius
        bound += np.abs(bound) * 1e-9 + 1
        order = np.argsort(-bound, kind="stable")
        leaves, inner = [], []
        for i in order.tolist():
            if bound[i] < self._worst(q.places):
                break
            (inner if nodes[i].children else leaves).append(nodes[i])
        if q.children:
            below = leaves + [c for n in inner for c in n.children]
            if below:
                for child in q.children:
                    self._visit(child, below)
            return
        if leaves:
            self._score(q.places, np.concatenate([n.places for n in leaves]))
        for n in inner:
            self._visit(q, n.children)

    def _score(self, q: np.ndarray, r: np.ndarray):
        self.scored += len(q) * len(r)
        if self.exact == "double":
            new = (self.q_points[q] @ self.points[r].T).astype(np.int64)
        elif self.exact == "long":
            new = self.q_vectors[q].astype(np.int64) @ self.vectors[r].astype(np.int64).T
        else:
            whole = [[[int(x) for x in v] for v in m] for m in (self.q_points[q], self.points[r])]
            new = np.array([[sum(a * b for a, b in zip(x, y)) for y in whole[1]] for x in whole[0]],
                           dtype=object).reshape(len(q), len(r))
        for i, row in zip(q.tolist(), new):
            ok = self.ids[r] != self.q_ids[i]
            ok &= (row >= max(self.scores[i, -1], self.floor[i])).astype(bool)
            if not ok.any():
                continue
            scores = np.concatenate([self.scores[i], row[ok]])
            ids = np.concatenate([self.found[i], self.ids[r][ok]])
            order = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j])) if self.exact == "object" \
                else np.lexsort((ids, -scores.astype(np.float64))) if self.exact == "double" \
                else np.lexsort((ids, ~scores))
            order = [j for j in order if ids[j] >= 0 or scores[j] == -2**63][:self.k]
            self.scores[i], self.found[i] = scores[order], ids[order]


# ------------------------------------------------------------------ Spark jobs
def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, vec, dim) with floor(scale * x) as doubles, of the rows that take part."""
    vec = qcol(vector_col).cast("array<double>")
    return rows.select(qcol(id_col).cast("long").alias("vec_id"), vec.alias("raw")) \
        .where("vec_id is not null and raw is not null").where(
            F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))) \
        .select("vec_id", F.transform("raw", lambda x: _floor(x * scale)).alias("vec"),
                F.size("raw").alias("dim"))


def _floor(x):
    """Floor as a double (values from 2^53 are whole)."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _pack(rows: DataFrame, key: list[str]) -> DataFrame:
    """One packed row per key: the ids, the vectors and the starting scores."""
    def pack(table: pa.Table) -> pa.Table:
        vecs = np.array(table.column("vec").to_pylist(), dtype="<f8")
        floor = np.array(table.column("floor").to_pylist(), dtype="<f8")
        return pa.table({**{c: table.column(c).slice(0, 1) for c in key},
                         "ids": pa.array([np.array(table.column("vec_id").to_pylist(), dtype="<i8").tobytes()]),
                         "vecs": pa.array([vecs.tobytes()]), "floor": pa.array([floor.tobytes()])})
    schema = ", ".join(f"{c} int" for c in key)
    return rows.groupBy(*key).applyInArrow(pack, f"{schema}, ids binary, vecs binary, floor binary")


def _searched(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): at most ``k`` rows of each block for each query.
    ``data`` is (dim, block, vec_id, vec), ``queries`` packed rows with their block."""
    own = data.select("dim", "block", F.lit(-1).alias("group"), "vec_id", "vec",
                      F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("vecs"),
                      F.lit(None).cast("binary").alias("floor"))
    asked = queries.select("dim", "block", "group", F.lit(None).cast("long").alias("vec_id"),
                           F.lit(None).cast("array<double>").alias("vec"), "ids", "vecs", "floor")
    rows = own.unionByName(asked).repartition("dim", "block").sortWithinPartitions("dim", "block", "group")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vecs, ready = None, [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["dim"], row["block"]) != at:
                    at, ids, vecs, ready = (row["dim"], row["block"]), [], [], None
                if row["group"] < 0:
                    ids.append(row["vec_id"])
                    vecs.append(row["vec"])
                    continue
                if ready is None:
                    if not ids:
                        continue
                    ready = Search(np.array(ids), np.array(vecs).reshape(len(ids), -1), k)
                q = np.frombuffer(row["ids"], "<i8")
                scores, found = ready(q, np.frombuffer(row["vecs"], "<f8").reshape(len(q), -1),
                                      np.frombuffer(row["floor"], "<f8"))
                there = found >= 0
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat(q, there.sum(axis=1))),
                    "vec_id": pa.array(found[there]),
                    "score": pa.array([int(s) for s in scores[there]], pa.int64())})

    return rows.mapInArrow(search, "query_id long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _centres(data: DataFrame, blocks: int) -> dict[int, np.ndarray]:
    """Of each vector length the regions' centres, from the ``SAMPLE`` rows of smallest hash."""
    rows = data.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).select("dim", "vec").collect()
    out = {}
    for dim in sorted({r["dim"] for r in rows}):
        points = np.unique(np.array([r["vec"] for r in rows if r["dim"] == dim], dtype=float), axis=0)
        middle = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))) if dim else 0
        out[dim] = points[farthest_first(points, middle, min(blocks, PIVOTS), 0.0)[0]] if dim else points[:1]
    return out


def _centre(centres: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return centres.get(dim, np.zeros((1, dim)))


def _in_regions(vectors: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with their nearest ``pivot`` (of their length) and its distance ``away``."""
    @F.arrow_udf("struct<pivot:int,away:double>")
    def nearest(vecs: pa.Array) -> pa.Array:
        pivot, away = np.zeros(len(vecs), dtype=np.int32), np.zeros(len(vecs))
        dims = vecs.value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            of = np.flatnonzero(dims == dim)
            x = vecs.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False).reshape(len(of), dim)
            c = _centre(centres, dim)
            pivot[of] = ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)
            away[of] = np.sqrt(((x - c[pivot[of]]) ** 2).sum(axis=1))
        return pa.StructArray.from_arrays([pa.array(pivot), pa.array(away)], ["pivot", "away"])
    return vectors.withColumn("r", nearest("vec")).select("*", "r.*").drop("r")


def _dealt(rows: DataFrame, most: int, name: str) -> tuple[DataFrame, list]:
    """``rows`` with the number (``name``) of a part of their region of ``most`` rows on
    average; the regions (dim, pivot, first part, parts, covering radius)."""
    regions = rows.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")) \
        .orderBy("dim", "pivot").collect()  # PIVOTS rows a vector length
    out, first = [], 0
    for r in regions:
        parts = -(-r["n"] // most)
        out.append((r["dim"], r["pivot"], first, parts, r["radius"]))
        first += parts
    if not out:
        return rows.withColumn(name, F.lit(0)), out
    table = rows.sparkSession.createDataFrame(out, "dim int, pivot int, first int, parts int, radius double")
    part = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    return rows.join(F.broadcast(table), ["dim", "pivot"]).withColumn(name, part) \
        .drop("first", "parts", "radius"), out


def _blocks_for(packed: DataFrame, centres: dict[int, np.ndarray], regions: list, favoured: bool) -> DataFrame:
    """A row for each block that a query group goes to: one of the region that its centre
    favours, or all of the regions that its worst k-th score does not rule out."""
    by_dim: dict[int, list] = {}
    for dim, pivot, first, parts, radius in regions:
        by_dim.setdefault(dim, []).append((pivot, first, parts, radius))

    @F.arrow_udf("array<int>")
    def blocks(dims: pa.Array, vecs: pa.Array, floors: pa.Array) -> pa.Array:
        out = []
        for dim, raw, floor in zip(dims.to_pylist(), vecs.to_pylist(), floors.to_pylist()):
            here = by_dim.get(dim, [])
            if not dim:  # empty vectors: all scores are 0
                out.append([b for r in here for b in range(r[1], r[1] + (1 if favoured else r[2]))])
                continue
            q = np.frombuffer(raw, "<f8").reshape(-1, dim)
            middle = q.mean(axis=0)
            reach = float(np.sqrt(((q - middle) ** 2).sum(axis=1)).max())
            c = _centre(centres, dim)[[r[0] for r in here]]
            dots = c @ middle
            if favoured:
                best = here[int(dots.argmax())]
                out.append([best[1]])
                continue
            radius = np.array([r[3] for r in here])
            bound = dots + np.linalg.norm(middle) * radius + (np.linalg.norm(c, axis=1) + radius) * reach
            bound += np.abs(bound) * 1e-9 + 1
            left = np.flatnonzero(bound >= np.frombuffer(floor, "<f8").min())
            out.append([b for i in left.tolist() for b in range(here[i][1], here[i][1] + here[i][2])])
        return pa.array(out, pa.list_(pa.int32()))

    return packed.withColumn("block", F.explode(blocks("dim", "vecs", "floor")))


def top_k(rows: DataFrame, is_query: str, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores, ties to smaller
    ids, of the rows that ``is_query`` (SQL on ``vec_id``) selects."""
    bound_batches(rows.sparkSession)
    vectors = materialize(integer_vectors(rows, id_col, vector_col, scale).distinct())
    # of equal vectors the k + 1 smallest ids: a query's own id may be among them
    same = Window.partitionBy("vec").orderBy("vec_id")
    data = vectors.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n")
    centres = _centres(vectors, max(1, -(-vectors.count() // BLOCK)))
    data, regions = _dealt(materialize(_in_regions(data, centres)), BLOCK, "block")
    asked, _ = _dealt(materialize(_in_regions(vectors.where(is_query), centres)), QUERY_BLOCK, "group")
    least = F.lit(float(-2**63))
    first = _blocks_for(_pack(asked.withColumn("floor", least), ["dim", "group"]), centres, regions, True)
    # a row of each query for every block that has a candidate: the best of all are k true scores
    seeds = materialize(_best(_searched(data, first, k), k).groupBy("query_id").agg(
        F.count("*").alias("n"), F.min("score").alias("worst")).where(F.col("n") == k))
    seeded = asked.join(seeds, asked["vec_id"] == seeds["query_id"], "left").select(
        asked["dim"], "group", "vec_id", "vec", F.coalesce(F.col("worst").cast("double"), least).alias("floor"))
    packed = materialize(_pack(seeded, ["dim", "group"]))
    left = _blocks_for(packed, centres, regions, False)
    return _best(_searched(data, left, k), k).select("query_id", "rank", "vec_id", "score")
