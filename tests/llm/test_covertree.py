"""Cover-tree search against all inner products."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import covertree
from tabulon.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    vecs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    vecs = sorted({(i, tuple(v)) for i, v in vecs})
    out = []
    for q, a in vecs:
        if q % 100 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vecs
                          if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def _run(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, QUERIES["op4_exact_top_k"](spark, str(tmp_path)).collect()))


def _vectors(n, dim, seed, centres=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    if centres:
        v = v * .05 + rng.normal(size=(centres, dim))[rng.integers(0, centres, n)]
    return [(i, np.float32(x).tolist()) for i, x in enumerate(v)]


@pytest.mark.parametrize("centres", [0, 12])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, centres):
    monkeypatch.setattr(covertree, "BLOCK", 150)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 3)
    rows = _vectors(900, 8, 1, centres)
    rows += [(2000 + i, rows[0][1]) for i in range(120)]  # one common vector, ties
    rows += [(None, rows[1][1]), (3000, None), (3100, [1.0] * 7 + [None]), (3200, [math.nan] * 8),
             (3300, [math.inf] + [0.0] * 7), (3400, [1.0, 2.0]), (3401, [2.0, 1.0]), (3500, []),
             (5, rows[5][1]), (100, rows[100][1])]
    assert _run(spark, tmp_path, rows) == brute(rows)


def test_few_rows_and_none(spark, tmp_path):
    rows = [(0, [1.0, -1.0]), (1, [0.5, 0.25]), (100, [-3.0, 2.0])]
    assert _run(spark, tmp_path / "a", rows) == brute(rows)
    assert _run(spark, tmp_path / "b", []) == []


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(101)], SCHEMA).withColumns(
        {c: F.lit(7) for c in ("vec", "dim", "block", "group", "raw", "rank", "score", "query_id")})
    got = covertree.top_k(frame, "vec_id % 100 = 0", k=2).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got)] == [(0, 1, 1), (0, 2, 2), (100, 1, 99), (100, 2, 98)]


@pytest.mark.parametrize("size", [1.0, 1e6, 1e10])
def test_search_is_exact_at_every_size(size):
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(400, 5)) * size * (1 if size < 1e9 else 1e-1))
    ids = np.arange(400)
    scores, found = covertree.Search(ids, v, 5)(ids[:40], v[:40], np.full(40, float(-2**63)))
    for i in range(40):
        want = sorted((-sum(int(a) * int(b) for a, b in zip(v[i], v[j])), j) for j in range(400) if j != i)[:5]
        assert [(-int(s), int(j)) for s, j in zip(scores[i], found[i])] == want


def test_cover_tree_covers_and_separates():
    points = np.random.default_rng(2).normal(size=(3000, 3)) * [1, 5, 20]

    def walk(node):
        away = np.linalg.norm(points[node.places] - node.centre, axis=1)
        assert away.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.places for c in node.children])) == sorted(node.places)
            centres = np.stack([c.centre for c in node.children])
            gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)
            assert gaps[~np.eye(len(centres), dtype=bool)].min() > node.radius * covertree.SHRINK - 1e-9
            return 1 + sum(map(walk, node.children))
        return 1

    assert walk(covertree.cover_tree(points, covertree.LEAF)) > 50
