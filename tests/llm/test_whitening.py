"""Whitening against plain NumPy over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import whitening
from tabulon.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, keep=32):
    """Per row: deviation and whitened values; explained shares."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    c = (d / n).astype(float)
    values, vecs = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(values)[::-1][:keep]
    return (d * d).sum(axis=1), c @ vecs[:, order] / np.sqrt(values[order]), values[order] / np.trace(c.T @ c / n)


def vectors(n, size, seed=3):
    rng = random.Random(seed)
    rows = [[rng.gauss(0, 1 + i) + (rng.random() if i else 0) for i in range(size)] for _ in range(n)]
    return rows + rows[:5] * 7  # a group of copies


@pytest.mark.parametrize("size", [5, 40])
def test_query_equals_plain_numpy(spark, tmp_path, size):
    rows = vectors(300, size)
    odd = [None, [], [1.0] * (size - 1) + [None], [float("nan")] + [0.0] * (size - 1), [float("inf")] * size,
           [1.0] * (size + 1), [3e38] * size]
    data = [(i, v, 1) for i, v in enumerate(rows)] + [(10_000 + i, v, 0) for i, v in enumerate(odd)] + [(None, rows[0], 2)]
    spark.createDataFrame(data, SCHEMA).repartition(7).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = QUERIES["op12_embedding_whitening"](spark, str(tmp_path)).collect()
    deviation, white, share = plain([*rows, rows[0]])
    keep = min(size, 32)
    assert len(got) == keep * (len(rows) + 1)
    assert {r.n for r in got} == {len(rows) + 1} and {r.component for r in got} == set(range(1, keep + 1))
    sign = {}
    for r in got:
        i, c = (r.vec_id if r.vec_id is not None else len(rows)), r.component - 1
        assert r.deviation == deviation[i] and abs(r.explained / share[c] - 1) < 1e-9
        sign.setdefault(c, 1 if r.whitened * white[i, c] >= 0 else -1)
        assert abs(r.whitened - sign[c] * white[i, c]) < 1e-6
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_weight_one_counts_every_different_vector_once(spark):
    rows = vectors(60, 4)
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], SCHEMA)
    got = whitening.whiten(df, weight="one").collect()
    deviation, white, _ = plain(rows[:60])
    assert got[0].n == 60 and len(got) == 4 * len(rows)
    one = {r.id: r for r in got if r.component == 1}
    assert all(one[i].deviation == deviation[i] for i in range(60))
    assert all(abs(abs(one[i].whitened) - abs(white[i, 0])) < 1e-9 for i in range(60))
    assert one[60].whitened == one[0].whitened
    with pytest.raises(ValueError):
        whitening.whiten(df, weight="two")


def test_components_without_variance_and_far_means(spark):
    rows = [(i, [1e9 + i % 3, 5.0, float(i)], 1) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(df).orderBy("id", "component").collect()
    assert [r.whitened is None for r in got[:3]] == [False, False, True]
    assert got[2].explained < 1e-10 and got[0].identity_error < 1e-9
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for _, v, _ in rows], dtype=object)
    want = ((50 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert [r.deviation for r in got if r.component == 1] == list(want)
    one = whitening.whiten(df.limit(1)).collect()
    assert [r.whitened for r in one] == [None] * 3 and one[0].deviation == 0 and one[0].identity_error == 0


def test_exact_sums_beyond_64_bits():
    x = np.array([[2 ** 51, -5], [-(2 ** 51), 7]])
    n = 2 ** 20
    model = whitening.Whitening(n, (2 ** 63 + 11, 4), np.eye(2), np.ones(2), np.ones(2))
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
    assert (model.deviations(x) == np.array([[n * int(v) - s for v, s in zip(row, model.sums)] for row in x],
                                            dtype=object)).all()
    assert model.squared(x) == [w if w < 2 ** 63 else None for w in want] == [None, None]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    df = spark.createDataFrame([(i, [float(i), float(i * i % 7)], 1) for i in range(20)], SCHEMA).withColumns(
        {c: F.lit("x") for c in ("x", "w", "z", "id", "deviation", "at")})
    assert len(whitening.whiten(df).collect()) == 40
