"""K-means steps and tree splits against plain NumPy."""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabulon.operators import kmeans, models, splits


def plain_lloyd(x, centers, max_iter, tol):
    centers = centers.copy()
    for _ in range(max_iter):
        of = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[of == c].mean(axis=0) if (of == c).any() else centers[c] for c in range(len(centers))])
        moved = np.sqrt(((new - centers) ** 2).sum(axis=1)).max()
        centers = new
        if moved <= tol:
            break
    apart = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    of = apart.argmin(axis=1)
    return centers, np.bincount(of, minlength=len(centers)), apart.min(axis=1).sum()


def points(n=300):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(1e6 + 5 * c, 1 + c, size=(n // 3, 4)) for c in range(3)])
    return np.concatenate([x, x[:3], x[:3]])


def test_all_models_equal_plain_steps_from_the_same_starts(spark):
    x = points()
    df = spark.createDataFrame([(v.tolist(), str(i)) for i, v in enumerate(x)], "features array<double>, key string")
    starts = kmeans.start_points(df.repartition(5), 7, 3)
    for s, got in enumerate(starts):
        order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"{s}:{i}".encode()).hexdigest())
        want, seen = [], set()
        for i in order:
            if x[i].tobytes() not in seen:
                seen.add(x[i].tobytes())
                want.append(x[i])
        assert np.array_equal(got, np.array(want[:7]))
    wanted = [starts[s][:k] for k in (2, 3, 7) for s in range(3)]
    for max_iter in (0, 1, 20):
        for parts in (1, 6):
            found = kmeans.lloyd(df.repartition(parts), wanted, max_iter, 1e-4)
            for start, fit in zip(wanted, found):
                centers, sizes, inertia = plain_lloyd(x, start, max_iter, 1e-4)
                assert np.allclose(fit.centers, centers, rtol=1e-12) and list(fit.sizes) == list(sizes)
                assert math.isclose(fit.inertia, inertia, rel_tol=1e-9)


def test_scans_do_not_grow_with_the_models(spark, monkeypatch):
    calls = []
    step = kmeans._step
    monkeypatch.setattr(kmeans, "_step", lambda *a, **k: calls.append(len(a[1])) or step(*a, **k))
    df = spark.createDataFrame(pd.DataFrame(points()[:, :2], columns=["x", "y"]))
    elbow, clusters, _ = models.kmeans_elbow(df, max_k=6, max_iter=5)
    assert len(calls) <= 6 and calls[0] == 4 * 3 and elbow.count() == 4
    assert clusters.agg(F.sum("size")).first()[0] == df.count()


def plain_splits(x, y, depth, bins):
    cuts = [sorted(set(np.quantile(x[:, f], [i / bins for i in range(1, bins)]))) for f in range(x.shape[1])]
    total, out, nodes = ((y - y.mean()) ** 2).sum(), [], {1: np.arange(len(y))}
    sse = lambda v: ((v - v.mean()) ** 2).sum()
    for level in range(depth):
        following = {}
        for node, rows in sorted(nodes.items()):
            best = None
            for f, cs in enumerate(cuts):
                for t in cs:
                    left = x[rows, f] <= t
                    if left.any() and not left.all():
                        gain = round((sse(y[rows]) - sse(y[rows][left]) - sse(y[rows][~left])) / total, 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = (gain, f, t, left)
            if best:
                gain, f, t, left = best
                out.append((node, level, f, t, len(rows), gain, int(left.sum())))
                following |= {2 * node: rows[left], 2 * node + 1: rows[~left]}
        nodes = following
    return out


def test_tree_splits_equal_plain_search(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(500, 3)), 2)
    x[:, 2] = rng.integers(0, 3, 500)
    y = np.where(x[:, 0] > 0.3, 5, 0) + np.where(x[:, 2] > 1, x[:, 1], 2) + rng.normal(size=500) / 10
    pdf = pd.DataFrame(x, columns=["a.b", "node", "bin"]).assign(y=y)
    df = spark.createDataFrame(pdf)
    got = splits.tree_splits(df.repartition(5), "y", ["a.b", "node", "bin"], depth=3, bins=16).orderBy("node").collect()
    want = plain_splits(x, y, 3, 16)
    names = ["a.b", "node", "bin"]
    assert [(r["node"], r["depth"], r["feature"], r["n"], r["n_left"]) for r in got] == [
        (w[0], w[1], names[w[2]], w[4], w[6]) for w in want]
    assert all(math.isclose(r["threshold"], w[3], abs_tol=1e-9) and math.isclose(r["gain"], w[5], abs_tol=3e-9)
               for r, w in zip(got, want))
    imps = splits.split_importances(splits.tree_splits(df, "y", names)).collect()
    assert math.isclose(sum(r["importance"] for r in imps), 1.0) and max(imps, key=lambda r: r["importance"])["feature"] == "a.b"


def test_splits_without_rows_or_variance(spark):
    df = spark.createDataFrame([(float(i), 3.0, None if i % 2 else 1.0) for i in range(9)], "a double, y double, z double")
    assert splits.tree_splits(df, "y", ["a"]).collect() == []
    assert splits.tree_splits(df.limit(0), "a", ["y"]).collect() == []
    assert splits.tree_splits(df, "a", ["y", "z"]).collect() == []
