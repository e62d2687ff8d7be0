import numpy as np
from pyspark.sql import functions as F

from tabulon.operators import forest, models


def _rows(spark, n=400):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 20, n), rng.normal(size=n)
    return spark.createDataFrame([(float(x), float(y), float(3 * x + (y > 0) + e)) for x, y, e
                                  in zip(a, b, rng.normal(size=n) / 10)], "f0 double, f1 double, label double").coalesce(1)


def test_trees_take_the_best_cuts_of_their_draws(spark):
    df = _rows(spark)
    model = forest.fit(df, 2, 3, 2, 7)
    got = df.withColumn("h", F.xxhash64(F.monotonically_increasing_id(), F.lit(7))).toPandas()
    factors = np.random.default_rng(7).integers(0, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    codes = [np.searchsorted(model.cuts[i], got[f"f{i}"].to_numpy()) for i in range(2)]
    y = got["label"].to_numpy()
    for t in range(3):
        w = forest.draws(got["h"].to_numpy(), factors[t]).astype(float)
        assert 0.85 < w.mean() < 1.15

        def best(of):
            def fall(f, c):
                left = of & (codes[f] <= c)
                right = of & ~left
                if not w[left].sum() or not w[right].sum():
                    return 0.0
                ends = [np.average(y[m], weights=w[m]) for m in (left, right)]
                return w[left].sum() * w[right].sum() / w[of].sum() * (ends[0] - ends[1]) ** 2
            return max(((f, c) for f in range(2) for c in range(len(model.cuts[f]))), key=lambda p: (fall(*p), -p[0], -p[1]))
        node = np.zeros(len(y), dtype=int)
        for i in range(3):
            of = node == i
            f, c = best(of)
            assert (model.feature[t, i], model.cut[t, i]) == (f, c)
            node = np.where(of, np.where(codes[f] <= c, 2 * i + 1, 2 * i + 2), node)
        means = [np.average(y[node == i], weights=w[node == i]) for i in range(3, 7)]
        assert np.allclose(model.value[t, 3:], means)
    found = model.predict(df).toPandas()
    assert np.corrcoef(found["prediction"], found["label"])[0, 1] > 0.9


def test_forest_holds_nothing_a_row_and_tree(spark):
    """The rows kept for the fit have a byte a feature, a label and one number."""
    kept = []
    write = forest.materialized
    forest.materialized = lambda df: kept.append(df.dtypes) or write(df)
    try:
        forest.fit(_rows(spark), 2, 5, 2, 7)
    finally:
        forest.materialized = write
    assert kept == [[("f0", "tinyint"), ("f1", "tinyint"), ("y", "double"), ("h", "bigint")]]


def test_constant_label_and_rare_value(spark):
    flat = spark.range(50).select("id", F.col("id").cast("double").alias("x"), F.lit(2.0).alias("y"))
    imps, m = models.random_forest(flat, ["id"], "y", ["x"], num_trees=3)
    assert [r["importance"] for r in imps.collect()] == [0.0] and m.first()["mse"] == 0
    rare = spark.range(1000).select("id", (F.col("id") % 250 != 0).cast("double").alias("x")) \
        .withColumn("y", F.col("x") * 5)
    imps, _ = models.random_forest(rare, ["id"], "y", ["x"], num_trees=10)
    assert abs(imps.first()["importance"] - 1.0) < 1e-12
