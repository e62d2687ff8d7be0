"""Two-sided path search, bounded distinct values, concurrent sources, listing in tasks, grid bins."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tabulon.operators import charts, clean, graph
from tabulon.sources import files


def plain_path(edges, start, goal):
    """Breadth-first; every node's parent is the smallest name of the level before."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level, parent = {start}, {start: None}
    while level and goal not in parent:
        following = {}
        for a in sorted(level):
            for b in near.get(a, ()):
                if b not in parent:
                    following.setdefault(b, a)
        parent |= following
        level = set(following)
    if goal not in parent:
        return []
    path = [goal]
    while parent[path[-1]] is not None:
        path.append(parent[path[-1]])
    return path[::-1]


@pytest.mark.parametrize("uneven", [8, 1])
def test_path_equals_plain_search(spark, monkeypatch, uneven):
    monkeypatch.setattr(graph, "UNEVEN", uneven)
    rng = random.Random(uneven)
    nodes = [f"n{i}" for i in range(60)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(75)] + [("n0", f"hub{i}") for i in range(200)]
    df = spark.createDataFrame(edges, "source string, target string")
    want = {(a, b): plain_path(edges, a, b) for a in nodes for b in nodes if a != b}
    by_length = {}
    for ends, path in want.items():
        by_length.setdefault(len(path), []).append(ends)
    assert {0, 2, 3, 4, 5, 6} <= set(by_length)
    by_length = {n: by_length[n] for n in (0, 2, 3, 4, 5, 6)}
    for length, ends in by_length.items():
        for a, b in ends[:1]:
            got = [r["node"] for r in graph.shortest_path(df, a, b).orderBy("step").collect()]
            assert got == want[a, b]
    a, b = by_length[5][0]
    assert graph.shortest_path(df, a, b, max_depth=3).isEmpty()
    assert graph.shortest_path(df, a, b, max_depth=4).count() == 5


def test_rounds_are_half_the_distance(spark, monkeypatch):
    rounds = []
    step = graph._next_level
    monkeypatch.setattr(graph, "_next_level", lambda *a: rounds.append(1) or step(*a))
    line = spark.createDataFrame([(f"v{i:02}", f"v{i + 1:02}") for i in range(20)], "source string, target string")
    assert graph.shortest_path(line, "v01", "v12").count() == 12 and len(rounds) == 6


def test_encode_ships_few_values(spark):
    rows = [(f"k{i % 9}", f"m{i % 10}", None if i % 3 else "xé", str(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "a string, b string, `c.d` string, e string")
    for parts in (1, 6):
        got = clean.encode_categorical(df.repartition(parts))
        assert got.columns == ["a", "b", "c.d", "e", "a_encoded", "c.d_encoded"]
        assert got.where("a_encoded <> cast(substring(a, 2, 1) as int)").isEmpty()
        assert {r[0] for r in got.select("`c.d_encoded`").distinct().collect()} == {None, 0}
    kept = clean._few_values(2, 10)
    import pyarrow as pa
    batches = [pa.RecordBatch.from_pydict({"x": [str(i % 50) for i in range(n, n + 100)], "y": ["z"] * 100}) for n in (0, 100)]
    out = next(iter(kept(batches)))
    assert out.num_rows == 11


def test_sources_are_read_at_the_same_time(spark, tmp_path, monkeypatch):
    paths = []
    for i in range(4):
        spark.range(i + 1).write.parquet(str(tmp_path / f"{i}.parquet"))
        paths.append(str(tmp_path / f"{i}.parquet"))
    paths[2] = str(tmp_path / "missing.parquet")
    meet, load = threading.Barrier(4, timeout=60), files.load
    pools = set()

    def slow(s, path, *a, **k):
        meet.wait()  # breaks unless all four are here together
        pools.add(s.sparkContext.getLocalProperty("spark.scheduler.pool"))
        return load(s, path, *a, **k)
    monkeypatch.setattr(files, "load", slow)
    frames, status = files.load_sources(spark, paths, threads=4)
    rows = status.orderBy("index").collect()
    assert [(r["index"], r["success"], r["n_rows"]) for r in rows] == [(0, True, 1), (1, True, 2), (2, False, 0), (3, True, 4)]
    assert sorted(frames) == [0, 1, 3] and "missing" in rows[2]["error"] and len(pools) == 4
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    assert files.load_sources(spark, [])[1].count() == 0


def test_listing_in_tasks_equals_sparks_own(spark, tmp_path):
    for name, text in {"a.csv": "x", "b/c.JSON": "yy", "b/d e/f.txt": "", "b/d e/g.bin": "1" * 50, "_hidden/x.csv": "n",
                       "b/.secret": "n", "z/_tmp.csv": "n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    cols = ["name", "extension", "category", "bytes", "modified", "within_limit", "readable"]
    for recursive in (True, False):
        own, tasks = (sorted(files.file_manifest(spark, str(tmp_path), recursive, 10, how).select(
            *cols[:4], F.date_trunc("second", "modified"), *cols[5:]).collect()) for how in ("source", "tasks"))
        assert own == [r for r in tasks if r["bytes"]] and len(tasks) == (4 if recursive else 1)
    path = files.file_manifest(spark, str(tmp_path), listing="tasks").where("name = 'c.JSON'").first()["path"]
    assert spark.read.text(path).first()[0] == "yy"
    assert files.file_manifest(spark, f"file://{tmp_path}", listing="tasks").count() == 4


def test_grid_bins(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(5, 2), None if i % 9 == 0 else rng.random()) for i in range(800)] + [(float("nan"), 1.0)]
    got = charts.scatter_bins(spark.createDataFrame(rows, "x double, y double"), x_bins=6, y_bins=3).collect()
    pairs = [(x, y) for x, y in rows if x == x and y is not None]
    assert sum(r["cnt"] for r in got) == len(pairs) and len(got) <= 18
    top_x, top_y = max(x for x, _ in pairs), max(y for _, y in pairs)
    for r in got:
        inside = [1 for x, y in pairs if r["x_lo"] <= x and (x < r["x_hi"] or r["x_bin"] == 5 and x <= top_x)
                  and r["y_lo"] <= y and (y < r["y_hi"] or r["y_bin"] == 2 and y <= top_y)]
        assert abs(len(inside) - r["cnt"]) <= 1  # an edge's last digit
    flat = charts.scatter_bins(spark.createDataFrame([(1.0, 2.0)] * 3, "x double, y double")).collect()
    assert [(r["x_bin"], r["y_bin"], r["cnt"], r["fit"]) for r in flat] == [(0, 0, 3, None)]
    assert charts.scatter_bins(spark.createDataFrame([], "x double, y double")).collect() == []
