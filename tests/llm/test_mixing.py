"""Source mixing against a sequential brute-force version."""

import re

import pytest
from pyspark.sql import functions as F

from llm.helpers import docs_frame, write_docs
from tabulon.llm import mixing
from tabulon.llm.queries import QUERIES


def targets(sizes):
    """Water-filling by repetition."""
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        left = sum(weight[s] for s in order if s not in full)
        share = {s: rest * weight[s] / left for s in order if s not in full} if left else {}
        over = {s for s, v in share.items() if v > 3 * sizes[s]}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in full}, **share}
        full |= over


def _run(spark, tmp_path, texts, sources):
    folder = write_docs(spark, tmp_path / "d", texts, sources=sources)
    return QUERIES["op7_source_mixing"](spark, folder).collect()


@pytest.mark.parametrize("hot", [False, True])
def test_targets_and_words_taken(spark, tmp_path, hot):
    texts = ["w " * (1 + (i * 37) % 90) for i in range(400)] + [None, "", "a\x85b\x0bc"]
    sources = [("s0" if hot and i % 3 else f"s{i % 11}") if i % 13 else None for i in range(len(texts))]
    rows = _run(spark, tmp_path, texts, sources)
    assert len(rows) == len(texts)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    by = {}
    for s, n in zip(sources, size):
        by[s] = by.get(s, 0) + n
    want = targets(by)
    taken = {}
    for r in rows:
        assert r.size == size[r.doc_id] and r.source_size == by[sources[r.doc_id]]
        assert r.target == pytest.approx(want[sources[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[sources[r.doc_id]] = taken.get(sources[r.doc_id], 0) + r.taken
    for s, n in taken.items():
        assert n == pytest.approx(want[s], abs=1)
    assert sorted(map(tuple, _run(spark, tmp_path / "again", texts, sources))) == sorted(map(tuple, rows))


def test_served_documents_follow_virtual_finish_times(spark):
    docs = docs_frame(spark, [f"t{i} " * (i % 7 + 1) for i in range(60)], sources=[f"s{i % 4}" for i in range(60)])
    rows = mixing.sized_rows(docs, None, "doc_id", "text", "source")
    goal = {r.source: r for r in mixing.source_targets(rows).collect()}
    served = mixing.schedule(rows, mixing.source_targets(rows)).join(rows, "rid").collect()
    for s, g in goal.items():
        own = sorted((r.finish, r.size, r.taken) for r in served if r.source == s)
        cum = 0
        for finish, n, taken in own:
            cum += n
            assert finish == pytest.approx(cum / g.weight)
            assert taken == min(n, max(0, round(g.target) - (cum - n)))


@pytest.mark.parametrize("max_epochs", [1, 3])
def test_truncation_is_where_the_words_served_reach_the_budget(spark, max_epochs):
    """Served word by word over the finish order, against the level that the totals give."""
    texts = ["w " * (1 + (i * 31) % 50) for i in range(200)] + ["", None, "w " * 5000]
    docs = docs_frame(spark, texts, sources=[f"s{(i * i) % 9}" for i in range(200)] + ["none", None, "long"])
    rows = mixing.sized_rows(docs, None, "doc_id", "text", "source")
    goal = mixing.source_targets(rows, max_epochs=max_epochs)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = mixing.finish_order(rows, goal, max_epochs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    end = mixing.truncation(order, goal)
    assert end == goal.first().level
    turns = sorted(order.collect(), key=lambda r: (r.finish, r.rid, r.epoch))
    assert [r.part for r in turns] == sorted(r.part for r in turns) and turns[-1].part > 0
    used = sum(max(0.0, min(r.size, r.weight * end - r.earlier)) for r in turns)
    assert used == pytest.approx(sum(r.size for r in turns if r.epoch == 0))


def test_mixed_rows_keep_columns_and_repeat(spark):
    docs = docs_frame(spark, ["a b c"] * 4 + ["d e f g"] * 90, sources=["s0"] * 4 + ["s1"] * 90) \
        .withColumns({c: F.lit("x") for c in ("row", "rid", "size", "epoch", "taken", "target")})
    got = mixing.mixed_rows(docs)
    assert got.columns == docs.columns
    assert [r.n for r in got.where("source = 's0'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()] == [3] * 4


def test_nothing_to_mix(spark):
    assert mixing.mix(docs_frame(spark, [])).collect() == []
    assert [r.taken for r in mixing.mix(docs_frame(spark, [None, ""])).collect()] == [0, 0]
