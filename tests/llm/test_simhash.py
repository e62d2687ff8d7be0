"""SimHash groups against comparing all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import docs_frame, groups, simhash, write_docs
from tabulon.llm import simhash as op
from tabulon.llm.components import components
from tabulon.llm.queries import QUERIES


def _texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "one", "One Two", "one two three", "A\x1cB\x85c d", "é ü ß É", "x " * 5000]
    for _ in range(40):
        body = [rng.choice(words) for _ in range(rng.randrange(3, 200))]
        texts.append(" ".join(body))
        for _ in range(rng.randrange(4)):
            near = list(body)
            near[rng.randrange(len(near))] = rng.choice(words)
            texts.append("  ".join(near) if rng.random() < .3 else " ".join(near).upper())
    return texts + texts[:20]


def test_query_matches_brute_force(spark, tmp_path):
    texts = _texts()
    prints = [simhash(t) for t in texts]
    root = groups(len(texts), [(i, j) for i in range(len(texts)) for j in range(i)
                               if (prints[i] ^ prints[j]).bit_count() <= 3])
    rows = QUERIES["op6_simhash_dedup"](spark, write_docs(spark, tmp_path / "d", texts)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == \
        [(i, f"{p:016x}", root[i]) for i, p in enumerate(prints)]


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200])
def test_bucket_links_connect_what_all_pairs_connect(n, radius):
    rng = np.random.default_rng(n * 10 + radius)
    seeds = rng.integers(0, 2**63, size=max(1, n // 8), dtype=np.uint64)
    values = rng.choice(seeds, n)
    for _ in range(radius + 1):
        values = values ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    bucket = np.sort(rng.integers(0, max(1, n // 20), n))
    got = op.bucket_links(values, bucket, radius)
    near = [(i, j) for i in range(n) for j in range(i) if bucket[i] == bucket[j]
            and int(values[i] ^ values[j]).bit_count() <= radius]
    assert groups(n, got.tolist()) == groups(n, near)
    assert len(got) < n
    assert all(int(values[a] ^ values[b]).bit_count() <= radius for a, b in got.tolist())


def test_large_buckets_are_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(op, "CELL", 8)
    rng = random.Random(1)
    prints = list({rng.getrandbits(6) | 1 << 40 for _ in range(60)} | {rng.getrandbits(60) for _ in range(60)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    got = components(op.links(frame, 3), "a", "b").collect()
    at = {p: i for i, p in enumerate(prints)}
    want = groups(len(prints), [(at[p], at[q]) for p in prints for q in prints
                                if p < q and (p ^ q).bit_count() <= 3])
    linked = {r.node: r.root for r in got}
    mine = groups(len(prints), [(at[a], at[b]) for a, b in linked.items()])
    assert mine == want


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "x long, y long"), "x", "y").collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_first_of_groups_keeps_one_row_each(spark):
    docs = docs_frame(spark, ["a b c d", "a b c d", None, "", "q r s t u", "a b c d"],
                      ids=[5, 5, None, None, 2, 3]).withColumns(
        {c: F.lit(1) for c in ("row", "rid", "fp", "id", "component", "component_id")})
    got = op.first_of_groups(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 2), (False, 3), (True, 0)]


def test_empty_table(spark):
    assert op.grouped(docs_frame(spark, [])).collect() == []
    assert op.first_of_groups(docs_frame(spark, [])).collect() == []
