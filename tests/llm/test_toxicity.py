"""The tagger's marginals against enumerating all tag sequences; held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import docs_frame, write_docs
from tabulon.llm import toxicity
from tabulon.llm.queries import QUERIES


def brute(u, step):
    n, total, p = len(u), 0.0, np.zeros(len(u))
    for tags in itertools.product((0, 1), repeat=n):
        w = float(np.exp(sum(x for x, t in zip(u, tags) if t)))
        for a, b in zip(tags, tags[1:]):
            w *= step[a, b]
        total += w
        p += w * np.array(tags)
    return p / total


@pytest.mark.parametrize("seed", range(6))
def test_marginals_match_enumeration(seed):
    rng = np.random.default_rng(seed)
    step = rng.uniform(.2, 3, (2, 2))
    sizes = rng.integers(1, 9, 7)
    u = rng.normal(0, 3, sizes.sum())
    first = np.zeros(len(u), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    got = toxicity.marginals(u, first, step)[0]
    want = np.concatenate([brute(x, step) for x in np.split(u, np.cumsum(sizes)[:-1])])
    assert got == pytest.approx(want, abs=1e-9)


def _corpus(n, seed):
    rng = random.Random(seed)
    plain = [a + b for a in ("ta", "re", "mi", "so", "lu", "pe") for b in ("na", "ko", "ri", "sel", "vu", "dom")]
    bad = ["grublow", "zorplax", "vexnit", "morgah"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(0 if i % 50 == 49 else 20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", "!", "en", ","]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    rows = _corpus(1200, 1)
    folder = str(tmp_path_factory.mktemp("tox"))
    extra = [(5000, None), (5001, ""), (5002, "é 😀 grublow zorplax tana"), (5003, "tana " * 20000), (5004, rows[0][1])]
    docs_frame(spark, [r[1] for r in rows] + [t for _, t in extra],
               ids=[r[0] for r in rows] + [i for i, _ in extra]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (3, None, None)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, folder).collect()}


def test_held_out_accuracy(scored):
    from zlib import crc32
    rows, got = scored
    held = [(i, t) for i, _, t in rows if got[i].held_out]
    assert len(held) > 200
    assert all(got[i].held_out == (crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    right = [t for i, t in held if got[i].predicted == t]
    assert len(right) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_offending_offsets_and_edge_texts(scored):
    rows, got = scored
    assert got[5002].spans == "4:11,12:19" and got[5002].predicted == 1
    assert got[5000].score == got[5001].score and got[5000].predicted == 0 and got[5003].predicted == 0
    assert got[5004].score == got[0].score


def test_without_both_classes_and_empty(spark):
    docs = docs_frame(spark, ["a b", None]).withColumns({c: F.lit("x") for c in ("row", "s", "score", "id", "label")})
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxic_documents(docs, labels).collect()
    assert [(r.score, r.predicted, r.spans) for r in rows] == [(0.0, 0, "")] * 2
    assert set(rows[0].row.asDict()) == set(docs.columns)
    assert toxicity.toxic_documents(docs_frame(spark, []), labels).collect() == []


def test_whole_query_against_enumeration(spark, tmp_path):
    """Same sample and weights; tags, spans and scores by enumerating tag sequences."""
    from zlib import crc32
    rng = random.Random(6)
    rows = [(i, t, x) for i, t, x in _corpus(300, 9)]
    short = [(1000 + i, " ".join(rng.choice(["tana", "grublow", "zorplax!", "Vexnit", "reko", "ünde", "sovu"])
                                 for _ in range(rng.randrange(11))), None) for i in range(60)]
    folder = write_docs(spark, tmp_path / "d", [t for _, t, _ in rows + short], ids=[i for i, _, _ in rows + short])
    spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, folder).collect()}
    learnt = [(t, x) for i, t, x in rows if crc32(str(i).encode()) % 4 != 2]
    tagger = toxicity.fit_texts([t.encode().split() for t, _ in learnt], np.array([x for _, x in learnt], dtype=bool))
    for i, text, _ in short:
        words = text.split()
        u = np.array([tagger.bias + sum(float(tagger.weights[f]) for f in toxicity.features(w.encode())) for w in words])
        p = brute(u, tagger.step) if words else np.zeros(0)
        toxic = sum(x for x in p if x >= 0.5)
        want = 1 / (1 + np.exp(-(tagger.slope * np.log(toxic + 0.5) + tagger.offset)))
        assert got[i].score == pytest.approx(want, abs=1e-6) and got[i].predicted == int(want >= 0.3)
        at, spans = 0, []
        for w, x in zip(words, p):
            spans += [f"{at}:{at + len(w)}"] if x >= 0.5 else []
            at += len(w) + 1
        assert got[i].spans == ",".join(spans)


def test_calibration_counts_each_row_for_those_it_stands_for():
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    truth, weight = rng.random(300) < 1 / (1 + np.exp(-2 * x)), np.where(rng.random(300) < .5, 4.0, 1.0)
    again = np.repeat(np.arange(300), weight.astype(int))
    assert toxicity._calibrate(x, truth, weight) == pytest.approx(toxicity._calibrate(x[again], truth[again], np.ones(len(again))))
