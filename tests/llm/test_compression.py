"""The compression classifier against plain zstandard calls and on held-out rows."""

import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from llm.helpers import docs_frame, write_docs
from tabulon.llm import compression
from tabulon.llm.queries import QUERIES


def _corpus(n, seed=8):
    rng = random.Random(seed)
    good = ["river", "stone", "walks", "under", "bright", "morning", "house", "garden", "paper", "slowly"]
    rows = []
    for i in range(n):
        words = [rng.choice(good) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(20, 300))]
        if i % 6 == 0:
            words = [w.upper() + "!!" for w in words] if i % 12 else [words[0]] * len(words)
        rows.append((" ".join(words), int(i % 6 != 0)))
    return rows


def _labels(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_query_on_held_out_rows_and_odd_texts(spark, tmp_path):
    rows = _corpus(900)
    odd = [None, "", "a", "日本語 " * 40_000, "\x00" * 10, rows[1][0], rows[1][0]]
    folder = write_docs(spark, tmp_path / "d", [r[0] for r in rows] + odd)
    _labels(spark, folder, [(i, q, 0) for i, (_, q) in enumerate(rows)] + [(None, 0, 0), (3, None, 1)])
    got = {r.doc_id: r for r in QUERIES["op11_quality_classifier"](spark, folder).collect()}
    assert set(got) == set(range(len(rows) + len(odd)))
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [i for i in range(len(rows)) if held_out(i)]
    good, bad = [i for i in held if rows[i][1]], [i for i in held if not rows[i][1]]
    assert sum(got[i].predicted for i in good) >= 0.97 * len(good)
    assert sum(not got[i].predicted for i in bad) >= 0.9 * len(bad)
    assert got[900].score == got[901].score and got[905].score == got[906].score == got[1].score


def test_held_out_labels_change_nothing(spark, tmp_path):
    rows = _corpus(300)
    scores = []
    for flip in (False, True):
        folder = write_docs(spark, tmp_path / f"d{flip}", [r[0] for r in rows])
        _labels(spark, folder, [(i, 1 - q if flip and held_out(i) else q, 0) for i, (_, q) in enumerate(rows)])
        scores.append(sorted((r.doc_id, r.score) for r in QUERIES["op11_quality_classifier"](spark, folder).collect()))
    assert scores[0] == scores[1]


def test_whole_query_against_plain_python(spark, tmp_path):
    """Same sample, dictionaries, sizes and line, computed without Spark."""
    rows = _corpus(240, seed=5)
    folder = write_docs(spark, tmp_path / "d", [r[0] for r in rows])
    _labels(spark, folder, [(i, q, 0) for i, (_, q) in enumerate(rows)])
    h = {r.id: (r.h, r.b) for r in spark.range(len(rows)).select(
        "id", F.pmod(F.xxhash64(F.lit("line"), "id"), F.lit(4)).alias("h"), F.lit(0).alias("b")).collect()}
    learnt = [i for i in range(len(rows)) if not held_out(i)]
    cut = lambda t: [t.encode()[k:k + 1024] for k in range(0, len(t.encode()), 1024)]
    compressors = []
    for v in (0, 1):
        blocks = {b for i in learnt if h[i][0] != 0 and rows[i][1] == v for b in cut(rows[i][0])}
        ordered = spark.createDataFrame([(b,) for b in blocks], "block binary").orderBy(F.xxhash64("block"), "block")
        own = zstandard.ZstdCompressionDict(compression.dictionary([bytes(r[0]) for r in ordered.collect()]))
        own.precompute_compress(level=3)
        compressors.append(zstandard.ZstdCompressor(level=3, dict_data=own, write_checksum=False,
                                                    write_content_size=False, write_dict_id=False))

    def difference(text):
        return sum(len(compressors[0].compress(b)) - len(compressors[1].compress(b)) for b in cut(text)) / len(text.encode())
    held = [i for i in learnt if h[i][0] == 0]
    slope, offset = compression.line(np.array([difference(rows[i][0]) for i in held]),
                                     np.array([float(rows[i][1]) for i in held]), np.ones(len(held)))
    for r in QUERIES["op11_quality_classifier"](spark, folder).collect():
        assert abs(r.difference - difference(rows[r.doc_id][0])) < 1e-12
        assert abs(r.score - 1 / (1 + np.exp(-(slope * r.difference + offset)))) < 1e-6


def test_line_finds_the_weighted_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    w = np.where(y > 0, 1.0, 3.0)
    slope, offset = compression.line(x, y, w, penalty=1e-9)
    p = 1 / (1 + np.exp(-(slope * x + offset)))
    assert abs((w * (p - y)).sum()) < 1e-4 and abs((w * (p - y) * x).sum()) < 1e-4


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_labels_of_one_class_or_none(spark, labels):
    docs = docs_frame(spark, ["some text", None]).withColumns({c: F.lit("x") for c in ("row", "score", "difference", "raw", "held")})
    found = compression.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == 2 and len({r.score for r in found}) == 1
    assert found[0].score == pytest.approx(0.5 if not labels else 1.0, abs=1e-5)
    assert compression.scored(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []


def test_few_blocks_become_the_dictionary_themselves():
    assert compression.dictionary([b"abc", b"def"]) == b"abcdef"
    assert compression.dictionary([]) == b""
    assert compression.Sizes(b"", b"").difference(b"anything") == 0.0
