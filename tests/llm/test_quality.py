"""Quality measures against plain counting; the classifier on held-out rows."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from llm.helpers import docs_frame, write_docs
from tabulon.llm import quality
from tabulon.llm.queries import QUERIES

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def _texts():
    rng = random.Random(4)
    words = ["the", "of", "é", "#*", "a<b", "\n", "\n", "x\x85y", "\t", "\x1c", "Zug", "|", "日本"]
    texts = [None, "", " \n\n ", "a\na\na", "a b c a b c", "same " * 60, "w " * 49, "u\r\nu\r\n"]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randrange(120))) for _ in range(200)] \
        + [" ".join(str(rng.random()) for _ in range(20000))]


def test_measures_match_plain_counting(spark, tmp_path):
    texts = _texts()
    folder = write_docs(spark, tmp_path / "d", texts)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = QUERIES["op8_quality_rules"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = measures(texts[r.doc_id])
        assert [r[n] for n in NAMES] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)  # no labels: nothing more is rejected


def _corpus(n):
    rng = random.Random(8)
    good = ["river", "stone", "walks", "under", "bright", "morning", "house", "garden", "paper", "slowly"]
    rows = []
    for i in range(n):
        words = [rng.choice(good) + rng.choice(["", "s", "ed"]) for _ in range(80)]
        if i % 4 == 0:
            words = [w.upper() + "!!" if rng.random() < .8 else w for w in words]
        rows.append((i, " ".join(words), int(i % 4 != 0)))
    return rows


def test_classifier_on_held_out_rows(spark):
    rows = _corpus(400)
    docs = docs_frame(spark, [r[1] for r in rows]).withColumns(
        {c: F.lit("x") for c in ("row", "m", "kept", "good", "label", "id", "features")})
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows if i < 250] + [(1, None, 1), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    held = [r for r in got if r.row.doc_id >= 250]
    assert sum(r.kept == bool(rows[r.row.doc_id][2]) for r in held) >= 0.97 * len(held)
    assert all(r.kept for r in held if rows[r.row.doc_id][2])
    assert set(got[0].row.asDict()) == set(docs.columns)


@pytest.mark.parametrize("window", [1, 2, 3, 4])
def test_repeated_words_windows(window):
    words = [w.encode() for w in "a b c a b c d a b e a".split()]
    grams = [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]
    count = Counter(grams)
    assert quality.repeated_words(words, window) == len(
        {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(window)})


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judged(docs_frame(spark, []), labels).collect() == []


def test_probability_keeps_the_labels_share_when_the_sample_is_full(spark):
    rng = random.Random(12)
    words = ["river", "stone", "walks", "under", "bright", "morning", "house", "garden", "paper", "slowly"]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(700)]  # both classes alike
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(700)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs_frame(spark, texts), labels, per_class=60)
    raws = [t.encode() for t in texts]
    good = [model.probability(model.margin(quality.gram_buckets(r, r.split()))) for r in raws]
    assert abs(sum(good) / len(good) - 6 / 7) < 0.06


def _plain_good(text, model):
    """The calibrated probability, gram by gram in whole numbers."""
    def bucket(h):
        return (h * 0x9E3779B97F4A7C15 % 2 ** 64) >> (64 - quality.HASH_BITS)
    raw = text.encode()
    own = [crc32(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    pairs = [7 if a == b else a * 31 + b + 1 for a, b in zip(own, own[1:])]
    grams = [int.from_bytes(raw[i:i + 4], "little") for i in range(len(raw) - 3)]
    margin = model.bias
    for weights, hashes in zip(model.weights, (own, pairs, grams)):
        if hashes:
            margin += sum(float(weights[bucket(h)]) for h in hashes) / len(hashes)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * margin + model.offset))))


def test_kept_matches_brute_force(spark, tmp_path):
    rows = _corpus(300)
    texts = [r[1] for r in rows] + [None, "", "w " * 60, "RIVER!! " * 20 + " ".join(_corpus(2)[1][1].split() * 400),
                                    " ".join(f"é{i} RIVERS!!" for i in range(90))]
    labels = [(i, q, 0) for i, _, q in rows if i < 200]
    folder = write_docs(spark, tmp_path / "d", texts)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    got = QUERIES["op8_quality_rules"](spark, folder).collect()
    assert len(got) == len(texts) and {r.kept for r in got} == {True, False}
    for r in got:
        text = texts[r.doc_id] or ""
        n, _, _, _, again = measures(text)
        good = _plain_good(text, model)
        assert r.good == pytest.approx(good, abs=1e-4)
        if abs(good - quality.THRESHOLD) > 1e-4:
            assert r.kept == (not (n < 50 or 100 * again > 50 * n) and good >= quality.THRESHOLD)
