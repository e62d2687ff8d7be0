"""Wavelet matrix files: round trips, and the query against the library."""

import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.helpers import docs_frame, write_docs
from tabulon.llm import wavelet
from tabulon.llm.queries import QUERIES, file_bytes, tokenizer_file


@pytest.fixture(scope="module")
def model():
    return file_bytes(tokenizer_file("word_bpe_49k.json"))


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (7, 2), (511, 3), (512, 300), (513, 65536), (3000, 70000)])
def test_access_count_select(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    f = wavelet.WaveletFile(wavelet.write_file([5, None], np.array([n, 0]), ids))
    assert f.doc_ids == [5, None] and f.lengths.tolist() == [n, 0]
    m = f.matrix
    assert (m.ids() == ids).all()
    for i in range(0, n, max(1, n // 50)):
        assert m.access(i) == ids[i]
        places = np.flatnonzero(ids == ids[i])
        assert m.count(int(ids[i])) == len(places)
        assert m.count(int(ids[i]), i, n) == (places >= i).sum()
        for k in {0, len(places) // 2, len(places) - 1}:
            assert m.select(int(ids[i]), k) == places[k]
    assert m.count(top + 5) == 0
    with pytest.raises(IndexError):
        m.select(top + 5, 0)


def _texts():
    rng = random.Random(9)
    parts = ["The", "cat", " ", "\n", "'s", "can't", "don'T", "é", "É", "é", "ΑΣ", "İ", "12", "x2y", " ", "\x85",
             "\x1c", "<|endoftext|>", "ﬁ", "日本", "😀", "--", "\"", " ́", "\t", "̈a", "ǅ", "ẞ"]
    texts = [None, "", " ", "\"", "word " * 20000, "z" * 5000]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]


def test_query_matches_the_library(spark, tmp_path, model):
    tok = Tokenizer.from_str(model.decode())
    texts = _texts()
    rng = random.Random(1)
    ids = rng.sample(range(10_000), len(texts))
    rows = QUERIES["op10_token_shards"](spark, write_docs(spark, tmp_path / "d", texts, ids=ids)).collect()
    start, want = 0, []
    for doc_id, text in sorted(zip(ids, texts)):
        own = tok.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(own), crc32(np.array(own, dtype="<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, rows)) == want


def test_parts_repeats_nulls_and_occurrences(spark, model):
    docs = docs_frame(spark, ["cat cat dog", "cat", "cat", None, "dog " * 50], ids=[3, None, 3, None, 1]) \
        .withColumns({c: F.lit("x") for c in ("id", "tie", "shard", "part")})
    files = wavelet.write_shards(docs, model, 1, part_ids=4)
    assert files.count() >= 3
    rows = wavelet.read_documents(files).collect()
    # null ids first (the texts "cat" and none), then 1, then the two rows of 3
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (0, 2), (1, 51), (3, 2), (3, 4)]
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, None, 1, 3, 3]
    cat = Tokenizer.from_str(model.decode()).encode("cat", add_special_tokens=False).ids[0]
    found = [(r.doc_id, r.place) for r in wavelet.occurrences(files, cat).collect()]
    assert sorted(found, key=str) == sorted([(3, 0), (3, 0), (3, 1), (None, 0)], key=str)


def test_empty_table(spark, model):
    assert wavelet.read_documents(wavelet.write_shards(docs_frame(spark, []), model, 1)).collect() == []


def test_slices_and_forgotten_words_change_nothing(model, monkeypatch):
    tok = Tokenizer.from_str(model.decode())
    monkeypatch.setattr(wavelet, "SLICE", 7)
    encoder = wavelet.WordEncoder(model)
    encoder.parts.bound = encoder.words.bound = 500  # both caches turn over all the time
    for text in [t or "" for t in _texts()] + ["plain words and\nlines, 12 can't; " * 30, " lead", "trail  ", "a<|endoftext|>b " * 3]:
        assert np.frombuffer(encoder(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
