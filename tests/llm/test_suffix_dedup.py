"""Removal of repeated strings against marking every window."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.helpers import docs_frame, sha, write_docs
from tabulon.llm import suffix_dedup as op
from tabulon.llm.queries import QUERIES


def brute(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    count = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            count[r[i:i + length]] = count.get(r[i:i + length], 0) + 1
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - length + 1):
            if count[r[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(r) else 0
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), len(r) - len(kept), spans, sha(kept)))
    return out


def _texts():
    rng = random.Random(11)
    words = [f"w{rng.getrandbits(20):x}" for _ in range(400)] + ["é", "日本", "😀"]
    passage = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    texts = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "ab" * 300, "x y z " * 400, passage[0], passage[0][:199]]
    for i in range(60):
        body = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 120)))]
        for _ in range(rng.randrange(3)):
            body.insert(rng.randrange(len(body) + 1), rng.choice(passage)[rng.randrange(40):])
        texts.append(" ".join(body))
    texts += texts[-5:] + [texts[-1] + "!", "?" + texts[-1], texts[-2][50:] + texts[-3][:260]]
    return texts + ["\x00" * 300 + "q"]


@pytest.mark.parametrize("divide", [4096, 1])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, divide):
    texts = _texts()
    monkeypatch.setattr(op.without_repeats, "__defaults__", (None, "text", 200, 32, divide))
    rows = QUERIES["op2_suffix_dedup"](spark, write_docs(spark, tmp_path / "d", texts)).collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_short_length_and_text_pieces(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 64)
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(90))) for _ in range(40)] + ["c" * 500]
    rows = op.without_repeats(docs_frame(spark, texts), length=12, gram=4).collect()
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts, 12)


def test_equal_windows_have_equal_anchors(monkeypatch):
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 100, 3000).astype(np.uint8).tobytes()
    raws = [raw + raw[700:1900] + b"zz" + raw[:900], b"", raw[:199], raw[:200], b"a" * 450, raw[100:800], b"b" * 200]
    for piece in (op.PIECE, 150):
        monkeypatch.setattr(op, "PIECE", piece)
        seen, windows = {}, [0] * len(raws)
        for t, s, n, a, o, h in zip(*[x.tolist() for x in op.contexts(raws)]):
            windows[t] += n
            assert h == op.context_hash(raws[t][s:s + n + 199]) and len(raws[t][s:s + n + 199]) == n + 199
            for j in range(n):
                window = raws[t][s + j:s + j + 200]
                assert seen.setdefault(window, (a, o - j)) == (a, o - j)
        assert windows == [max(0, len(r) - 199) for r in raws]


def test_repeats_nulls_clashes_and_empty(spark):
    text = "".join(chr(97 + i * 7 % 26) for i in range(26)) * 3 + "0123456789" * 15
    docs = docs_frame(spark, [text, text, None, None], ids=[1, 1, None, None]).withColumns(
        {c: F.lit("x") for c in ("row", "key", "size", "packed", "runs", "kept", "anchor", "start")})
    rows = op.without_repeats(docs).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(0, 0), (0, 0), (228, 228), (228, 228)]
    assert set(rows[0].row.asDict()) == set(docs.columns)
    assert op.without_repeats(docs_frame(spark, [])).collect() == []


def test_frequent_passage_is_divided_without_a_ceiling(spark, monkeypatch):
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, ends = some(420), [some(7) for _ in range(3)]
    texts = [some(150) + rng.choice(ends) + passage + some(150) for _ in range(400)]
    whole, most = op._sorted, []

    def counted(pieces, *args):
        by = [c for c in ("shard", "anchor", "part") if c in pieces.columns]
        most.append(pieces.groupBy(*by[:1 if by[0] == "shard" else 2]).count().agg(F.max("count")).first()[0] or 0)
        return whole(pieces, *args)

    monkeypatch.setattr(op, "_sorted", counted)
    rows = op.without_repeats(docs_frame(spark, texts), divide=2).collect()
    got = {r.row.doc_id: (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert max(most) <= 2


def test_shards_sorted_in_lots(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(op, "LOT", 100)
    shard = [1, 1, 2, 3, 3, 3, 3, 4]
    batches = [pa.RecordBatch.from_pydict({"shard": pa.array(shard[i:i + 2], pa.int64()),
                                           "bytes": pa.array([b"x" * 60] * len(shard[i:i + 2]))}) for i in range(0, 8, 2)]
    lots = [t.column("shard").to_pylist() for t in op._lots(iter(batches))]
    assert sum(lots, []) == shard and len(lots) > 2
    assert all(a[-1] != b[0] for a, b in zip(lots, lots[1:]))
