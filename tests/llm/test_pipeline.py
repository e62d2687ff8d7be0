"""The corpus pipeline stage by stage against brute force."""

import random
import re

import numpy as np
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

import corpus_pipeline as cp
from llm.helpers import base_secrets, docs_frame, groups, simhash
from llm.test_quality import measures
from tabulon.llm.queries import file_bytes, tokenizer_file


def _texts():
    rng = random.Random(13)
    words = [f"{a}{b}" for a in ("ta", "re", "mi", "so", "lu") for b in ("na", "ko", "ri", "sel", "vu", "dom", "ghi")]
    texts = [None, "", "short one", "same " * 80]
    for i in range(120):
        body = [rng.choice(words) for _ in range(rng.randrange(50, 160))]
        if i % 7 == 0:
            body.insert(5, "password=hunter2222")
        texts.append(" ".join(body))
        if i % 5 == 0:
            texts.append(" ".join(body) + " end")
    return texts + texts[10:14]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipe"))
    docs_frame(spark, _texts()).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_match_brute_force(spark, folder):
    texts = _texts()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = cp.quality_rules(spark, docs, folder)
    assert kept.columns == docs.columns
    good = [i for i, t in enumerate(texts) if (m := measures(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]]
    assert sorted(r.doc_id for r in kept.collect()) == good

    first = cp.near_duplicates(spark, kept, folder)
    prints = [simhash(texts[i]) for i in good]
    root = groups(len(good), [(a, b) for a in range(len(good)) for b in range(a)
                              if (prints[a] ^ prints[b]).bit_count() <= 3])
    want = sorted(good[i] for i in set(root))
    assert first.columns == docs.columns
    assert sorted(r.doc_id for r in first.collect()) == want

    clean = cp.secret_scan(spark, first, folder)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    for r in clean.collect():
        found = base_secrets(texts[r.doc_id])
        assert not any(base_secrets(r.text).values()) and r.n_chars == len(r.text)
        assert (r.text == texts[r.doc_id]) == (not any(found.values()))

    mixed = cp.source_mixing(spark, clean, folder).collect()
    size = {i: len(re.findall(r"\S+", texts[i])) for i in want}
    total, weight = sum(size.values()), {"s0": 5, "s1": 2, "s2": 1}
    words = {s: sum(size[r.doc_id] for r in mixed if r.source == s) for s in weight}
    for s, w in weight.items():  # whole documents: within the longest one
        own = sum(n for i, n in size.items() if f"s{i % 3}" == s)
        assert abs(words[s] - min(3 * own, total * w / 8)) <= max(size.values()) or words[s] >= total * w / 8


def test_run_gives_the_librarys_ids(spark, folder):
    sp = spm.SentencePieceProcessor(model_proto=file_bytes(tokenizer_file("piece_bpe_32k.model")))
    rows = cp.run(spark, folder).collect()
    texts = _texts()
    assert len(rows) > 50
    for r in rows:
        text = texts[r.doc_id]
        if any(base_secrets(text).values()):
            continue
        ids = sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.n_tokens == len(ids) and r.round_trip


def test_other_columns_and_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id between 4 and 30").withColumns(
        {c: F.lit("x") for c in ("row", "rid", "fp", "spans", "kept", "key", "size", "taken")})
    empty = docs_frame(spark, [])
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, empty, folder).collect() == []
    assert cp.STAGES[-1][1](spark, empty, folder).collect() == []
