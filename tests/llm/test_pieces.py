"""SentencePiece operator against the library itself."""

import random

import numpy as np
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F

from llm.helpers import docs_frame, sha, write_docs
from tabulon.llm import pieces
from tabulon.llm.queries import QUERIES, file_bytes, tokenizer_file


@pytest.fixture(scope="module")
def model():
    return file_bytes(tokenizer_file("piece_bpe_32k.model"))


def _texts():
    rng = random.Random(2)
    parts = ["the", " ", "  ", "   ", "Ünïcode", "\n", "\t", "▁", "▁▁", "<s>", "</s>", "<unk>", "<0x41>", "😀", "日本語",
             "é", " ", "x" * 70, "12.5", "\x00", "'s", "ſ", "‍", "𝒳", "中 文"]
    texts = [None, "", " ", "  ", "a", " a ", "▁", "word " * 20000, "y" * 30000]
    return texts + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]


def test_query_matches_the_library(spark, tmp_path, model):
    sp = spm.SentencePieceProcessor(model_proto=model)
    texts = _texts()
    rows = QUERIES["op3_sentencepiece"](spark, write_docs(spark, tmp_path / "d", texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(np.array(ids, dtype="<u4").tobytes())
        assert r.decoded_sha256 == sha(sp.decode(ids))


def test_words_are_encoded_apart_for_this_model(model):
    assert pieces.Encoder(model).by_word


def test_bounds_follow_the_librarys_offsets(model):
    sp = spm.SentencePieceProcessor(model_proto=model)
    encoder = pieces.Encoder(model)
    for text in _texts():
        text = text or ""
        ids = np.frombuffer(encoder.ids(text), dtype="<u4")
        bounds = encoder.bounds(text, ids)
        source = text.encode()
        assert len(bounds) == len(ids) + 1
        assert b"".join(source[a:b] for a, b in zip(bounds, bounds[1:])) == source
        for n, (i, a, b) in enumerate(zip(ids.tolist(), bounds, bounds[1:])):
            piece = sp.id_to_piece(i)
            if encoder.length[i] == 1 and piece.startswith("<0x"):
                continue
            if i in (sp.bos_id(), sp.eos_id()):
                assert a == b
            else:
                got = source[a:b].decode().replace(" ", "▁")
                assert piece == got or (n == 1 and piece == "▁" + got)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_compiled_character_map(rule):
    lib = spm.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True,
                                      remove_extra_whitespaces=True)
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(lib.serialized_model_proto())
    own = pieces.Normalizer(pieces.CharacterMap(proto.normalizer_spec.precompiled_charsmap), True, True)
    for text in ["", "  a  b ", "ＡＢＣ ①②", "ﬁne ½ ㍿", "é Å", "tab\tnew\nline", "ｶﾞ", "x　y", "Straße İ"]:
        got, align = own(text.encode())
        assert got.decode() == lib.normalize(text)
        assert len(align) == len(got) + 1 and (np.diff(align.astype(int)) >= 0).all()
    got, align = own("ＡＢ".encode())
    assert got.decode() == ("▁ab" if rule.endswith("cf") else "▁AB")
    assert align.tolist() == [0, 0, 0, 0, 3, 6]


def test_empty_table_and_clashing_columns(spark, model):
    docs = docs_frame(spark, []).withColumns({c: F.lit("x") for c in ("ids", "bounds", "decoded")})
    assert docs.select("*", pieces.encoded(F.col("text"), model).alias("e")).collect() == []
