"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from llm.helpers import docs_frame, write_docs
from tabulon.llm import spelling
from tabulon.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def vocabulary(texts):
    words = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], 0)) for w, n in words.items())


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def _texts():
    rng = random.Random(21)
    base = ["stones", "rivers", "étoile", "stünden", "abcde", "ÀÉîõü", "aaaaaa", "letters×", "x" * 3000]
    words = []
    for w in base:
        words += [w] * 12
        for _ in range(6):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1:], w[:i] + "é" + w[i:], w[:i] + "z" + w[i + 1:]])] * rng.randrange(2, 7)
    words += ["".join(rng.choice("abÿ") for _ in range(rng.randrange(4, 8))) for _ in range(2500)]
    rng.shuffle(words)
    texts = [" ".join(rng.choice([str.upper, str, str.title])(w) for w in words[i:i + 70]) for i in range(0, len(words), 70)]
    return texts + [None, "", "日本語 12 _ 𝔸bcde", "-".join(words), texts[0], texts[0]]


def test_query_equals_all_pairs(spark, tmp_path):
    texts = _texts()
    folder = write_docs(spark, tmp_path / "d", texts)
    want = brute(vocabulary(list(enumerate(texts))))
    assert got(QUERIES["op13_spelling_variants"](spark, folder)) == want
    assert sum(1 for r in want if r[1]) > 100 and any(r[1] and r[1] != r[2] for r in want)


def test_long_lists_are_divided_without_loss(spark, monkeypatch):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 10))) for _ in range(600)}
    words |= {"common" + "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 6))) for _ in range(300)}
    counted = {w: rng.randrange(1, 40) for w in words}
    vocab = spark.createDataFrame([(w.encode(), n) for w, n in counted.items()], "word binary, n long")
    monkeypatch.setattr(spelling, "QUERIES_AT_ONCE", 7)
    for most in (20_000, 40, 5):
        monkeypatch.setattr(spelling, "LIST", most)
        assert got(spelling.variants(vocab)) == brute(counted)


def test_roots_of_a_long_chain(spark):
    chain = {"a" * i + "b" * (40 - i): 2 ** i for i in range(20)}
    vocab = spark.createDataFrame([(w.encode(), n) for w, n in chain.items()], "word binary, n long")
    rows = {r.word: r for r in spelling.variants(vocab).collect()}
    last = "a" * 19 + "b" * 21
    assert {r.root for r in rows.values()} == {last} and rows[last].form is None


def test_empty_table_null_ids_and_clashing_columns(spark):
    assert spelling.variants(spelling.vocabulary(docs_frame(spark, []))).collect() == []
    docs = docs_frame(spark, ["seven seven seven", None], ids=[None, 3]).withColumns(
        {c: F.lit("x") for c in ("word", "n", "id", "key", "bucket", "core")})
    rows = spelling.variants(spelling.vocabulary(docs)).collect()
    assert [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows] == [("seven", None, "seven", 3, 0, None)]
