"""Quality rules: text measures and a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word and character
n-grams (shares of a text's words, word pairs and character 4-grams), fitted
on labelled quality rows and calibrated by a second, one-dimensional logistic
regression on rows held back from the first (Platt scaling).  Texts are scored
in Arrow batches against a fixed threshold.

``SAMPLE`` bounds the labelled rows per class that are fitted on: those with
the smallest hash of their id, whatever the size of the table.  Both regressions
weight them by their class's labelled rows over those sampled, so that a
probability means the same at every size.  Everything else reads every row and
whole texts.

Defined cases: a null text counts as empty (no words, so it fails the base
rules); without labels of both classes nothing is rejected beyond the base
rules; texts of any length are read whole; a probability of just the threshold
keeps its text; repeated rows get equal results; an empty table gives an empty
result; all input columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.llm.common import materialize, text_or_empty

#: Labelled rows fitted on, per class.
SAMPLE = 1500
#: Hash buckets of each of the three n-gram groups, as a power of two.
HASH_BITS = 15
GROUPS = 3
#: A text is rejected below this probability of good quality.
THRESHOLD = 0.6
#: Penalties of the weights and of the calibration line.
PENALTY, LINE_PENALTY = 1e-4, 1e-3
#: Words kept with their hash, per worker.
CACHE_WORDS = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = " \t\n\x0b\x0c\r"


class _Hashes(dict):
    """crc32 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = crc32(word)
        return h


_HASHES = _Hashes()


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h * _MIX >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def gram_buckets(raw: bytes, words: list[bytes]) -> list[np.ndarray]:
    """Hash buckets of the words, word pairs and character 4-grams of a text."""
    own = np.array([_HASHES[w] for w in words], dtype=np.uint64)
    pairs = own[:-1] * np.uint64(31) + own[1:] + np.uint64(1)
    if len(own) > 1:  # a word said twice is one and the same pair
        pairs = np.where(own[:-1] == own[1:], np.uint64(7), pairs)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    grams = b[:-3] | b[1:-2] << np.uint64(8) | b[2:-1] << np.uint64(16) | b[3:] << np.uint64(24) \
        if len(b) > 3 else b[:0]
    return [_bucket(own), _bucket(pairs), _bucket(grams)]


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside a ``window``-word sequence that the text has at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    own = np.array([number[w] for w in words], dtype=np.int64)
    key = own[:n]
    for k in range(1, window):
        if k > 1:  # keep the numbers small: pairs are numbered anew
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(number) + own[k:n + k]
    _, where, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[where] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(window):
        covered[k:n + k] |= twice
    return int(covered.sum())


def measures(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines: dict[str, int] = {}
    for line in text.split("\n"):
        lines[line] = lines.get(line, 0) + 1
    again = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(_SPACE))
    return (len(words), len(text) - sum(map(text.count, _SPACE)),
            sum(map(text.count, "#*$%&|<>")), again, repeated_words(words))


@dataclass(frozen=True)
class Model:
    """Weights per group and bucket, and the calibration line of the margin."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, groups: list[np.ndarray]) -> float:
        return self.bias + sum(float(w[g].mean()) for w, g in zip(self.weights, groups) if len(g))

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measured(text: Column, model: Model | None) -> Column:
    """Struct of the measures and ``good``, the calibrated probability (null
    without a model)."""
    @F.arrow_udf(f"struct<{MEASURES.replace(' long', ':bigint')},good:double>")
    def of(texts: pa.Array) -> pa.Array:
        out, good = [], []
        for text, raw in zip(texts.to_pylist(), pc.cast(texts, pa.binary()).to_pylist()):
            words = raw.split()  # of bytes: at 0x20 and 0x09-0x0D
            out.append(measures(text, words))
            good.append(None if model is None else
                        model.probability(model.margin(gram_buckets(raw, words))))
        names = [m.split()[0] for m in MEASURES.split(", ")]
        cols = list(zip(*out)) if out else [[]] * len(names)
        return pa.StructArray.from_arrays(
            [*[pa.array(c, pa.int64()) for c in cols], pa.array(good, pa.float64())], [*names, "good"])
    return of(text)


# ------------------------------------------------------------------------ fitting
def labelled_rows(labels: DataFrame, label: str) -> DataFrame:
    """(id, label) of the labelled rows, each once."""
    return labels.select(qcol("doc_id").alias("id"), qcol(label).cast("int").alias("label")) \
        .where("id is not null and label in (0, 1)").distinct()


def class_weights(labels: DataFrame, label: str, per_class: int) -> Column:
    """A sampled row's weight: labelled rows of its class for each one sampled."""
    counts = labelled_rows(labels, label).groupBy("label").count().collect()
    weight = F.lit(1.0)
    for r in counts:
        weight = F.when(F.col("label") == r["label"], max(1.0, r["count"] / per_class)).otherwise(weight)
    return weight


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                    id_col: str = "doc_id", text_col: str = "text", only: Column | None = None) -> DataFrame:
    """(id, text, label) of at most ``per_class`` labelled rows of each class,
    those with the smallest hash of their id.  ``only`` selects label rows."""
    own = labelled_rows(labels, label)
    own = own if only is None else own.where(only)
    picked = None
    for value in (0, 1):
        some = own.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = some if picked is None else picked.union(some)
    texts = docs.select(qcol(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return materialize(texts.join(picked, "id"))


@F.udf(VectorUDT())
def _features(raw):
    """Shares of the n-grams of a text, group after group."""
    raw = bytes(raw)
    values: dict[int, float] = {}
    for g, found in enumerate(gram_buckets(raw, raw.split())):
        at, n = np.unique(found, return_counts=True)
        values.update(zip((at + (g << HASH_BITS)).tolist(), (n * (SCALE / max(1, len(found)))).tolist()))
    return SparseVector(GROUPS << HASH_BITS, values)


#: Shares are multiplied by this for fitting, to be in the range of the penalty.
SCALE = 20.0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The classifier of ``label`` = 1; none without rows of both classes."""
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    held = F.pmod(F.xxhash64(F.lit("held"), "id"), F.lit(4)) == 0
    rows = materialize(sample.select("label", held.alias("held"),
                                     class_weights(labels, label, per_class).alias("weight"),
                                     _features(F.encode("text", "UTF-8")).alias("features")))
    sizes = {(r.held, r.label) for r in rows.select("held", "label").distinct().collect()}
    if {(False, 0), (False, 1)} - sizes:
        return None
    fitted = LogisticRegression(labelCol="label", weightCol="weight", maxIter=100, regParam=PENALTY, standardization=False) \
        .fit(rows.where("not held"))
    weights = fitted.coefficients.toArray().reshape(GROUPS, -1) * SCALE
    slope, offset = 1.0, 0.0
    if not {(True, 0), (True, 1)} - sizes:
        @F.udf(VectorUDT())
        def margin(v):
            return Vectors.dense(float(fitted_weights[v.indices] @ v.values) + bias)
        fitted_weights, bias = fitted.coefficients.toArray(), float(fitted.intercept)
        line = LogisticRegression(labelCol="label", weightCol="weight", maxIter=100, regParam=LINE_PENALTY, standardization=False) \
            .fit(rows.where("held").select("label", "weight", margin("features").alias("features")))
        slope, offset = float(line.coefficients[0]), float(line.intercept)
    return Model(weights.astype(np.float32), float(fitted.intercept), slope, offset)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns of ``docs``), the measures, ``good``, ``base_failed`` and ``kept``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    found = docs.select(F.struct("*").alias("row"), measured(text_or_empty(text_col), model).alias("m")) \
        .select("row", "m.*")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.coalesce("good", F.lit(1.0)) >= threshold))
