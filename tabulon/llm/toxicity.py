"""Toxic spans by a linear-chain conditional random field.

Two tags per word.  A word's evidence is the sum of learned weights of its
hashed features (the word itself and its first letters, lower-cased, without
punctuation); neighbouring tags are tied by learned transitions.  Training
words get their tags from the labelled documents: a word of a toxic document is
tagged where one of its features is found in toxic documents almost only.
Weights are fitted by gradient ascent on the tags' likelihood.

Forward-backward marginals are exact over whole texts.  All words of a batch
form one chain with a fresh start at each document; the chain is cut into equal
lanes, whose transfer matrices are multiplied up side by side, so the work is
a few array operations per place in a lane.  Spans with a marginal of
``SPAN`` or more are the offending offsets; a document's score is the sum of
their marginals, calibrated by a logistic curve.

``SAMPLE`` bounds the labelled documents per class that are fitted on (smallest
hash of the id); bias, weights and calibration count each for its class's labelled rows over
those sampled, so a score means the same at every size.  Scoring reads every row.

Defined cases: a null or empty text has no words and gets the score of zero
toxic words; without training rows of both classes every score is 0; texts of any
length are read whole; a score of just the threshold counts as toxic; all input
columns are kept in ``row``, whatever their names; repeated
rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import text_or_empty
from tabulon.llm.quality import labelled_rows, labelled_sample

#: Labelled documents fitted on, per class.
SAMPLE = 1500
#: Hash buckets of the word features, as a power of two.
HASH_BITS = 20
#: First letters of a word that are a feature beside the word.
PREFIXES = (4, 5, 6)
#: A feature marks training words if toxic documents have this share of its
#: uses, were both classes alike in size, with this gain in log-likelihood.
MIN_SHARE, MIN_GAIN = 0.95, 10.0
#: Marginal from which a word is an offending span; score from which a document is toxic.
SPAN, PREDICTED = 0.5, 0.3
#: Gradient steps and their length.
STEPS, RATE = 30, 0.5
#: Words kept with their evidence, per worker.
CACHE_WORDS = 300_000

_EDGES = b" \t.,;:!?\"'()[]{}<>*_-\xc2\xbf\xa1"


def features(word: bytes) -> list[int]:
    """Hash buckets of the features of a word."""
    core = word.strip(_EDGES).decode("utf-8", "ignore").lower()
    kinds = [core] + [f"{core[:n]}*" for n in PREFIXES]
    return [crc32(k.encode()) >> (32 - HASH_BITS) for k in kinds] if core else []


# ------------------------------------------------------------ forward-backward
def _ratios(evidence: np.ndarray, first: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For each place of the chain the ratio of the forward messages of tag 1
    and tag 0.  ``first`` marks the places where a chain begins anew; ``step``
    is the 2 x 2 matrix of transition factors."""
    n = len(evidence)
    if not n:
        return np.zeros(0)
    width = max(1, int(np.sqrt(n)))
    lanes = -(-n // width)
    pad = lanes * width - n
    e = np.exp(np.pad(evidence, (0, pad))).reshape(lanes, width)
    new = np.pad(first, (0, pad)).reshape(lanes, width)
    # transfer of a lane: [[a, b], [c, d]] on (message 0, message 1)
    a, b, c, d = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for k in range(width):
        fresh, x = new[:, k], e[:, k]
        s0, s1 = a + c, b + d
        a, b, c, d = (np.where(fresh, s0, step[0, 0] * a + step[1, 0] * c),
                      np.where(fresh, s1, step[0, 0] * b + step[1, 0] * d),
                      x * np.where(fresh, s0, step[0, 1] * a + step[1, 1] * c),
                      x * np.where(fresh, s1, step[0, 1] * b + step[1, 1] * d))
        top = a + b + c + d
        a, b, c, d = a / top, b / top, c / top, d / top
    enter = np.empty(lanes)
    r = 1.0
    for i in range(lanes):
        enter[i] = r
        r = (c[i] + d[i] * r) / (a[i] + b[i] * r)
    out = np.empty((lanes, width))
    r = enter
    for k in range(width):
        r = e[:, k] * np.where(new[:, k], 1.0, (step[0, 1] + step[1, 1] * r) / (step[0, 0] + step[1, 0] * r))
        out[:, k] = r
    return out.reshape(-1)[:n]


def marginals(evidence: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, ...]:
    """Probability of tag 1 at each place; also the forward and backward ratios."""
    evidence = np.clip(evidence, -30, 30)
    forward = _ratios(evidence, first, step)
    last = np.append(first[1:], True)
    # backward over the reversed chain; it includes the place's own evidence, taken off again
    with_own = _ratios(evidence[::-1], last[::-1], step.T)[::-1]
    backward = with_own * np.exp(-evidence)
    odds = forward * backward
    return odds / (1 + odds), forward, with_own


@dataclass
class Tagger:
    """Weights per feature bucket, bias, transitions and the calibration."""

    weights: np.ndarray
    bias: float
    step: np.ndarray
    slope: float
    offset: float
    known: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def evidence(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.bias + float(self.weights[features(w)].sum())
        return np.array([known[w] for w in words])

    def marginals(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        sizes = [len(t) for t in texts]
        ends = np.cumsum(sizes)
        first = np.zeros(int(ends[-1]) if sizes else 0, dtype=bool)
        first[(ends - sizes)[np.array(sizes) > 0]] = True
        u = np.concatenate([self.evidence(t) for t in texts]) if len(first) else np.zeros(0)
        return np.split(marginals(u, first, self.step)[0], ends[:-1])

    def score(self, toxic_words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * measure(toxic_words) + self.offset)))


def measure(toxic_words: np.ndarray) -> np.ndarray:
    """What the score is a logistic curve of: none, one and several toxic words lie
    about equally far apart."""
    return np.log(toxic_words + 0.5)


def offending(p: np.ndarray) -> float:
    """Expected number of toxic words among the offending spans."""
    return float(p[p >= SPAN].sum())


# ------------------------------------------------------------------------ fitting
def fit(docs: DataFrame, labels: DataFrame, only: Column | None = None, label: str = "toxic",
        per_class: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """The tagger of ``label`` from a bounded sample of the labelled rows that
    ``only`` selects (a condition on ``id``); none without both classes."""
    sample = labelled_sample(docs, labels, label, per_class, id_col, text_col, only)
    rows = sample.orderBy("id").select(F.encode("text", "UTF-8").alias("raw"), "label").collect()
    texts = [bytes(r.raw).split() for r in rows]
    toxic = np.array([r.label for r in rows], dtype=bool)
    if toxic.all() or not toxic.any():
        return None
    own = labelled_rows(labels, label)
    counts = {r["label"]: r["count"] for r in (own if only is None else own.where(only)).groupBy("label").count().collect()}
    shares = np.array([max(1.0, counts.get(v, 0) / per_class) for v in (0, 1)])
    return fit_texts(texts, toxic, shares[toxic.astype(int)])


def fit_texts(texts: list[list[bytes]], toxic: np.ndarray, weight: np.ndarray | None = None) -> Tagger:
    """``weight``: the labelled rows that each text stands for."""
    weight = np.ones(len(texts)) if weight is None else weight
    held = np.arange(len(texts)) % 5 == 4  # for the calibration
    used = [t for t, h in zip(texts, held) if not h]
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for t in used for w in t), dtype=np.int64)
    sizes = np.array([len(t) for t in used], dtype=np.int64)
    kinds = np.full((len(number), 1 + len(PREFIXES)), -1, dtype=np.int64)
    for w, n in number.items():
        found = features(w)
        kinds[n, :len(found)] = found
    in_toxic, stands = np.repeat(toxic[~held], sizes), np.repeat(weight[~held], sizes)
    marked = _marking(word, sizes, in_toxic, kinds)
    owner, column = np.nonzero(kinds >= 0)
    flat = kinds[owner, column]
    tagged_word = ((kinds >= 0) & marked[kinds]).any(axis=1)
    tag = tagged_word[word] & in_toxic
    first = np.zeros(len(word), dtype=bool)
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    inner = np.flatnonzero(~first)  # places with a word before them
    inner = inner[inner > 0]

    weights, trans = np.zeros(1 << HASH_BITS), np.zeros((2, 2))
    bias = float(np.log(max(1, stands[tag].sum()) / max(1, stands[~tag].sum())))
    seen, seen_t, seen_b = np.full(1 << HASH_BITS, 1e-6), np.full((2, 2), 1e-6), 1e-6
    actual = np.bincount(tag[inner - 1] * 2 + tag[inner], stands[inner], minlength=4).reshape(2, 2)
    for _ in range(STEPS):  # gradient ascent with per-weight step lengths
        by_word = np.bincount(owner, weights[flat], minlength=len(number)) + bias
        u, step = by_word[word], np.exp(trans)
        p, forward, backward = marginals(u, first, step)
        pair = step[None] * np.stack([np.ones(len(inner)), forward[inner - 1]], 1)[:, :, None] \
            * np.stack([np.ones(len(inner)), backward[inner]], 1)[:, None, :]
        expected = (pair * (stands[inner] / pair.sum((1, 2)))[:, None, None]).sum(0)
        miss = np.bincount(word, (tag - p) * stands, minlength=len(number))
        g = np.bincount(flat, miss[owner], minlength=1 << HASH_BITS) - 0.01 * weights
        gt, gb = actual - expected - 0.1 * trans, float(miss.sum())
        seen += g * g
        seen_t += gt * gt
        seen_b += gb * gb
        weights += RATE * g / np.sqrt(seen)
        trans += 0.2 * gt / np.sqrt(seen_t)
        bias += 0.2 * gb / np.sqrt(seen_b)
    tagger = Tagger(weights.astype(np.float32), bias, np.exp(trans), 1.0, 0.0)
    rest = [t for t, h in zip(texts, held) if h] or texts
    truth, stands = (toxic[held], weight[held]) if held.any() else (toxic, weight)
    if truth.all() or not truth.any():
        rest, truth, stands = texts, toxic, weight
    found = np.array([offending(m) for m in tagger.marginals(rest)])
    tagger.slope, tagger.offset = _calibrate(measure(found), truth, stands)
    return tagger


def _marking(word: np.ndarray, sizes: np.ndarray, in_toxic: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Mask of the features found in toxic documents almost only, by a likelihood
    ratio.  Uses are counted by different neighbours, so copies count once."""
    before, after = np.append(0, word[:-1] + 1), np.append(word[1:] + 1, 0)
    ends = np.cumsum(sizes)[sizes > 0]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    after[ends - 1] = 0
    beside = (before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
              + after.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(HASH_BITS)

    def uses(of: np.ndarray) -> np.ndarray:
        key = np.concatenate([kinds[word[of], c].astype(np.uint64) << np.uint64(64 - HASH_BITS) | beside[of]
                              for c in range(kinds.shape[1])])
        key = np.unique(key[np.concatenate([kinds[word[of], c] >= 0 for c in range(kinds.shape[1])])])
        return np.bincount((key >> np.uint64(64 - HASH_BITS)).astype(np.int64), minlength=1 << HASH_BITS)

    n, m = uses(in_toxic).astype(float), uses(~in_toxic).astype(float)
    base = n.sum() / max(1.0, n.sum() + m.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        share = n / (n + m)
        gain = n * np.log(share / base) + np.where(m > 0, m * np.log((1 - share) / (1 - base)), 0.0)
        even = share / base / (share / base + (1 - share) / (1 - base))
        return (n > 0) & (gain >= MIN_GAIN) & (even >= MIN_SHARE)


def _calibrate(x: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve of ``truth`` over ``x`` (Newton
    steps with a small penalty)."""
    design = np.stack([x, np.ones(len(x))], 1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        grad = design.T @ (weight * (truth - p)) - 0.05 * at
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        move = np.linalg.solve(curve, grad)
        at = at + np.clip(move, -2, 2)
    return float(at[0]), float(at[1])


# ------------------------------------------------------------------------ scoring
def scored(text: Column, tagger: Tagger | None) -> Column:
    """Struct of ``score`` and ``spans`` (offending ``start:end`` in code points,
    comma-joined)."""
    @F.arrow_udf("struct<score:double,spans:string>")
    def of(texts: pa.Array) -> pa.Array:
        scores, spans = [], []
        rows = pc.cast(texts, pa.binary()).to_pylist()
        if tagger is None:
            scores, spans = [0.0] * len(rows), [""] * len(rows)
        else:
            found = tagger.marginals([r.split() for r in rows]) if rows else []
            scores = tagger.score(np.array([offending(m) for m in found])).tolist() if rows else []
            spans = [",".join(offsets(r, np.flatnonzero(m >= SPAN))) for r, m in zip(rows, found)]
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(spans, pa.string())], ["score", "spans"])
    return of(text)


def offsets(raw: bytes, places: np.ndarray) -> list[str]:
    """``start:end`` in code points of the words at ``places``."""
    if not len(places):
        return []
    wanted, out = set(places.tolist()), []
    words = re.finditer(r"[^\x20\x09-\x0D]+", raw.decode())
    for i, m in enumerate(words):
        if i in wanted:
            out.append(f"{m.start()}:{m.end()}")
    return out


def toxic_documents(docs: DataFrame, labels: DataFrame, only: Column | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``score``, ``predicted`` and ``spans``."""
    tagger = fit(docs, labels, only, id_col=id_col, text_col=text_col)
    found = docs.select(F.struct("*").alias("row"), scored(text_or_empty(text_col), tagger).alias("s"))
    return found.select("row", "s.score", F.when(F.col("s.score") >= PREDICTED, 1).otherwise(0)
                        .alias("predicted"), "s.spans")
