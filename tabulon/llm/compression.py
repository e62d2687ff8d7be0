"""Quality by compression: dictionaries of good and of bad text.

Two zstandard dictionaries are built from blocks of labelled good and bad
texts.  A text is cut into blocks of ``BLOCK`` bytes, every block is compressed on
its own with either dictionary (so that a long text does not become its own
dictionary), and the difference of the two sizes, over the text's bytes, is the
measure.  A logistic line fitted on labelled rows that the dictionaries have not
seen turns it into a probability of label 1.

Bounds of the fit: ``ROWS`` labelled rows of each class for the dictionaries and
``HELD`` for the line, those with the smallest hash of their id; of the former's blocks
the ``BLOCKS`` different ones of smallest hash.  The line weights a class by its labelled
rows over those sampled, so a probability means the same at every size.
Every text is scored whole.

Defined cases: a null text counts as empty, and an empty text's difference is 0; very
long texts are scored block after block; without labels of both classes every
score is the share of label 1 (0.5 without any label); ties at a threshold are
up to the caller; repeated rows get equal results; an empty table gives an empty
result; columns of the documents pass through inside ``row``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.llm.common import materialize, text_or_empty

#: Bytes compressed at once.
BLOCK = 1024
#: Labelled rows per class that the dictionaries, and the line, may come from.
ROWS, HELD = 2000, 1000
#: Blocks per class in a dictionary's sample.
BLOCKS = 6000
#: Bytes of a dictionary.
DICTIONARY = 64 << 10
LEVEL = 3


def dictionary(blocks: list[bytes], size: int = DICTIONARY, level: int = LEVEL) -> bytes:
    """A trained dictionary of the blocks; too few to train on serve as they are."""
    try:
        return zstandard.train_dictionary(size, blocks, level=level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


class Sizes:
    """Compressed sizes with two dictionaries; compressors are made once a worker."""

    def __init__(self, bad: bytes, good: bytes, block: int = BLOCK, level: int = LEVEL):
        self.dictionaries, self.block, self.level = (bad, good), block, level
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def _compressors(self):
        if self.made is None:
            self.made = []
            for raw in self.dictionaries:
                own = zstandard.ZstdCompressionDict(raw)
                if raw:
                    own.precompute_compress(level=self.level)
                self.made.append(zstandard.ZstdCompressor(
                    level=self.level, dict_data=own if raw else None, write_checksum=False,
                    write_content_size=False, write_dict_id=False).compress)
        return self.made

    def difference(self, raw: bytes) -> float:
        """(size with the bad dictionary - with the good one) / bytes, of all blocks."""
        bad, good = self._compressors()
        more = 0
        for i in range(0, len(raw), self.block):
            part = raw[i:i + self.block]
            more += len(bad(part)) - len(good(part))
        return more / len(raw) if raw else 0.0

    def column(self, text: Column) -> Column:
        @F.arrow_udf("double")
        def of(texts: pa.Array) -> pa.Array:
            raws = pc.cast(texts, pa.binary()).to_pylist()
            return pa.array([self.difference(r) for r in raws], pa.float64())
        return of(text)


@dataclass(frozen=True)
class Model:
    """Sizes (none without both classes) and the line of the difference."""

    sizes: Sizes | None
    slope: float
    offset: float

    def score(self, difference: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * difference + F.lit(self.offset))))


def line(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression in one variable, by Newton steps."""
    scale = float(np.sqrt(np.average(x * x, weights=weight))) or 1.0
    rows = np.stack([x / scale, np.ones_like(x)], axis=1)
    weight = weight / weight.sum()
    at = np.zeros(2)

    def loss(a):
        m = rows @ a
        return float(weight @ (np.logaddexp(0, m) - y * m)) + penalty / 2 * a[0] ** 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-rows @ at))
        slope = rows.T @ (weight * (p - y)) + penalty * np.array([at[0], 0.0])
        bend = (rows * (weight * p * (1 - p))[:, None]).T @ rows + np.diag([penalty, 1e-9])
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0] / scale), float(at[1])


def _labelled(labels: DataFrame, label: str, only: Column | None) -> DataFrame:
    own = labels.select(qcol("doc_id").alias("id"), qcol(label).cast("int").alias("label")) \
        .where("id is not null and label in (0, 1)").distinct()
    own = own if only is None else own.where(only)
    return own.withColumn("held", F.pmod(F.xxhash64(F.lit("line"), "id"), F.lit(4)) == 0)


def _picked(own: DataFrame, held: bool, per_class: int) -> DataFrame:
    some = [own.where((F.col("held") == held) & (F.col("label") == v)).orderBy(F.xxhash64("id"), "id")
            .limit(per_class) for v in (0, 1)]
    return some[0].union(some[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", only: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``only`` (over ``id``) selects the labelled rows that may be learnt from."""
    own = materialize(_labelled(labels, label, only))
    counts = {(r["held"], r["label"]): r["count"] for r in own.groupBy("held", "label").count().collect()}
    ones = sum(c for (_, v), c in counts.items() if v)
    share = ones / sum(counts.values()) if counts else 0.5
    flat = Model(None, 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if {(False, 0), (False, 1)} - set(counts):
        return flat
    picked = materialize(_picked(own, False, ROWS).union(_picked(own, True, HELD)))
    texts = docs.select(qcol(id_col).alias("id"), F.encode(text_or_empty(text_col), "UTF-8").alias("raw"))
    found = texts.join(F.broadcast(picked), "id")  # at most 2 * (ROWS + HELD) rows
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / BLOCK).cast("int")),
                      lambda i: F.substring("raw", i * BLOCK + 1, F.lit(BLOCK)))
    blocks = materialize(found.where("not held and octet_length(raw) > 0")
                         .select("label", F.explode(cut).alias("block")).distinct())
    made = []
    for value in (0, 1):
        rows = blocks.where(F.col("label") == value).orderBy(F.xxhash64("block"), "block").limit(BLOCKS)
        made.append(dictionary([bytes(r["block"]) for r in rows.select("block").collect()]))
    sizes = Sizes(*made)
    held = found.where("held").select("label", "id", sizes.column(F.col("raw")).alias("x")) \
        .groupBy("id", "label").agg(F.min("x").alias("x")).select("label", "x").collect()
    if len({r["label"] for r in held}) < 2:
        return Model(sizes, 100.0, flat.offset)
    weights = {v: max(1.0, counts[True, v] / HELD) for v in (0, 1)}
    return Model(sizes, *line(np.array([r["x"] for r in held]), np.array([r["label"] for r in held], dtype=float),
                              np.array([weights[r["label"]] for r in held])))


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", only: Column | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``difference`` and ``score``."""
    model = fit(docs, labels, label, only, id_col, text_col)
    size = model.sizes.column(text_or_empty(text_col)) if model.sizes else F.lit(0.0)
    return docs.select(F.struct("*").alias("row"), size.alias("difference")) \
        .withColumn("score", model.score(F.col("difference")))
