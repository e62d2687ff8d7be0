"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has bit i set if more than half of its word shingles'
XXH64 values (seed 42) have it.  Fingerprints within ``radius`` bits are
linked; linked fingerprints form components.

* Equal fingerprints collapse first (map-side), so copies cost one row.
* Two fingerprints within ``radius`` bits agree on all but ``radius`` of
  ``radius + 2`` bit blocks, hence on some pair of blocks: each fingerprint
  goes into one table per pair, keyed by the pair's bits.
* In a bucket the fingerprints are stored vertically, one bit plane per bit
  position, 64 fingerprints to a word.  Shifting the planes by d compares every
  member with its d-th successor at once; carry-save counters add the 64
  difference planes bit-sliced, and words whose distances all exceed the
  radius are abandoned.
* A bucket beyond ``CELL`` members is dealt over pairs of its parts, so no
  task holds more than two parts.  A bucket yields a spanning forest of its
  links, never all pairs.

Defined cases: a null or blank text has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle; texts of any length are read
whole; the component id is the
smallest non-null id of the component (null if all are null); repeated rows
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.llm.common import bound_batches, materialize, text_or_empty
from tabulon.llm.components import components

BITS = 64
#: Members of one part of a bucket; a cell holds two parts.
CELL = 4096


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of UTF-8 ``text`` as an unsigned number."""
    from xxhash import xxh64_intdigest
    words = text.lower().split()  # of bytes: A-Z, and blanks 0x20, 0x09-0x0D
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.array([xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    bits = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int) -> Column:
    """Fingerprint column (signed 64-bit) of a text column."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = [fingerprint(t, shingle) for t in pc.cast(texts, pa.binary()).to_pylist()]
        return pa.array(np.array(found, dtype=np.uint64).view(np.int64))
    return of(text)


# ------------------------------------------------------- bit-sliced comparison
def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values: row b, bit i of the packed row = bit b of value i."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    pad = (-packed.shape[1]) % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, pad)))).view("<u8")


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Planes with value i + d at place i (zero beyond the end)."""
    words, bits = divmod(d, 64)
    out = np.zeros_like(planes)
    n = planes.shape[1] - words
    if n > 0:
        out[:, :n] = planes[:, words:] >> np.uint64(bits)
        if bits and n > 1:
            out[:, :n - 1] |= planes[:, words + 1:] << np.uint64(64 - bits)
    return out


def links_at(planes: np.ndarray, d: int, same: np.ndarray, radius: int) -> np.ndarray:
    """Places i where value i and value i + d differ in at most ``radius`` bits.
    ``same``: packed mask of the places whose pair is in one bucket."""
    alive = np.flatnonzero(same)
    if not len(alive):
        return alive
    span = slice(alive[0], alive[-1] + 1)
    other = _shifted(planes[:, span.start:span.stop + (d // 64) + 1], d)[:, :span.stop - span.start]
    diff = planes[:, span] ^ other
    alive = alive - span.start
    width = max(1, radius.bit_length() + 1)
    counter = np.zeros((width, len(alive)), dtype=np.uint64)
    over = ~same[span][alive]
    for start in range(0, BITS, 8):
        for b in range(start, start + 8):
            carry = diff[b, alive]
            for k in range(width):  # carry-save: add one plane to all counters
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
        over |= _exceeds(counter, radius)
        keep = over != ~np.uint64(0)
        if not keep.any():
            return np.zeros(0, dtype=np.int64)
        if not keep.all():  # abandon words of which every distance exceeds the radius
            alive, counter, over = alive[keep], counter[:, keep], over[keep]
    near = np.unpackbits(np.ascontiguousarray(~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(near)
    return (alive[word] + span.start) * 64 + bit


def _exceeds(counter: np.ndarray, radius: int) -> np.ndarray:
    """Mask of the lanes whose counter is above ``radius`` (bitwise comparison)."""
    above = np.zeros(counter.shape[1], dtype=np.uint64)
    equal = ~np.zeros(counter.shape[1], dtype=np.uint64)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            equal = equal & counter[k]
        else:
            above = above | (equal & counter[k])
            equal = equal & ~counter[k]
    return above


def bucket_links(values: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """A spanning forest of the links inside the buckets, as pairs of places.
    ``bucket`` numbers are ascending."""
    n = len(values)
    _, start, size = np.unique(bucket, return_index=True, return_counts=True)
    planes = planes_of(values)
    end = np.repeat(start + size, size)
    root = np.arange(n)
    kept = []
    for d in range(1, int(size.max(initial=1))):
        same = np.packbits(np.arange(n) + d < end, bitorder="little")
        same = np.pad(same, (0, planes.shape[1] * 8 - len(same))).view("<u8")
        at = links_at(planes, d, same, radius)
        at = at[root[at] != root[at + d]]
        if not len(at):
            continue
        parent = root.tolist()

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a in at.tolist():
            x, y = find(a), find(a + d)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((a, a + d))
        root = np.array(parent)
        while (root[root] != root).any():
            root = root[root]
    return np.array(kept, dtype=np.int64).reshape(-1, 2)


def block_masks(radius: int) -> list[int]:
    """Masks of all pairs of ``radius + 2`` bit blocks, as signed numbers."""
    edges = np.linspace(0, BITS, radius + 3).round().astype(int)
    blocks = [((1 << int(b)) - (1 << int(a))) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in (a | b for a, b in combinations(blocks, 2))]


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp``, enough to connect
    all fingerprints that are connected by links."""
    keyed = prints.select("fp", F.posexplode(F.array(*[
        F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(radius)])).alias("tab", "bits"))
    sizes = keyed.groupBy("tab", "bits").count().where("count > 1")
    members = keyed.join(sizes, ["tab", "bits"]) \
        .withColumn("parts", F.ceil(F.col("count") / CELL).cast("int")) \
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cells = members.select("tab", "bits", "fp", "part", F.explode(
        F.when(F.col("parts") == 1, F.array(F.lit(0)))
        .otherwise(F.array_except(F.sequence(F.lit(0), F.col("parts") - 1), F.array("part")))).alias("with")) \
        .select("tab", "bits", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "fp")
    cell = ["tab", "bits", "i", "j"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def found(part: pd.DataFrame) -> pd.DataFrame:
            values = part["fp"].to_numpy().astype(np.int64).view(np.uint64)
            number = (part[cell] != part[cell].shift()).any(axis=1).cumsum().to_numpy()
            pairs = bucket_links(values, number, radius)
            fp = values.view(np.int64)
            return pd.DataFrame({"a": fp[pairs[:, 0]], "b": fp[pairs[:, 1]]})

        for batch in batches:  # a cell may go over batches: its start is held back
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (held[cell] == held[cell].iloc[-1]).all(axis=1).to_numpy()
            whole = len(held) if not last.any() else int(np.argmax(last))
            if whole:
                yield found(held.iloc[:whole])
                held = held.iloc[whole:].reset_index(drop=True)
        if held is not None and len(held):
            yield found(held)

    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInPandas(compare, "a long, b long")


def grouped(docs: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id",
            text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns, or those in ``keep``),
    ``rid``, ``id``, ``fp`` (signed), ``component`` (a fingerprint that stands for
    the component) and ``component_id``."""
    bound_batches(docs.sparkSession)
    kept = F.struct(*[qcol(c) for c in keep]) if keep else F.struct("*")
    rows = materialize(docs.select(
        kept.alias("row"), F.monotonically_increasing_id().alias("rid"),
        qcol(id_col).alias("id"), fingerprints(text_or_empty(text_col), shingle).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("id").alias("id"))
    linked = components(links(prints, radius), "a", "b")
    rooted = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "id", F.coalesce("root", "fp").alias("component"))
    ids = rooted.groupBy("component").agg(F.min("id").alias("component_id"))
    named = rooted.select("fp", "component").join(ids, "component")
    return rows.join(named, "fp")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest
    id (null ids last), of equal ids the first read."""
    rows = grouped(docs, None, id_col, text_col, shingle, radius)
    first = rows.select("component", F.struct(F.col("id").isNull().alias("none"), "id", "rid").alias("at")) \
        .groupBy("component").agg(F.min("at").alias("at")).select(F.col("at.rid").alias("rid"))
    return rows.join(first, "rid", "left_semi").select("row.*")
