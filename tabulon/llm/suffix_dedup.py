"""Removal of long repeated byte strings, by suffix order and common prefixes.

Every byte covered by a ``length``-byte string that also starts anywhere else
(same document included) goes; strings are judged on the input and overlaps
count.  Matches never cross documents.

A suffix array of a whole corpus does not fit one task, so the suffixes are
dealt out first, exactly:

* Every ``length``-byte window has a least gram: that of ``GRAM`` bytes in it
  with the least hash, the leftmost of equals.  The window reaches half of what
  is beside the gram to its left or to its right; gram and that half are its
  anchor.  All this depends on the window's bytes only, so equal windows have
  equal anchors at equal places.
* Consecutive windows with the same anchor form one context (about 240
  bytes).  Contexts whose anchor occurs once hold nothing repeated.  Of an
  anchor whose contexts are all equal, everything is.
* All other contexts, each different one once with a mark if it occurs again,
  go to shards by anchor.  The contexts of very frequent anchors are divided
  first, round by round, by the anchor's place in the window and by all the
  bytes that windows of such places share: parts without a partner are out,
  equal parts are repeated, the rest goes on.  Parts end at single windows,
  which are alone or equal, so that no shard has more than ``DIVIDE`` contexts.
* A task sorts its shards in lots of a bounded size: suffixes with their common
  prefixes, by external induced sorting (:mod:`tabulon.llm.induced`, its queues
  on disk beyond a bound).  A window is repeated if a neighbour shares
  ``length`` bytes.

Texts are shuffled twice, compressed: to cut out the contexts that are to be
sorted, and to remove what was found.  Both joins are on (text hash, size),
and what arrives is checked against the context's own hash.

Defined cases: a null text counts as empty; texts shorter than ``length`` stay
whole; exact copies lose all their bytes, repeated rows likewise; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.llm.common import bound_batches, materialize, text_or_empty
from tabulon.llm.induced import sorted_suffixes

LENGTH, GRAM = 200, 32
#: Occurrences of an anchor beyond which its contexts are divided among more
#: shards, and the number of parts that a round makes of one.
DIVIDE, FAN = 4096, 5
#: Bytes of the shards that are sorted together.
LOT = 4 << 20
#: Windows of a long text, and bytes of short texts, handled at once.
PIECE, GROUP = 1 << 19, 1 << 17

_ODD, _MIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 20) - 1)


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all ``gram``-byte strings (a power of two), by doubling."""
    h = (text.astype(np.uint64) + np.uint64(1)) * _MIX
    step, factor = 1, int(_ODD)
    while step < gram:
        h = h[:-step] * np.uint64(factor) + h[step:]
        step, factor = step * 2, factor * factor % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.minimum(h[:len(h) - (width - step)], h[width - step:]) if step < width else h


def contexts(raws: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of the contexts of all texts: the text's number, the first window's place
    in it, the number of windows, the anchor's hash, the offset of its gram in the
    first window, and the context's own hash."""
    half = (length - gram) // 2
    sizes = np.array([len(r) for r in raws], dtype=np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(raws), dtype=np.uint8)
    out = []
    # a window belongs to the text it starts in, and must end there
    room = np.repeat(ends - length, sizes) >= np.arange(len(text)) if len(text) else np.zeros(0, dtype=bool)
    for at in range(0, max(0, len(text) - length + 1), PIECE):
        part = text[at:at + PIECE + length - 1]
        h = gram_hashes(part, gram)
        # least upper bits first, then leftmost
        least = window_minimum(h & ~_PLACE | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        place = (least & _PLACE).astype(np.int64)
        inside = room[at:at + len(place)]
        turn = np.append(True, (place[1:] != place[:-1]) | ~inside[:-1])
        # a text's windows end before the next text's begin: the gap parts them
        first = np.flatnonzero(turn & inside)
        stop = np.flatnonzero(inside & np.append((place[1:] != place[:-1]) | ~inside[1:], True)) + 1
        # windows that reach far enough to the left of the gram, then the others
        mid = np.clip(place[first] - half + 1, first, stop)
        first, stop = np.stack([first, mid], 1).ravel(), np.stack([mid, stop], 1).ravel()
        side = np.arange(len(first)) % 2
        first, stop, side = (x[first < stop] for x in (first, stop, side))
        least_at = place[first]
        total = _running(part)
        own = _hashes(total, first, stop + length - 1)
        shared = _hashes(total, least_at - half * (1 - side),
                         least_at + np.where(side, length - half + 1, gram))
        anchor = (shared + h[least_at] + side.astype(np.uint64)) * _ODD
        anchor ^= anchor >> np.uint64(32)
        out.append((first + at, stop - first, anchor.view(np.int64), least_at - first, own.view(np.int64)))
    none = np.zeros(0, dtype=np.int64)
    start, windows, anchor, offset, own = (np.concatenate([none, *x]) for x in (zip(*out) if out else [[]] * 5))
    number = np.searchsorted(ends, start, side="right")
    return number, start - (ends - sizes)[number], windows, anchor, offset, own


_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.ones(max(n, 1), dtype=np.uint64)
        known[1:] = np.uint64(base)
        _POWERS[base] = known = np.cumprod(known)
    return known[:n]


def _running(text: np.ndarray) -> np.ndarray:
    """Running sums of symbol times power, from which any part's hash follows."""
    mixed = (text.astype(np.uint64) + np.uint64(1)) * _MIX
    mixed ^= mixed >> np.uint64(29)
    return np.append(np.uint64(0), np.cumsum(mixed * _powers(len(text), _BASE)))


def _hashes(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of parts of the text with these running sums."""
    own = (total[end] - total[begin]) * _powers(len(total), _INVERSE)[begin]
    return (own ^ own >> np.uint64(32)) * _MIX


def context_hash(raw: bytes) -> int:
    """The own hash of a context of these bytes."""
    total = _running(np.frombuffer(raw, dtype=np.uint8))[-1:]
    return int(((total ^ total >> np.uint64(32)) * _MIX).view(np.int64)[0])


def _identity(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("key"), F.octet_length(text).alias("size")]


def packed(text: Column) -> Column:
    """The text's UTF-8 bytes, compressed for the shuffle."""
    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        import zstandard
        compress = zstandard.ZstdCompressor(level=1).compress
        return pa.array([compress(t) for t in pc.cast(texts, pa.binary()).to_pylist()], pa.binary())
    return pack(text)


def _unpack():
    import zstandard
    return zstandard.ZstdDecompressor().decompress


# ------------------------------------------------------------------ Spark jobs
def context_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, size, start, windows, offset, anchor, context) of all contexts."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = pc.cast(batch.column("text"), pa.binary()).to_pylist()
            key, size = batch.column("key").to_numpy(), batch.column("size").to_numpy()
            use = [i for i, r in enumerate(raws) if len(r) >= length]
            while use:
                n, some = 0, []
                while use and n < GROUP:
                    some.append(use.pop())
                    n += len(raws[some[-1]])
                number, start, windows, anchor, offset, own = contexts([raws[i] for i in some], length, gram)
                text = np.array(some)[number]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key[text]), "size": pa.array(size[text]),
                    "start": pa.array(start.astype(np.int32)), "windows": pa.array(windows.astype(np.int16)),
                    "offset": pa.array(offset.astype(np.int16)), "anchor": pa.array(anchor),
                    "context": pa.array(own)})
    return texts.mapInArrow(_gathered(cut), "key long, size int, start int, windows short, offset short, "
                                            "anchor long, context long")


def _gathered(cut):
    """Many small batches as fewer larger ones."""
    def run(batches):
        held, n = [], 0
        for batch in cut(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 16:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return run


_PIECE = "anchor long, context long, again boolean, n long, first int, windows int, offset int, bytes binary"


def _extracted(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, context, again, n, first, windows, offset, bytes): each wanted
    context cut from its text."""
    by_text = wanted.groupBy("key", "size").agg(F.collect_list(F.struct(  # of one text
        "start", "windows", "offset", "anchor", "context", "again", "n")).alias("wanted"))
    once = texts.dropDuplicates(["key", "size"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpack()
        for batch in batches:
            out = []
            for packed_text, contexts_ in zip(batch.column("packed").to_pylist(), batch.column("wanted").to_pylist()):
                raw = unpack(packed_text)
                for c in contexts_:
                    own = raw[c["start"]:c["start"] + c["windows"] + length - 1]
                    if context_hash(own) == c["context"]:
                        out.append((c["anchor"], c["context"], c["again"], c["n"], 0, c["windows"], c["offset"], own))
            cols = list(zip(*out)) if out else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             [c.split()[0] for c in _PIECE.split(", ")])

    return once.join(by_text, ["key", "size"]).select("packed", "wanted").mapInArrow(cut, _PIECE)


def _parts(pieces: DataFrame, width: int, length: int) -> DataFrame:
    """The pieces cut where the anchor's offset reaches a multiple of ``width``,
    with their ``shard``, the hash of all bytes that windows of such offsets share,
    and their ``own`` hash."""
    col = F.col
    each = pieces.withColumn("turn", F.explode(F.sequence(
        F.floor((col("offset") - col("windows") + 1) / width).cast("int"), F.floor(col("offset") / width).cast("int"))))
    top = F.least("offset", col("turn") * width + width - 1)
    low = F.greatest(col("offset") - col("windows") + 1, col("turn") * width)
    each = each.select("anchor", "context", "again", "turn", (col("first") + col("offset") - top).alias("first"),
                       (top - low + 1).alias("windows"), top.alias("offset"),
                       F.substring("bytes", col("offset") - top + 1, top - low + length).alias("bytes"))
    shared = F.substring("bytes", col("offset") - col("turn") * width + 1, F.lit(length - width + 1))
    return each.withColumn("shard", F.xxhash64("anchor", F.lit(width), "turn", shared)) \
        .withColumn("own", F.xxhash64("offset", "windows", "bytes")).drop("turn")


def _divided(pieces: DataFrame, length: int, gram: int, divide: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of frequent anchors in shards of at most ``divide``, and the runs
    (anchor, context, first, end) found on the way."""
    again = pieces.where("again").select("anchor", "context", "first", F.col("windows").alias("end"))
    ready, runs, width = [], [again], (length - gram) // 2 + 1
    while True:
        width = -(-width // FAN)
        parts = _parts(pieces, width, length)
        # written first: the join is of two plain shuffles, which can be split
        shards = materialize(parts.groupBy("shard").agg(
            F.count("*").alias("n"), (F.min("own") != F.max("own")).alias("sort")).where("n > 1"))
        parts = materialize(parts.join(shards, "shard"))
        runs.append(parts.where("not sort").select(
            "anchor", "context", "first", (F.col("first") + F.col("windows")).alias("end")))
        if width == 1:  # single windows, alone or equal; unequal hashes of equal sums are sorted
            ready.append(parts.where("sort"))
            break
        ready.append(parts.where(F.col("sort") & (F.col("n") <= divide)))
        pieces = parts.where(F.col("sort") & (F.col("n") > divide))
        if pieces.isEmpty():
            break
    return reduce(DataFrame.unionByName, ready), reduce(DataFrame.unionByName, runs)


def repeated_windows(pieces: list[bytes], windows: np.ndarray, length: int) -> np.ndarray:
    """Of the windows of all pieces, one after the other: whether the window's
    bytes are found at another place."""
    if not len(pieces):
        return np.zeros(0, dtype=bool)
    raw = np.frombuffer(b"".join(p + b"\xff" for p in pieces), dtype=np.uint8)
    sizes = np.array([len(p) + 1 for p in pieces])
    ends = np.cumsum(sizes)
    plain = np.ones(len(raw), dtype=bool)
    plain[ends - 1] = False
    kind = np.uint8 if raw[plain].max(initial=0) <= 253 else np.uint16
    text = raw.astype(kind) + kind(2)  # 0 ends the shard, 1 a piece
    text[~plain] = 1
    same = np.zeros(len(text) + 1, dtype=bool)
    last = None
    for places, common in sorted_suffixes(np.append(text, kind(0)), length):
        near = common >= length
        same[places[near]] = True
        before = np.append(places[:1] if last is None else last, places[:-1])
        same[before[near]] = True
        last = places[-1:]
    at = np.repeat(ends - sizes, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    return same[at]


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole shards, which come one after the other, in tables of about ``LOT`` bytes."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.column("bytes").nbytes
        if n < LOT:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        shard = table.column("shard").to_numpy()
        end = int(np.flatnonzero(shard != shard[-1])[-1]) + 1 if (shard != shard[-1]).any() else 0
        if end:
            yield table.slice(0, end).combine_chunks()
        held = table.slice(end).combine_chunks().to_batches()
        n = sum(b.column("bytes").nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _sorted(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, context, first, end): runs of repeated windows of each context."""
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lots(batches):
            yield runs(table)

    def runs(table: pa.Table) -> pa.RecordBatch:
        windows = table.column("windows").to_numpy().astype(np.int64)
        found = repeated_windows(table.column("bytes").to_pylist(), windows, length)
        found |= np.repeat(table.column("again").to_numpy(), windows)
        # runs of repeated windows, broken where a piece begins
        begin = np.zeros(len(found) + 1, dtype=bool)
        begin[np.cumsum(windows) - windows] = True
        rises = np.flatnonzero(found & (begin[:-1] | ~np.append(False, found[:-1])))
        falls = np.flatnonzero(found & (begin[1:] | ~np.append(found[1:], False) | (np.arange(1, len(found) + 1) == len(found)))) + 1
        piece = np.searchsorted(np.cumsum(windows), rises, side="right")
        base = (np.cumsum(windows) - windows)[piece]
        first = table.column("first").to_numpy()[piece]
        return pa.RecordBatch.from_pydict({
            "anchor": pa.array(table.column("anchor").to_numpy()[piece]),
            "context": pa.array(table.column("context").to_numpy()[piece]),
            "first": pa.array((rises - base + first).astype(np.int32)),
            "end": pa.array((falls - base + first).astype(np.int32))})

    return pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        sort, "anchor long, context long, first int, end int")


def repeated_runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, divide: int = DIVIDE) -> DataFrame:
    """(key, size, runs): for each text the runs (first, end) of places where a
    repeated ``length``-byte string starts.  ``texts``: (key, size, text)."""
    rows = context_rows(texts, length, gram)
    # written first, so that the join below is of two plain shuffles, which
    # adaptive execution splits where many contexts have one anchor
    anchors = materialize(rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("lo"),
                                                     F.max("context").alias("hi")).where("n > 1"))
    seen = materialize(rows.join(anchors, "anchor").select(
        *rows.columns, (F.col("lo") != F.col("hi")).alias("sort"), "n"))
    unsure = seen.where("sort")
    wanted = unsure.groupBy("anchor", "context").agg(
        (F.count("*") > 1).alias("again"), F.first("n").alias("n"),
        F.min(F.struct("key", "size", "start", "windows", "offset")).alias("at")).select(
        "anchor", "context", "again", "n", "at.*")
    pieces = _extracted(texts.select("key", "size", packed(F.col("text")).alias("packed")), wanted, length)
    frequent = F.col("n") > divide
    if anchors.where(frequent & (F.col("lo") != F.col("hi"))).isEmpty():
        found = _sorted(pieces.withColumn("shard", F.col("anchor")), length)
    else:
        pieces = materialize(pieces)
        divided, runs = _divided(pieces.where(frequent), length, gram, divide)
        shards = pieces.where(~frequent).withColumn("shard", F.col("anchor"))
        found = _sorted(shards.unionByName(divided.select(*shards.columns)), length).unionByName(runs)
    sorted_ = unsure.select("key", "size", "start", "anchor", "context").distinct() \
        .join(found, ["anchor", "context"]).select(
            "key", "size", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end")).alias("end"))
    sure = seen.where("not sort").select("key", "size", F.col("start").alias("first"),
                                         (F.col("start") + F.col("windows")).alias("end")).distinct()
    return sorted_.union(sure).distinct().groupBy("key", "size").agg(
        F.collect_list(F.struct("first", "end")).alias("runs"))


def kept_bytes(raw: bytes, runs: list[tuple[int, int]], length: int) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    left, spans, at = [], 0, 0
    for first, end in sorted(runs):
        if first > at or not spans:  # removed runs that touch are one
            left.append(raw[at:first])
            spans += 1
        at = max(at, end + length - 1)
    left.append(raw[at:])
    kept = b"".join(left)
    return len(raw) - len(kept), spans, kept


def without_repeats(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text",
                    length: int = LENGTH, gram: int = GRAM, divide: int = DIVIDE) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns, or those in ``keep``),
    ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes)."""
    bound_batches(docs.sparkSession)
    text = text_or_empty(text_col)
    runs = repeated_runs(docs.select(*_identity(text), text.alias("text")), length, gram, divide)
    kept = F.struct(*[qcol(c) for c in keep]) if keep else F.struct("*")
    rows = docs.select(kept.alias("row"), *_identity(text), packed(text).alias("packed"))

    @F.arrow_udf("struct<n_removed:bigint,n_spans:bigint,kept:binary>")
    def cut(texts: pa.Array, runs_: pa.Array) -> pa.Array:
        unpack, out = _unpack(), []
        for t, own in zip(texts.to_pylist(), runs_.to_pylist()):
            raw = unpack(t)
            out.append(kept_bytes(raw, [(r["first"], r["end"]) for r in own or ()], length))
        cols = list(zip(*out)) if out else [[]] * 3
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                                           pa.array(cols[2], pa.binary())], ["n_removed", "n_spans", "kept"])

    return rows.join(runs, ["key", "size"], "left").select(
        "row", F.col("size").cast("long").alias("n_bytes"), cut("packed", "runs").alias("c")) \
        .select("row", "n_bytes", "c.*")
