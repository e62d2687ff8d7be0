"""Spelling variants: words one edit apart, found by scanning sorted word lists.

A list of words is sorted, and edit-matrix rows are kept for prefixes: all words
that begin alike share the rows of their common prefix (known from the adjacent
common-prefix lengths), a row holds only the three cells beside the diagonal,
and a range of words whose shared prefix already costs more than one edit is
skipped.  The scan goes level by level over all queries of a list at once.

No list holds the whole vocabulary.  Of two words one edit apart, the shorter of
``m`` letters, the first ``m // 2`` letters or the last ``m // 2`` agree, so lists
are made of the words that agree there.  A list longer than ``LIST`` is divided in
the same way by the letters left between, until it is short enough or only one
letter is left, where the alphabet bounds it; no pair is lost, and a pair
found by its first letters is passed over in the list of its last ones.

A word's *form* is its near word of largest count, if that is at least ``ratio``
times its own; *root* follows forms to the last one (pointers are doubled every
round, and counts grow along them, so there are no circles).

Defined cases: a null or empty text has no words; very long texts and words are
taken whole; equal words of repeated rows count every time; ties go to the smaller
word in code-point order; an empty table gives an empty result; columns other
than the id and the text are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.llm.common import materialize, text_or_empty

#: Words in one list; longer lists are divided.
LIST = 20_000
#: Words of the lists that one task call sorts and scans.
BUCKET = 50_000
#: Queries scanned at once, which bounds the rows that are kept.
QUERIES_AT_ONCE = 4_096
#: Different words that a task counts before it hands them on.
FLUSH = 300_000

#: Words are kept as one byte a letter (all lie below U+0100): letters, A-Z as a-z, else a space.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_FAR = 2  # any distance above one edit


# ------------------------------------------------------------------- vocabulary
def text_words(text: str, doc_id: str, noise: int | None) -> Iterator[tuple[bytes, int]]:
    """Lower-cased runs of letters with their counts.  With ``noise``, a run whose
    crc32 of ``doc_id:run`` is divisible by it loses the letter at crc32 mod length."""
    runs = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
    if noise is None:
        yield from runs.items()
        return
    begin = crc32(f"{doc_id}:".encode())
    for run, count in runs.items():
        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
        if h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        yield run, count


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
               min_count: int = 3, noise: int | None = None) -> DataFrame:
    """(word, n) of all texts; ``word`` holds one byte a letter.  A null id counts as
    empty in ``noise``."""
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.binary()),
                                              pa.array(words.values(), pa.int64())], ["word", "n"])
            words.clear()
            return out
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, count in text_words(text, doc_id, noise):
                    if len(word) >= min_length:
                        words[word] += count
                if len(words) >= FLUSH:
                    yield flush()
        yield flush()

    texts = docs.select(F.coalesce(qcol(id_col).cast("string"), F.lit("")).alias("id"),
                        text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .where(F.col("n") >= min_count)


# ------------------------------------------------------------------- sorted lists
def _common(flat: np.ndarray, start: np.ndarray, length: np.ndarray, list_id: np.ndarray) -> np.ndarray:
    """Common prefix of every word with the one before; -1 where a list begins."""
    lcp = np.zeros(len(start), dtype=np.int64)
    lcp[:1] = -1
    same = np.flatnonzero(list_id[1:] == list_id[:-1]) + 1
    lcp[1:][list_id[1:] != list_id[:-1]] = -1
    depth = 0
    while len(same):
        same = same[(length[same] > depth) & (length[same - 1] > depth)]
        same = same[flat[start[same] + depth] == flat[start[same - 1] + depth]]
        depth += 1
        lcp[same] = depth
    return lcp


def near_in_lists(flat: np.ndarray, start: np.ndarray, length: np.ndarray, lcp: np.ndarray,
                  list_start: np.ndarray, list_end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, word) places of the words exactly one edit apart within their list.

    ``flat`` holds the letters of the sorted words, ``lcp`` the common prefixes.
    """
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    padded = np.append(flat, np.zeros(1, flat.dtype))

    def level(depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where prefixes of that many letters begin, and where any range ends."""
        if depth not in levels:
            bounds = np.flatnonzero(lcp < depth)
            levels[depth] = bounds[length[bounds] >= depth], np.append(bounds, len(lcp))
        return levels[depth]

    def differs(query: np.ndarray, at: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """0 or 1 where the query has that place, else far."""
        inside = (at >= 0) & (at < length[query])
        own = padded[np.where(inside, start[query] + at, len(flat))]
        return np.where(inside, (own != letter).astype(np.int8), np.int8(_FAR))

    several = np.flatnonzero(list_end - list_start > 1)
    for i in range(0, len(several), QUERIES_AT_ONCE):
        query = several[i:i + QUERIES_AT_ONCE]
        first, last = list_start[query], list_end[query]
        row = np.full((3, len(query)), _FAR, dtype=np.int8)  # cells j = depth - 1, depth, depth + 1
        row[1] = 0
        row[2] = np.where(length[query] > 0, 1, _FAR)
        depth = 0
        while len(query):
            cell = length[query] - depth + 1  # of the whole query
            ends = np.flatnonzero((length[first] == depth) & (cell >= 0) & (cell <= 2))
            hit = ends[row[cell[ends], ends] == 1]
            if len(hit):
                yield query[hit], first[hit]
            begins, bounds = level(depth + 1)
            low, high = np.searchsorted(begins, first), np.searchsorted(begins, last)
            many = high - low
            parent = np.repeat(np.arange(len(query)), many)
            place = np.arange(len(parent)) - np.repeat(np.cumsum(many) - many, many)
            child = begins[low[parent] + place]
            query, old = query[parent], row[:, parent]
            letter = flat[start[child] + depth]
            new0 = np.minimum(old[0] + differs(query, np.full(len(query), depth - 1), letter), old[1] + 1)
            new1 = np.minimum(np.minimum(old[1] + differs(query, np.full(len(query), depth), letter), old[2] + 1),
                              np.where(length[query] > depth, new0 + 1, _FAR))
            new2 = np.minimum(old[2] + differs(query, np.full(len(query), depth + 1), letter),
                              np.where(length[query] > depth + 1, new1 + 1, _FAR))
            new0 = np.where(length[query] >= depth, new0, _FAR)
            new1 = np.where(length[query] > depth, new1, _FAR)
            row = np.minimum(np.stack([new0, new1, new2]), _FAR).astype(np.int8)
            live = np.flatnonzero(row.min(axis=0) <= 1)  # all other ranges are skipped
            query, first, row = query[live], child[live], row[:, live]
            last = bounds[np.searchsorted(bounds, first, side="right")]
            depth += 1


def _scan(table: pa.Table) -> pa.Table:
    """Near words of one bucket's lists: per word their number and the best one."""
    keys = [("key", "ascending"), ("core", "ascending")]
    table = table.take(pc.sort_indices(table, sort_keys=keys)).combine_chunks()
    none = pa.table({"word": pa.array([], pa.binary()), "near": pa.array([], pa.int64()),
                     "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.binary())})
    if not table.num_rows:
        return none
    key, core, word = (pc.cast(table[c], pa.large_binary()).combine_chunks() for c in ("key", "core", "word"))
    list_id = np.cumsum(np.append(True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False))) - 1
    offsets = np.frombuffer(core.buffers()[1], dtype=np.int64)[core.offset:core.offset + len(core) + 1]
    flat = np.frombuffer(core.buffers()[2], dtype=np.uint8) if core.buffers()[2] else np.zeros(0, np.uint8)
    start, length = offsets[:-1], np.diff(offsets)
    lcp = _common(flat, start, length, list_id)
    bounds = np.append(np.flatnonzero(lcp < 0), len(lcp))
    n, size = table["n"].to_numpy(), table["size"].to_numpy()
    total, most = table["length"].to_numpy(), table["cap"].to_numpy()
    found = []
    for query, other in near_in_lists(flat, start, length, lcp, bounds[list_id], bounds[list_id + 1]):
        # two words of m + 1 letters belong to the lists of m + 1
        keep = np.minimum(total[query], total[other]) == size[query]
        found.append((query[keep], other[keep]))
    query = np.concatenate([q for q, _ in found]) if found else np.zeros(0, np.int64)
    other = np.concatenate([o for _, o in found]) if found else query
    for cap in np.unique(most[query]):  # pairs with so long a common prefix are found in another list
        of = np.flatnonzero(most[query] == cap)
        prefix = np.cumsum(lcp < cap)
        again = of[prefix[query[of]] == prefix[other[of]]]
        query, other = np.delete(query, again), np.delete(other, again)
    if not len(query):
        return none
    rank = np.empty(len(word), dtype=np.int64)
    rank[pc.sort_indices(word).to_numpy()] = np.arange(len(word))
    order = np.lexsort((rank[other], -n[other], query))
    query, other = query[order], other[order]
    head = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    return pa.table({"word": table["word"].take(pa.array(query[head])),
                     "near": pa.array(np.diff(np.append(head, len(query)))),
                     "best_n": pa.array(n[other[head]]),
                     "best": table["word"].take(pa.array(other[head]))})


def _divided(members: DataFrame) -> DataFrame:
    """Every member in two lists: by the next letters of its first part, and of its last."""
    step = F.floor((F.col("size") - F.col("a") - F.col("b")) / 2).cast("int")
    by_first = F.struct((F.col("a") + step).alias("a"), F.col("b").alias("b"), F.col("cap").alias("cap"),
                        F.concat("path", F.lit("p")).alias("path"))
    by_last = F.struct(F.col("a").alias("a"), (F.col("b") + step).alias("b"),
                       F.least("cap", F.col("a") + step).alias("cap"), F.concat("path", F.lit("s")).alias("path"))
    return members.select("word", "n", "length", "size", F.explode(F.array(by_first, by_last)).alias("part")) \
        .select("word", "n", "length", "size", "part.*") \
        .withColumn("key", F.concat(
            F.encode(F.concat_ws(":", "path", "size", F.lit("")), "UTF-8"),
            F.substring("word", F.lit(1), F.col("a")),
            F.substring("word", F.col("length") - F.col("b") + 1, F.col("b"))))


def near_words(vocab: DataFrame, min_length: int = 1) -> DataFrame:
    """(word, n, n_near, best_n, best): the number of words one edit away, and of these
    the one of largest ``n`` (ties: the smallest); null if there is none.

    ``vocab`` has different words as bytes, one a letter.
    """
    spark = vocab.sparkSession
    vocab = vocab.select("word", "n", F.octet_length("word").cast("int").alias("length"))
    sizes = F.filter(F.array(F.col("length"), F.col("length") - 1), lambda m: m >= min_length)
    members = vocab.select("*", F.explode(sizes).alias("size"), F.lit(0).alias("a"), F.lit(0).alias("b"),
                           F.lit(2 ** 31 - 1).alias("cap"), F.lit("").alias("path"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + 4 * vocab.count() // BUCKET)
    found = vocab.select("word", "n", F.lit(0).cast("long").alias("near"),
                         F.lit(None).cast("struct<m:long,best:binary>").alias("best"))
    lists = _divided(members)
    while True:
        long_ones = lists.where(F.col("size") - F.col("a") - F.col("b") > 1).groupBy("key").count() \
            .where(F.col("count") > LIST).select("key")
        long_ones = materialize(long_ones)
        more = not long_ones.isEmpty()
        short = lists.join(long_ones, "key", "left_anti") if more else lists
        core = F.substring("word", F.col("a") + 1, F.col("length") - F.col("a") - F.col("b"))
        scanned = short.select("key", core.alias("core"), "word", "n", "size", "length", (F.col("cap") - F.col("a")).alias("cap"),
                               F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")) \
            .groupBy("bucket").applyInArrow(_scan, "word binary, near long, best_n long, best binary")
        found = found.unionByName(scanned.select(
            "word", F.lit(None).cast("long").alias("n"), "near",
            F.struct((-F.col("best_n")).alias("m"), "best").alias("best")))
        if not more:
            break
        lists = materialize(_divided(materialize(lists.join(long_ones, "key"))))
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("b")) \
        .select("word", "n", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form."""
    at = materialize(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = materialize(at.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = ahead.select("word", "root")
        if ahead.where("moved").isEmpty():
            return at


def _text(word: str) -> Column:
    return F.decode(F.col(word), "ISO-8859-1")


def variants(vocab: DataFrame, ratio: int = 2, min_length: int = 1) -> DataFrame:
    """word, form, root (text), n, n_near, form_n of every word of ``vocab``."""
    has = F.col("best_n") >= F.lit(ratio) * F.col("n")
    forms = materialize(near_words(materialize(vocab), min_length).select(
        "word", "n", "n_near", F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    return forms.join(_roots(forms), "word", "left").select(
        _text("word").alias("word"), _text("form").alias("form"),
        F.decode(F.coalesce("root", "word"), "ISO-8859-1").alias("root"), "n", "n_near", "form_n")
