"""Token ids in wavelet matrix files.

Documents are range-partitioned and sorted by id, so the shards follow one
another in ascending order of id.  Each shard is cut into parts of whole
documents; a part is one self-contained compressed file, kept as one binary
row of a Parquet table under the shared checkpoint folder: written by Spark's
own commit protocol, so a lost executor leaves no half file, and readable by
any executor from any store.

A file holds a header, the documents' ids and lengths, and for every bit of an
id, from the highest, one plane: the bits of all ids in the order that the
planes above have put them (zeros first, stable).  Counts of ones per 512 bits
give rank in constant time; access, counting and occurrence lookup walk the
planes.

Defined cases: a null text counts as empty and has the end id only; texts of any length
are encoded whole; null ids
come first, equal ids are ordered by their text's digest; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.columns import qcol
from tabulon.llm.common import bound_batches, materialize, text_or_empty

#: Ids of a part; a longer document has a part of its own.
PART_IDS = 1 << 20
MAGIC = b"TBWAVE1\n"
#: Bytes of one generation of the words that a worker knows.
CACHE_BYTES = 96 << 20
#: Characters of a text that are taken apart at once.
SLICE = 1 << 20
#: Bits between two counts of ones.
RANK_BITS = 512
_HEAD = struct.Struct("<8sQQBQQQ")


# --------------------------------------------------------------------- the file
class WaveletMatrix:
    """Planes with rank support over ids of ``bits`` bits."""

    def __init__(self, n: int, bits: int, planes: list[np.ndarray], ones: list[np.ndarray]):
        self.n, self.bits, self.planes, self.ones = n, bits, planes, ones
        self.zeros = [n - int(o[-1]) for o in ones]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ones = [], []
        for b in reversed(range(bits)):
            mask = (now & now.dtype.type(1 << b)).astype(bool)
            plane = np.packbits(mask, bitorder="little")
            planes.append(plane)
            ones.append(_counts(plane))
            now = np.concatenate([now[~mask], now[mask]])
        return cls(len(ids), bits, planes, ones)

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def rank1(self, level: int, i: int) -> int:
        """Ones of a plane before place ``i``."""
        block = i // RANK_BITS
        plane = self.planes[level][block * RANK_BITS // 8:(i >> 3) + 1]
        whole = (i - block * RANK_BITS) >> 3
        n = int(self.ones[level][block]) + int(np.bitwise_count(plane[:whole]).sum())
        return n + (int(plane[whole]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else n

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        out = 0
        for level in range(self.bits):
            one, r = self.bit(level, i), self.rank1(level, i)
            out = out << 1 | one
            i = self.zeros[level] + r if one else i - r
        return out

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank1(level, begin), self.rank1(level, end)
            if token >> (self.bits - 1 - level) & 1:
                begin, end = self.zeros[level] + a, self.zeros[level] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """Occurrences of ``token`` in places ``begin`` to ``end``."""
        if token >> self.bits:
            return 0
        a, b = self._range(token, begin, self.n if end is None else end)
        return b - a

    def _select(self, level: int, one: int, k: int) -> int:
        """Place of the ``k``-th (from 0) zero or one of a plane."""
        counts = self.ones[level] if one else \
            np.minimum(np.arange(len(self.ones[level])) * RANK_BITS, self.n) - self.ones[level]
        block = int(np.searchsorted(counts, k, side="right")) - 1
        plane = self.planes[level][block * RANK_BITS // 8:(block + 1) * RANK_BITS // 8]
        bits = np.unpackbits(plane, bitorder="little") == one
        return block * RANK_BITS + int(np.flatnonzero(bits)[k - int(counts[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``token``."""
        begin, end = self._range(token, 0, self.n) if not token >> self.bits else (0, 0)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        i = begin + k
        for level in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - level) & 1
            i = self._select(level, one, i - self.zeros[level] if one else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids: the stable partitions are undone from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for level in reversed(range(self.bits)):
            mask = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, up = self.zeros[level], np.empty_like(now)
            up[~mask] = now[:z]
            up[mask] = now[z:] | kind(1 << (self.bits - 1 - level))
            now = up
        return now


def _counts(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of ``RANK_BITS``, and in all."""
    width = RANK_BITS // 8
    padded = np.pad(plane, (0, -len(plane) % width)).reshape(-1, width)
    per = np.bitwise_count(padded).sum(axis=1, dtype=np.uint32)
    return np.concatenate([[0], np.cumsum(per)]).astype("<u4")


def write_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of one file."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids)
    docs = pack(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()
                + np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()
                + lengths.astype("<u8").tobytes())
    planes = pack(b"".join(p.tobytes() for p in matrix.planes))
    ones = pack(b"".join(o.tobytes() for o in matrix.ones))
    return _HEAD.pack(MAGIC, len(ids), len(doc_ids), matrix.bits, len(docs), len(planes), len(ones)) \
        + docs + planes + ones


class WaveletFile:
    """A file read back: ``doc_ids``, ``lengths`` and ``matrix``."""

    def __init__(self, raw: bytes):
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        magic, n, n_docs, bits, a, b, c = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = _HEAD.size
        docs = unpack(raw[at:at + a])
        values, none = np.frombuffer(docs, "<i8", n_docs), np.frombuffer(docs, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [None if x else v for v, x in zip(values.tolist(), none.tolist())]
        self.lengths = np.frombuffer(docs, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        width = (n + 7) // 8
        blocks = -(-width // (RANK_BITS // 8)) + 1
        planes = np.frombuffer(unpack(raw[at + a:at + a + b]), np.uint8).reshape(bits, width)
        ones = np.frombuffer(unpack(raw[at + a + b:at + a + b + c]), "<u4").reshape(bits, blocks)
        self.matrix = WaveletMatrix(n, bits, list(planes), list(ones))


# ---------------------------------------------------------------------- encoding
#: Letters and digits of Latin-1, and the tokenizer's own split of a lower-cased
#: word into parts that it encodes apart.  Words of these characters are the same
#: under canonical composition, and have one lower case.
_LATIN_WORD = re.compile("[!-~\u00a1-\u00ff]+")
_PLAIN_TEXT = re.compile("[ \n!-~\u00a1-\u00ff]*")
_LETTER, _NUMBER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER} \n]+")


_ONE = struct.Struct("<I")


def _byte_symbols() -> list[str]:
    """The symbol that stands for each byte in the vocabulary: printable Latin-1
    as it is, the others from U+0100 on in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


_BYTE_SYMBOLS = _byte_symbols()


class _Known(dict):
    """Ids of words as bytes, found on first sight.  Two generations of about
    ``bound`` bytes: a full one becomes the old one, whose words come back when
    used."""

    #: Bytes that an entry takes besides its characters.
    SHARE = 150

    def __init__(self, encode: Callable[[str], bytes], bound: int = CACHE_BYTES):
        super().__init__()
        self.encode, self.bound, self.load, self.old = encode, bound, 0, {}

    def __missing__(self, word: str) -> bytes:
        if self.load > self.bound:
            self.old, self.load = dict(self), 0
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        self.load += len(word) + len(ids) + self.SHARE
        self[word] = ids
        return ids


class WordEncoder:
    """The library's ids of whole texts.  The tokenizer drops white space and works
    on either side of it apart.  A text of plain characters is taken apart into
    words' parts, as the tokenizer does, so that few different parts are left to
    encode; any other text is encoded by word, and a word of other characters goes to the
    library as it is."""

    def __init__(self, model: bytes):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model.decode())
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.model = self.tokenizer.model
        self.parts = _Known(self._merged)
        self.words = _Known(self._encode)

    def _merged(self, part: str) -> bytes:
        """Ids of a part by the library's merges alone."""
        seen = part if part.isascii() else "".join(map(_BYTE_SYMBOLS.__getitem__, part.encode()))
        ids = [t.id for t in self.model.tokenize(seen)]
        return _ONE.pack(ids[0]) if len(ids) == 1 else struct.pack(f"<{len(ids)}I", *ids)

    def _encode(self, word: str) -> bytes:
        """Ids of a word; white space between words (an empty word) has none."""
        if not word:
            return b""
        if _LATIN_WORD.fullmatch(word) and not (self.special and self.special.search(word)):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(word.lower())))
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _slice(self, text: str) -> bytes:
        if _PLAIN_TEXT.fullmatch(text) and not (self.special and self.special.search(text)):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):  # long texts in slices that end between words
            end = text.find(" ", at + SLICE) if len(text) - at > SLICE else -1
            end = end if end >= 0 else len(text)
            out.append(self._slice(text[at:end]))
            at = end
        return b"".join(out)


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(model: bytes) -> WordEncoder:
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(model)
    return _ENCODERS[key]


# ------------------------------------------------------------------ Spark jobs
def write_shards(docs: DataFrame, model: bytes, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", part_ids: int = PART_IDS) -> DataFrame:
    """The files of all documents: (shard, part, n_ids, content), shards and their
    parts in ascending order of id."""
    bound_batches(docs.sparkSession)
    texts = docs.select(qcol(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")) \
        .withColumn("tie", F.xxhash64("text"))
    ordered = texts.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = _encoder(model), TaskContext.get().partitionId()
        last = np.array([end_id], dtype="<u4").tobytes()
        part, held, doc_ids, lengths = 0, [], [], []

        def file() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            content = write_file(doc_ids, np.array(lengths), ids)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()),
                 "n_ids": pa.array([len(ids)], pa.int64()), "content": pa.array([content], pa.binary())})

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                raw = encode(text) + last
                if held and sum(lengths) + len(raw) // 4 > part_ids:
                    yield file()
                    part, held, doc_ids, lengths = part + 1, [], [], []
                held.append(raw)
                doc_ids.append(doc_id)
                lengths.append(len(raw) // 4)
        if held:
            yield file()

    return materialize(ordered.mapInArrow(build, "shard int, part int, n_ids long, content binary"))


def read_documents(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files;
    ``start`` counts the ids of all documents before it."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "content"))):
                f = WaveletFile(raw)
                ids = f.matrix.ids().astype("<u4").tobytes()
                ends = np.cumsum(f.lengths)
                begins = ends - f.lengths
                crc = [crc32(ids[4 * a:4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([shard] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()),
                    "id": pa.array(f.doc_ids, pa.int64()), "at": pa.array(begins, pa.int64()),
                    "n_tokens": pa.array(f.lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    docs = files.select("shard", "part", "content").mapInArrow(
        read, "shard int, part int, id long, at long, n_tokens long, ids_crc32 long")
    before = (Window.unboundedPreceding, -1)
    sizes = files.select("shard", "part", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(  # one row per shard
        "shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*before)), F.lit(0)).alias("base"))
    parts = sizes.select("shard", "part", F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("shard").orderBy("part").rowsBetween(*before)), F.lit(0)).alias("off"))
    heads = parts.join(shards, "shard").select("shard", "part", (F.col("base") + F.col("off")).alias("head"))
    return docs.join(heads, ["shard", "part"]).select(
        F.col("id").alias(id_col), (F.col("head") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(files: DataFrame, token: int) -> DataFrame:
    """(doc_id, place) of every occurrence of ``token``, found by select on the
    compressed files; ``place`` counts from the document's first id."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                f = WaveletFile(raw)
                at = np.array([f.matrix.select(token, k) for k in range(f.matrix.count(token))], dtype=np.int64)
                ends = np.cumsum(f.lengths)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([f.doc_ids[i] for i in doc], pa.int64()),
                    "place": pa.array(at - (ends - f.lengths)[doc], pa.int64())})
    return files.select("content").mapInArrow(find, "doc_id long, place long")
