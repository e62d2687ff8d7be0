"""SentencePiece encoding with byte offsets into the source, and decoding.

The text is normalised by the model's own character map: at every place the
longest prefix found in the compiled map (a double-array trie) is replaced,
and each normalised byte remembers the source byte it came from.  The pieces
cover the normalised text in order, so their lengths and that alignment give
every piece's span in the source's UTF-8 bytes.

The ids come from the sentencepiece library.  Where no piece of a BPE model
goes over the start of a word, merges cannot cross it either, and a text is
encoded word by word with a bounded cache of the library's results; the
condition is checked on the model's vocabulary.  Any other model encodes
whole texts.

Defined cases: a null text counts as empty and gives the begin and end ids
only, which span nothing; texts of any length are encoded whole; other columns, names and repeated rows pass
through; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.llm.wordcache import WordCache

#: The mark that stands for a blank in pieces.
MARK = "▁"


class CharacterMap:
    """The compiled character map of a model: trie units, then replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], dtype="<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that starts at ``at``."""
        units, found = self.units, None
        node = _offset(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units) or units[node] & 0x800000FF != text[i]:
                break
            unit = units[node]
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        begin = found[1]
        return found[0], self.texts[begin:self.texts.index(b"\0", begin)]


def _offset(unit: int) -> int:
    return (unit >> 10) << ((unit & 512) >> 6)


def _char_bytes(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


@dataclass
class Normalizer:
    charmap: CharacterMap
    dummy_prefix: bool
    trim: bool

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes and, for each of them and the end, its source byte."""
        mark = MARK.encode()
        if not self.charmap.units and not self.trim:
            if not text:
                return b"", np.zeros(1, dtype=np.uint32)
            source = np.frombuffer(text, dtype=np.uint8)
            align = np.repeat(np.arange(len(source), dtype=np.uint32), 1 + 2 * (source == 32))
            prefix = mark if self.dummy_prefix else b""
            return prefix + text.replace(b" ", mark), np.concatenate(
                [np.zeros(len(prefix), np.uint32), align, [len(text)]]).astype(np.uint32)
        out, align, i, blank = bytearray(), [], 0, self.trim
        parts = []
        while i < len(text):
            hit = self.charmap.longest(text, i) if self.charmap.units else None
            step, new = hit if hit else (_char_bytes(text[i]), None)
            parts.append((i, text[i:i + step] if new is None else new))
            i += step
        if self.trim:  # blanks at the ends go
            while parts and not parts[0][1].strip(b" "):
                parts.pop(0)
        if not parts:
            return b"", np.zeros(1, dtype=np.uint32)
        if self.dummy_prefix:
            out += mark
            align += [parts[0][0]] * len(mark)
        for at, new in parts:
            if self.trim and blank:
                new = new.lstrip(b" ")
            for c in new:
                if c == 32:
                    out += mark
                    align += [at] * len(mark)
                else:
                    out.append(c)
                    align.append(at)
            blank = bytes(out).endswith(mark) if not new else new.endswith(b" ")
        end = len(text)
        if self.trim:
            while out.endswith(mark):
                end = align[len(out) - len(mark)]
                del out[-len(mark):], align[-len(mark):]
        return bytes(out), np.array([*align, end], dtype=np.uint32)


class Encoder:
    """The library's processor, the alignment and a bounded word cache."""

    def __init__(self, model: bytes):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb
        self.sp = spm.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        self.normalize = Normalizer(CharacterMap(spec.precompiled_charsmap),
                                    spec.add_dummy_prefix, spec.remove_extra_whitespaces)
        kind = pb.ModelProto.SentencePiece
        inner = re.compile(f"[^{MARK}]{MARK}")
        usual = {kind.NORMAL, kind.BYTE, kind.UNKNOWN, kind.CONTROL}
        self.by_word = (
            trainer.model_type == pb.TrainerSpec.BPE and spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
            and not trainer.treat_whitespace_as_suffix
            and all(p.type in usual and not inner.search(p.piece) for p in proto.pieces)
            and self.sp.piece_to_id(MARK) != self.sp.unk_id())
        #: Normalised bytes that an id covers; -1: as many as the text has there.
        self.length = np.array([
            1 if p.type == kind.BYTE else 0 if p.type == kind.CONTROL
            else -1 if p.type == kind.UNKNOWN else len(p.piece.encode()) for p in proto.pieces])
        self.words = WordCache(self._encode)
        self.mark_id = np.array([self.sp.piece_to_id(MARK)], dtype="<u4").tobytes()

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of ``words``, each a mark and what follows up to the next word;
        the library puts the first mark there itself."""
        ids = self.sp.encode([w[1:] for w in words], num_threads=1)
        return [np.array(i, dtype="<u4").tobytes() if len(w) > 1 else self.mark_id
                for w, i in zip(words, ids)]

    def ids(self, text: str) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit numbers."""
        if not self.by_word:
            return np.array(self.sp.encode(text, add_bos=True, add_eos=True), dtype="<u4").tobytes()
        words = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK)) if text else []
        ends = np.array([self.sp.bos_id(), self.sp.eos_id()], dtype="<u4")
        return ends[:1].tobytes() + self.words.ids(words) + ends[1:].tobytes()

    def bounds(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Source byte where each id begins, and where the last one ends; an id
        spans the bytes from its own bound to the next one's."""
        normal, align = self.normalize(text.encode())
        length = self.length[ids]
        if (length < 0).any():
            length = self._unknown(normal, ids, length)
        at = np.concatenate([[0], np.cumsum(length)])
        return align[np.minimum(at, len(align) - 1)].astype("<u4")

    def _unknown(self, normal: bytes, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Lengths where unknown ids cover runs without pieces: up to the next known piece."""
        length, at = length.copy(), 0
        for i, n in enumerate(length.tolist()):
            if n < 0:
                later = next((k for k in range(i + 1, len(ids)) if length[k] > 0), None)
                end = len(normal) if later is None else \
                    normal.index(self.sp.id_to_piece(int(ids[later])).encode(), at + 1)
                length[i] = n = end - at
            at += n
        return length

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


_ENCODERS: dict[int, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    """One encoder, with its word cache, per worker process and model."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def encoded(text: Column, model: bytes) -> Column:
    """Struct of ``ids`` and ``bounds`` (little-endian unsigned 32-bit numbers,
    one bound more than ids) and ``decoded`` (the library's decoding of the ids)."""
    @F.arrow_udf("struct<ids:binary,bounds:binary,decoded:string>")
    def of(texts: pa.Array) -> pa.Array:
        encoder = _encoder(model)
        ids, bounds, decoded = [], [], []
        for text in texts.to_pylist():
            raw = encoder.ids(text)
            numbers = np.frombuffer(raw, dtype="<u4")
            ids.append(raw)
            bounds.append(encoder.bounds(text, numbers).tobytes())
            decoded.append(encoder.decode(numbers))
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.binary()), pa.array(bounds, pa.binary()), pa.array(decoded, pa.string())],
            ["ids", "bounds", "decoded"])
    return of(text)


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
