"""Suffix order and common prefixes by external induced sorting.

The suffixes of a text are L or S type (larger or smaller than their
successor); S* suffixes are the S suffixes after an L one.  The substrings
between S* places are sorted and named; unless the names are unique, the
string of names is sorted by the same induction, recursively.  From the sorted
S* suffixes all L suffixes are induced in one ascending sweep, and from those
all S suffixes in one descending sweep.

A sweep is driven by a priority queue of tuples (first symbol, order of
arrival, place, common prefix with the tuple before it in its bucket).  Tuples
reach a bucket in their final order, so the queue keeps one first-in first-out
run per bucket, on disk beyond a memory bound.  The common prefix of two
neighbours is one more than the least of those between the suffixes that
induced them; it is carried through the queue, capped at the length asked for.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Bytes of queued tuples kept in memory, and tuples handled at once.
QUEUE_BYTES, CHUNK = 32 << 20, 1 << 20
#: Symbols of the names' strings are swept in blocks of about this many places.
BLOCK = 1 << 12


class DiskQueue:
    """First-in first-out runs of (place, common prefix) per key, popped by key."""

    def __init__(self, memory: int = QUEUE_BYTES):
        self.memory, self.held = memory, 0
        self.runs: dict[int, list] = defaultdict(list)
        self.file = None

    def push(self, key: int, places: np.ndarray, prefix: np.ndarray):
        self.runs[key].append((places, prefix))
        self.held += places.nbytes + prefix.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self):
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for key, run in self.runs.items():
            for i, (places, prefix) in enumerate(run):
                if isinstance(places, np.ndarray):
                    at = self.file.tell()
                    self.file.write(places.astype("<i8").tobytes())
                    self.file.write(prefix.astype("<i2").tobytes())
                    run[i] = (at, (len(places), len(prefix)))
        self.held = 0

    def pop(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The runs of ``key`` in the order of arrival; it may grow meanwhile."""
        run = self.runs[key]
        while run:
            first, second = run.pop(0)
            if isinstance(first, np.ndarray):
                self.held -= first.nbytes + second.nbytes
                yield first, second
            else:
                n, m = second
                self.file.seek(first)
                raw = self.file.read(8 * n + 2 * m)
                yield np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i2", m, 8 * n)


def larger_types(text: np.ndarray) -> np.ndarray:
    """True at L suffixes.  The last symbol is unique and the least, of S type."""
    n = len(text)
    falls = np.zeros(n, dtype=bool)
    falls[:-1] = text[:-1] > text[1:]
    differs = np.ones(n, dtype=bool)
    differs[:-1] = text[:-1] != text[1:]
    # a place of a run of equal symbols has the type of the run's last place
    last = np.flatnonzero(differs)
    return falls[last[np.searchsorted(last, np.arange(n))]]


def _whole(n: int) -> type:
    """The number type for places of ``n`` symbols."""
    return np.int32 if n < 2**31 - 1 else np.int64


def star_places(larger: np.ndarray) -> np.ndarray:
    return (np.flatnonzero(~larger[1:] & larger[:-1]) + 1).astype(_whole(len(larger)))


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common symbols from places ``a`` and ``b`` on, at most ``cap``."""
    size, step = text.itemsize, 8 // text.itemsize
    raw = np.concatenate([text, np.zeros(cap + 8, dtype=text.dtype)])
    words = np.ndarray(len(raw) - step + 1, dtype="<u8", buffer=raw, strides=(size,))
    out = np.full(len(a), cap, dtype=np.int16)
    at = np.arange(len(a))
    for k in range(0, cap, step):
        diff = words[np.minimum(a[at] + k, len(words) - 1)] ^ words[np.minimum(b[at] + k, len(words) - 1)]
        here = diff != 0
        if here.any():
            low = diff[here] & (~diff[here] + np.uint64(1))  # lowest set bit
            bit = np.bitwise_count(low - np.uint64(1)).astype(np.int64)
            out[at[here]] = np.minimum(cap, k + bit // (8 * size))
            at = at[~here]
        if not len(at):
            break
    return out


def name_substrings(text: np.ndarray, larger: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks from 1 of the substrings from each S* place to the next; places of
    one symbol differ by type, L before S."""
    symbols = text.astype(np.uint64) * np.uint64(2) + (~larger).astype(np.uint64) + np.uint64(1)
    bits = max(1, int(symbols.max()).bit_length())
    per = max(1, 62 // bits)
    length = np.diff(np.append(stars, stars[-1])) + 1
    name, open_ = np.zeros(len(stars), dtype=np.uint64), np.arange(len(stars))
    done = 0
    while len(open_):
        key = np.zeros(len(open_), dtype=np.uint64)
        for k in range(done, done + per):
            inside = length[open_] > k
            symbol = np.where(inside, symbols[np.minimum(stars[open_] + k, len(text) - 1)], np.uint64(0))
            key = key << np.uint64(bits) | symbol
        # order by the name so far, then by these symbols
        order = np.lexsort((key, name[open_]))
        n, s = name[open_][order], key[order]
        fresh = np.append(True, (n[1:] != n[:-1]) | (s[1:] != s[:-1]))
        group = np.flatnonzero(fresh)
        # names are places in the order of all: a group starts where its old name did
        old = np.append(True, n[1:] != n[:-1])
        begin = np.maximum.accumulate(np.where(old, np.arange(len(n)), 0))
        at = np.maximum.accumulate(np.where(fresh, np.arange(len(n)), 0))
        name[open_[order]] = n + (at - begin).astype(np.uint64)
        done += per
        size = np.repeat(np.diff(np.append(group, len(n))), np.diff(np.append(group, len(n))))
        more = (size > 1) & (length[open_[order]] > done)
        # a group goes on as a whole if one of its members does
        goes = np.repeat(np.maximum.reduceat(more, group), np.diff(np.append(group, len(n)))) if len(n) else more
        open_ = open_[order][goes]
    return np.unique(name, return_inverse=True)[1].astype(_whole(len(name))) + 1


def sort_stars(text: np.ndarray, larger: np.ndarray) -> np.ndarray:
    """S* places in the order of their suffixes."""
    stars = star_places(larger)
    if len(stars) < 2:
        return stars
    names = name_substrings(text, larger, stars)
    if names.max() == len(names):
        order = np.empty(len(names), dtype=_whole(len(names)))
        order[names - 1] = np.arange(len(names))
    else:  # the last name is unique and the least: it holds the end
        order = suffix_order(names - 1)
    return stars[order]


# ---------------------------------------------------------- strings of names
def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes; the last symbol is 0 and unique."""
    if len(text) == 1:
        return np.zeros(1, dtype=_whole(1))
    larger = larger_types(text)
    up = _sweep_blocks(text, larger, sort_stars(text, larger))
    seeds = up[larger[up]]
    top = int(text.max())
    down = _sweep_blocks(top - text, ~larger, seeds[::-1])
    return np.append(len(text) - 1, down[::-1])


def _sweep_blocks(text: np.ndarray, target: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """``seeds`` (in order) and the ``target`` suffixes that they induce, in order.
    Neighbouring symbols are swept as one block; what a block induces in itself
    is put in its place round by round."""
    count = np.bincount(text)
    edge = np.unique(np.cumsum(count) // BLOCK, return_index=True)[1]
    alone = np.flatnonzero(count >= BLOCK // 8)  # frequent symbols are blocks of their own
    edge = np.unique(np.concatenate([edge, alone, alone + 1]))
    edge = edge[edge < len(count)]
    block_of = np.searchsorted(edge, np.arange(len(count)), side="right") - 1
    single = np.diff(np.append(edge, len(count))) == 1
    starts = np.searchsorted(block_of[text[seeds]], np.arange(len(edge) + 1))
    queue, rank, out = DiskQueue(), np.zeros(len(text) + 1, dtype=_whole(len(text))), []
    none = np.zeros(0, dtype=seeds.dtype)
    for b in range(len(edge)):
        came = np.concatenate([none, *[p for p, _ in queue.pop(b)]])
        own, extra = seeds[starts[b]:starts[b + 1]], none
        if not len(came) and not len(own):
            continue
        if single[b]:  # what a symbol induces in its own bucket comes after what it had
            rounds = [came]
            while len(rounds[-1]):
                before = rounds[-1][rounds[-1] > 0] - 1
                rounds.append(before[target[before] & (text[before] == edge[b])])
            places = np.concatenate([*rounds, own])
            before = places[places > 0] - 1
            before = before[target[before]]
            inside = text[before] == edge[b]
        while not single[b]:
            places = np.concatenate([came, extra, own])
            seed = np.arange(len(places)) >= len(came) + len(extra)
            turn = np.concatenate([np.arange(len(came)), len(came) + rank[extra + 1], np.arange(len(own))])
            symbol = text[places].astype(np.int64) * 2 + seed
            order = np.argsort(symbol * (2 * len(places) + 1) + turn)
            places = places[order]
            rank[places] = np.arange(len(places))
            before = places[places > 0] - 1
            before = before[target[before]]
            inside = block_of[text[before]] == b
            if inside.sum() == len(extra):
                break
            extra = before[inside]
        out.append(places)
        later = before[~inside]
        if len(later):
            key = block_of[text[later]]
            by = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(key[by]) > 0))
            for i, part in zip(cut, np.split(later[by], cut[1:])):
                queue.push(int(key[by][i]), part, np.zeros(0, np.int16))
    return np.concatenate(out) if out else none


# --------------------------------------------------- bytes, with common prefixes
def sorted_suffixes(text: np.ndarray, cap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of (places, common prefix with the suffix before) in descending order
    of the suffixes, of small symbols that end in a unique 0.  In the order given,
    "before" is the larger neighbour."""
    larger = larger_types(text)
    stars = sort_stars(text, larger)
    prefix = np.zeros(len(stars), dtype=np.int16)
    prefix[1:] = common_prefix(text, stars[1:], stars[:-1], cap)
    places, prefixes = [], []
    for p, c, seed in _sweep(text, larger, stars, prefix, cap):
        if not seed:
            places.append(p)
            prefixes.append(c)
    none = np.zeros(0, dtype=np.int64)
    up, prefix = np.concatenate([none, *places]), np.concatenate([none.astype(np.int16), *prefixes])
    # read from the other end, a suffix's neighbour before it is the one that came after
    seeds, prefix = up[::-1], np.append(np.int16(0), prefix[:0:-1]) if len(up) else prefix
    top = text.dtype.type(text.max())
    for p, c, _ in _sweep(top - text, ~larger, seeds, prefix, cap):
        yield p, c


def _sweep(text: np.ndarray, target: np.ndarray, seeds: np.ndarray, prefix: np.ndarray,
           cap: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Symbol by symbol the induced suffixes, then the seeds, with the common
    prefix of each and the one before it."""
    queue = DiskQueue()
    symbols = int(text.max()) + 1
    #: Least prefix since the last tuple sent to a bucket; -1: none sent yet.
    since = np.full(symbols, -1, dtype=np.int16)
    starts = np.searchsorted(text[seeds], np.arange(symbols + 1))
    last_of_run = np.flatnonzero(np.append(text[:-1] != text[1:], True))

    def run_length(place: int) -> int:
        """Equal symbols from a place on."""
        return int(last_of_run[np.searchsorted(last_of_run, place)]) - place + 1

    def send(places: np.ndarray, prefix: np.ndarray):
        ok = np.flatnonzero((places > 0) & target[places - 1])
        before = places[ok] - 1
        to = text[before]
        by = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1])) if len(by) else []
        least = prefix.min()
        fresh = np.minimum(since, np.where(since < 0, np.int16(-1), least))
        for a, b in zip(cut, [*cut[1:], len(by)]):
            at, key = ok[by[a:b]], int(to[by[a]])
            segments = np.minimum.reduceat(prefix, np.append(0, at + 1)[:len(at) + (at[-1] + 1 < len(prefix))])
            own = segments[:len(at)].copy()
            own[0] = min(own[0], since[key])
            fresh[key] = segments[len(at)] if len(segments) > len(at) else cap
            queue.push(key, before[by[a:b]], np.minimum(cap, own + 1).astype(np.int16))
        since[:] = fresh

    for c in range(symbols):
        last = None
        for places, common in queue.pop(c):
            for i in range(0, len(places), CHUNK):
                part = places[i:i + CHUNK], common[i:i + CHUNK]
                yield *part, False
                send(*part)
            last = places[-1]
        own = seeds[starts[c]:starts[c + 1]]
        if len(own):
            common = prefix[starts[c]:starts[c + 1]].copy()
            # the last induced and the first seed part where the shorter run of c ends
            common[0] = 0 if last is None else min(
                cap, run_length(int(last)), run_length(int(own[0])))
            for i in range(0, len(own), CHUNK):
                part = own[i:i + CHUNK], common[i:i + CHUNK]
                yield *part, True
                send(*part)
