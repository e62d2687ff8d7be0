"""Induced sorting against sorting all suffixes."""

import numpy as np
import pytest

from tabulon.llm import induced


def prefix(b, x, y, cap):
    k = 0
    while k < cap and x + k < len(b) and y + k < len(b) and b[x + k] == b[y + k]:
        k += 1
    return k


def _texts():
    rng = np.random.default_rng(1)
    for trial in range(250):
        if trial % 3:
            yield np.append(rng.integers(1, 1 + rng.integers(1, 5), rng.integers(1, 80)), 0)
        else:
            yield np.append(np.tile(rng.integers(1, 4, rng.integers(1, 5)), 12), 0)


@pytest.mark.parametrize("memory,chunk,block", [(0, 3, 1), (100, 7, 8), (1 << 20, 1 << 20, 1 << 12)])
def test_orders_and_common_prefixes(monkeypatch, memory, chunk, block):
    monkeypatch.setattr(induced, "CHUNK", chunk)
    monkeypatch.setattr(induced, "BLOCK", block)
    monkeypatch.setattr(induced.DiskQueue.__init__, "__defaults__", (memory,))
    rng = np.random.default_rng(2)
    for text in _texts():
        b = text.tolist()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert induced.suffix_order(text).tolist() == want
        cap = int(rng.integers(1, 30))
        for kind in (np.uint8, np.uint16):
            runs = list(induced.sorted_suffixes(text.astype(kind), cap))
            places = np.concatenate([p for p, _ in runs])
            common = np.concatenate([c for _, c in runs])
            assert places.tolist() == want[:0:-1]
            assert common.tolist() == [0] + [prefix(b, x, y, cap) for x, y in zip(places[1:], places)]


def test_queue_keeps_the_order_of_arrival_on_disk():
    queue, held = induced.DiskQueue(64), {k: [] for k in range(3)}
    for i in range(60):
        part = np.arange(i, i + i % 4)
        queue.push(i % 3, part, part.astype(np.int16))
        held[i % 3] += part.tolist()
    assert queue.file is not None
    for k in range(3):
        got = list(queue.pop(k))
        assert [x for p, _ in got for x in p.tolist()] == held[k] == [x for _, c in got for x in c.tolist()]
