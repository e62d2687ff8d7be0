"""A bounded cache of encoded words, one per worker process."""

from __future__ import annotations

from collections.abc import Callable


class WordCache(dict):
    """Words and their ids as bytes.  Two generations of about ``bound`` bytes (a
    word counts its characters and a fixed share): a full one becomes the old
    one, whose words come back when used."""

    SHARE = 150

    def __init__(self, encode: Callable[[list[str]], list[bytes]], bound: int = 40 << 20):
        super().__init__()
        self.encode, self.bound, self.load, self.old = encode, bound, 0, {}

    def fill(self, words) -> None:
        """Make all ``words`` known; those new are encoded at once."""
        if self.load > self.bound:
            self.old, self.load = dict(self), 0
            self.clear()
        missing = {w for w in words if w not in self}
        if not missing:
            return
        old = self.old
        new = [w for w in missing if w not in old]
        if len(new) < len(missing):
            self.update((w, old[w]) for w in missing if w in old)
        if new:
            self.update(zip(new, self.encode(new)))
        self.load += sum(map(len, missing)) + self.SHARE * len(missing)

    def ids(self, words: list[str]) -> bytes:
        """Ids of ``words``, joined."""
        self.fill(words)
        return b"".join([self[w] for w in words])
