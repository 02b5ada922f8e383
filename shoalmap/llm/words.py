"""Words and rolling hashes of many texts at once, for use inside tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text; a null text has no word.
Texts are worked on in blocks of about a megabyte, so memory does not grow with a partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """`bytes.split` cuts at exactly the bytes 0x20 and 0x09-0x0D; `lower` changes A-Z only."""
    if not text:
        return []
    return text.encode().lower().split() if lower else text.encode().split()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Roll:
    """Polynomial hash of any byte range from one prefix sum, modulo 2^64."""

    def __init__(self, which: int):
        self.table = mixed(np.arange(1, 257, dtype=np.uint64) * _SEEDS[which])
        self.base = int(mixed(_SEEDS[which : which + 1] if which == 0 else np.array([_SEEDS[1]]))[0]) | 1
        self.back = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.back)):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * self.down[start])


_ROLLS: list[Roll] = []


def roll(which: int) -> Roll:
    """The two hashes are made once per Python worker."""
    while len(_ROLLS) <= which:
        _ROLLS.append(Roll(len(_ROLLS)))
    return _ROLLS[which]


class Block:
    """Words of several texts, end to end. `rows` are the places of the texts in the caller's list."""

    def __init__(self, rows: list[int], texts: list[list[bytes]]):
        self.rows = rows
        self.words = [w for t in texts for w in t]
        counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.counts = counts
        self.first = np.cumsum(counts) - counts
        self.joined = b" ".join(self.words) + b" " if self.words else b""
        self.data = np.frombuffer(self.joined, dtype=np.uint8)
        self.ends = np.flatnonzero(self.data == 32)
        self.starts = np.concatenate([np.zeros(1, dtype=np.int64), self.ends[:-1] + 1]) if len(self.ends) else self.ends
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.stop = np.repeat(self.first + counts, counts)
        self._prefix: dict[int, np.ndarray] = {}

    def place(self, i: np.ndarray) -> np.ndarray:
        """Place of a word inside its text."""
        return i - self.first[self.text[i]]

    def whole(self, size: int) -> np.ndarray:
        """First words of all windows of `size` words that stay in one text."""
        at = np.arange(len(self.words))
        return at[at + size <= self.stop]

    def hashes(self, start: np.ndarray, size: int | np.ndarray, which: int = 0) -> np.ndarray:
        """Hash of the `size` words from each start, joined by single spaces."""
        if which not in self._prefix:
            self._prefix[which] = roll(which).prefix(self.data)
        return roll(which).ranges(self._prefix[which], self.starts[start], self.ends[start + size - 1])


def blocks(texts: Iterable[str | None], size: int = BLOCK_BYTES, lower: bool = False) -> Iterator[Block]:
    """Whole texts in blocks of at most `size` bytes; a longer text is a block of its own."""
    rows, held, total = [], [], 0
    for row, text in enumerate(texts):
        n = len(text) if text else 0
        if held and total + n > size:
            yield Block(rows, held)
            rows, held, total = [], [], 0
        rows.append(row)
        held.append(words_of(text, lower))
        total += n
    if held:
        yield Block(rows, held)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)
