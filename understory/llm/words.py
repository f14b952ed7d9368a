"""Words of texts as 64-bit hashes, whole batches at a time.

A word is a run of code points other than ASCII punctuation, white space and
control characters, in lower case. Texts are hashed as bytes with numpy: a
polynomial over prefix sums gives every word's hash without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1_000_000  # texts hashed at once; a longer text makes a chunk of its own
_BASE = 0x9E3779B97F4A7C15
_WORD_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public splitmix64 constants); keeps no structure of its input."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * CHUNK_BYTES)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of several texts, in order.

    ``hash`` is by word; ``text`` is the index of its text; ``first`` has for each
    text where its words begin, with one more entry at the end. ``start`` and
    ``end`` are byte offsets into ``blob``.
    """

    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    blob: bytes

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.first[i]:self.first[i + 1]]

    def normal(self, i: int) -> bytes:
        """The words of text ``i`` joined by single spaces."""
        lo, hi = self.first[i], self.first[i + 1]
        return b" ".join(self.blob[a:b] for a, b in zip(self.start[lo:hi], self.end[lo:hi], strict=True))


def hash_words(texts: list[str | None]) -> Words:
    """Hash all words of ``texts``; null texts have none."""
    parts = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    blob = b" ".join(parts) + b" "
    raw = np.frombuffer(blob, np.uint8)
    inside = _WORD_BYTE[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers_to(len(raw))
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * down[start])
    borders = np.cumsum([0] + [len(p) + 1 for p in parts])
    first = np.searchsorted(start, borders)
    text = np.repeat(np.arange(len(parts)), np.diff(first))
    return Words(hashed, text, first, start, end, blob)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, their first word's index, and their text."""
    n = len(words.hash) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    whole = np.flatnonzero(words.text[:n] == words.text[width - 1:])
    acc = np.zeros(len(whole), np.uint64)
    for j in range(width):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(_BASE) + words.hash[whole + j]
    return mix(acc), whole, words.text[whole]


def in_chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that hold about CHUNK_BYTES together."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
