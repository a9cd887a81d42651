"""Words of many texts at once, as 64-bit hashes, by array operations on code points.

A batch of texts becomes one array of code points; word limits come from a character table and word hashes from
prefix sums of a polynomial modulo 2**64, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@lru_cache
def letters_and_digits() -> np.ndarray:
    """True for every letter or digit of Unicode."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache
def ascii_letters_and_digits() -> np.ndarray:
    """True for a-z and 0-9 only."""
    found = np.zeros(0x110000, dtype=bool)
    found[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1)]] = True
    return found


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Characters hashed at a time; arrays of eight bytes a character are only ever this long.
CHUNK = 1 << 20


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    out = []
    for factor in (_BASE, _INVERSE):
        p = np.full(n + 1, factor, dtype=np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


def _chunks(texts: list[str], kind: np.ndarray) -> Iterator[list[tuple[int, str]]]:
    """Pieces (text number, piece) in groups of about CHUNK characters; long texts are cut outside words."""
    group, size = [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            stop = min(len(text), at + CHUNK)
            while stop < len(text) and kind[ord(text[stop])] and kind[ord(text[stop - 1])]:
                stop += 1
            group.append((k, text[at:stop]))
            size += stop - at
            at = stop
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


def _hash(pieces: list[str], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the pieces, and how many each piece has."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    codes = np.frombuffer("\n".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inside = np.zeros(len(codes) + 2, dtype=np.int8)
    inside[1:-1] = kind[codes]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    length = 1 << max(16, int(len(codes)).bit_length())
    powers, back = _powers(length)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=sums[1:])
    begins = np.zeros(len(pieces) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=begins[1:])
    return mix((sums[end] - sums[start]) * back[start]), np.diff(np.searchsorted(start, begins))


class Words:
    """`hashes` of all words in text order, `first` the first word of each text (with a last entry for the end)."""

    def __init__(self, texts: list[str], kind: np.ndarray):
        lowered = [t.lower() for t in texts]
        hashes, counts = [np.zeros(0, dtype=np.uint64)], np.zeros(len(texts), dtype=np.int64)
        for group in _chunks(lowered, kind):
            found, each = _hash([piece for _, piece in group], kind)
            hashes.append(found)
            np.add.at(counts, [k for k, _ in group], each)
        self.hashes = np.concatenate(hashes)
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all sequences of k words that stay within one text, and the text each belongs to."""
        h = self.hashes
        if len(h) < k:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        out = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            out = mix(out * _BASE + h[i : len(h) - k + 1 + i])
        owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        whole = owner[: len(out)] == owner[k - 1 :]
        return out[whole], owner[: len(out)][whole]
