"""Word shingle sets of whole texts as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from .caches import register

#: Words: runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    text = text.lower() if text.isascii() else text.translate(_LOWER)
    return WORD.findall(text)


class WordHasher:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self, most: int = 100_000):
        self.known: dict[str, int] = {}
        self.most = most

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


HASHER = WordHasher()
register("shingles", HASHER.known.clear)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, in order; of all the words if there are fewer."""
    n = min(n, len(hashes))
    if n == 0:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _MIX[0] + hashes[i : len(hashes) - n + 1 + i])
    return out


def shingle_set(text: str, n: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending; empty for a text without words."""
    return np.unique(rolling(HASHER(words_of(text)), n))


_BYTE = np.random.default_rng(17).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(18).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_stream(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of each word's text. inside says by byte value what words are made of, 0 to 255, blank not."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    solid = inside[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = np.flatnonzero(solid)
    start = np.flatnonzero(first[at])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = np.diff(np.append(start, len(at)))
    place = np.arange(len(at), dtype=np.int32) - np.repeat(start.astype(np.int32), length)
    hashes = np.add.reduceat(_BYTE[data[at]] * _PLACE[place & 4095], start)
    return mix(hashes ^ length.astype(np.uint64)), np.searchsorted(ends, at[start], side="right")
