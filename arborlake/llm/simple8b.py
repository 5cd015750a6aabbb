"""Simple-8b word-aligned coding of unsigned 64-bit integers, vectorised both ways.

A word has a 4-bit selector on top and 60 data bits; the selector says how many values of how many bits follow, the first
in the lowest bits. Selector 0 stands for one value over 60 bits, an escape, which is kept aside in order.
Values are coded in groups of GROUP that start at a word of their own, so any group can be decoded alone.
"""

from __future__ import annotations

import numpy as np

GROUP = 4096
#: By selector, how many values a word holds and of how many bits. Selector 0 is the escape.
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_COUNTS = np.array(COUNTS, np.int64)


_SHORT = np.array([max(1, i.bit_length()) for i in range(1 << 16)], np.uint8)


def bit_lengths(values: np.ndarray) -> np.ndarray:
    """At least 1 each."""
    top = int(values.max()) if len(values) else 0
    if top < len(_SHORT):
        return _SHORT[values.astype(np.uint16)]
    out = np.ones(len(values), np.uint8)
    for b in range(1, top.bit_length()):
        out += values >= np.uint64(1 << b)
    return out


def _selectors(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and its selector: at each start the selector that takes the most values without leaving the group."""
    n = len(bits)
    room = GROUP - np.arange(n, dtype=np.int32) % GROUP
    best = np.zeros(n, np.uint8)
    best[bits <= 60] = 14
    widest, have = bits.copy(), 1  # widest[i]: the most bits among bits[i : i + have], shorter at the end
    for s in range(13, 0, -1):
        c = COUNTS[s]
        while have < c and have < n:
            step = min(have, c - have)
            widest[:-step] = np.maximum(widest[:-step], widest[step:])
            have += step
        if c > n:
            break
        np.putmask(best[: n - c + 1], (widest[: n - c + 1] <= BITS[s]) & (room[: n - c + 1] >= c), s)
    jump, starts, i = _COUNTS[best].astype(np.uint8).tobytes(), [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    at = np.array(starts, np.int64)
    return at, best[at]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values; words may be those of many groups in a row, with all their escapes."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    stops = np.cumsum(_COUNTS[sel])
    out = np.empty(int(stops[-1]) if len(stops) else 0, np.uint64)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        if s == 0:
            out[stops[rows] - 1] = escapes
            continue
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        out[(stops[rows] - COUNTS[s])[:, None] + np.arange(COUNTS[s])] = (words[rows, None] >> shifts) & np.uint64((1 << BITS[s]) - 1)
    return out


def encode_groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and by group where its words and its escapes start, with a last entry for the end."""
    values = values.astype(np.uint64, copy=False)
    at, sel = _selectors(bit_lengths(values))
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(COUNTS)):
        rows = np.flatnonzero(sel == s)
        first = at[rows]
        for k in range(COUNTS[s] if len(rows) else 0):
            words[rows] |= values[first + k] << np.uint64(k * BITS[s])
    escaped = at[sel == 0]
    edges = np.append(np.arange(0, len(values), GROUP), len(values))
    return words, values[escaped], np.searchsorted(at, edges).astype("<u4"), np.searchsorted(escaped, edges).astype("<u4")
