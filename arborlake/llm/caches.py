"""Caches of a worker process. Workers are used again by later stages; an operator that starts work empties the caches of all others, so that a worker never holds two."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

_CLEAR: dict[str, Callable[[], None]] = {}
_now = ""


def register(name: str, clear: Callable[[], None]) -> None:
    _CLEAR[name] = clear


def claim(name: str) -> None:
    global _now
    if name != _now:
        _now = name
        for other, clear in _CLEAR.items():
            if other != name:
                clear()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # not this C library
            pass
