"""Terms of whole texts: runs of bytes that a table keeps, A-Z lower-cased. Bytes above 0x7F belong to terms, so a cut between terms never parts a character."""

from __future__ import annotations

from collections.abc import Iterator

_PIECE = 4_000_000


def byte_table(digits: bool) -> bytes:
    """For bytes.translate: letters, bytes above 0x7F and, if asked for, digits stay; all others become blanks."""
    keep = [*range(0x80, 0x100), *range(0x61, 0x7B), *(range(0x30, 0x3A) if digits else ())]
    out = bytearray(b" " * 256)
    for c in keep:
        out[c] = c
    for c in range(0x41, 0x5B):
        out[c] = c + 32
    return bytes(out)


def term_lists(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms in order, those of a few MB of text at a time."""
    if len(text) <= _PIECE:
        yield text.translate(table).split()
        return
    at = 0
    while at < len(text):
        stop = at + _PIECE
        while stop < len(text) and table[text[stop]] != 32:  # a term longer than a piece stays whole
            stop += 1
        yield text[at:stop].translate(table).split()
        at = stop
