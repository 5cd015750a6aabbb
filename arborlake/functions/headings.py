"""Headings of plain lines: their level, and lines that hold a heading and text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed
from .text import safe_truncate, trim, word_count


def heading_level(line: Column, trimmed: bool = False) -> Column:
    """1 to 4, or null for a line that is no heading; the first rule that holds counts. trimmed: the line has no white space at its ends."""
    t = line if trimmed else trim(line)
    n, low = F.octet_length(t), F.lower(t)
    ends = t.rlike(r"[.,;]$")
    bare = trim(F.regexp_replace(low, r":+$", ""))
    number = F.regexp_replace(F.regexp_extract(t, r"^\S+", 0), r"\.+$", "")
    return (
        F.when((n == 0) | (n > 120) | (ends & (n > 40)), None)
        .when(low.isin(fixed.SECTION_KEYWORDS) | bare.isin(fixed.SECTION_KEYWORDS), 2)
        .when(low.rlike("^(?:chapter|part) "), 1)
        .when(low.rlike("^(?:section|appendix) "), 2)
        .when(number.rlike(r"^[0-9]+(?:\.[0-9]+)*$") & (n <= 80), F.least(F.regexp_count(number, F.lit(r"\.")) + 1, F.lit(4)))
        .when((n >= 3) & (n <= 80) & t.rlike(r"^[\p{Lu}\s\p{Punct}0-9]+$") & t.rlike(r"\p{IsAlphabetic}"), 2)
        .when((n <= 60) & ~ends & t.rlike(r"^[\p{Lu}0-9]") & t.rlike(r"\p{IsAlphabetic}") & (word_count(t) <= 5), 3)
    )


def title(text: Column, mark: str = "...") -> Column:
    return F.when(F.octet_length(text) > 80, F.concat(safe_truncate(text, 80), F.lit(mark))).otherwise(text)


def _layers() -> list[list[str]]:
    """Section keywords, those first that no other keyword begins: of one layer at most one begins a line, and a later layer holds the longer ones."""
    out: dict[int, list[str]] = {}
    for kw in fixed.SECTION_KEYWORDS:
        out.setdefault(sum(kw != k and kw.startswith(k) for k in fixed.SECTION_KEYWORDS), []).append(kw)
    return [out[k] for k in sorted(out)]


def split_leading(line: Column) -> Column:
    """A section keyword at the start of a long line and the text behind it, as two lines; else the line. Keywords are tried longest first."""
    out = F.array(line)
    for layer in _layers():
        # one pattern for all keywords: an expression for each is too much for generated code, and was then interpreted
        start = rf"(?is)^({'|'.join(map(re.escape, layer))})(?: |:\s*)(.*)$"
        rest = trim(F.regexp_extract(line, start, 2))
        fits = (F.octet_length(rest) > 15) & rest.rlike(r"^[\p{Lu}0-9]")
        out = F.when(fits, F.array(F.regexp_extract(line, start, 1), rest)).otherwise(out)
    return F.when(F.octet_length(line) < 15, F.array(line)).otherwise(out)


#: Letters whose case re.IGNORECASE ignores though lower() does not, or changes the length.
_FOLDED = {"\u0130": "i", "\u0131": "i", "\u017f": "s"}


def _folded(line: str) -> str:
    """In lower case, with a place for each of the line's."""
    if not line.isascii():
        for c, low in _FOLDED.items():
            line = line.replace(c, low)
    return line.lower()


def _keyword_places(line: str) -> list[tuple[int, int, int]]:
    """(start, place in SECTION_KEYWORDS, end) of every keyword in a line, whatever its case, in this order."""
    low, out = _folded(line), []
    for k, kw in enumerate(fixed.SECTION_KEYWORDS):
        at = low.find(kw)
        while at >= 0:
            out.append((at, k, at + len(kw)))
            at = low.find(kw, at + 1)
    return sorted(out)


def fused_parts(line: str) -> list[str]:
    """A line cut wherever a section keyword runs into the text on its left, or into a capital or digit on its right. Keywords are sought once, however many cuts there are."""
    out, start, places = [], 0, _keyword_places(line)
    for at, _, end in places:
        if at < start:
            continue
        left = at > start and line[at - 1] not in " \n"
        right = end < len(line) and (line[end].isupper() or line[end] in "0123456789")
        if left or right:
            if before := line[start:at].strip():
                out.append(before)
            out.append(line[at:end])
            start = end
            while start < len(line) and line[start].isspace():
                start += 1
    if not out:
        return [line]
    if rest := line[start:].strip():
        out.append(rest)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_fused(lines: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in lines:
        yield batch.map(lambda s: None if s is None else fused_parts(s))
