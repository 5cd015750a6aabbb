"""Query understanding: intent, search terms, complexity and the enrichment gate, all as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import word_count, words


def any_of(phrases: list[str]) -> str:
    return "|".join(re.escape(p) for p in phrases)


def intent(query: Column) -> Column:
    low = F.lower(query)
    out = F.when(low.rlike(f"^(?:{any_of(fixed.FACTUAL_PREFIXES)})"), "factual").otherwise("specific")
    for name, phrases in reversed(fixed.INTENT_PHRASES.items()):
        out = F.when(low.rlike(any_of(phrases)), name).otherwise(out)
    return out


def search_terms(query: Column) -> Column:
    """Lower-cased words of letters, digits, - and _ over two bytes that are no stop words; in order, repeats kept."""
    parts = F.transform(F.split(query, r"[^\p{IsAlphabetic}\p{N}_-]"), F.lower)
    return F.filter(parts, lambda w: (F.octet_length(w) > 2) & ~w.isin(fixed.QUERY_STOP_WORDS))


def fallback_terms(query: Column) -> Column:
    """For a query without search terms: its first three words over three bytes."""
    return F.transform(F.slice(F.filter(words(query), lambda w: F.octet_length(w) > 3), 1, 3), F.lower)


def fetch_terms(query: Column) -> Column:
    terms = search_terms(query)
    return F.slice(F.when(F.size(terms) > 0, terms).otherwise(fallback_terms(query)), 1, fixed.TERMS_PER_QUERY)


def merge_terms(terms: Column, *more: Column) -> Column:
    """terms, then those of each further list that are not yet there."""
    for new in more:
        terms = F.concat(terms, F.array_except(new, terms))
    return terms


def _by_intent(kind: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), kind)


def complexity(query: Column) -> Column:
    n, k = word_count(query), F.size(search_terms(query))
    long, many = F.when(n > 20, 2).when(n > 10, 1).otherwise(0), F.when(k > 4, 2).when(k > 2, 1).otherwise(0)
    return _by_intent(intent(query), fixed.INTENT_BASE) + long + many


def recommended_steps(query: Column) -> Column:
    return F.least(F.greatest(2 * complexity(query) + 4, F.lit(6)), F.lit(15))


def min_tool_calls(kind: Column) -> Column:
    return _by_intent(kind, fixed.MIN_TOOL_CALLS)


def hint(query: Column) -> Column:
    terms = search_terms(query)
    listed = F.array_join(F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    return F.concat(_by_intent(intent(query), fixed.INTENT_HINTS), F.when(F.size(terms) > 0, F.concat(F.lit("\nRecommended search terms: "), listed)).otherwise(""))


def wants_enrichment(query: Column, engine_loaded: bool = True) -> Column:
    n, k, kind = word_count(query), F.size(search_terms(query)), intent(query)
    out = F.when((n <= 3) | (k < 3) | (kind == "summarize"), True).when((n >= 8) & (k >= 4), False)
    out = out.when(kind.isin("comparison", "list_extract") & (k >= 3), False).when(kind.isin("entity", "factual") & (k >= 4), False).otherwise(True)
    return out & F.lit(engine_loaded)
