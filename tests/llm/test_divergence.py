"""The divergence audit against a plain version over all terms and pairs, and against its SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from arborlake.llm import divergence
from arborlake.llm.terms import byte_table, term_lists
from verify import rows_of

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top):
    texts = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in texts:
        groups[lang].add(source)
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        p = {}
        for s in [*sources, None]:
            n = counts[lang, s] if s is not None else sum((counts[lang, x] for x in sources), Counter())
            total = sum(n[t] for t in kept)
            p[s] = {t: 1 + 1_000_000_000 * (n[t] + 2) // (total + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-f(p[s][t], p[None][t]), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def result(df, **options):
    return sorted(map(tuple, divergence.divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()))


SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, part string"


def made(n, sources, words):
    return [(f"w{i % words} w{i * i % words} Ähm-{'x' * (i % 7)} z{'y' * (i % sources)}", "en" if i % 3 else None, f"s{i % sources}" if i % sources else None) for i in range(n)]


def test_against_plain(spark):
    rows = [*made(500, 9, 40), ("", "de", "a"), (None, "de", "b"), ("only here", "de", "b"), ("x" * 30, "fr", "one"), *([("tie tie", "tt", "a"), ("tie tie", "tt", "b")] * 6), ("lang null", None, None), ("DIGITS9in12words", "en", "s1")]
    df = spark.createDataFrame([(i % 50, *r, "clash", 1, "p") for i, r in enumerate(rows)], SCHEMA).repartition(7)
    assert result(df) == plain(rows, 10, 10)
    assert result(df, least=1, top=3) == plain(rows, 1, 3)


def test_flushes(monkeypatch):
    """The scans, with bounds so small that all of them are met, give the same sums."""
    rows = made(400, 9, 60)
    given = pa.RecordBatch.from_arrays([pa.array([r[1] or "" for r in rows]), pa.array([r[2] or "" for r in rows]), pa.array([r[0].encode() for r in rows])], names=["lang", "source", "text"])

    def run():
        parts = list(divergence._partials(iter([given])))
        order = [("lang", "ascending"), ("term", "ascending"), ("source", "ascending")]
        counted = pa.Table.from_batches(divergence._counted(3)(iter(pa.Table.from_batches(parts).sort_by(order).to_batches(max_chunksize=11))), divergence._COUNTED)
        kept = sorted((r for r in counted.to_pylist() if r["term"]), key=lambda r: (r["lang"], r["term"], r["source"] is not None, r["source"] or ""))
        scored = pa.Table.from_pylist([{"lang": r["lang"], "term": r["term"], "source": r["source"], "p": 1000 * r["n"] + len(r["term"]), "p0": 1 + len(r["source"] or "")} for r in kept])
        pairs, terms = Counter(), defaultdict(list)
        for r in pa.Table.from_batches(divergence._emitted(2)(iter(scored.to_batches(max_chunksize=7)))).to_pylist():
            if r["part"] == "pair":
                pairs[r["lang"], frozenset((r["source"], r["item"]))] += r["value"]
            else:
                terms[r["lang"], r["source"]].append((-r["value"], r["item"]))
        return len(parts), kept, pairs, {k: sorted(v)[:2] for k, v in terms.items()}

    one = run()
    monkeypatch.setattr(divergence, "_HELD_ENTRIES", 20)
    monkeypatch.setattr(divergence, "_HELD_PAIRS", 8)
    monkeypatch.setattr(divergence, "_HELD_ROWS", 5)
    many = run()
    assert one[1:] == many[1:]
    assert one[0] < many[0]
    total = Counter()
    for text, lang, source in rows:
        total.update((lang or "", t, source or "") for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)))
    kept = {(r["lang"], r["term"]) for r in one[1]}
    assert {(r["lang"], r["term"], r["source"]): r["n"] for r in one[1] if r["source"] is not None} == {k: n for k, n in total.items() if k[:2] in kept}


def test_odd_rows(spark, odd, none):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert result(odd, least=1) == plain(rows, 1, 10)
    assert result(odd) == plain(rows, 10, 10) == []
    assert result(none) == []


@pytest.mark.parametrize("digits", [True, False])
def test_long_terms_stay_whole(digits):
    table = byte_table(digits)
    text = ("é" * 3_000_001 + " a9b " + "漢" * 2_000_000 + " End").encode()
    got = [t for part in term_lists(text, table) for t in part]
    assert got == ["é".encode() * 3_000_001, *([b"a9b"] if digits else [b"a", b"b"]), "漢".encode() * 2_000_000, b"end"]


def test_query(spark, sf):
    df = divergence.op12_source_divergence(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel = con.sql(divergence.OP12_SQL)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
