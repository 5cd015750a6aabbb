"""Source divergence audit: how far the vocabularies of a language's sources are apart, and which terms a source has too many of.

Sort-based streaming. Each task counts its documents' terms for each (lang, source) and gives them off as partial runs, so that no term, source or text is hot in the shuffle. Repartitioned by
(lang, term) and sorted by (lang, term, source), a run-length scan adds up the runs: documents and counts of each term, source by source, a batch of rows and one
term's sources at a time. A second scan of the kept terms, now with their probabilities, emits for each run the partial sums of its pairs of sources and its terms.

Pairs are exact without a row for every absent term. With f0 the value of a pair where both lack a term, a term that both have adds f less what the pair would get if one lacked it; what
one source has adds by the histogram of its probabilities, for every other source; and all kept terms add f0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_tables, quoted, read_table, stored, text_of
from .terms import byte_table, term_lists

_TABLE = byte_table(digits=False)
_HELD_ENTRIES, _HELD_BYTES, _HELD_PAIRS, _HELD_ROWS = 600_000, 64_000_000, 500_000, 100_000
_DOC = 1 << 40  # documents are counted above so many occurrences

_PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("docs", pa.int64()), ("n", pa.int64())])
_COUNTED = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64())])
_EMITTED = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, source, text): lang, term, source, documents with the term, its occurrences, summed over a task's documents; and a row with an empty term for each (lang, source)."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    seen = entries = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            terms = pa.array([*own, b""], pa.binary()).cast(pa.string())
            both = [*own.values(), 0]
            counts = (pa.array([v // _DOC for v in both], pa.int64()), pa.array([v % _DOC for v in both], pa.int64()))
            whole = pa.RecordBatch.from_arrays([pa.repeat(lang, len(terms)), terms, pa.repeat(source, len(terms)), *counts], schema=_PARTIAL)
            yield from (whole.slice(i, 50_000) for i in range(0, len(terms), 50_000))

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = text.as_py()
            counts: Counter = Counter()
            for terms in term_lists(raw, _TABLE):
                counts.update(terms)
            own = held.setdefault((lang, source), {})
            entries -= len(own)
            for term, n in counts.items():
                own[term] = own.get(term, 0) + n + _DOC
            entries += len(own)
            seen += len(raw)
            if seen > _HELD_BYTES or entries > _HELD_ENTRIES:
                yield from flush()
                held, seen, entries = {}, 0, 0
    yield from flush()


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value is not the one before it, from the second on; no value is null."""
    return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)


def _whole_runs(batches: Iterator[pa.RecordBatch], fold: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows (lang, term, ...) cut between runs of one (lang, term), and where each run starts. A run that goes on is folded when it is long."""
    rest = None

    def starts_of(rows: pa.RecordBatch) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], _changes(rows.column(0)) | _changes(rows.column(1))]))

    for b in batches:
        if b.num_rows:
            rows = b if rest is None else pa.concat_batches([rest, b])
            starts = starts_of(rows)
            last = int(starts[-1])
            if last:
                yield rows.slice(0, last), starts[:-1]
            rest = rows.slice(last)
            if rest.num_rows > _HELD_ROWS:
                rest = fold(rest)
    if rest is not None:
        yield rest, starts_of(rest)


def _by_source(rows: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted partial runs: where each source of each run starts, and its documents and occurrences."""
    at = np.union1d(starts, np.flatnonzero(_changes(rows.column(2))) + 1)
    return at, np.add.reduceat(rows.column(3).to_numpy(), at), np.add.reduceat(rows.column(4).to_numpy(), at)


def _fold(rows: pa.RecordBatch) -> pa.RecordBatch:
    """A long run of partial counts with one row for each source."""
    at, docs, n = _by_source(rows, np.zeros(1, np.int64))
    return pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(at)) for c in range(3)), pa.array(docs), pa.array(n)], schema=rows.schema)


def _counted(least: int):
    """The scan of sorted partial runs: lang, term, source, n of terms in at least least documents, with a row without source for the whole language; and the rows with an empty term."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in _whole_runs(batches, _fold):
            at, docs, n = _by_source(rows, starts)
            first = np.searchsorted(at, starts)
            mark = pc.equal(rows.column(1).take(pa.array(starts)), "").to_numpy(zero_copy_only=False)
            kept = (np.add.reduceat(docs, first) >= least) & ~mark
            whole, own = np.flatnonzero(kept), np.flatnonzero(np.repeat(kept | mark, np.diff([*first, len(at)])))
            if len(whole):
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(starts[whole])) for c in (0, 1)), pa.nulls(len(whole), pa.string()), pa.array(np.add.reduceat(n, first)[whole])], schema=_COUNTED)
            if len(own):
                yield pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(at[own])) for c in (0, 1, 2)), pa.array(n[own])], schema=_COUNTED)

    return scan


def _f(p, q):
    return (p - q) ** 2 // (p + q)


class _Pairs:
    """Sums for pairs of sources, by their numbers, combined when many are held."""

    def __init__(self):
        self.keys, self.values, self.held = [], [], 0

    def add(self, run: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray) -> None:
        """Every two rows of a run; runs are in order, each source at most once in each."""
        step = 0
        while True:
            step += 1
            i = np.flatnonzero(run[step:] == run[:-step]) if step < len(run) else []
            if not len(i):
                return
            j = i + step
            a, b, a0, b0 = p[i], p[j], p0[i], p0[j]
            self.keys.append((source[i] << 31) | source[j])
            self.values.append(_f(a, b) - _f(a, b0) - _f(a0, b) + _f(a0, b0))
            self.held += len(i)
            if self.held > 4 * _HELD_PAIRS:
                self.combine()

    def combine(self) -> None:
        if self.keys:
            keys, of = np.unique(np.concatenate(self.keys), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, of, np.concatenate(self.values))
            self.keys, self.values, self.held = [keys], [sums], len(keys)


def _first(rows: pa.Table, top: int) -> pa.Table:
    """The top rows of each group by value, the earlier of equal ones; rows (group, term, value) are in order of term within a group."""
    group, value = rows.column(0).to_numpy(), rows.column(2).to_numpy()
    order = np.lexsort((np.arange(len(group)), -value, group))
    group = group[order]
    rank = np.arange(len(group)) - np.searchsorted(group, group)
    return rows.take(pa.array(np.sort(order[rank < top])))


def _emitted(top: int):
    """The scan of sorted kept runs (lang, term, source, p, p0), the language's own row first: partial sums of pairs, and each source's top terms as far as this task has seen."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[tuple[str, str], int] = {}
        pairs, best, held = _Pairs(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            names = list(index)
            lang, source = (pa.array([n[k] for n in names], pa.string()) for k in (0, 1))
            pairs.combine()
            parts = []
            if pairs.held:
                a, b = pairs.keys[0] >> 31, pairs.keys[0] & 0x7FFFFFFF
                parts.append(("pair", a, source.take(pa.array(b)), pa.array(pairs.values[0])))
            if best:
                rows = _first(pa.concat_tables(best), top).combine_chunks()
                parts.append(("term", rows.column(0).to_numpy(), rows.column(1).combine_chunks(), rows.column(2).combine_chunks()))
            for part, of, item, value in parts:
                of = pa.array(of)
                whole = pa.RecordBatch.from_arrays([pa.repeat(part, len(of)), lang.take(of), source.take(of), item, value], schema=_EMITTED)
                yield from (whole.slice(i, 50_000) for i in range(0, len(of), 50_000))

        for rows, starts in _whole_runs(batches, lambda r: r):
            size = np.diff([*starts, rows.num_rows])
            p, p0 = rows.column(3).to_numpy(), rows.column(4).to_numpy()
            q, run = np.repeat(p[starts], size), np.repeat(np.arange(len(starts)), size)
            own = np.ones(rows.num_rows, bool)
            own[starts] = False  # the language's own rows
            own = np.flatnonzero(own)
            if not len(own):
                continue
            lang, source = (rows.column(c).take(pa.array(own)).dictionary_encode() for c in (0, 2))
            code = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            codes, of = np.unique(code, return_inverse=True)
            langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
            number = np.array([index.setdefault((langs[c // len(sources)], sources[c % len(sources)]), len(index)) for c in codes.tolist()], np.int64)[of]
            p, p0, q = p[own], p0[own], q[own]
            pairs.add(run[own], number, p, p0)
            more = np.flatnonzero(p > q)
            best.append(pa.table([pa.array(number[more]), rows.column(1).take(pa.array(own[more])), pa.array(_f(p[more], q[more]))], names=["group", "term", "value"]))
            held += len(more)
            if held > _HELD_ROWS:
                best = [_first(pa.concat_tables(best), top)]
                held = best[0].num_rows
            if pairs.held > _HELD_PAIRS:
                pairs.combine()
            if pairs.held > _HELD_PAIRS or 2 * held > _HELD_ROWS and len(best) == 1:
                yield from flush()
                index, pairs, best, held = {}, _Pairs(), [], 0
        yield from flush()

    return scan


def _probability(n: str) -> Column:
    """In billionths, of n occurrences in a group that has total, smoothed over the kept terms of its language."""
    return F.expr(f"1 + CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0)) div (total + 2 * kept)")


def _value(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def divergence(docs: DataFrame, least: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: every other source of the language with the sum of (p-q)^2 div (p+q) over all kept terms, p and q being the sources' probabilities of a
    term; part term: the top terms that the source has more of than its language, by the same value.

    Kept are terms in at least least of a language's rows; a row is a document. Terms are runs of letters and of all characters above U+007F, A-Z lower-cased. Probabilities are
    1 + 1000000000 * (n + 2) div (N + 2 * V). Null texts, languages and sources are empty; every (lang, source) that occurs takes part, with no terms too. Rows count as often as they repeat;
    doc_id and other columns are ignored, whatever their names. Texts may be as long as a row allows. Equal values rank by item. An empty table gives no rows. A task holds the
    sources of one term, so a language may have as many sources as the square of them is worth returning.
    """
    spark = docs.sparkSession
    rows = docs.select(text_of(quoted(lang_col)).alias("lang"), text_of(quoted(source_col)).alias("source"), text_of(quoted(text_col)).cast("binary").alias("text"))
    partial = rows.mapInArrow(_partials, "lang string, term string, source string, docs long, n long")
    runs = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    counts, counts_path = stored(runs.mapInArrow(_counted(least), "lang string, term string, source string, n long"), "term-counts")

    kept = counts.filter("term <> ''")
    groups = counts.filter("term = ''").select("lang", "source")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = kept.filter("source IS NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    every = groups.unionByName(groups.select("lang", F.lit(None).cast("string").alias("source")).distinct())
    same = lambda a, b: (a["lang"] == b["lang"]) & a["source"].eqNullSafe(b["source"])
    stats = every.join(totals, same(every, totals), "left").select(every["lang"], every["source"], "total").join(terms, "lang", "left")
    stats, stats_path = stored(stats.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")).select("*", F.when(F.col("kept") > 0, _probability("0")).alias("p0")), "sources")

    scored = kept.join(stats, same(kept, stats)).select(kept["lang"], "term", kept["source"], _probability("n").alias("p"), "p0")
    sorted_runs = scored.repartition("lang", "term").sortWithinPartitions("lang", "term", F.asc_nulls_first("source"))
    emitted, _ = stored(sorted_runs.mapInArrow(_emitted(top), "part string, lang string, source string, item string, value long"), "divergences")

    own = stats.filter("source IS NOT NULL")
    other = own.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    apart = F.col("source") != F.col("item")
    none = own.join(other, "lang").filter(apart).select("lang", "source", "item", F.coalesce(F.col("kept") * _value("p0", "q0"), F.lit(0)).alias("value"))
    histogram = scored.filter(kept["source"].isNotNull()).groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    lone = histogram.join(other, "lang").filter(apart).groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (_value("p", "q0") - _value("p0", "q0"))).alias("value"))
    both = emitted.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = lambda df: df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = none.unionByName(turned(lone.unionByName(both))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(order).cast("int").alias("rank"))
    out = ranked(pairs).unionByName(ranked(emitted.filter("part = 'term'")).filter(F.col("rank") <= top))
    out, _ = stored(out, "divergence")
    drop_tables(spark, [counts_path, stats_path])
    return out


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS kept FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
grid AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, sum(n) AS n FROM grid GROUP BY ALL),
p AS (SELECT lang, source, term, n, CAST(1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * kept) AS BIGINT) AS p FROM grid JOIN v USING (lang)),
q AS (SELECT lang, term, CAST(1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * kept) AS BIGINT) AS q FROM whole JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source WHERE a.lang NOT IN (SELECT lang FROM k)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= 10
"""
