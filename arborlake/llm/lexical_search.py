"""Ranked lexical search with block-max pruning over a forward index.

A block is a range of consecutive documents with its terms, for each term the documents that hold it and the most that any of them can score with it, and the documents' postings (a forward
index). For a query, the sum of its terms' maxima bounds every document of a block. The best blocks of each query are scored first, which gives a score that its results must
reach; then each task sorts its blocks by bound and scores them until no bound reaches what the queries' results have. Nothing is left out: a block is passed over only if none of its
documents can be among the first.

Texts are never shuffled; queries go to the tasks in blocks of a bounded size, and what comes back is at most k rows a query and task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from .common import drop_tables, quoted, read_table, stored, table_path, text_of
from .small_table import small_table
from .terms import byte_table, term_lists

_TABLE = byte_table(digits=True)
_MOST_BOUNDS = 1_000_000


@dataclass(frozen=True)
class Index:
    """path of the blocks, documents with terms, all their terms, and the type of document ids."""

    path: str
    documents: int
    terms: int
    id_type: str


def _counted(text: bytes) -> Counter:
    out: Counter = Counter()
    for part in term_lists(text, _TABLE):
        out.update(part)
    return out


def _narrow(values: np.ndarray, bound: int) -> bytes:
    return values.astype("<u2" if bound < 1 << 16 else "<u4").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


def term_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds, times its term's weight, in a document of length measure m."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _block(held: list[tuple], documents: int, terms: int) -> dict:
    """Of (id, counted terms, length): a row of the index."""
    names = sorted(set().union(*(h[1] for h in held)))
    at = dict(zip(names, range(len(names)), strict=True))
    sizes = np.array([len(h[1]) for h in held], np.int64)
    term = np.fromiter((at[t] for h in held for t in h[1]), np.int64, int(sizes.sum()))
    tf = np.fromiter((n for h in held for n in h[1].values()), np.int64, len(term))
    m = np.array([25 + 75 * h[2] * documents // terms for h in held], np.int64)
    order = np.argsort(term, kind="stable")
    df = np.bincount(term, minlength=len(names))
    top = np.maximum.reduceat(term_score(tf, np.repeat(m, sizes))[order], np.cumsum(df) - df)
    return {
        "ids": [h[0] for h in held], "terms": b"\n".join(names), "df": df.astype("<u4").tobytes(), "top": top.astype("<u4").tobytes(), "m": m.astype("<i8").tobytes(),
        "sizes": sizes.astype("<u4").tobytes(), "term": _narrow(term, len(names)), "tf": _narrow(tf, int(tf.max()) + 1),
    }


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 32, block_bytes: int = 1 << 20) -> Index:
    """Write the index of every whole text to path. A block ends with block_docs documents with terms, or with the document that reaches block_bytes of text.

    Terms are runs of digits, letters and all characters above U+007F, A-Z lower-cased. A document without terms, or without a text, is in no block. Ids may be null or repeat
    (each row is a document) and of any atomic type. Texts may be as long as a row allows. Other columns are ignored, whatever their names. An empty table gives an empty index.
    """
    rows = docs.select(text_of(quoted(text_col)).cast("binary").alias("text"), quoted(id_col).alias("id"))
    kind = rows.schema["id"].dataType

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for text in b.column(0):
                size = sum(map(len, term_lists(text.as_py(), _TABLE)))
                n, total = n + (size > 0), total + size
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    n, total = rows.select("text").mapInArrow(lengths, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    binary = ["terms", "df", "top", "m", "sizes", "term", "tf"]
    schema = pa.schema([("block", pa.int64()), ("ids", to_arrow_type(ArrayType(kind))), *((c, pa.binary()) for c in binary)])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k, held, size = TaskContext.get().partitionId() << 33, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal k, held, size
            out = pa.RecordBatch.from_pylist([{"block": first + k, **_block(held, n, total)}], schema)
            k, held, size = k + 1, [], 0
            return out

        for b in batches:
            for text, name in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                raw = text.as_py()
                if counts := _counted(raw):
                    held.append((name, counts, sum(counts.values())))
                    size += len(raw)
                    if len(held) >= block_docs or size >= block_bytes:
                        yield flush()
        if held:
            yield flush()

    ddl = f"block long, ids array<{kind.simpleString()}>, " + ", ".join(f"{c} binary" for c in binary)
    rows.mapInArrow(blocks, ddl).write.parquet(path)
    return Index(path, n, total, kind.simpleString())


class _Queries:
    """A block of queries: their terms one after the other as numbers of a vocabulary, and where each begins."""

    def __init__(self, texts: list[list[bytes]]):
        self.words: dict[bytes, int] = {}
        self.flat = np.array([self.words.setdefault(t, len(self.words)) for ts in texts for t in ts], np.int64)
        self.sizes = np.array([len(ts) for ts in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.weight = np.zeros(len(self.words), np.int64)

    def known(self, names: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Which of a block's terms the queries have, by their place in the block and in the vocabulary."""
        of = np.fromiter((self.words.get(t, -1) for t in names.split(b"\n")), np.int64)
        at = np.flatnonzero(of >= 0)
        return at, of[at]

    def bounds(self, names: bytes, top: bytes) -> np.ndarray:
        at, of = self.known(names)
        value = np.zeros(len(self.words), np.int64)
        value[of] = np.frombuffer(top, "<u4")[at] * self.weight[of]
        return np.add.reduceat(value[self.flat], self.starts)

    def scores(self, row: dict, some: np.ndarray) -> np.ndarray:
        """Documents x those queries."""
        at, of = self.known(row["terms"])
        sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
        total = int(sizes.sum())
        term, tf = _wide(row["term"], total), _wide(row["tf"], total)
        place = np.full(len(row["top"]) // 4, len(at), np.int64)
        place[at] = np.arange(len(at))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        value = np.zeros((len(sizes), len(at) + 1), np.int64)
        mine = place[term] < len(at)
        value[doc[mine], place[term[mine]]] = term_score(tf[mine], np.frombuffer(row["m"], "<i8")[doc[mine]])
        value[:, :-1] *= self.weight[of]
        column = np.full(len(self.words), len(at), np.int64)
        column[of] = np.arange(len(at))
        n = self.sizes[some]
        stops = np.cumsum(n)
        inner = np.arange(int(stops[-1])) - np.repeat(stops - n, n) + np.repeat(self.starts[some], n)
        return np.add.reduceat(value[:, column[self.flat[inner]]], stops - n, axis=1)


class _Best:
    """The first k of each query as far as seen, and the score that further ones must reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.held = k, np.maximum(least, 1), {}

    def add(self, some: np.ndarray, scores: np.ndarray, ids: list) -> None:
        for d, j in zip(*(x.tolist() for x in np.nonzero(scores >= self.least[some])), strict=True):
            q = int(some[j])
            held = self.held.setdefault(q, [])
            held.append((-int(scores[d, j]), ids[d] is None, ids[d]))
            if len(held) >= 8 * self.k:
                self.cut(q)

    def cut(self, q: int) -> None:
        held = self.held[q]
        held.sort(key=lambda h: h[:2] + (() if h[1] else (h[2],)))
        del held[self.k :]
        if len(held) == self.k:
            self.least[q] = max(self.least[q], -held[-1][0])

    def rows(self) -> Iterator[tuple]:
        for q in self.held:
            self.cut(q)
            yield from ((q, i, -minus) for minus, _, i in self.held[q])


def _rows_of(b: pa.RecordBatch) -> Iterator[dict]:
    for i in range(b.num_rows):
        yield {c: b.column(k)[i].as_py() for k, c in enumerate(b.schema.names)}


def _search_block(index: Index, names: list, texts: list[list[bytes]], kind: str, k: int, seeds: int, spark: SparkSession) -> tuple[DataFrame, str]:
    """The results of one block of queries, stored: query (its number here), doc_id, score."""
    blocks = spark.read.parquet(index.path)
    queries = _Queries(texts)
    sent = spark.sparkContext.broadcast(queries)  # bounded by the block of queries

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(sent.value.words), np.int64)
        for b in batches:
            for names, counts in zip(b.column(0), b.column(1), strict=True):
                at, of = sent.value.known(names.as_py())
                df[of] += np.frombuffer(counts.as_py(), "<u4")[at]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["word", "df"])

    counted = blocks.select("terms", "df").mapInArrow(frequencies, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the block of queries
    for word, df in zip(*(counted.column(c).to_pylist() for c in ("word", "df")), strict=True):
        queries.weight[word] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df + 1)))
    sent.destroy()
    sent = spark.sparkContext.broadcast(queries)

    def first_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        bound, block = np.zeros((seeds, len(q.sizes)), np.int64), np.zeros((seeds, len(q.sizes)), np.int64)
        for b in batches:
            for number, names, top in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                new = q.bounds(names.as_py(), top.as_py())
                at = bound.argmin(axis=0)
                better = np.flatnonzero(new > bound[at, np.arange(len(new))])
                bound[at[better], better], block[at[better], better] = new[better], number
        _, query = some = np.nonzero(bound)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(block[some]), pa.array(bound[some])], names=["query", "block", "bound"])

    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    seeded = blocks.select("block", "terms", "top").mapInArrow(first_blocks, "query long, block long, bound long").withColumn("k", F.row_number().over(by_bound)).filter(F.col("k") <= seeds)
    seeded = seeded.groupBy("block").agg(F.collect_list("query").alias("some")).toArrow()  # `seeds` blocks for each query of the block of queries

    schema = pa.schema([("query", pa.int64()), ("doc_id", to_arrow_type(blocks.schema["ids"].dataType.elementType)), ("score", pa.int64())])
    ddl = f"query long, doc_id {index.id_type}, score long"

    def given(best: _Best) -> Iterator[pa.RecordBatch]:
        rows = list(best.rows())
        for i in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 10_000], strict=True), schema, strict=True)], schema=schema)

    def score_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k, np.zeros(len(sent.value.sizes), np.int64))
        for b in batches:
            for row in _rows_of(b):
                some = np.array(row["some"], np.int64)
                best.add(some, sent.value.scores(row, some), row["ids"])
        yield from given(best)

    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))).cast("int")).filter(F.col("rank") <= k)
    seed_table = small_table(spark, "block long, some array<long>", *(seeded.column(c).to_pylist() for c in ("block", "some")))
    firsts = ranked(blocks.join(F.broadcast(seed_table), "block").drop("block", "df").mapInArrow(score_seeds, ddl))  # a few rows for each query
    least = np.zeros(len(queries.sizes), np.int64)
    reached = firsts.filter(F.col("rank") == k).select("query", "score").toArrow()  # one row for each query
    least[reached.column("query").to_numpy()] = reached.column("score").to_numpy()
    started = spark.sparkContext.broadcast(least)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        best, step = _Best(k, started.value), max(1, _MOST_BOUNDS // len(q.sizes))
        for whole in batches:
            for b in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                at = {c: j for j, c in enumerate(b.schema.names)}
                bounds = np.array([q.bounds(x.as_py(), y.as_py()) for x, y in zip(b.column(at["terms"]), b.column(at["top"]), strict=True)])
                for i in np.argsort(-(bounds - best.least).max(axis=1), kind="stable").tolist():
                    some = np.flatnonzero(bounds[i] >= best.least)
                    if len(some):
                        row = next(_rows_of(b.slice(i, 1)))
                        best.add(some, q.scores(row, some), row["ids"])
        yield from given(best)

    found = ranked(blocks.drop("block", "df").mapInArrow(search, ddl))
    own = small_table(spark, f"query long, item_id {kind}", list(range(len(names))), names)
    out = stored(found.join(F.broadcast(own), "query").select("item_id", "rank", "doc_id", "score"), "found")
    sent.destroy()
    started.destroy()
    return out


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_chars: int = 4_000_000, seeds: int = 4) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each query, all if fewer; equal scores by ascending id, a null id last.

    A score sums, over the query's terms with their repeats, floor(1000 * ln((2N + 2) / (2df + 1))) * (1000000000 * tf div (1000 * tf + 8 * m)), m being 25 + 75 * n * N div L. The queries are read to the
    driver in blocks of block_chars characters, each of which costs three scans of the index's terms and one of its postings. Queries without terms, or without a text, give no rows;
    of queries that repeat an id each has its own. Documents that repeat an id each have a rank of their own. An empty index or no queries give no rows.
    """
    spark = queries.sparkSession
    rows = queries.select(quoted(id_col).alias("item_id"), text_of(quoted(text_col)).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    paths: list[str] = []

    def flush(names: list, texts: list[list[bytes]]) -> None:
        if texts and index.documents:
            paths.append(_search_block(index, names, texts, kind, k, seeds, spark)[1])

    names, texts, size = [], [], 0
    for row in rows.toLocalIterator():
        terms = [t for part in term_lists(row["text"].encode(), _TABLE) for t in part]
        if terms:
            names.append(row["item_id"])
            texts.append(terms)
            size += len(row["text"])
            if size >= block_chars:
                flush(names, texts)
                names, texts, size = [], [], 0
    flush(names, texts)
    ddl = f"item_id {kind}, rank int, doc_id {index.id_type}, score long"
    return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "lexical-index")
    index = build_index(read_table(spark, sf_dir, "documents"), path)
    out = search(index, read_table(spark, sf_dir, "benchmark"))
    drop_tables(spark, [path])
    return out


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT row_number() OVER () AS row, doc_id, len(terms) AS n, terms FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term), s),
r AS (SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0) WHERE rank <= 10
"""
