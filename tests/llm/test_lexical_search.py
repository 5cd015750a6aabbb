"""Ranked search against scoring every document, and against its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from arborlake.llm import lexical_search as ls
from verify import rows_of

LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(c[2] for c in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in counted:
            m = 25 + (75 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if df[t])
            if score > 0:
                scores.append((-score, i is None, i))
        scores.sort(key=lambda s: s[:2] + (() if s[1] else (s[2],)))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def found(spark, tmp_path, docs, items, k=10, **options):
    index = ls.build_index(docs, f"{tmp_path}/index", **{o: options.pop(o) for o in ("block_docs", "block_bytes") if o in options})
    return sorted(map(tuple, ls.search(index, items, k, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


def made(n, seed=7):
    rng = random.Random(seed)
    return [" ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("options", [{}, {"block_docs": 1}, {"block_docs": 3, "seeds": 1}, {"block_bytes": 40, "block_chars": 100}, {"k": 3}, {"k": 1000}])
def test_against_all(spark, tmp_path, options):
    texts = made(400)
    docs = [(i % 390, t) for i, t in enumerate([*texts, *texts[:20], "", None, "!!", "ONE w1", "one W1"])]  # ties, repeated ids, texts without terms
    items = [(i, t) for i, t in enumerate([*made(20, 8), *texts[:5], "w1 w1 w1 w2", "nowhere to be found", "", None, "w5"])] + [(3, "w9 w9"), (None, "w8")]
    got = found(spark, tmp_path, spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, score string, block int").repartition(5), spark.createDataFrame(items, "item_id long, text string"), **options)
    # queries under one id are told apart by their own rows
    assert got == plain(docs, items, options.get("k", 10))


def test_blocks_are_passed_over(spark, tmp_path, monkeypatch):
    """Most pairs of a query and a block are not scored."""
    texts = made(2000, 3)
    index = ls.build_index(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"{tmp_path}/index", block_docs=4)
    blocks = spark.read.parquet(index.path).toArrow().to_batches()
    q = ls._Queries([[t.encode() for t in terms(t)] for t in texts[:40]])
    df = Counter(t for x in texts for t in set(terms(x)))
    for t, j in q.words.items():
        q.weight[j] = math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df[t.decode()] + 1)))
    want = {i: [r[3] for r in plain(list(enumerate(texts)), [(i, texts[i])])] for i in range(40)}
    scored = every = 0
    for b in blocks:
        for row in ls._rows_of(b):
            bounds, scores = q.bounds(row["terms"], row["top"]), q.scores(row, ls.np.arange(40))
            assert (scores <= bounds).all() and (scores.max(axis=0) >= 0).all()
            scored, every = scored + sum(bounds[i] >= min(want[i]) for i in range(40)), every + 40
    assert scored < every / 2


def test_odd_rows(spark, tmp_path, odd, none):
    items = [(1, "the quick brown fox"), (2, "ÜNÏCODE ünïcode 漢字"), (3, "word1x1 end again"), (4, "x"), (5, "12")]
    got = found(spark, tmp_path, odd, spark.createDataFrame(items, "item_id long, text string"))
    assert got == plain([(r.doc_id, r.text) for r in odd.collect()], items)
    assert found(spark, f"{tmp_path}/2", none, spark.createDataFrame(items, "item_id long, text string")) == []
    assert found(spark, f"{tmp_path}/3", odd, spark.createDataFrame([], "item_id long, text string")) == []


def test_text_ids(spark, tmp_path):
    docs = spark.createDataFrame([("b", "same words"), ("a", "same words"), (None, "same words")], "`my.id` string, `the.text` string")
    docs = docs.union(spark.createDataFrame([("z", "else")] * 9, "i string, t string"))
    index = ls.build_index(docs, f"{tmp_path}/index", "my.id", "the.text")
    got = ls.search(index, spark.createDataFrame([("q", "words other")], "`q.id` string, `q.text` string"), id_col="q.id", text_col="q.text").orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in got] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


def test_query(spark, sf):
    df = ls.op11_lexical_search(spark, sf)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(ls.OP11_SQL)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())
