import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from arborlake.llm import exact_dedup as D
from arborlake.llm import ngram_join as J
from arborlake.llm.components import connected_components
from verify import rows_of

from .brute import jaccard_classes


def test_exact_on_odd_rows(odd, none):
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in D.exact_duplicates(odd, keep="largest").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    base = odd.filter("doc_id = 1").first()["text"]
    assert got[1, sha(base)] == (2, 3, False) and got[2, sha(base)] == (2, 3, True) and got[None, sha(base)] == (2, 3, False)
    assert got[4, sha("")] == (5, 3, False) and got[5, sha("")] == (5, 3, True) and got[9, sha("x")] == (9, 2, True)
    assert D.exact_duplicates(odd).count() == odd.count() and D.exact_duplicates(none).count() == 0
    kept = D.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id IN (2, 5)").count() == 0


def test_collisions_stay_apart(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "BB"])], "doc_id long, text string")
    got = D.exact_duplicates(docs, hash_of=lambda t: F.octet_length(t))
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()) == [(0, 0, 2), (1, 1, 2), (2, 0, 2), (3, 3, 1), (4, 1, 2)]


def test_op7_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rel, df = con.sql(D.OP7_SQL), D.op7_exact_dedup(spark, sf)
    assert rows_of(df.columns, df.collect()) == rows_of(rel.columns, rel.fetchall())


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(20)]
    root = {x: x for e in chain for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in chain:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rng.shuffle(chain)
    got, _ = connected_components(spark.createDataFrame(chain, "u long, v long"))
    lone = {a for a, b in chain if a == b} - {x for a, b in chain if a != b for x in (a, b)}
    assert {(r["node"], r["component"]) for r in got.collect()} == {(x, find(x)) for x in root if x not in lone}


def near_copies(seed, groups=12, copies=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 40, 120]))]
        for _ in range(copies):
            words = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in base]
            out.append(" ".join(words + (passage if rng.random() < 0.3 else [])))
    out += ["", "  ", None]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("size", "percent", "share"), [(3, 90, None), (5, 80, None), (1, 60, 0.2), (2, 100, None)])
def test_join_against_all_pairs(spark, size, percent, share):
    rows = near_copies(size * percent)
    got = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), size, percent, early_share=share)
    assert sorted(map(tuple, got.collect())) == jaccard_classes(rows, size, percent)


def test_op4_against_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, J.op4_ngram_jaccard_join(spark, sf).collect())) == jaccard_classes(rows, 3, 90)


def test_join_on_odd_rows(odd, none):
    got = {(r["doc_id"], r["n_shingles"] > 0): r["component_id"] for r in J.jaccard_classes(odd, 2, 80).collect()}
    assert got[1, True] == got[2, True] == got[3, True] == 1 and got[7, True] == 6 and got[4, False] == 4 and got[8, False] == 8 and got[9, True] == 9 and got[None, True] is None
    assert J.jaccard_classes(odd).count() == odd.count() and J.jaccard_classes(none).count() == 0
    kept = J.drop_near_duplicates(odd, 2, 80)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.select("doc_id").filter("doc_id IS NOT NULL").distinct().collect()) == [1, 4, 5, 6, 8, 9, 10, 11]
    with pytest.raises(ValueError):
        J.jaccard_classes(none, percent=0)


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_KEYS", -1)
    rows = near_copies(77)
    assert sorted(map(tuple, J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())) == jaccard_classes(rows, 3, 90)


def test_repeated_rows_keep_their_links(spark):
    a = [f"a{i}" for i in range(100)]
    c, d = a[:6] + [f"c{i}" for i in range(90)], a[10:] + [f"d{i}" for i in range(200)]
    texts = [(1, " ".join(a))] * 2 + [(2, " ".join(a[10:]))] + [(k, " ".join(c[: 99 - k])) for k in (3, 4)] + [(k, " ".join(d[: 295 - k])) for k in (5, 6, 7, 8)]
    for times in (1, 150):
        rows = texts[:1] * times + texts
        got = {r["doc_id"]: r["component_id"] for r in J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 5, 8: 5}


def test_an_id_with_several_texts(spark):
    a, b = ([f"{c}{i}" for i in range(100)] for c in "ab")
    texts = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[10:])), (3, " ".join(b[10:])), (4, " ".join(a[:6] + b[:6] + [f"c{i}" for i in range(90)]))]
    got = J.jaccard_classes(spark.createDataFrame(texts, "doc_id long, text string"), 1, 90)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


@pytest.mark.parametrize(("size", "percent", "share"), [(3, 90, None), (1, 60, 0.2)])
def test_links_against_all_pairs(spark, size, percent, share):
    rows = near_copies(size * percent)
    rows += rows[:30]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        ws = (t or "").split()
        sets[i] = frozenset(tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))) if ws else frozenset()
    link = lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
    want = {i: sum(link(s, o) for j, o in sets.items() if j != i) for i, s in sets.items()}
    rep = {i: min((j for j, o in sets.items() if o == s), default=i) if s else i for i, s in sets.items()}
    got = J.jaccard_links(docs, size, percent, early_share=share).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["n_shingles"], r["rep_id"], r["n_links"]) for r in got} == {(i, len(s), rep[i], want[i]) for i, s in sets.items()}
    reps = sorted({rep[i] for i, s in sets.items() if s})
    pairs = {(min(r["x"], r["y"]), max(r["x"], r["y"]), r["common"]) for r in J.jaccard_pairs(docs, size, percent, early_share=share).collect()}
    assert pairs == {(i, j, len(sets[i] & sets[j])) for i in reps for j in reps if i < j and link(sets[i], sets[j])} and len(pairs) > len(reps) / 4


def test_links_on_odd_rows(odd, none):
    got = {(r["doc_id"], r["n_shingles"] > 0): r["n_links"] for r in J.jaccard_links(odd, 2, 80).collect()}
    assert got[1, True] == got[2, True] == got[3, True] == 2 and got[6, True] == got[7, True] == 1 and got[4, False] == got[9, True] == got[None, True] == 0
    assert J.jaccard_links(odd).count() == odd.count() and J.jaccard_links(none).count() == J.jaccard_pairs(none).count() == 0
