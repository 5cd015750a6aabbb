"""Dropping operators judge rows, not ids: repeated ids and rows, null ids, and names that need quotes or clash."""

import random

import pytest

import corpus_pipeline
from arborlake.llm import common
from arborlake.llm import decontaminate as C
from arborlake.llm import exact_dedup as D
from arborlake.llm import language_id as L
from arborlake.llm import ngram_join as J
from arborlake.llm.small_table import small_table

from . import brute

A, B, Z = "alpha one two three four five six", "beta seven eight nine ten eleven twelve", "zeta some other words that stand alone here"
ROWS = [(1, A), (5, A), (5, B), (7, B), (9, Z), (9, Z), (None, A), (None, "only here without any id at all"), (3, None), (4, ""), (None, None)]


@pytest.fixture(scope="module")
def odd_names(spark):
    """Columns with dots, backticks and the names that operators use inside."""
    rows = [(i, t, k % 2, "x", float(k), "n", "s") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, "`doc.id` long, `te``xt` string, gone int, key string, c0 double, norm string, hash string")


def left(df):
    return sorted(((r[0] or 0, r[1]) for r in df.select(common.quoted("doc.id"), common.quoted("te`xt")).collect()), key=str)


@pytest.mark.parametrize("most", [1_000_000, -1])
def test_exact(spark, odd_names, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_KEYS", most)
    monkeypatch.setattr(D, "BROADCAST_KEYS", most)
    got = D.drop_exact_duplicates(odd_names, "doc.id", "te`xt")
    assert got.schema == odd_names.schema
    assert left(got) == sorted([(1, A), (5, B), (9, Z), (0, "only here without any id at all"), (3, None)], key=str)
    last = D.drop_exact_duplicates(odd_names, "doc.id", "te`xt", "largest")
    assert left(last) == sorted([(5, A), (7, B), (9, Z), (0, "only here without any id at all"), (4, "")], key=str)


def test_one_row_is_kept_of_rows_that_repeat(spark):
    docs = spark.createDataFrame(ROWS * 3, "doc_id long, text string")
    for keep in ("smallest", "largest"):
        got = D.exact_duplicates(docs, keep=keep).collect()
        assert len(got) == len(docs.collect()) and sum(r["kept"] for r in got) == len({(t or "") for _, t in ROWS})
    names = spark.createDataFrame([("b", A), ("a", A), ("c", B)], "doc_id string, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in D.exact_duplicates(names).collect()) == [("a", "a", True), ("b", "a", False), ("c", "c", True)]


def test_near(spark, odd_names):
    got = J.drop_near_duplicates(odd_names, 1, 90, "doc.id", "te`xt")
    assert got.schema == odd_names.schema
    assert left(got) == sorted([(1, A), (5, B), (9, Z), (0, "only here without any id at all"), (3, None), (4, ""), (0, None)], key=str)


def test_near_keeps_one_of_each_class(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(4, " ".join(base)), (4, " ".join([*base, "x"])), (2, " ".join([*base, "y"])), (None, " ".join([*base, "z"])), (4, "quite another text"), (8, "quite another text ")]
    got = J.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()
    assert sorted((r["doc_id"], r["text"][-4:]) for r in got) == [(2, "39 y"), (4, "text")]


def test_an_id_is_one_node(spark):
    """Classes of ids against brute force over the union of an id's texts."""
    rows = [(i, t) for i, t in ROWS if i is not None]
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_classes(spark.createDataFrame(ROWS, "doc_id long, text string"), 1, 90).filter("doc_id IS NOT NULL").collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 9, 3: 3, 4: 4}
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 6]))) for _ in range(30)]
    rows = [(rng.randrange(25), rng.choice(texts)) for _ in range(60)]
    sets = [(i, frozenset(t.split())) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets:
        for j, o in sets:
            if 100 * len(s & o) >= 90 * len(s | o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = sorted(map(tuple, J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()))
    assert got == sorted((i, len(s), find(i)) for i, s in sets)


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("b", A), ("a", A + " x"), ("c", Z), (None, A)], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in J.jaccard_classes(docs, 1, 80).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), (None, None)}
    items = spark.createDataFrame([("q", A), (None, "seven eight")], "item_id string, text string")
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in C.find_contamination(docs, items).collect()} == {("b", "q", 1.0), ("a", "q", 1.0), (None, "q", 1.0)}


def test_contaminated(spark, odd_names):
    items = spark.createDataFrame([(1, A)], "item_id long, text string")
    got = C.drop_contaminated(odd_names, items, "doc.id", "te`xt")
    assert got.schema == odd_names.schema and left(got) == sorted(((i or 0, t) for i, t in ROWS if t != A), key=str)


def test_unidentified(spark, odd_names):
    model = L.train(spark.createDataFrame([(1, A + B + Z, "en")], "doc_id long, text string, lang string"))
    got = L.drop_unidentified(odd_names, model, "te`xt")
    assert got.schema == odd_names.schema and left(got) == sorted(((i or 0, t) for i, t in ROWS if t), key=str)


def test_edits_against_every_alignment(spark):
    """Every text with every item, by plain Smith-Waterman: nothing found that does not reach the score, equal scores, and few missed; over one block and many."""
    rng = random.Random(12)
    vocabulary = [f"v{i}" for i in range(80)]
    items = [[rng.choice(vocabulary) for _ in range(n)] for n in (2, 3, 5, 9, 12, 20, 30, 45) * 2]
    texts = []
    for k in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        if k % 3:
            body[3:3] = [w if rng.random() > (k % 4) / 10 else rng.choice(vocabulary) for w in rng.choice(items)]
        texts.append(body)
    texts.append([w if i % 3 < 2 else "edited" for i, w in enumerate(items[7])])  # every third word
    want = {}
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            if len(x) >= 3 and (s := brute.smith_waterman(x, t) / (2 * len(x))) >= C.least_score(len(x), 0.4, 8):
                want[d, i] = s
            elif len(x) < 3 and " ".join(x) in " ".join(t) and any(t[k : k + len(x)] == x for k in range(len(t))):
                want[d, i] = 1.0
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for block in (500_000, 40):
        got = {(r["doc_id"], r["item_id"]): r["score"] for r in C.find_contamination(docs, bench, block_words=block).collect()}
        assert all(k in want and v == pytest.approx(want[k]) for k, v in got.items()) and len(got) >= 0.95 * len(want) and (60, 7) in got


def test_pipeline_on_repeated_rows(spark, sf):
    """Each stage leaves one row of each text that stays, whatever the ids."""
    rows = [(i, t, "en" if t else None, None, None) for i, t in ROWS] + [(20 + k, f"{w} " * 3 + A + B, "en", "s", 1) for k, w in enumerate(["x", "y"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs, _ = common.stored(stage(spark, docs, sf), name)
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in docs.collect()), key=str)
    assert [x for x in got if x[0] < 20] == sorted([(1, A), (5, B), (9, Z), (0, "only here without any id at all")], key=str)


def test_small_table(spark):
    rows = [(1, "a", bytearray(b"x")), (None, None, None)]
    got = small_table(spark, "n long, s string, b binary", *map(list, zip(*rows, strict=True)))
    assert [tuple(r) for r in got.collect()] == rows
    assert small_table(spark, "n long, s string", [], []).count() == 0
