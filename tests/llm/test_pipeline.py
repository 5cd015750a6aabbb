import pytest

import corpus_pipeline
from arborlake.llm.common import stored

from .brute import LOWER, jaccard_classes


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows that each stage leaves."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs, _ = stored(stage(spark, docs, sf), name)
    return [*out, docs]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, sf, stages):
    read, known, single, apart, clean, packed = stages
    assert all(s.columns == read.columns for s in stages[:-1])
    texts = {r["doc_id"]: r["text"] for r in read.collect()}
    assert ids(read) - ids(known) == {i for i, t in texts.items() if not any(c.isalpha() for c in t or "")}
    first = {}
    for i in sorted(ids(known)):
        first.setdefault((texts[i] or "").translate(LOWER), i)
    assert ids(single) == set(first.values())
    assert ids(apart) == {i for i, _, c in jaccard_classes([(i, texts[i]) for i in ids(single)], 5, 80) if i == c}
    words = lambda t: " " + " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) + " "
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids(clean) == {i for i in ids(apart) if not any(x in words(texts[i]) for x in items)}
    assert ids(packed) == ids(clean)


def test_run_is_the_stages(spark, sf, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).drop("sequence_id", "offset").groupBy("doc_id").agg({"length": "sum"}).collect())) == sorted(map(tuple, stages[-1].groupBy("doc_id").agg({"length": "sum"}).collect()))


def test_odd_and_empty_tables(spark, sf, odd, none):
    for docs in (none, odd.withColumn("lang", odd["keep_id"])):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs, _ = stored(stage(spark, docs, sf), name)
            assert name == "packing" or docs.columns == before.columns
            assert ids(docs) <= ids(before)
    assert ids(docs) >= {1, 6, 9, 11}
