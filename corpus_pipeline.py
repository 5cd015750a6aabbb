"""The corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Every stage reads what its predecessor wrote, works on all of it, and drops what its operator rejects; the last returns the packed pieces.

Stages judge rows, not ids: nulls in any column, repeated rows and ids, equal ids of unequal texts, and columns with the names of results are each as the stage's drop_* or pack() states. An empty table
passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from arborlake.llm.common import read_table, stored
from arborlake.llm.tokens import default_tokenizer


def _bounded(spark: SparkSession) -> None:
    """Batches of Arrow end at 8 MB instead of 64 MB: each task holds a few of them, in the executor's direct memory and again in its worker. A session's own setting stays."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
    if spark.conf.get(name, default).rstrip("b") == default:
        spark.conf.set(name, str(8 << 20))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have no letters or no clear language; the model learns from the documents' own lang."""
    _bounded(spark)
    return language_id.drop_unidentified(docs, language_id.train(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of equal texts stays."""
    _bounded(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of texts that share 0.8 of their runs of five words stays."""
    _bounded(spark)
    return ngram_join.drop_near_duplicates(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold an item of benchmark."""
    _bounded(spark)
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048; a null text is empty, rows that repeat are packed as often, other columns are left out, an empty table gives no pieces."""
    _bounded(spark)
    return packing.pack(docs, default_tokenizer())


STAGES = [
    ("language_id", by_language),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: No stage but exact dedup can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
