"""Exact dedup: group by a 128-bit content hash, keep one stable id, and compare bytes inside groups.

All of it is DataFrame operations. One scan writes each row's id and hashes, fixed-width rows that are all that is grouped; only the texts of hashes that
repeat are compared byte by byte, and these are pre-aggregated by (hash, text) before their shuffle, so a text with very many copies
leaves each input partition once. What joins back is written first, so that adaptive execution can split a hot group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, drop_tables, lower_ascii, numbered, quoted, read_table, stored, text_of, without_rows


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text.cast("binary")))


def _classes(rows: DataFrame, keep: str, hash_of: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Of rows (doc_id, norm): doc_id, tag (another for each row), hash, sha of each; and hash, sha, best (with the doc_id and tag of the row that stays), group_size of each text that several rows have."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    spark = rows.sparkSession
    ids, _ = stored(rows.select("doc_id", F.monotonically_increasing_id().alias("tag"), hash_of(F.col("norm")).alias("hash"), F.unhex(F.sha2("norm", 256)).alias("sha")), "hashes")
    many, many_path = stored(ids.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "repeated-hashes")
    few = many.count() <= BROADCAST_KEYS
    # texts that share a hash are told apart by their bytes: the aggregate compares whole texts
    found = rows.select(hash_of(F.col("norm")).alias("hash"), "norm").join(F.broadcast(many) if few else many, "hash", "left_semi")
    texts, texts_path = stored(found.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1").select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size"), "repeated-texts")
    few = texts.count() <= BROADCAST_KEYS
    member = ids.join(F.broadcast(texts) if few else texts, ["hash", "sha"])
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    best = F.min(first) if keep == "smallest" else F.max_by(first, F.struct("doc_id", -F.col("tag")))
    classes, _ = stored(member.groupBy("hash", "sha").agg(best.alias("best"), F.first("group_size").alias("group_size")), "classes")
    drop_tables(spark, [many_path, texts_path])
    return ids, classes


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = lower_ascii,
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their normalised texts have the same bytes: texts whose hashes agree are compared whole, so texts that collide stay apart
    (hash_of is a parameter so that tests can force collisions), and ids find their text by SHA-256 within the hash. One row of each text is kept, the one with the
    smallest or largest id; of rows that repeat this id and the text, one.

    Nulls: a null text counts as empty; a null id belongs to its group and counts in group_size, but is kept only if the
    group has no other id. Ids may be of any type that has an order. Texts may be as long as a row allows. Other columns are ignored, whatever their names.
    An empty table gives no rows.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), normalise(text_of(quoted(text_col))).alias("norm"))
    ids, classes = _classes(rows, keep, hash_of)
    few = classes.count() <= BROADCAST_KEYS
    own = F.col("best").isNull()
    return ids.join(F.broadcast(classes) if few else classes, ["hash", "sha"], "left").select(
        "doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (own | (F.col("tag") == F.col("best.tag"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs with one row of each text, the one that exact_duplicates keeps; all columns stay, whatever their names.

    Rows are judged one by one, not by id: of an id's several texts each stands for itself, and rows without an id are compared like others. Of rows that repeat an id and
    a text, the first stays by its other columns as JSON. Null texts are empty, and one empty text stays. An empty table stays empty.
    """
    plain, (own, text) = numbered(docs, id_col, text_col)
    norm = lower_ascii(text_of(text))
    ids, classes = _classes(plain.select(own.alias("doc_id"), norm.alias("norm")), keep, content_hash)
    few = classes.count() <= BROADCAST_KEYS
    key = lambda doc_id, sha: F.concat(F.when(doc_id.isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), doc_id.cast("string"))).cast("binary"), sha)
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    found = ids.join(F.broadcast(classes) if few else classes, ["hash", "sha"]).groupBy(key(F.col("doc_id"), F.col("sha")).alias("key")).agg(F.first(~same).alias("gone"), F.count(F.lit(1)).alias("n"))
    return without_rows(plain, key(own, F.unhex(F.sha2(norm, 256))), found.filter("gone OR n > 1"), docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"), keep="largest")


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t
"""
