"""Token-id output: Simple-8b token files in id order, and their reader.

The texts are range-partitioned and sorted by id, so every partition is one shard of the order; each is tokenised and written
in blocks by a Spark writer, whose commit protocol lets tasks be lost and run again. A row of the table is one block:
shard, block, what it starts at within its shard, and a blob that can be decoded alone:

    magic AL8B | u32 documents, ids, groups, words, escapes | i64 document ids | u8 id present | u32 document lengths
    | u32 word offsets (groups + 1) | u32 escape offsets (groups + 1) | u64 words | u64 escapes

A group is 4,096 ids and starts at a word of its own. Documents are never cut: a block ends at the first document that
reaches ids_per_block. The reader finds each shard's start from the shards' totals, one row for each shard.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import read_table, table_path, text_of
from .tokens import default_tokenizer, encoded, encoder

MAGIC = b"AL8B"
_HEAD = struct.Struct("<4s5I")
BLOCKS = "shard int, block int, starts_at long, n_docs int, n_ids long, data binary"


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    values = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.uint64)
    words, escapes, word_at, escape_at = simple8b.encode_groups(values)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join((
        _HEAD.pack(MAGIC, len(doc_ids), len(values), len(word_at) - 1, len(words), len(escapes)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), np.array([len(x) for x in ids], "<u4").tobytes(),
        word_at.tobytes(), escape_at.tobytes(), words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
    ))


def unpack_block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are present, lengths, and all ids one after the other."""
    magic, docs, n, groups, words, escapes = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at, out = _HEAD.size, []
    for kind, k in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", groups + 1), ("<u4", groups + 1), ("<u8", words), ("<u8", escapes)):
        out.append(np.frombuffer(data, kind, k, at))
        at += out[-1].nbytes
    values = simple8b.decode(out[5], out[6])
    if len(values) != n or at != len(data):
        raise ValueError("a token block is damaged")
    return out[0], out[1], out[2], values


def unpack_group(data: bytes, group: int) -> np.ndarray:
    """The ids of one group, read through the offsets alone."""
    _, docs, _, groups, words, _ = _HEAD.unpack_from(data)
    at = _HEAD.size + 13 * docs
    word_at = np.frombuffer(data, "<u4", groups + 1, at)
    escape_at = np.frombuffer(data, "<u4", groups + 1, at + word_at.nbytes)
    at += 2 * word_at.nbytes
    i, j, k, m = *map(int, word_at[group : group + 2]), *map(int, escape_at[group : group + 2])
    return simple8b.decode(np.frombuffer(data, "<u8", j - i, at + 8 * i), np.frombuffer(data, "<u8", m - k, at + 8 * (words + k)))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1, ids_per_block: int = 65_536, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every whole text, end_id behind each, in ascending order of id, nulls first; rows that repeat an id go by text.

    A null text is empty: its document has the end id alone. Other columns are ignored. An empty table gives a table without blocks.
    """
    end = b"" if end_id is None else struct.pack("<I", end_id)
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("starts_at", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        block, starts, held, names, ids = 0, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, starts, held, names, ids
            out = pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "starts_at": starts, "n_docs": len(names), "n_ids": held, "data": pack_block(names, ids)}], schema)
            block, starts, held, names, ids = block + 1, starts + held, 0, [], []
            return out

        for b in batches:
            for name, raw in encoded(enc, b.column(0), b.column(1)):
                names.append(name)
                ids.append(np.frombuffer(raw + end, "<u4"))
                held += len(ids[-1])
                if held >= ids_per_block:
                    yield flush()
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, BLOCKS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit, as bytes), decoded from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                names, known, lengths, values = unpack_block(data.as_py())
                stops = np.cumsum(lengths, dtype=np.int64)
                offsets = np.concatenate([[0], 4 * stops]).astype(np.int32)
                raw = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(names, mask=known == 0), pa.array(start + stops - lengths), pa.array(lengths.astype(np.int64)), raw], schema=schema)

    return blocks.join(F.broadcast(bases), "shard").select((F.col("base") + F.col("starts_at")).alias("start"), "data").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = table_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), path, default_tokenizer())
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
