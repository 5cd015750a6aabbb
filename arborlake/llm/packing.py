"""Packing along a space-filling curve: neighbouring documents share training sequences.

Every document gets a hashed vector of its character 4-grams, projected to a few dimensions; the Hilbert index of that point
is its key. The texts are dealt out along the curve into ranges of about equal bytes: an exact histogram of bytes by key, refined where a cell holds more than a
range, gives the bounds, and a single key that holds more (a group of copies) is dealt over several ranges by row. Each range is sorted by (key, id) and cut into
full sequences. What is left at the ends of the ranges, less than a sequence each, is cut in a second pass over these tails alone; what then is left
is cut at the binary digits of its length, into sequences of a power of two ids, which need no padding, so no position of any sequence is padding.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import claim
from .common import drop_tables, quoted, read_table, stored, text_of
from .small_table import small_table
from .tokens import crc, default_tokenizer, encoded, encoder

BUCKETS, DIMS, BITS = 256, 4, 8
#: Bytes of text in a range, and how many ranges there are at most; beyond, ranges grow.
RANGE_BYTES, MOST_RANGES = 16_000_000, 20_000


def hashed_vectors(texts: list[str]) -> np.ndarray:
    """A unit vector of BUCKETS hashed 4-gram counts for each text; all zero for a text without any."""
    raw = [t.encode() for t in texts]
    out = np.zeros((len(raw), BUCKETS), np.float32)
    for i, b in enumerate(raw):
        x = np.frombuffer(b, np.uint8).astype(np.uint32)
        if len(x) >= 4:
            h = ((x[:-3] * np.uint32(0x01000193) ^ x[1:-2]) * np.uint32(0x01000193) ^ x[2:-1]) * np.uint32(0x01000193) ^ x[3:]
            out[i] = np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(24), minlength=BUCKETS)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS)).astype(np.float32)


def grid(points: np.ndarray, reach: float = 2.0) -> np.ndarray:
    """Each coordinate as one of 2^BITS steps; a squashing function keeps far points on the grid."""
    return np.minimum((np.tanh(points / reach) + 1) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.int64)


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The Hilbert index of each row of integer coordinates, by the transpose form of the curve."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def curve_keys(texts: list[str]) -> np.ndarray:
    return hilbert_index(grid(hashed_vectors(texts) @ projection()))


class Ranges:
    """Which range a key and a row's number fall into: the first key of each run of keys, its first range, and over how many ranges it is dealt."""

    def __init__(self, cells: list[tuple[int, int]], most_bytes: float):
        """cells: (first key, bytes), ascending; a cell of more bytes than a range is one key."""
        self.first, self.range, self.over = [0], [0], [1]
        n, held = 0, 0
        for key, size in cells:
            if size > most_bytes:
                n += held > 0
                self._add(key, n, times := -int(-size // most_bytes))
                n, held = n + times, 0
            else:
                if held and held + size > most_bytes:
                    n, held = n + 1, 0
                if not held:
                    self._add(key, n, 1)
                held += size
        self.n = n + (held > 0) or 1

    def _add(self, key: int, at: int, over: int) -> None:
        if key == self.first[-1]:
            self.range[-1], self.over[-1] = at, over
        else:
            self.first.append(key)
            self.range.append(at)
            self.over.append(over)

    def of(self, keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
        k = np.searchsorted(np.array(self.first), keys, side="right") - 1
        return np.array(self.range)[k] + rows % np.array(self.over)[k]


def ranges(sizes: DataFrame, range_bytes: int = RANGE_BYTES, most_ranges: int = MOST_RANGES) -> Ranges:
    """Of sizes (key, bytes): cells of 2^16 keys, refined to single keys where they hold more than a range. At most 2^16 and 256 for each range come to the driver at a time."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    most, bits = max(range_bytes, total / most_ranges), DIMS * BITS
    cells, hot, rows = [], [None], sizes
    for shift in range(bits - 16, -1, -8):
        cell = F.shiftright("key", shift)
        got = rows.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes")).collect()
        hot = [r["cell"] for r in got if shift and r["bytes"] > most]
        large = set(hot)
        cells += [(r["cell"] << shift, r["bytes"]) for r in got if r["cell"] not in large]
        if not hot:
            break
        named = small_table(sizes.sparkSession, "cell long", hot)  # fewer than there are ranges
        rows = rows.withColumn("cell", cell).join(F.broadcast(named), "cell", "left_semi").drop("cell")
    return Ranges(sorted(cells), most)


def add_curve_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held=None) -> DataFrame:
    """doc_id, text, key, range; a null text is empty, and empty texts share the key of the origin. held broadcasts Ranges; without it, instead of text, the text's bytes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                keys = curve_keys(part.column(1).to_pylist())
                if held is None:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pc.add(pc.cast(pc.binary_length(part.column(1)), pa.int64()), 64)], names=["key", "bytes"])
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(keys), pa.array(held.value.of(keys, part.column(2).to_numpy()))], names=["doc_id", "text", "key", "range"])

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), text_of(quoted(text_col)).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(keyed, "key long, bytes long" if held is None else "doc_id long, text string, key long, range long")


def tail_sizes(n: int) -> list[int]:
    """The powers of two that sum up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Cutter:
    """Cuts a stream of documents into pieces of sequences of size ids, in order."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence, self.filled, self.open = size, first_sequence, 0, []

    def add(self, doc_id: int | None, ids: bytes, start: int = 0, of: int | None = None) -> list[tuple]:
        """The pieces of the sequences that this document, or its ids from start on, of so many, fills: doc_id, start, length, crc, document's ids, sequence, offset."""
        out, at, n = [], 0, len(ids) // 4
        while at < n:
            k = min(n - at, self.size - self.filled)
            self.open.append((doc_id, start + at, ids[4 * at : 4 * (at + k)], n if of is None else of))
            self.filled += k
            at += k
            if self.filled == self.size:
                out += self._close(self.open)
                self.open, self.filled = [], 0
        return out

    def _close(self, parts: list[tuple]) -> list[tuple]:
        out, offset = [], 0
        for doc_id, start, raw, n in parts:
            out.append((doc_id, start, len(raw) // 4, crc(raw), n, self.sequence, offset))
            offset += len(raw) // 4
        self.sequence += 1
        return out

    def end(self) -> list[tuple]:
        out, parts = [], self.open[::-1]
        for size in tail_sizes(self.filled):
            taken = []
            while size:
                doc_id, start, raw, n = parts.pop()
                k = min(size, len(raw) // 4)
                taken.append((doc_id, start, raw[: 4 * k], n))
                if 4 * k < len(raw):
                    parts.append((doc_id, start + k, raw[4 * k :], n))
                size -= k
            out += self._close(taken)
        self.open, self.filled = [], 0
        return out

    def tail(self) -> list[tuple]:
        """What is left, uncut: doc_id, start, ids, document's ids."""
        return self.open


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _batches(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, with end_id behind it, lies in one piece, and a document's pieces follow each other. All sequences but the last few have size ids, those a
    smaller power of two each, another for each. A sequence_id is the range's number times 2^32 plus a running number; tails come behind all ranges. Null texts are empty and
    pack their end id alone; without end_id they have no piece. Ids are integers or null, others raise. Rows that repeat an id are packed like any others; ties of the key go
    by id, then text. Texts may be as long as memory for one row allows. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    end, spark = b"" if end_id is None else struct.pack("<I", end_id), docs.sparkSession
    schema = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])
    wide = schema.append(pa.field("ids", pa.binary()))
    sizes, sizes_path = stored(add_curve_key(docs, id_col, text_col), "curve-keys")
    dealt = ranges(sizes, range_bytes)
    drop_tables(spark, [sizes_path])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, cutter = encoder(tokenizer, chunks=300_000, words=300_000), Cutter(size, part << 32)
        for b in batches:
            rows = []
            for name, raw in encoded(enc, b.column(0), b.column(1), most=1_000_000):
                rows += [(*p, None) for p in cutter.add(name, raw + end)]
                if len(rows) >= 5000:
                    yield _batches(rows, wide)
                    rows = []
            if rows:
                yield _batches(rows, wide)
        if cutter.open:
            yield _batches([(name, start, len(raw) // 4, 0, n, part, k, raw) for k, (name, start, raw, n) in enumerate(cutter.tail())], wide)

    last = dealt.n << 32

    def cut_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(size, last)
        for b in batches:
            rows = []
            for name, start, n, raw in zip(*(b.column(c).to_pylist() for c in (0, 1, 2, 3)), strict=True):
                rows += cutter.add(name, raw, start, n)
            if rows:
                yield _batches(rows, schema)
        if rows := cutter.end():
            yield _batches(rows, schema)

    rows = add_curve_key(docs, id_col, text_col, spark.sparkContext.broadcast(dealt)).repartitionById(dealt.n, F.col("range").cast("int")).sortWithinPartitions("key", "doc_id", "text")
    pieces, _ = stored(rows.select("doc_id", "text").mapInArrow(cut, PIECES + ", ids binary"), "pieces")
    tails = pieces.filter("ids IS NOT NULL").repartition(1).sortWithinPartitions("sequence_id", "offset")  # less than a sequence of each range
    tails = tails.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(cut_tails, PIECES)
    return pieces.filter("ids IS NULL").drop("ids").union(tails)


def op9_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), default_tokenizer())
