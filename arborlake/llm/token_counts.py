"""Edit-aware token counts: a segment tree of pre-token runs for each text, re-encoded only where edits touch it.

A leaf is a run of about LEAF characters that ends behind a blank or a line end, where this tokenizer never looks across; inner nodes hold the sums of
characters and tokens below them. An edit descends by character sums to the leaves it touches, takes in the next leaf as long as the new
text does not end at such a boundary, re-encodes these alone, and updates the sums on the paths to the root; if the number of leaves
changes, the sums are laid out anew without encoding anything else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_of
from .tokens import WordCachedEncoder, default_tokenizer, encoder, slices

LEAF = 512
_LEAF = re.compile(r"(?s).{0,%d}[^ \n\t\r]*[ \n\t\r]?" % (LEAF - 1))


def leaves_of(text: str) -> list[str]:
    """Runs that each end behind a boundary, or at the end of the text."""
    out, at = [], 0
    while at < len(text):
        end = _LEAF.match(text, at).end()
        out.append(text[at:end])
        at = end
    return out


class SegmentTree:
    """Sums of characters and tokens in heap order: node 1 is the root, leaf i is node size + i."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.lay_out(np.array([chars, tokens], np.int64).reshape(2, -1))

    def lay_out(self, leaves: np.ndarray) -> None:
        self.n = leaves.shape[1]
        self.size = 1 << max(0, (self.n - 1).bit_length())
        self.sums = np.zeros((2, 2 * self.size), np.int64)
        self.sums[:, self.size : self.size + self.n] = leaves
        at = self.size
        while at > 1:
            self.sums[:, at // 2 : at] = self.sums[:, at : 2 * at : 2] + self.sums[:, at + 1 : 2 * at : 2]
            at //= 2

    @classmethod
    def load(cls, n: int, chars: list[int], tokens: list[int]) -> SegmentTree:
        tree = cls.__new__(cls)
        tree.n, tree.size, tree.sums = n, len(chars) // 2, np.array([chars, tokens], np.int64)
        return tree

    chars = property(lambda self: int(self.sums[0, 1]))
    tokens = property(lambda self: int(self.sums[1, 1]))

    def leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at offset, or the last, and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            left = 2 * node
            if offset < start + self.sums[0, left] or not self.sums[0, left + 1]:
                node = left
            else:
                start += int(self.sums[0, left])
                node = left + 1
        return node - self.size, start

    def length(self, leaf: int) -> int:
        return int(self.sums[0, self.size + leaf])

    def replace(self, first: int, last: int, chars: list[int], tokens: list[int]) -> None:
        """Put new leaves in the place of [first, last)."""
        new = np.array([chars, tokens], np.int64).reshape(2, -1)
        if new.shape[1] != last - first:
            old = self.sums[:, self.size : self.size + self.n]
            self.lay_out(np.concatenate([old[:, :first], new, old[:, last:]], axis=1))
            return
        self.sums[:, self.size + first : self.size + last] = new
        lo, hi = (self.size + first) // 2, (self.size + last - 1) // 2
        while lo >= 1 and last > first:
            for node in range(lo, hi + 1):
                self.sums[:, node] = self.sums[:, 2 * node] + self.sums[:, 2 * node + 1]
            lo, hi = lo // 2, hi // 2


def count(enc: WordCachedEncoder, parts: list[str]) -> list[int]:
    return [len(x) // 4 for x in enc.encode(parts)]


def build(enc: WordCachedEncoder, texts: list[str]) -> list[SegmentTree]:
    parts = [leaves_of(t) for t in texts]
    tokens = iter(count(enc, [p for ps in parts for p in ps]))
    return [SegmentTree([len(p) for p in ps], [next(tokens) for _ in ps]) for ps in parts]


def apply_edit(enc: WordCachedEncoder, text: str, tree: SegmentTree, start: int, length: int, insert: str) -> tuple[str, int]:
    """The new text, and how many characters were encoded for it; tree is changed. start and length are clipped to the text."""
    start = min(max(0, start), len(text))
    stop = min(len(text), start + max(0, length))
    new = text[:start] + insert + text[stop:]
    if not tree.n:
        region, first, last = insert, 0, 0
    else:
        first, left = tree.leaf_at(start)
        last, at = tree.leaf_at(max(start, stop - 1))
        right = at + tree.length(last)
        last += 1
        region = text[left:start] + insert + text[stop:right]
        while last < tree.n and region and region[-1] not in " \n\t\r":  # the boundary that the next leaf stood behind is gone
            region += text[right : right + tree.length(last)]
            right += tree.length(last)
            last += 1
    parts = leaves_of(region)
    tree.replace(first, last, [len(p) for p in parts], count(enc, parts))
    return new, len(region)


EDITS = "array<struct<start:int,length:int,insert:string>>"
COUNTS = "doc_id long, n_tokens_before long, n_tokens_after long, n_chars_before long, n_chars_after long, encoded_chars long"
_TREE = "n_leaves int, tree_chars array<long>, tree_tokens array<long>"


def _columns(trees: list[SegmentTree]) -> list[pa.Array]:
    return [pa.array([t.n for t in trees], pa.int32()), pa.array([t.sums[0] for t in trees], pa.list_(pa.int64())), pa.array([t.sums[1] for t in trees], pa.list_(pa.int64()))]


def build_trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_leaves, tree_chars, tree_tokens (sums in heap order; the root, at 1, has the text's) to be kept beside the texts. Null texts are empty and have no leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *_columns(build(enc, texts[i:j]))], names=["doc_id", "n_leaves", "tree_chars", "tree_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text")).mapInArrow(run, f"doc_id long, {_TREE}")


def edit_trees(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text, tree and encoded_chars after the edits of each row: doc_id, text, n_leaves, tree_chars, tree_tokens and edits (EDITS, one after the other, each on what the last left)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for s in range(0, b.num_rows, 500):
                texts, trees, work = [], [], []
                for r in b.slice(s, 500).to_pylist():
                    tree, text, done = SegmentTree.load(r["n_leaves"], r["tree_chars"], r["tree_tokens"]), r["text"] or "", 0
                    for e in r["edits"] or []:
                        text, n = apply_edit(enc, text, tree, e["start"] or 0, e["length"] or 0, e["insert"] or "")
                        done += n
                    texts.append(text)
                    trees.append(tree)
                    work.append(done)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, 500), pa.array(texts, pa.string()), *_columns(trees), pa.array(work, pa.int64())], names=["doc_id", "text", "n_leaves", "tree_chars", "tree_tokens", "encoded_chars"])

    return rows.select("doc_id", "text", "n_leaves", "tree_chars", "tree_tokens", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, f"doc_id long, text string, {_TREE}, encoded_chars long")


def count_edited(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """Trees built and edited in one pass: doc_id, token and character counts before and after the edits, and how many characters the edits had encoded.

    edits_col is EDITS. Null texts are empty; null edits, and nulls in an edit, do nothing; places beyond the text are clipped to it. Null ids are carried, repeated rows each
    give theirs, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                out = []
                for tree, text, edits in zip(build(enc, texts[i:j]), texts[i:j], b.column(2).slice(i, j - i).to_pylist(), strict=True):
                    before, done = (tree.tokens, tree.chars), 0
                    for e in edits or []:
                        if e:
                            text, n = apply_edit(enc, text, tree, e["start"] or 0, e["length"] or 0, e["insert"] or "")
                            done += n
                    out.append((before[0], tree.tokens, before[1], tree.chars, done))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=[c.split()[0] for c in COUNTS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"), F.col(edits_col).cast(EDITS).alias("edits")).mapInArrow(run, COUNTS)


def stated_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each, placed by the id's checksum: some characters replaced, some deleted, a word added at the end."""
    n = F.char_length(text_of(F.col("text"))) + 1
    place = lambda salt: F.pmod(F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(salt)).cast("binary")), n).cast("int")
    edit = lambda start, length, insert: F.struct(start.alias("start"), F.lit(length).alias("length"), F.lit(insert).alias("insert"))
    return docs.select("doc_id", "text", F.array(edit(place("a"), 12, "re-edited, "), edit(place("b"), 40, ""), edit(n, 0, " appended")).alias("edits"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_edited(stated_edits(read_table(spark, sf_dir, "documents")), default_tokenizer())
