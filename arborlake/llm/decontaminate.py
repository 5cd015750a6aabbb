"""Benchmark decontamination: rare n-gram seeds find where a text may hold a test item, word-level Smith-Waterman scores it.

The benchmark is a stated query set: its items are read to the driver in blocks of at most block_words words, and each block's seed table is
broadcast, whatever the benchmark's size; a block's matches are written before the next block is read, and its tables are given back. The corpus is scanned twice a block and
never shuffled. The first scan counts in how many texts each seed occurs, over all texts, and gives one row per seed and task; the second finds the seeds that are kept and
aligns on the spot. A seed is size words in a row, or size of size + 1 with one left out, so that regular edits leave some; it is kept if it is rare in the
corpus or among the rarest half of its item's seeds, so that an item that leaked into very many texts keeps seeds too. One seed is enough for an alignment, unless
too few of the item's words stand nearby for any alignment to reach the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import claim
from .common import numbered, quoted, read_table, row_key, stored, text_of, without_rows
from .shingles import _MIX, mix, word_stream
from .small_table import small_table
from .tokens import text_slices

MATCH, MISMATCH, GAP = 2, -1, -1
MATCHES = "score double, n_seeds long, doc_start long, doc_end long, item_start long, item_end long"
_MARKS = re.compile("[\u0080-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb-\u00bf\u00d7\u00f7\u2000-\u206f\u20a0-\u20cf\u2190-\u2bff\u3000-\u3004\u3008-\u3020\ufe30-\ufe4f\uff00-\uff0f\uff1a-\uff20]")
#: Characters of scripts that are written without blanks (Thai, Lao, Tibetan, Burmese, Khmer, Tai, Javanese, Kana, Bopomofo, Han, Yi): each is a word.
_ALONE = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3021-\u3029\u3031-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\ua4cf\ua980-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and each word's text: runs of letters, digits and other characters over 127 but marks, lower-cased; in scripts without blanks, each character."""
    plain = [t.lower() if t.isascii() else _ALONE.sub(r" \g<0> ", _MARKS.sub(" ", t.lower())) for t in texts]
    return word_stream([t.encode("utf-8", "surrogatepass") for t in plain], _INSIDE)


def patterns(words: int, size: int) -> list[tuple[int, ...]]:
    """Which words make a seed of an item of so many words: size in a row, and those of size + 1 with an inner one left out; all words of a shorter item."""
    if words <= size:
        return [tuple(range(words))] if words else []
    return [tuple(range(size)), *(tuple(i + (i >= gap) for i in range(size)) for gap in range(1, size))]


def grams(words: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """A hash of the pattern's words at each place where it fits."""
    n = max(0, len(words) - pattern[-1])
    out = np.full(n, sum(1 << i for i in pattern), np.uint64)
    for i in pattern:
        out = mix(out * _MIX[0] + words[i : i + n])
    return out


def seed_hits(words: np.ndarray, of_text: np.ndarray, seeds: "Seeds") -> tuple[np.ndarray, np.ndarray]:
    """Positions in words where a seed starts that lies in one text, ascending, and the seeds' numbers."""
    every = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for pattern in seeds.patterns:
        pos, k = seeds.find(grams(words, pattern))
        whole = of_text[pos] == of_text[pos + pattern[-1]]
        every.append((pos[whole], k[whole]))
    pos, k = (np.concatenate(x) for x in zip(*every, strict=True))
    order = np.argsort(pos, kind="stable")
    return pos[order], k[order]


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score of two sequences of word hashes with linear gaps, and the last aligned position in each, -1 if nothing matches."""
    row, steps = np.zeros(len(b) + 1, np.int64), GAP * np.arange(len(b) + 1)
    best = (0, -1, -1)
    for i, x in enumerate(a):
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), row[1:] + GAP), 0)
        row = np.maximum.accumulate(new - steps) + steps  # gaps along the row
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j - 1)
    return best


def align(item: np.ndarray, window: np.ndarray) -> tuple[float, tuple[int, int], tuple[int, int]]:
    """Score as a share of the item's full score, and the aligned [start, stop) in the item and in the window."""
    score, i, j = smith_waterman(item, window)
    if score <= 0:
        return 0.0, (0, 0), (0, 0)
    _, p, q = smith_waterman(item[: i + 1][::-1], window[: j + 1][::-1])
    return score / (MATCH * len(item)), (i - p, i + 1), (j - q, j + 1)


class Seeds:
    """Sorted seed hashes with the places they have in items, and the patterns they are made by."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray, at: np.ndarray, made: list[tuple[int, ...]]):
        self.patterns = made
        order = np.lexsort((at, items, hashes))
        self.hashes, self.items, self.at = hashes[order], items[order], at[order]
        self.keys, self.first = np.unique(self.hashes, return_index=True)
        self.stop = np.append(self.first[1:], len(self.hashes))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams that hold a seed, and the seed's number among keys."""
        near = np.flatnonzero(self.bits[(grams >> np.uint64(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, grams[near]), max(0, len(self.keys) - 1))
        hit = self.keys[k] == grams[near] if len(self.keys) else np.zeros(len(near), bool)
        return near[hit], k[hit]


def item_seeds(items: list[np.ndarray], size: int) -> Seeds:
    """All seeds of all items, by their patterns."""
    hashes, of_item, at, made = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], set()
    for i, x in enumerate(items):
        for pattern in patterns(len(x), size):
            g = grams(x, pattern)
            made.add(pattern)
            hashes.append(g)
            of_item.append(np.full(len(g), i))
            at.append(np.arange(len(g)))
    return Seeds(np.concatenate(hashes), np.concatenate(of_item), np.concatenate(at), sorted(made))


def kept_seeds(seeds: Seeds, counts: np.ndarray, most: int) -> Seeds:
    """Those of at most so many texts, and of each item the rarest half. counts: texts for each of the seeds' keys."""
    counts = counts[np.searchsorted(seeds.keys, seeds.hashes)]
    keep = counts <= most
    order = np.lexsort((seeds.hashes, counts, seeds.items))
    rank = np.empty(len(order), np.int64)
    lengths = np.bincount(seeds.items, minlength=int(seeds.items.max()) + 1) if len(order) else np.zeros(0, int)
    rank[order] = np.arange(len(order)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keep |= rank < (lengths[seeds.items] + 1) // 2
    return Seeds(seeds.hashes[keep], seeds.items[keep], seeds.at[keep], seeds.patterns)


def least_score(words: int, min_score: float, min_words: int) -> float:
    """The share of its full score that an item of so many words needs: min_score, but no less than min_words words, or all of its own, are worth."""
    return max(min_score, min(1.0, min_words / words))


def find_items(words: np.ndarray, pos: np.ndarray, k: np.ndarray, items: list[np.ndarray], seeds: Seeds, min_score: float, min_words: int) -> list[tuple]:
    """For each item that a text holds: its number, score, seeds, and the aligned places in text and item. pos, k: where which seed starts in words."""
    times = seeds.stop[k] - seeds.first[k]
    entry = np.repeat(seeds.first[k] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
    of_item, at = seeds.items[entry], seeds.at[entry]
    diagonal = np.repeat(pos, times) - at
    order = np.lexsort((at, diagonal, of_item))
    of_item, at, diagonal = of_item[order], at[order], diagonal[order]
    slack = np.array([len(items[i]) // 4 + 8 for i in of_item.tolist()])
    cuts = np.flatnonzero((np.diff(of_item) != 0) | (np.diff(diagonal) > slack[1:])) + 1
    best: dict[int, tuple] = {}
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)], strict=True):
        item, wide = int(of_item[lo]), int(slack[lo])
        own, start = items[item], max(0, int(diagonal[lo]) - wide)
        window, least = words[start : int(diagonal[hi - 1]) + len(own) + wide], least_score(len(own), min_score, min_words)
        if np.isin(own, window).sum() < least * len(own):  # no alignment scores more than all words of the item that stand there
            continue
        score, (i, j), (p, q) = align(own, window)
        if score >= least and (item not in best or score > best[item][1]):
            best[item] = (item, score, len(np.unique(at[lo:hi])), start + p, start + q, i, j)
    return list(best.values())


def _block(rows: DataFrame, names: list, kind: str, texts: list[str], size: int, rare_share: float, min_score: float, min_words: int, n_docs: int) -> DataFrame:
    spark = rows.sparkSession
    words, of_text = words_of(texts)
    items = np.split(words, np.searchsorted(of_text, np.arange(1, len(texts))))
    seeds = item_seeds(items, size)
    every = spark.sparkContext.broadcast(seeds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        seeds = every.value
        total = np.zeros(len(seeds.keys), np.int64)
        for b in batches:
            for _, texts in text_slices(b.column(0)):
                words, of_text = words_of(texts)
                pos, k = seed_hits(words, of_text, seeds)
                total += np.bincount(np.unique(of_text[pos] * len(seeds.keys) + k) % max(1, len(seeds.keys)), minlength=len(seeds.keys))
        got = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(total[got])], names=["seed", "n"])

    counted = rows.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # a row for each of the block's seeds at most
    counts = np.zeros(len(seeds.keys), np.int64)
    counts[counted["seed"].to_numpy()] = counted["n"].to_numpy()
    kept = spark.sparkContext.broadcast((items, kept_seeds(seeds, counts, max(5, int(rare_share * n_docs)))))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        items, seeds = kept.value
        for b in batches:
            at, out = [], []
            for i, texts in text_slices(b.column(0)):
                words, of_text = words_of(texts)
                pos, k = seed_hits(words, of_text, seeds)
                edges = np.searchsorted(of_text, np.arange(len(texts) + 1))
                for d in np.unique(of_text[pos]).tolist():
                    lo, hi = np.searchsorted(pos, edges[d : d + 2])
                    found = find_items(words[edges[d] : edges[d + 1]], pos[lo:hi] - edges[d], k[lo:hi], items, seeds, min_score, min_words)
                    at += [i + d] * len(found)
                    out += found
            if out:
                cols = [pa.array(c, pa.float64() if n == 1 else pa.int64()) for n, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at, pa.int64())), *cols], names=["doc_id", "number", *(c.split()[0] for c in MATCHES.split(", "))])

    found = rows.select("text", "doc_id").mapInArrow(match, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, number long, {MATCHES}")
    named = small_table(spark, f"number long, item_id {kind}", list(range(len(names))), names)  # a row for each of the block's items
    out, _ = stored(found.join(F.broadcast(named), "number").select("doc_id", "item_id", *(c.split()[0] for c in MATCHES.split(", "))), "matches")
    every.destroy()
    kept.destroy()
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 3, rare_share: float = 0.001, min_score: float = 0.4, min_words: int = 8, block_words: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per text and test item it holds: doc_id, item_id, score (1: the whole item word by word), n_seeds, and the
    aligned words of text and item as [start, end).

    Words are runs of letters and digits, lower-cased, and single characters of scripts without blanks (words_of). A copy is found if one of its seeds is unchanged and its
    alignment has min_score of the item's full score and is worth min_words words at least, or for items of fewer, all of them; of several places the best counts, the
    first of equals. Items of fewer than size words match where all their words stand in a row. Items without words, or null, match nothing; so do null and empty texts.
    Repeated rows, of texts or items, each give their rows; null ids are carried, and ids may be of any type. Texts may be as long as memory for one row allows. Other columns are
    ignored, whatever their names. Without texts or items there are no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(quoted(text_col)).alias("text"))
    asked = benchmark.select(quoted(item_id_col).alias("item_id"), text_of(quoted(item_text_col)).alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    n_docs = rows.count()
    names, texts, held, found = [], [], 0, []
    for name, text in asked.toLocalIterator():
        names.append(name)
        texts.append(text)
        held += len(text) // 4
        if held >= block_words:
            found.append(_block(rows, names, kind, texts, size, rare_share, min_score, min_words, n_docs))
            names, texts, held = [], [], 0
    if names:
        found.append(_block(rows, names, kind, texts, size, rare_share, min_score, min_words, n_docs))
    none = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {kind}, {MATCHES}"
    return reduce(DataFrame.union, found) if found else small_table(spark, none, *([] for _ in none.split(", ")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that hold a test item; all columns stay, whatever their names.

    Rows are judged one by one by their own text: of an id's several texts only those that hold an item go, and rows without an id are judged like others. Rows that repeat
    stay or go together. Null and empty texts stay. An empty table, of texts or items, takes nothing away.
    """
    plain, (own, text) = numbered(docs, id_col, text_col)
    key = row_key(own, text)
    found = find_contamination(plain.select(key.alias("key"), text.alias("text")), benchmark, id_col="key", text_col="text", **options)
    return without_rows(plain, key, found.select(F.col("doc_id").alias("key"), F.lit(True).alias("gone")).distinct(), docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
