"""Language ID: script ranges narrow the candidates, per-word scores and a Viterbi path label spans of mixed text.

A word's score for a language is the sum of its character trigrams' log probabilities, for the languages whose training texts use the word's
script; a word in a script that no language uses says nothing. The path with the best sum of scores, less a penalty for every switch,
gives each word its language, and the language with the most letters is the text's. Training counts trigrams of a bounded sample of labelled texts
(about per_language of each) where they are read; only counts are gathered, languages times BUCKETS at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import claim, register
from .common import crc_fold, numbered, read_table
from .tokens import slices

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
UNKNOWN = "und"
#: First code points of letter ranges and the script of each range, up to the next; 0 is any other script.
SCRIPT_STARTS = (0, 0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x900, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000)
SCRIPT_OF = (0, 1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 0, 9, 10, 0, 1, 2, 0, 11, 0, 12, 0, 10, 0, 12, 0, 12)
SCRIPTS = 13
_STARTS, _OF = np.array(SCRIPT_STARTS, np.uint32), np.array(SCRIPT_OF)


def scripts_of(codes: np.ndarray) -> np.ndarray:
    return _OF[np.searchsorted(_STARTS, codes, side="right") - 1]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between a 2 and a 3, and where each word starts."""
    codes = np.frombuffer("".join(["\x02" + w + "\x03" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.flatnonzero(codes == 2)


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Of each trigram; those that run from one word into the next are left in."""
    h = (codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1]) * np.uint32(0x85EBCA6B) ^ codes[2:]
    return (h * np.uint32(0xC2B2AE35) >> np.uint32(17)).astype(np.int64)


class LanguageModel:
    """Scores of languages for words, with a bounded cache of words."""

    def __init__(self, languages: list[str], counts: np.ndarray, script_counts: np.ndarray, switch_penalty: float = 12.0, most_words: int = 300_000):
        self.languages, self.switch_penalty, self.most_words = languages, switch_penalty, most_words
        total = counts.sum(1, keepdims=True)
        self.logs = np.log((counts + 0.1) / (total + 0.1 * BUCKETS)).T.astype(np.float32).copy()
        self.uses = script_counts >= np.maximum(1, 0.001 * script_counts.sum(1, keepdims=True))
        self.default = int(total[:, 0].argmax()) if len(languages) else 0
        self.known: dict[str, int] = {}
        self.scores, self.letters = np.zeros((0, len(languages)), np.float32), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        codes, starts = _codes(words)
        logs = self.logs[_buckets(codes)]
        inner = np.ones(len(codes) - 2, bool)
        inner[starts[1:] - 1] = inner[starts[1:] - 2] = False
        new = np.add.reduceat(np.where(inner[:, None], logs, 0), starts, axis=0)
        allowed = self.uses[:, scripts_of(codes[starts + 1])].T
        new = np.where(allowed | ~allowed.any(1, keepdims=True), new, new.min(1, keepdims=True) - 20)
        new[~allowed.any(1)] = 0
        self.known.update(zip(words, range(len(self.scores), len(self.scores) + len(words)), strict=True))
        self.scores = np.concatenate([self.scores, new.astype(np.float32)])
        self.letters = np.concatenate([self.letters, np.array([sum(map(str.isalpha, w)) for w in words], np.int32)])

    def clear(self, more_than: int = 0) -> None:
        """Forget all words; numbers of rows that were given out no longer hold."""
        if len(self.known) > more_than:
            self.known, self.scores, self.letters = {}, self.scores[:0].copy(), self.letters[:0].copy()

    def rows_of(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, its words' rows in scores and letters."""
        words = [WORD.findall(t.lower()) for t in texts]
        missing = set()
        for w in words:
            missing |= set(w).difference(self.known)
        if missing:
            self._learn(sorted(missing))
        known = self.known
        return [np.fromiter(map(known.__getitem__, w), np.int32, len(w)) for w in words]

    def label(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The language number of each word of each text, by Viterbi; texts of like length go together."""
        out: list[np.ndarray] = [r[:0] for r in rows]
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: -len(rows[i]))
        i = 0
        while i < len(order):
            longest = len(rows[order[i]])
            j = i + 1
            while j < len(order) and j - i < 4096 and (j - i) * longest < 1_000_000 and 2 * len(rows[order[j]]) >= longest:
                j += 1
            group = order[i:j]
            for g, path in zip(group, self._viterbi([rows[g] for g in group], longest), strict=True):
                out[g] = path
            i = j
        return out

    def _viterbi(self, rows: list[np.ndarray], longest: int) -> list[np.ndarray]:
        n, k = len(rows), len(self.languages)
        padded = np.full((longest, n), -1, np.int32)
        for i, r in enumerate(rows):
            padded[: len(r), i] = r
        best = np.zeros((n, k), np.float32)
        stays, came = np.empty((longest, n, k), bool), np.empty((longest, n), np.int16)
        each = np.arange(n)
        for t in range(longest):
            came[t] = best.argmax(1)
            leave = (best[each, came[t]] - self.switch_penalty)[:, None]
            stays[t] = best >= leave
            step = self.scores[padded[t]]
            step[padded[t] < 0] = 0
            best = np.maximum(best, leave) + step
        state, path = best.argmax(1).astype(np.int16), np.empty((longest, n), np.int16)
        for t in range(longest - 1, -1, -1):
            path[t] = state
            state = np.where(stays[t, each, state], state, came[t])
        return [path[: len(r), i] for i, r in enumerate(rows)]


def train(labelled: DataFrame, per_language: int = 2000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", switch_penalty: float = 12.0) -> LanguageModel:
    """A model of the languages in lang_col. Rows without text or language are passed over, and without any row the model knows no language; per_language is the expected number of texts of each that are counted.

    Texts are chosen by hash of their id, so rows that repeat an id are counted all or none, rows without an id all alike, and whole texts are counted, however long. Other columns are ignored.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    million, share = 1_000_000, F.lit(0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, int(million * min(1, per_language / sizes[lang]))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit("language-id")), F.lit(million)) < share)
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scripts = np.zeros((len(number), BUCKETS), np.int64), np.zeros((len(number), SCRIPTS), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if words := WORD.findall(text.lower()):
                    codes, starts = _codes(words)
                    keep = np.ones(len(codes) - 2, bool)
                    keep[starts[1:] - 1] = keep[starts[1:] - 2] = False
                    total[number[lang]] += np.bincount(_buckets(codes)[keep], minlength=BUCKETS)
                    scripts[number[lang]] += np.bincount(scripts_of(codes[codes > 3]), minlength=SCRIPTS)
        both = np.concatenate([total, scripts], axis=1)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(both[i, j])], names=["lang", "feature", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(languages), BUCKETS + SCRIPTS), np.int64)
    table[counted["lang"].to_numpy(), counted["feature"].to_numpy()] = counted["n"].to_numpy()
    return LanguageModel(languages, table[:, :BUCKETS], table[:, BUCKETS:], switch_penalty)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry: Column | str = "doc_id", spans: bool = False) -> DataFrame:
    """carried, lang_pred, score, known, and with spans an array of (lang, start, end) by word number.

    score is the share of the text's letters in spans of lang_pred, known that in words of scripts that some language uses. Null texts and texts without a letter are `und`, with score 0, as are all if the model knows no language. A text whose letters are all
    in scripts that no language uses gets the language with the most training text and score 0. Ties go to the first language by name. carry
    names what each row keeps, for instance a struct of all columns; repeated rows each give theirs, other columns are ignored, and an empty table gives no rows.
    The text may be as long as memory for one row allows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select((F.col(carry) if isinstance(carry, str) else carry).alias("carried"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["carried"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        m: LanguageModel = held.value
        register("language", m.clear)
        for whole in batches:
            for s in range(0, whole.num_rows, 5000):
                b = whole.slice(s, 5000)
                m.clear(m.most_words)
                rows, texts = [], b.column(1).to_pylist()
                if not m.languages:
                    texts = [""] * len(texts)
                for i, j in slices(texts):
                    rows += m.rows_of([t or "" for t in texts[i:j]])
                texts.clear()
                names, scores, known, found = [], [], [], []
                for r, path in zip(rows, m.label(rows), strict=True):
                    n = m.letters[r]
                    if not n.sum():
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        known.append(0.0)
                    else:
                        letters = np.bincount(path, n, len(m.languages))
                        telling = m.scores[r].any(1)
                        top = int(letters.argmax()) if telling.any() else m.default
                        names.append(m.languages[top])
                        scores.append(float(letters[top] / letters.sum()) if telling.any() else 0.0)
                        known.append(float(n[telling].sum() / n.sum()))
                    if spans:
                        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)] if len(path) else [0]
                        found.append([{"lang": m.languages[path[i]], "start": i, "end": j} for i, j in zip(edges, edges[1:], strict=False)])
                cols = [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known, pa.float64())]
                if spans:
                    cols.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(cols, names=["carried", "lang_pred", "score", "known", "spans"][: len(cols)])

    return rows.mapInArrow(run, f"carried {kind}, lang_pred string, score double, known double" + ", spans array<struct<lang:string,start:int,end:int>>" * spans)


def drop_unidentified(docs: DataFrame, model: LanguageModel, text_col: str = "text", least_known: float = 0.4) -> DataFrame:
    """docs without rows whose text has no letter, or fewer than least_known of its letters in words of scripts that some language uses; mixed text stays, however many languages share it.

    All columns stay, whatever their names, and no row is shuffled. Null and empty texts go; rows that repeat stay or go together; null ids don't matter. An empty table stays
    empty, and a model without languages takes all rows away.
    """
    plain, (text,) = numbered(docs, text_col)
    rows = identify(plain.select(F.struct(*plain.columns).alias("row"), text.alias("text")), model, "text", "row")
    return rows.filter((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= least_known)).select("carried.*").toDF(*docs.columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() by a model of the documents that are not held out. A row without an id has no remainder: it is neither held out nor learned from."""
    docs = read_table(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 4)
    model = train(docs.filter(fold != 2))
    out = identify(docs, model)
    return out.select(F.col("carried").alias("doc_id"), F.coalesce(crc_fold(F.col("carried"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
