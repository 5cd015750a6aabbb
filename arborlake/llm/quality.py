"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of PASSAGE words, all of them. A passage is described by how often classes of characters follow each other and by
repetition of its words, and encoded by a learned layer; a gated attention, learned from labels of whole texts, weighs the passages,
and the weighted sum of their encodings gives the score. Training reads a bounded sample of labelled texts; scoring is one map over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import claim
from .common import crc_fold, read_table, text_of
from .tokens import slices

PASSAGE, CLASSES = 64, 14
FEATURES = CLASSES * CLASSES + 6


def _class_table() -> np.ndarray:
    """By byte: lower, upper, digit, blank, line end, sentence marks, quotes, brackets, slashes and bars, dashes, three of symbols, and bytes over 127."""
    table = np.full(256, 12, np.uint8)
    for k, members in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:", "'\"`", "()[]{}<>", "/\\|", "-_=+~", "#*^", "$%&@")):
        table[[ord(c) for c in members]] = k
    table[128:] = 13
    return table


_CLASS = _class_table()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and the number of passages of each text: one, all zero, for a text without words."""
    raw = [t.encode("utf-8", "surrogatepass") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)  # of words; each text ends in a blank, so no word crosses texts
    text_of_word = np.searchsorted(ends, starts, side="right")
    words = np.bincount(text_of_word, minlength=len(texts))
    passages = np.maximum(1, -(-words // PASSAGE))
    before = np.cumsum(passages) - passages
    number = np.arange(len(starts)) - np.repeat(np.cumsum(words) - words, words)
    of_word = before[text_of_word] + number // PASSAGE
    n = int(passages.sum())
    out = np.zeros((n, FEATURES), np.float32)
    if not len(starts):
        return out, passages
    word_of_byte = np.cumsum(first) - 1
    inside = np.flatnonzero(word_of_byte >= 0)
    inside = inside[(inside < len(data) - 1)]
    same_text = np.ones(len(data), bool)
    same_text[ends - 1] = False  # nor does a pair of characters
    inside = inside[same_text[inside]]
    cls = _CLASS[data].astype(np.int64)
    pair = cls[inside] * CLASSES + cls[inside + 1]
    counts = np.bincount(of_word[word_of_byte[inside]] * (CLASSES * CLASSES) + pair, minlength=n * CLASSES * CLASSES).reshape(n, -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))

    solid = np.flatnonzero(~space)
    at = solid - starts[word_of_byte[solid]]
    hashes = np.add.reduceat(_BYTE[data[solid]] * (2 * at + 1).astype(np.uint64) ** np.uint64(3), np.searchsorted(solid, starts))
    size = np.bincount(of_word, minlength=n)
    filled = np.maximum(1, size)
    keys = np.unique((of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    length = np.diff(np.append(np.searchsorted(solid, starts), len(solid)))
    mean = np.bincount(of_word, length, n) / filled
    out[:, -6] = distinct / filled
    out[:, -5] = np.bincount(of_word, again, n) / filled
    out[:, -4] = np.log1p(mean) / 3
    out[:, -3] = np.bincount(of_word, length > 15, n) / filled
    out[:, -2] = np.log1p(size) / 5
    out[:, -1] = size > 0
    return out, passages


class AttentionModel:
    """H = tanh(X W + b); weights softmax(w . (tanh(H V) * sigmoid(H U))) within a text; score sigmoid(c . sum + d)."""

    def __init__(self, width: int = 24, gate: int = 12, seed: int = 5):
        r = np.random.default_rng(seed)
        shape = {"W": (FEATURES, width), "b": (width,), "V": (width, gate), "U": (width, gate), "w": (gate,), "c": (width,), "d": (1,)}
        self.p = {k: (r.standard_normal(s) / np.sqrt(s[0]) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        a, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (a * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        weight = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * weight[:, None], starts)
        return {"h": h, "a": a, "g": g, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.forward(x, counts)["score"].astype(np.float64)

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        p, f, starts = self.p, self.forward(x, counts), np.cumsum(counts) - counts
        h, a, g, weight = f["h"], f["a"], f["g"], f["weight"]
        ds = (f["score"] - y) / len(y)
        dz = np.repeat(np.outer(ds, p["c"]), counts, axis=0)
        dh = weight[:, None] * dz
        dw = (dz * h).sum(1)
        de = weight * (dw - np.repeat(np.add.reduceat(weight * dw, starts), counts))
        da, dg = de[:, None] * p["w"] * g * (1 - a * a), de[:, None] * p["w"] * a * g * (1 - g)
        dh += da @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ da, "U": h.T @ dg, "w": (a * g).T @ de, "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> None:
        """Adam over shuffled texts, with a step size that falls to nothing."""
        r, steps = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        total = epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(bags), batch):
                take = order[i : i + batch]
                grads = self.gradients(np.concatenate([bags[k] for k in take]), np.array([len(bags[k]) for k in take]), y[take])
                steps += 1
                for k, g in grads.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * (1 - steps / total) * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, most_texts: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel:
    """A model of label_col, 0 or 1, from about most_texts labelled texts, chosen by hash of their id; labels of one id are averaged. Null ids and labels are passed over."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.avg("y").alias("y"))
    million, n = 1_000_000, known.count()
    sample = known.filter(F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(million)) < int(million * min(1, most_texts / max(1, n))))
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text")).join(F.broadcast(sample), "id")  # about most_texts rows of 16 bytes

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, counts = features(b.column(0).to_pylist())
            parts = np.split(x.astype(np.float16), np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([p.tobytes() for p in parts], pa.binary()), b.column(2)], names=["id", "x", "y"])

    got = sorted(rows.select("text", F.col("id").cast("string").alias("id"), "y").mapInArrow(bags, "id string, x binary, y double").toArrow().to_pylist(), key=lambda r: (r["id"], r["x"]))
    model = AttentionModel()
    if got:
        model.fit([np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in got], np.array([r["y"] for r in got], np.float32))
    return model


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score from 0 to 1, top_passage (the number of the passage with the largest weight), one row for each row of docs.

    Null texts count as empty, and empty texts get the score of an empty passage. Repeated rows each get theirs, null ids are carried, other columns ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                x, counts = features(texts[i:j])
                f = held.value.forward(x, counts)
                top = [int(w.argmax()) for w in np.split(f["weight"], np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(f["score"].astype(np.float64)), pa.array(top, pa.int32())], names=["doc_id", "score", "top_passage"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, top_passage int")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(crc_fold(F.col("doc_id"), 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
