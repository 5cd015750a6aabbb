"""Token ids of whole texts with a public tokenizer, exact, and much faster on large corpora by caching words."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .caches import claim, register

#: A line that is a word with ASCII marks behind, or any other line.
_CHUNK = re.compile(r"(?m)^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)|(.+))$")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordCachedEncoder:
    """encode(texts) gives each text's ids as little-endian 32-bit bytes, the same as the tokenizer's on the whole text.

    It holds for tokenizers that drop white space and whose normaliser and pre-tokenizer never look across it: a text is
    then its chunks between blanks one after the other. A chunk of Latin letters with ASCII marks behind is in turn its
    word and its marks, since the pre-tokenizer splits letters from marks. Whatever has other characters goes to
    the tokenizer as it is. Caches are emptied when full, so memory is bounded.
    """

    def __init__(self, path: str, chunks: int = 600_000, words: int = 700_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.chunks, self.words, self.most_chunks, self.most_words = {"": b""}, {}, chunks, words

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_words(self, words: list[str]) -> None:
        """Encode words of letters together and cut at the ids that end a word."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                raw, at = ids.tobytes(), 0
                for word, stop in zip(part, stops.tolist(), strict=True):
                    self.words[word] = raw[at : 4 * stop]
                    at = 4 * stop
            else:
                for word in part:
                    self.words[word] = self._plain(word)

    def _learn(self, missing: list[str]) -> None:
        found = _CHUNK.findall("\n".join(missing))
        lower = "\n".join([f[0] for f in found]).lower().split("\n")
        self._learn_words([w for w in set(lower).difference(self.words) if w])
        words, marks = self.words, {m: self._plain(m) for m in {f[1] for f in found}}
        other = [f[2] for f in found if f[2]]
        plain = iter([np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(other, add_special_tokens=False)])
        self.chunks.update(zip(missing, [next(plain) if f[2] else words[w] + marks[f[1]] if f[1] else words[w] for w, f in zip(lower, found, strict=True)], strict=True))

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        if len(self.chunks) > self.most_chunks:
            self.chunks = {"": b""}
        if len(self.words) > self.most_words:
            self.words = {}
        column = pc.coalesce(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), pa.scalar("")).cast(pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        coded = lists.values.dictionary_encode()
        distinct, of = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        raw = list(map(self.chunks.get, distinct))
        if missing := [c for c, r in zip(distinct, raw, strict=True) if r is None]:
            self._learn(missing)
            raw = list(map(self.chunks.__getitem__, distinct))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        n = size[of]
        stops = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((np.cumsum(size) - size)[of] - stops[:-1], n)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(raw), "<u4")[at].tobytes()
        edges = (4 * stops[lists.offsets.to_numpy()]).tolist()
        return [ids[i:j] for i, j in zip(edges, edges[1:], strict=False)]


_ENCODERS: dict[tuple, WordCachedEncoder] = {}
register("tokens", _ENCODERS.clear)


def encoder(path: str, **most: int) -> WordCachedEncoder:
    """One for each worker process, tokenizer and size of caches."""
    claim("tokens")
    key = (path, *sorted(most.items()))
    if key not in _ENCODERS:
        _ENCODERS[key] = WordCachedEncoder(path, **most)
    return _ENCODERS[key]


def slices(texts: list[str | None], characters: int = 2_000_000):
    """(start, stop) of consecutive texts with about so many characters together."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= characters:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def text_slices(texts: pa.Array, characters: int = 400_000):
    """(start, texts) of consecutive texts with about so many characters together; only one slice is held as Python strings."""
    stops = np.cumsum(pc.coalesce(pc.utf8_length(texts), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        done = int(stops[start - 1]) if start else 0
        stop = min(len(texts), int(np.searchsorted(stops, done + characters)) + 1)
        yield start, texts.slice(start, stop - start).to_pylist()
        start = stop


def encoded(enc: WordCachedEncoder, ids: pa.Array, texts: pa.Array, most: int = 4_000_000):
    """Each id and its text's ids as bytes, a few MB of text at a time."""
    stops = np.cumsum(pc.coalesce(pc.binary_length(texts), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.searchsorted(stops, np.arange(most, int(stops[-1]) if len(stops) else 0, most), side="right"))
    edges = [0, *(c for c in cuts.tolist() if 0 < c < len(stops)), len(stops)]
    for i, j in zip(edges, edges[1:], strict=False):
        yield from zip(ids.slice(i, j - i).to_pylist(), enc.encode(texts.slice(i, j - i)), strict=True)


def crc(data: bytes) -> int:
    return zlib.crc32(data)
