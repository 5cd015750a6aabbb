import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from arborlake.llm import packing as P
from arborlake.llm import simple8b as S
from arborlake.llm import token_counts as C
from arborlake.llm import token_files as TF
from arborlake.llm.common import table_path
from arborlake.llm.tokens import WordCachedEncoder, default_tokenizer, encoded, encoder

PLAIN = Tokenizer.from_file(default_tokenizer())


def ids_of(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids, "<u4")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZé ß\n\t.,'<|>-5\u0301\u3000漢Σς\x1cİ"), st.characters(exclude_categories=["Cs"]))))
def test_encoder_is_the_tokenizer(text):
    for t in (text, text + " <|endoftext|>. don't I'LL"):
        assert encoder(default_tokenizer()).encode([t])[0] == ids_of(t).tobytes()


def test_encoder_with_small_caches():
    enc, texts = WordCachedEncoder(default_tokenizer(), 5, 5), ["one two, three! one", None, "", "two two four five six seven eight", "one " * 50]
    for _ in range(3):
        assert [r for _, r in encoded(enc, pa.array(range(5)), pa.array(texts), 10)] == [ids_of(t).tobytes() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, escapes, word_at, escape_at = S.encode_groups(v)
    assert (S.decode(words, escapes) == v).all() and word_at[-1] == len(words) and escape_at[-1] == len(escapes) == (v >= 2**60).sum()


def test_blocks_and_groups():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 49_408, n).astype("<u4") for n in (0, 1, 9000, 3, 5000)]
    data = TF.pack_block([5, None, 7, 8, 9], docs)
    names, known, lengths, values = TF.unpack_block(data)
    everything = np.concatenate(docs)
    assert known.tolist() == [1, 0, 1, 1, 1] and lengths.tolist() == [len(d) for d in docs] and (values == everything).all()
    for g in range(-(-len(everything) // S.GROUP)):
        assert (TF.unpack_group(data, g) == everything[g * S.GROUP : (g + 1) * S.GROUP]).all()
    with pytest.raises(ValueError):
        TF.unpack_block(b"XXXX" + data[4:])


def whole_order(rows, end=True):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.append(ids_of(t), 1).astype("<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_op10_against_the_tokenizer(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, TF.op10_token_files(spark, sf).collect()), key=repr) == whole_order(rows)


def test_token_files_of_odd_rows(spark, odd, none):
    path = table_path(spark, "odd-tokens")
    TF.write_token_files(odd, path, default_tokenizer(), ids_per_block=100)
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in TF.read_token_files(spark, path).collect()]
    assert sorted(got, key=repr) == whole_order([(r["doc_id"], r["text"]) for r in odd.collect()])
    path = table_path(spark, "no-tokens")
    TF.write_token_files(none, path, default_tokenizer())
    assert TF.read_token_files(spark, path).count() == 0


def held_pieces(got, ref, size=2048):
    """Every id of ref (by document and order) in one piece, and sequences without gaps."""
    sequences, parts = {}, {}
    for doc, start, length, crc, n, seq, offset in got:
        parts.setdefault(doc, []).append((start, length, crc, n))
        sequences.setdefault(seq, []).append((offset, length))
    for doc, ids in ref.items():
        at = 0
        for start, length, crc, n in sorted(parts.pop(doc, [])):
            assert start == at and n == len(ids) and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert not parts
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == size or at & (at - 1) == 0 and at < size


def test_op9_holds_every_id(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    held_pieces(map(tuple, P.op9_curve_packing(spark, sf).collect()), {i: np.append(ids_of(t), 1).astype("<u4") for i, t in rows})


def test_packing_odd_rows(spark, odd, none):
    one = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    held_pieces(map(tuple, P.pack(one, default_tokenizer(), 64).collect()), {r["doc_id"]: np.append(ids_of(r["text"]), 1).astype("<u4") for r in one.collect()}, 64)
    assert P.pack(odd, default_tokenizer()).agg({"length": "sum"}).first()[0] == sum(len(ids_of(r["text"])) + 1 for r in odd.collect())
    assert P.pack(none, default_tokenizer()).count() == 0
    assert P.pack(odd.filter("doc_id = 4"), default_tokenizer(), end_id=None).count() == 0
    with pytest.raises(ValueError):
        P.pack(none, default_tokenizer(), 1000)


def test_packing_over_many_ranges(spark):
    """Ranges of few bytes, and copies of one text that fill many: all ids are packed, tails are merged, and no range holds far more than its share."""
    rng = random.Random(3)
    same = " ".join(f"copy{rng.randrange(99)}" for _ in range(60))
    rows = [(i, same) for i in range(120)] + [(200 + i, " ".join(f"{rng.choice('abc')}{rng.randrange(999)}" for _ in range(rng.randrange(1, 120)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in P.pack(docs, default_tokenizer(), 64, range_bytes=3000).collect()]
    held_pieces(got, {i: np.append(ids_of(t), 1).astype("<u4") for i, t in rows}, 64)
    length = Counter()
    for r in got:
        length[r[5]] += r[2]
    short = [n for n in length.values() if n < 64]
    assert len({r[5] >> 32 for r in got}) > 15 and len(short) == len(set(short)) <= 6
    keys = sorted(zip(P.curve_keys([t for _, t in rows]).tolist(), [len(t) for _, t in rows], strict=True))
    cells = {k: sum(n for x, n in keys if x == k) for k, _ in keys}
    dealt = P.Ranges(sorted(cells.items()), 3000)
    held = Counter()
    for row, (k, n) in enumerate(keys):
        held[int(dealt.of(np.array([k]), np.array([row]))[0])] += n
    assert max(held.values()) < 2 * 3000 and set(held) == set(range(dealt.n))
    order = [int(dealt.of(np.array([k]), np.array([0]))[0]) for k, _ in keys]
    assert order == sorted(order)


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    key = P.hilbert_index(cells, bits)
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1)
    assert sorted(key) == list(range(len(cells))) and (steps == 1).all()


def test_near_texts_are_near_on_the_curve():
    rng = random.Random(1)
    words = {k: [f"{k}{rng.randrange(10**6)}" for _ in range(40)] for k in ("ab", "zq")}
    texts = [" ".join(rng.choice(words[k]) for _ in range(200)) for k in ("ab", "zq") for _ in range(50)]
    order = np.argsort(P.curve_keys(texts), kind="stable") // 50
    assert (np.diff(order) != 0).sum() < 25


def test_segment_trees_against_whole_counts():
    rng, enc = random.Random(5), encoder(default_tokenizer())
    for t in ["", "a", " ", "x" * 2000, " \n " * 400, *(" ".join(f"w{rng.randrange(500)}" for _ in range(n)) for n in (10, 500, 1500))]:
        tree = C.build(enc, [t])[0]
        assert "".join(C.leaves_of(t)) == t and tree.tokens == len(ids_of(t))
        for _ in range(15):
            start, length, insert = rng.randrange(-1, len(t) + 2), rng.choice([0, 1, 5, 60, 1200, 10**6]), rng.choice(["", " ", "abc", "Thé word, ", "\n", "z" * 600, "a b " * 300])
            t, _ = C.apply_edit(enc, t, tree, start, length, insert)
            assert (tree.chars, tree.tokens) == (len(t), len(ids_of(t)))


def edited(text, edits):
    for s, n, x in edits:
        s = min(max(0, s), len(text))
        text = text[:s] + x + text[min(len(text), s + n) :]
    return text


def test_op3_against_whole_counts(spark, sf):
    docs = C.stated_edits(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    want = {r["doc_id"]: (len(ids_of(r["text"])), len(ids_of(edited(r["text"], r["edits"])))) for r in docs}
    got = C.op3_token_counts(spark, sf).collect()
    assert {r["doc_id"]: (r["n_tokens_before"], r["n_tokens_after"]) for r in got} == want
    long = [r for r in got if r["n_chars_before"] > 20_000]
    assert all(r["encoded_chars"] < r["n_chars_before"] / 4 for r in long)


def test_stored_trees_and_odd_rows(spark, odd, none):
    docs = C.stated_edits(odd)
    assert C.count_edited(docs, default_tokenizer()).count() == odd.count() and C.count_edited(C.stated_edits(none), default_tokenizer()).count() == 0
    keyed = docs.filter("doc_id IN (1, 4, 5, 6, 11)")
    after = C.edit_trees(keyed.join(C.build_trees(keyed, default_tokenizer()), "doc_id"), default_tokenizer())
    for r in after.collect():
        assert r["tree_tokens"][1] == len(ids_of(r["text"])) and r["tree_chars"][1] == len(r["text"])
