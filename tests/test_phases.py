"""Migrations, cancellation, extraction of pages, the judge of headings, and forwarded tokens."""

import pathlib
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from arborlake.operators import migrations as MI
from arborlake.operators import tree as T
from arborlake.operators import undecided as U
from arborlake.plans import models as M
from arborlake.sources import extract as EX
from arborlake.streaming import cancel as CA


@pytest.mark.parametrize("start", [0, 1, 2, 3])
def test_migrations_from_each_version(spark, tmp_path, start):
    db = f"t{uuid.uuid4().hex}"
    MI.create(spark, db, f"{tmp_path}/db")
    assert MI.version(spark, db) == 0 and not MI.has_columns(spark, f"{db}.traces", "input_tokens")
    MI.insert(spark.createDataFrame([("c1", "t", "d1", "", ""), ("c2", "t", "", "", ""), ("c3", "t", None, "", ""), ("c1", "t", "d1", "", "")], MI.TABLES["conversations"]), db, "conversations")
    MI.insert(spark.createDataFrame([("t1", "c1", "p", 5, 0.1, 3, 2, "")], MI.TABLES["traces"]), db, "traces")
    assert MI.migrate(spark, db, start) == start
    if start == 1:  # a migration that was done, but not recorded
        MI.MIGRATIONS[1](spark, db)
    for _ in range(2):
        assert MI.initialize(spark, db) == 3
        assert sorted(r.version for r in spark.table(f"{db}.schema_version").collect()) == [1, 2, 3]
        assert [tuple(r) for r in spark.table(f"{db}.conversation_documents").select("conv_id", "doc_id").collect()] == [("c1", "d1")]
        assert spark.table(f"{db}.traces").select("id", "total_tokens", "input_tokens", "output_tokens").first() == ("t1", 5, 0, 0)
        assert {r.kind: r.n for r in MI.catalog_counts(spark, db).collect()} == {"tables": 8, "lookups": 8}
    spark.sql(f"DROP DATABASE {db} CASCADE")


def test_cancel_stops_one_query_only(spark):
    box, out, errors = CA.Cancellation(spark), {}, {}

    def slow(frames):
        for f in frames:
            time.sleep(0.2)
            yield f

    def query(tag, rows):
        phases = [("read", lambda _: spark.range(rows).repartition(rows)), ("fetch", lambda df: df.mapInPandas(slow, "id long").count()), ("answer", lambda n: n + 1)]
        try:
            out[tag] = box.run(tag, phases)
        except CA.Cancelled as e:
            errors[tag] = str(e)

    threads = [threading.Thread(target=query, args=a) for a in (("long", 2000), ("short", 4))]
    for t in threads:
        t.start()
    time.sleep(3)
    with pytest.raises(ValueError, match="runs as"):
        box.run("long", [])
    assert box.cancel("long") and not box.cancel("nobody")
    for t in threads:
        t.join(60)
    assert out == {"short": 5} and errors == {"long": "long: cancelled in fetch"}
    assert box.run("long", [("again", lambda _: spark.range(3).count())]) == 3 and box.cancel_all() == 0


def test_cancel_between_phases(spark):
    box, seen = CA.Cancellation(spark), []
    with pytest.raises(CA.Cancelled, match="before second"):
        box.run("q", [("first", lambda _: seen.append(box.cancel("q"))), ("second", lambda _: seen.append("no"))])
    assert seen == [True]
    with pytest.raises(ZeroDivisionError):
        box.run("q", [("first", lambda _: 1 / 0)])


def test_extracted_pages(spark, tmp_path):
    def extractor(content):
        for page in content.decode().split("\f"):
            if page == "bad":
                raise RuntimeError("page is damaged")
            yield None if page == "none" else page

    rows = [("a", b"one\ftwo"), ("b", b"one\fbad\fthree"), ("c", None), ("d", b"\xff"), ("e", b"none"), ("a", b"one\ftwo")]
    got = EX.extract_pages(spark.createDataFrame(rows, "doc_id string, content binary"), extractor)
    want = [("a", 1, "one", None)] * 2 + [("a", 2, "two", None)] * 2 + [("b", 1, "one", None), ("b", 2, None, "RuntimeError: page is damaged"), ("c", 0, None, "ValueError: no content"), ("e", 1, "", None)]
    rows = sorted(map(tuple, got.collect()))
    assert [r for r in rows if r[0] != "d"] == want and [(r[1], r[2], r[3][:18]) for r in rows if r[0] == "d"] == [(0, None, "UnicodeDecodeError")]
    assert EX.extract_pages(spark.createDataFrame([("x", b"1")], "doc_id string, content binary"), lambda c: []).collect() == [("x", 0, None, None)]
    (tmp_path / "a.pdf").write_bytes(b"p1\fp2")
    (tmp_path / "b.txt").write_bytes(b"no")
    (tmp_path / "c.pdf").write_bytes(b"x" * 100)
    pages = EX.extract_pages(EX.read_files(spark, str(tmp_path), most_bytes=50), EX.form_feed_pages)
    assert [r.text for r in EX.paged_text(pages).collect()] == ["p1\fp2"]


def test_each_line_is_judged_once(spark, tmp_path):
    def judge(lines):
        (tmp_path / uuid.uuid4().hex).write_text("\n".join(lines))
        return [None if "odd" in x else "heading: 2" if "maybe" in x else "body" for x in lines]

    docs = spark.createDataFrame([(i, "Introduction\nmaybe one of these\nplain words in a line that is not one\nodd line it is here too\nends with a stop.\nx\n" + "y" * 90) for i in range(30)] + [(99, None)], "doc_id long, text string").repartition(6)
    lines = T.lines_of(docs)
    got = U.judged(lines, judge)
    assert got.count() == lines.count()
    assert {(r.line, r.level) for r in got.filter("heading_source = 'model'").collect()} == {("maybe one of these", 2)}
    assert {(r.line, r.level) for r in got.filter("level IS NOT NULL AND heading_source IS NULL").collect()} == {("Introduction", 2)}
    asked = sorted(x for f in pathlib.Path(tmp_path).iterdir() for x in f.read_text().split("\n"))
    assert asked == ["maybe one of these", "odd line it is here too", "plain words in a line that is not one"]
    answers = spark.createDataFrame([("HEADING:1 sure",), ("heading: 3",), ("heading",), ("body",), (None,), ("a heading",)], "a string")
    assert [r[0] for r in answers.select(U.answered_level(F.col("a"))).collect()] == [1, 3, 3, None, None, None]


class Broken(M.Echo):
    """Fails before the first token until it is asked a third time; breaks off behind the second where the prompt says so."""

    calls = 0

    def chat_stream(self, messages, tools=None):
        Broken.calls += 1
        if Broken.calls < 3:
            raise RuntimeError("429 rate limit")
        for k, token in enumerate(messages[-1]["content"].split()):
            if k == 2 and "break" in messages[-1]["content"]:
                raise RuntimeError("connection lost")
            yield token
        return M.Response("", 1, 2)


def test_streams_are_retried_before_their_first_token():
    tokens = M.Retry(Broken(), sleep=lambda s: None)
    assert list(tokens.chat_stream([{"role": "user", "content": "a b c"}])) == ["a", "b", "c"] and Broken.calls == 3
    with pytest.raises(RuntimeError, match="lost"):
        list(tokens.chat_stream([{"role": "user", "content": "a b break"}]))


def test_forwarded_tokens(spark):
    rows = [("s1", " two  words "), ("s2", None), (None, "x"), ("s1", "again")]
    got = sorted((r.stream_id or "", r.k, r.token, r.done, r.output_tokens, r.error) for r in M.forward_tokens(spark.createDataFrame(rows, "stream_id string, text string"), "echo").collect())
    want = [("", 1, "x", False, None, None), ("", 2, "", True, 1, None), ("s1", 1, " two", False, None, None), ("s1", 2, "  words", False, None, None), ("s1", 3, " ", False, None, None), ("s1", 4, "", True, 2, None), ("s1", 1, "again", False, None, None), ("s1", 2, "", True, 1, None), ("s2", 1, "", True, 0, None)]
    assert got == sorted(want)
