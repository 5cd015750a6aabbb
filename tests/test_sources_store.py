import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborlake.operators import store as ST
from arborlake.operators import tree as T
from arborlake.plans import catalog
from arborlake.plans import models as M
from arborlake.sources import parsers as P
from arborlake.streaming import events as EV


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def kinds(nodes):
    return [(r["node_type"], r["level"], r["content"], r["parent_pos"]) for r in nodes.filter("pos > 0").orderBy("doc_id", "pos").collect()]


def test_pdf_lines_are_parsed_once(spark):
    # a paragraph goes on over a page's end, a page's section stands behind it, empty pages have one too
    rows = [(1, "some words\nmore of them\fand on\n\nRESULTS\nlast\f"), (2, None), (3, "SCOPE\nalone")]
    nodes = P.parse_pdf_text(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [tuple(r) for r in nodes.filter("pos > 0").orderBy("doc_id", "pos").select("doc_id", "node_type", "level", "content", "parent_pos").collect()]
    assert got == [
        (1, "section", None, "Page 1", 0), (1, "paragraph", None, "some words\nmore of them\nand on", 1), (1, "section", None, "Page 2", 0), (1, "section", 2, "RESULTS", 3), (1, "paragraph", None, "last", 4), (1, "section", None, "Page 3", 0),
        (2, "paragraph", None, P.EMPTY_PDF, 0), (3, "section", 2, "SCOPE", 0), (3, "paragraph", None, "alone", 1),
    ]
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_equal_ids_keep_their_headings(spark):
    lines = spark.createDataFrame([(1, 0, "SCOPE", 2), (1, 0, "BUDGET", 2), (1, 1, "text", None)], "doc_id long, idx int, line string, level int")
    assert sorted(r["content"] for r in T.line_events(lines).collect()) == ["BUDGET", "SCOPE", "text"]


def test_events_are_handed_on_in_bounded_batches():
    # a batch of documents was held with all of its events
    text = "\n\n".join(f"paragraph {i}" for i in range(1000))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [text, None, text]})
    made = list(P._event_batches([batch], P.markdown_events, 20_000))
    assert len(made) > 5 and max(b.nbytes for b in made) < 40_000
    rows = [r for b in made for r in b.to_pylist()]
    assert [(r["doc_id"], r["idx"], r["content"]) for r in rows] == [(d, i, f"paragraph {i}") for d in (1, 3) for i in range(1000)]


def test_small_sheets_are_read_as_trees(spark, monkeypatch):
    row = '<table:table-row table:number-rows-repeated="2"><table:table-cell office:value-type="float" office:value="1.50"/>{}</table:table-row>'
    inner = '<table:table-cell><table:table table:name="In">' + row.format("") + "</table:table></table:table-cell>"
    files = [catalog._sheet_file("ods", row.format("") * 2), catalog._sheet_file("ods", row.format(inner)), catalog._sheet_file("xlsx", '<row r="2"><c r="C2"><v>7</v></c><c><v>8</v></c></row><row><c><v>9</v></c></row>'), catalog._sheet_file("xlsx", "<row>")]
    whole = [P.sheet_events(f) for f in files]
    monkeypatch.setattr(P, "_WHOLE", 0)
    assert whole == [P.sheet_events(f) for f in files] and [len(e) for e in whole] == [6, 10, 4, 0]
    # sheets have sections of one level only, for which nine were kept
    nodes = P.parse_sheets(spark.createDataFrame([(1, bytearray(files[0]))], "doc_id long, data binary"))
    assert nodes._jdf.queryExecution().optimizedPlan().toString().count("_l9") == 0


def test_markdown(spark):
    text = "# Title\n\nSome **bold** text\nwith `code`.\n\n### Deep\n- item one\n- item two\n\n```python\nx = 1\n```\n![alt](pic.png)\n\n## Sub\nlast"
    assert kinds(P.parse_markdown(docs(spark, text))) == [
        ("section", 1, "Title", 0), ("paragraph", None, "Some bold text\nwith `code`.", 1), ("section", 3, "Deep", 1), ("list_item", None, "item one", 3), ("list_item", None, "item two", 3),
        ("code_block", None, "x = 1", 3), ("image", None, "alt", 3), ("section", 2, "Sub", 1), ("paragraph", None, "last", 8),
    ]


def test_plain_code_and_pages(spark):
    assert [k[2] for k in kinds(P.parse_plain(docs(spark, "one\n\ntwo\nlines\n\n\n\nthree", "")))] == ["one", "two\nlines", "three"]
    assert P.code_blocks(docs(spark, "\n".join(f"line {i}" for i in range(120)) + "\n")).select("line_start", "line_end").collect() == [(1, 60), (61, 120)]
    assert P.code_blocks(docs(spark, "\n\n", "")).count() == 0
    pages = P.page_texts(docs(spark, '{"pages":[{"page":3,"text":"a"},{"text":"b"},{"text":" "}]}', '[{"text":"c"}]', "junk", ""))
    assert sorted(map(tuple, pages.collect())) == [(1, 2, "b"), (1, 3, "a"), (2, 1, "c")]
    got = kinds(P.parse_pdf_text(docs(spark, "Introduction\nsome text here\n\fABSTRACT\nmore text")))
    assert [g[2] for g in got] == ["Page 1", "Introduction", "some text here", "Page 2", "ABSTRACT", "more text"] and got[1][3] == 1 and got[4][3] == 4 and [g[1] for g in got] == [None, 2, None, None, 2, None]
    assert [k[2] for k in kinds(P.parse_pdf_text(docs(spark, "", "\f \n")))] == [P.EMPTY_PDF] * 2
    assert [k[2] for k in kinds(P.parse_page_json(docs(spark, '[{"text":"Introduction\\nbody"}]')))] == ["Introduction", "body"]


def test_csv_and_office(spark):
    got = kinds(P.parse_csv(docs(spark, "a,b\n1,x\n2,\n", "a,b\n1\n")))
    assert got[1:] == [("table_row", None, "a | b", 1), ("table_row", None, "a: 1 | b: x", 1), ("table_row", None, "a: 2", 1)] and got[0][2] == "2 rows × 2 columns"
    detail = P.table_details(docs(spark, "a,b\n1,x\n2,\n")).first()
    assert detail["columns"] == ["a", "b"] and detail["summary"] == "2 rows × 2 columns\nColumns: a, b\nSchema:\na (e.g. 1, 2)\nb (e.g. x)" and detail["pos"] == 1
    assert P.parse_csv(docs(spark, "a,b\n1,x\n")).filter("pos = 0").first()["content"] == "doc-1 — 1 rows × 2 columns"
    assert P.parse_csv(docs(spark, "h\n" + "\n".join(map(str, range(501))))).filter("node_type = 'table_row'").count() == 501
    assert P.parse_csv(docs(spark, "h\n" + "\n".join(map(str, range(500))) + "\n1,2\n")).filter("node_type = 'table_row'").count() == 501  # a ragged row behind the last one read
    assert P.parse_csv(docs(spark, "\n\na\n" + "x" * 200_000 + "\n")).filter("node_type = 'table_row'").count() == 2
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
        z.writestr("word/media/i.jpg", b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00")
    data = spark.createDataFrame([(1, bytearray(buf.getvalue())), (2, bytearray(b"junk"))], "doc_id long, data binary")
    assert kinds(P.parse_docx(data)) == [("section", 2, "Head", 0), ("paragraph", None, "Para", 1), ("table", None, "Table", 1), ("table_row", None, "x | y", 3)]
    assert P.docx_images(data).select("mime_type", "width", "height").collect() == [("image/jpeg", 7, 5)]
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="S1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="B1" t="inlineStr"><is><t>v</t></is></c></row><row><c r="A2"><v>1.0</v></c><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>')
    assert kinds(P.parse_sheets(spark.createDataFrame([(1, bytearray(buf.getvalue()))], "doc_id long, data binary")))[-1][2] == "k: 1 | v: 2.5"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nx")
    assert P.read_texts(spark, str(tmp_path)).select("name", "doc_type").collect() == [("a.md", "markdown")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.csv").write_text("k,v\n1,2\n3,\n")
    assert sorted(r["row_text"] for r in P.csv_rows(spark, str(tmp_path / "t")).collect()) == ["k: 1 | v: 2", "k: 3"]
    for bad in ("", "a/../b", str(tmp_path), str(tmp_path / "none")):
        with pytest.raises(ValueError):
            P.validate_path(bad)
    assert P.validate_path(str(tmp_path / "a.md")).name == "a.md"


def test_store(spark):
    conv = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, title string, at int")
    new = spark.createDataFrame([(2, "c", 5), (3, "d", 5)], "id int, title string, at int").withColumn("created", F.col("at"))
    got = ST.upsert(conv.withColumn("created", F.col("at")), new, ["id"], "at", ["created"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1, 1), (2, "c", 5, 1), (3, "d", 5, 5)]
    assert ST.insert_ignore(conv, conv.withColumn("title", F.lit("z")), ["id"]).count() == 2
    assert ST.update(conv, "id", 1, title=F.lit("n")).filter("title = 'n'").count() == 1
    assert ST.delete(conv, conv.select("id").filter("id = 1")).count() == 1
    traces = spark.createDataFrame([("t1", 1), ("t2", 2)], "id string, conv_id int")
    left = ST.cascade_delete(
        spark.createDataFrame([(1,)], "conv_id int"), conv, spark.createDataFrame([(1, "m"), (2, "m")], "conv_id int, x string"), traces, spark.createDataFrame([("t1",), ("t2",)], "msg_id string"),
        spark.createDataFrame([("t1",), ("t2",)], "trace_id string"), spark.createDataFrame([(1, "d"), (2, "d")], "conv_id int, doc_id string"),
    )
    assert {k: v.count() for k, v in left.items()} == dict.fromkeys(left, 1)
    usage = spark.createDataFrame([("gpt-4o", 1_000_000, 0), ("nobody", 0, 1_000_000)], "model string, input_tokens long, output_tokens long")
    assert {r["model"]: r["cost"] for r in ST.priced(usage, ST.price_table(spark)).collect()} == {"gpt-4o": 2.5, "nobody": 1.5}
    msgs = spark.createDataFrame([(1, t, "user", "x" * 100) for t in range(5)], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in ST.history_window(msgs, 60).orderBy("turn").collect()] == [3, 4]
    assert ST.schema_version(spark.createDataFrame([], "version long")).first()["version"] == 0


def test_models():
    calls = []

    class Flaky:
        name = "flaky"

        def chat(self, messages, tools=None):
            calls.append(1)
            if len(calls) < 3:
                raise RuntimeError("429 Retry-After: 120")
            return M.Response("ok")

    waits = []
    assert M.Retry(Flaky(), sleep=waits.append).chat([]).content == "ok" and waits == [30, 30]
    with pytest.raises(ValueError):
        M.provider("nobody")
    history = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "tool", "content": "r1", "tool_call_id": "1"}, {"role": "tool", "content": "r2", "tool_call_id": "2"}]
    assert M.anthropic_messages(history)[0] == "s" and len(M.anthropic_messages(history)[1]) == 3 and len(M.anthropic_messages(history, True)[1]) == 2
    assert len(M.google_messages(history)[1]) == 2 and M.google_messages(history)[0] == {"parts": [{"text": "s"}]}
    for args in (("", "", "m", "k"), ("n", "", "", "k"), ("n", "", "m"), ("n", "ftp://x", "m", "k")):
        with pytest.raises(ValueError):
            M.validate_provider(*args)
    M.validate_provider("Ollama", "", "m")
    for args in (("", ["d"], "p"), ("m", [], "p"), ("m", ["d"], "")):
        with pytest.raises(ValueError):
            M.validate_chat(*args)


def test_model_udf(spark):
    call = M.chat_udf("echo")
    row = spark.createDataFrame([("hello there",), (None,)], "p string").select(call("p").alias("r")).orderBy("r.content").collect()
    assert [(r["r"]["content"], r["r"]["output_tokens"]) for r in row] == [("", 0), ("hello there", 2)]


def events(spark):
    rows = [(1, 1, "step-start", None, None, None), (2, 1, "step-complete", 7, None, None), (3, 1, "token", None, "Hel", None), (4, 1, "token", None, "lo", None), (5, 2, "token", None, "x", None), (6, 2, "response", None, None, "final")]
    return spark.createDataFrame(rows, "seq long, conv_id long, type string, tokens_used long, token string, content string").withColumn("error", F.lit(None).cast("string"))


def test_stream_equals_batch(spark, tmp_path):
    batch = {r["conv_id"]: (r["started"], r["completed"], r["tokens_used"], r["answer"]) for r in EV.fold_conversation(events(spark)).collect()}
    assert batch == {1: (1, 1, 7, "Hello"), 2: (0, 0, 0, "final")}
    events(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = EV.fold_stream(spark.readStream.schema(events(spark).schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["conv_id"]: (r["started"], r["completed"], r["tokens_used"], r["answer"]) for r in spark.table("folded").collect()} == batch


def test_sse(spark):
    lines = ['data: {"choices":[{"delta":{"content":"Hi "}}]}', "", 'data: {"choices":[{"delta":{"content":"you","tool_calls":[{"index":0,"id":"c","function":{"name":"f","arguments":"{\\"a\\""}}]}}]}', 'data: {"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"arguments":":1}"}}]}}],"usage":{"prompt_tokens":3,"completion_tokens":2}}', "data: [DONE]", "data: x"]
    data = EV.sse_data(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "stream_id int, k int, line string"))
    assert EV.openai_stream(data).first() == (1, "Hi you", 3, 2)
    assert EV.openai_tool_calls(data).first() == (1, 0, "c", "f", '{"a":1}')
    lines = ['data: {"type":"message_start","message":{"usage":{"input_tokens":5}}}', 'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"Yo"}}', 'data: {"type":"message_delta","usage":{"output_tokens":4}}']
    data = EV.sse_data(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "stream_id int, k int, line string"))
    assert EV.anthropic_stream(data).first() == (1, "Yo", 5, 4)
