"""Small operators and functions that no registered query reads to their edges."""

from pyspark.sql import functions as F

from arborlake.functions import fixed
from arborlake.functions import text as X
from arborlake.operators import relations as R
from arborlake.operators import store as ST
from arborlake.operators import tree as T
from arborlake.streaming import events as EV


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def nodes(spark):
    return T.nodes_from_lines(spark.createDataFrame([(1, "INTRODUCTION\nfirst words of it\n\nMETHODS\nother words\n\nlast words"), (2, "only one line")], "doc_id long, text string"))


def test_labels(spark):
    c = F.lit
    assert one(spark, *(X.step_label(c(k)) for k in [*fixed.STEP_LABELS, "other"])) == [*fixed.STEP_LABELS.values(), "other"]
    assert one(spark, X.chatml(c("be brief"), c("hi"))) == ["<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n"]
    none = c(None).cast("string")
    assert one(spark, X.node_label(c("text"), c("sum"), c("t")), X.node_label(c(""), c("sum"), c("t")), X.node_label(none, c(""), c("t")), X.node_label(none, none, c("t"))) == ["text", "sum", "(t)", "(t)"]
    assert one(spark, X.documents_label(c(1), c("a.md")), X.documents_label(c(2), c("a.md")), X.documents_label(c(0), none)) == ["a.md", "2 documents", "0 documents"]
    assert one(spark, X.conversation_title(c("x" * 41)), X.conversation_title(c("ß" * 50)), X.conversation_title(c(""))) == ["x" * 40, "ß" * 40, ""]
    assert one(spark, X.data_address(c("a/b"), c(b"\x00\xff" * 60)), X.data_address(c("a/b"), c(b"")), X.data_address(c("a/b"), none.cast("binary"))) == ["data:a/b;base64," + "AP8A/wD/" * 20, "data:a/b;base64,", None]


def test_trees(spark):
    n = nodes(spark)
    assert sorted(r.pos for r in T.subtree(n.filter("doc_id = 1"), 3).collect()) == [3, 4, 5]
    assert T.subtree(n, 99).count() == 0
    row = T.compare_nodes(n, 1, 1, 3).first()
    assert (row["left"], row["right"]) == ("INTRODUCTION", "METHODS") and T.compare_nodes(n, 1, 1, 99).count() == 0
    active = spark.createDataFrame([(1, 4), (1, 4), (1, 3), (2, 0), (3, 1), (None, None)], "doc_id long, pos int")
    assert sorted(map(tuple, T.opened(n, active).collect())) == [(1, 0), (1, 3)] and T.opened(n, active.limit(0)).count() == 0
    enriched = spark.createDataFrame([(1, 1, "s", ["E"], ["t"])], "doc_id long, pos int, summary string, entities array<string>, topics array<string>")
    got = {(r.doc_id, r.pos): (r.preview, r.children_count, r.summary, r.entities, r.topics) for r in T.rich_overview(n, enriched).collect()}
    assert got == {(1, 1): ("INTRODUCTION", 1, "s", ["E"], ["t"]), (1, 3): ("METHODS", 2, None, [], []), (2, 1): ("only one line", 0, None, [], [])}
    c = F.lit
    assert [round(x, 4) for x in one(spark, T.relevance(c(2), c(4), c("x" * 100)), T.relevance(c(4), c(4), c("x" * 900)), T.relevance(c(0), c(0), c("")))] == [0.5, 1.0, 0.0]


def test_drawing(spark):
    drawn = T.layout(nodes(spark))
    assert sorted(map(tuple, drawn.collect())) == [(1, 0, 52.5, 0.0), (1, 1, 0.0, 80.0), (1, 2, 0.0, 160.0), (1, 3, 105.0, 80.0), (1, 4, 70.0, 160.0), (1, 5, 140.0, 160.0), (2, 0, 0.0, 0.0), (2, 1, 0.0, 80.0)]
    assert sorted(map(tuple, T.layout_bounds(drawn).collect())) == [(1, -40.0, -40.0, 180.0, 220.0), (2, -40.0, -40.0, 40.0, 140.0)]
    relations = spark.createDataFrame([("a", 1, 3, 2, 1), ("b", 1, 3, 2, 9), ("c", 1, None, 2, 1), ("d", 1, 2, 1, 0)], "id string, source_doc_id long, source_pos int, target_doc_id long, target_pos int")
    assert sorted((r.id, r.x1, r.y1, r.x2, r.y2, r.mid_y) for r in R.edges(relations, drawn).collect()) == [("a", 105.0, 80.0, 0.0, 80.0, 80.0), ("d", 0.0, 160.0, 52.5, 0.0, 80.0)]


def test_conversations(spark):
    conv = spark.createDataFrame([(1, "How it Works"), (2, "other"), (3, None), (4, "SHOW")], "id int, title string")
    assert [[r.id for r in ST.titled(conv, s).orderBy("id").collect()] for s in ("hOw", " ", "", "w i", "%", "none")] == [[1, 4], [1, 2, 3, 4], [1, 2, 3, 4], [1], [], []]
    rows = spark.createDataFrame([(1, 5), (2, 7), (3, None), (4, 5)], "id int, at int")
    assert [r.id for r in ST.listing(rows, "at", "id").collect()] == [2, 1, 4, 3] and [r.id for r in ST.listing(rows, "at", "id", newest=False).collect()] == [3, 1, 4, 2]
    steps = spark.createDataFrame([(1, 2, ["b", "c", "b"]), (1, 1, ["a", "c", None]), (2, 1, []), (3, 1, None), (None, 1, ["x"])], "conv_id int, step_number int, node_ids array<string>")
    assert sorted(((r.conv_id or 0, r.place, r.node_id) for r in ST.visited_nodes(steps).collect())) == [(0, 1, "x"), (1, 1, "a"), (1, 2, "c"), (1, 3, "b")]
    messages = spark.createDataFrame([(1, 1, "user", "again"), (1, 2, "assistant", "again"), (1, 3, "user", "again"), (1, 4, "user", "more")], "conv_id int, turn int, role string, text string")
    assert sorted(r.turn for r in ST.history_window(messages, current=F.lit("again")).collect()) == [2, 4]
    progress = spark.createDataFrame([("d", 1, "queued"), ("d", 3, "done"), ("d", 2, "running"), ("e", 1, None)], "doc_id string, seq int, status string")
    assert sorted(map(tuple, EV.latest_progress(progress).collect())) == [("d", 3, "done"), ("e", 1, None)]
