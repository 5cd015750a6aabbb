import timeit

import pytest
from pyspark.sql import functions as F

from arborlake.functions import headings as H
from arborlake.functions import queries as Q
from arborlake.functions import text as X
from arborlake.operators import enrich as E
from arborlake.plans import catalog


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("line", "level"), [
    ("Chapter 1", 1), ("Part I", 1), ("Section 3.2", 2), ("Appendix A", 2), ("1. Introduction", 1), ("2.3 Methods", 2), ("1.2.1 Overview", 3), ("ABSTRACT", 2), ("RESULTS AND DISCUSSION", 2),
    ("Introduction", 2), ("Data Analysis", 3), ("Skills:", 2), ("methodology", 2), ("2024 was good", 1), ("This is a normal sentence that ends with a full stop and is long.", None),
    ("Clause that goes on and on until it ends in a comma,", None), ("This Line Has Far Too Many Words", None), ("", None), ("   ", None), ("A" * 130, None),
])
def test_heading_level(spark, line, level):
    assert one(spark, line, H.heading_level) == level


def test_fused_and_leading_headings(spark):
    assert H.fused_parts("EducationLovely Professional University") == ["Education", "Lovely Professional University"]
    assert H.fused_parts("some textSkillsPython, Rust") == ["some text", "Skills", "Python, Rust"]
    assert H.fused_parts("plain line") == ["plain line"] and H.fused_parts("") == [""]
    assert one(spark, "Work Experience Built large systems for years", H.split_leading) == ["Work Experience", "Built large systems for years"]
    assert one(spark, "Skills: Python and many other things", H.split_leading) == ["Skills", "Python and many other things"]
    assert one(spark, "Skills overview", H.split_leading) == ["Skills overview"]
    assert one(spark, "a projectsX", H.split_fused) == ["a", "projects", "X"]


def test_splits_of_odd_lines(spark):
    # the longer keyword fails on the length of what follows, the shorter one fits
    assert one(spark, "Contact Information: Paris", H.split_leading) == ["Contact", "Information: Paris"]
    assert one(spark, "Contact Information: Paris, Rue de la Paix", H.split_leading) == ["Contact Information", "Paris, Rue de la Paix"]
    assert one(spark, "CONCLUSIONS:  \t It all went very well", H.split_leading) == ["CONCLUSIONS", "It all went very well"]
    assert one(spark, None, H.split_leading) == [None]
    # letters that lower() leaves or makes longer keep their places
    assert H.fused_parts("İİ xSKİLLſ7 \u212a") == ["İİ x", "SKİLLſ", "7 \u212a"]
    assert H.fused_parts(" indexIndexindex ") == ["index", "Index", "index"]


def test_splits_are_generated_code_and_linear(spark):
    # an expression for each keyword was too large to be compiled, so it was interpreted
    leading = spark.range(1).select(H.split_leading(F.col("id").cast("string")).alias("y"))._jdf.queryExecution().analyzed().toString()
    assert leading.count("regexp") < 50  # hundreds before
    # a search of the rest behind each cut took time with the square of the cuts
    seconds = timeit.timeit(lambda: H.fused_parts("skillsX " * 20_000), number=1)
    assert len(H.fused_parts("skillsX " * 20_000)) == 40_000 and seconds < 5


@pytest.mark.parametrize(("text", "n", "cut"), [("hello", 10, "hello"), ("hello", 5, "hello"), ("hello world", 5, "hello"), ("héllo wörld", 2, "h"), ("héllo wörld", 3, "hé"), ("", 5, ""), ("hello", 0, ""), ("漢字", 5, "漢"), ("😀", 3, "")])
def test_safe_truncate(spark, text, n, cut):
    assert one(spark, text, lambda x: X.safe_truncate(x, n)) == cut


def test_intents_and_terms(spark):
    cases = {"Summarize the report": "summarize", "Who is the CEO": "entity", "compare A and B": "comparison", "list all features": "list_extract", "what happened in 2020": "factual", "quantum flux": "specific"}
    assert {q: one(spark, q, Q.intent) for q in cases} == cases
    assert one(spark, "What is the Revenue of ACME-Corp in Q3, revenue?", Q.search_terms) == ["revenue", "acme-corp", "revenue"]
    assert one(spark, "is it so good?", Q.fetch_terms) == ["good"]
    assert one(spark, "what does this with that mean", Q.fallback_terms) == ["what", "does", "this"]
    assert 6 <= one(spark, "x " * 40, Q.recommended_steps) <= 15
    assert one(spark, "a b", Q.wants_enrichment) is True and one(spark, "a b", lambda x: Q.wants_enrichment(x, False)) is False


def test_summary_entities_topics(spark):
    text = "ACME Corp reported strong revenue. The board met in January 2026 today. It earned $1.2M and 12.5% more in q3 2025. John Smith Junior Senior Major agreed."
    assert one(spark, text, X.extractive_summary) == "ACME Corp reported strong revenue. The board met in January 2026 today."
    assert one(spark, "short", X.extractive_summary) == "short"
    assert one(spark, text, E.entities) == ["$1.2M", "12.5%", "January 2026", "John Smith Junior Senior", "Q3 2025"]
    rows = spark.createDataFrame([(1, "growth growth growth market market alpha beta 12345 with the"), (2, None)], "id int, text string")
    assert [(r["topic"], r["n"]) for r in E.topic_counts(rows, ["id"]).orderBy("rank").collect()] == [("growth", 3), ("market", 2), ("alpha", 1), ("beta", 1)]


def test_entities_are_computed_once(spark):
    rows = spark.createDataFrame([(1, "John Smith met us. He paid 5% in May 2024"), (2, "nothing"), (3, None), (4, "$3 Q1 2020")], "id int, text string")
    found = rows.select("id", E.only(F.array_join(E.entities(F.col("text")), "|"), lambda e: e != "").alias("e"))
    assert {r["id"]: r["e"] for r in found.collect()} == {1: "5%|John Smith|May 2024", 4: "$3|Q1 2020"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1  # a filter would compute them again
    assert plan.count("regexp_replace") == 4  # the words' marks for names and dates are shared


def test_united_tags_need_no_shuffle(spark, tmp_path):
    rows = spark.createDataFrame([(1, "John Smith likes market market growth"), (2, "12 a of"), (3, None), (4, "alpha")], "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    tags = catalog.united_tags(spark, str(tmp_path))
    assert {r["doc_id"]: r["tags"] for r in tags.collect()} == {1: "John Smith|market|growth|john|likes|smith", 4: "alpha"}
    plan = tags._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("array_distinct") == 1


def test_small_functions(spark):
    assert one(spark, 'a1, "b2" , c3., x', X.comma_list) == ["a1", "b2", "c3"]
    assert one(spark, "dir/Some.File.PDF", X.extension) == "pdf" and one(spark, "a/b/", X.file_name) == "Untitled"
    assert one(spark, "Retry-After: 120", X.retry_after_ms) == 30_000 and one(spark, "retry-after (seconds) = 7", X.retry_after_ms) == 7_000 and one(spark, "nothing", X.retry_after_ms) is None
    assert one(spark, "error 429", X.is_retryable) is True and one(spark, "error 401", X.is_retryable) is False
    assert one(spark, "p1\fp2\fp3", X.page_count) == 2 and one(spark, "p1", X.page_count) == 1
    numbers = spark.createDataFrame([(1.0,), (1e7,), (0.25,)], "x double").select(X.plain_number(F.col("x")).alias("y")).collect()
    assert [r["y"] for r in numbers] == ["1", "10000000", "0.25"]
    assert one(spark, " a \n b  c", lambda x: X.squeeze(x, 3)) == "a b…"
