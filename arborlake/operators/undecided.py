"""A model's word on lines that may be headings: each distinct line is judged once, whatever its number of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import stored

#: From lines to a model's answers, batch by batch; it runs in tasks.
Judge = Callable[[list[str]], list[str]]
INSTRUCTION = "Classify the given line as heading or body text. Reply ONLY with: heading:1 OR heading:2 OR heading:3 OR body"


def answered_level(answer):
    """1 to 3 as an answer names it, 3 for a heading without a number, else null. Column in, Column out."""
    low = F.lower(answer)
    named = [F.when(F.contains(low, F.lit(f"heading:{k}")) | F.contains(low, F.lit(f"heading: {k}")), k) for k in (1, 2, 3)]
    return F.coalesce(*named, F.when(low.startswith("heading"), 3)).cast("int")


def undecided(lines: DataFrame) -> DataFrame:
    """The distinct lines without a level that may be headings: 2 to 80 bytes, not ending with a full stop, comma or semicolon."""
    return lines.filter("level IS NULL AND octet_length(line) BETWEEN 2 AND 80").filter(~F.col("line").rlike("[.,;]$")).select("line").distinct()


def judged(lines: DataFrame, judge: Judge, batch: int = 64) -> DataFrame:
    """lines (doc_id, idx, line, level) with the level that the judge gives to undecided ones, and heading_source: model where it did.

    The judge sees each distinct undecided line once, in batches; its answers are stored before they are joined back, so a lost executor does not ask again for what is written. Null answers
    and other words leave a line as it is; so does a null line. An empty table gives no rows and no calls.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), batch):
                part = f["line"].iloc[i : i + batch].tolist()
                yield pd.DataFrame({"line": part, "answer": judge(part)})

    answers = stored(undecided(lines).mapInPandas(ask, "line string, answer string"), "headings")
    levels = answers.select("line", answered_level(F.col("answer")).alias("_level")).filter("_level IS NOT NULL")
    out = lines.join(levels, "line", "left").withColumn("heading_source", F.when(F.col("level").isNull() & F.col("_level").isNotNull(), "model"))
    return out.withColumn("level", F.coalesce("level", F.when(F.col("heading_source").isNotNull(), F.col("_level")))).drop("_level").select(*lines.columns, "heading_source")
