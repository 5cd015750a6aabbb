"""Event streams: the channel's events as a streaming DataFrame, and their reduction to a state for each step."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "seq long, conv_id long, type string, step_number int, tool string, input string, output string, tokens_used long, latency_ms long, token string, content string, error string"


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Files of events as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def read_files(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The file or folder of one table as a stream."""
    path = f"{folder}/{name}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def reduce_steps(events: DataFrame) -> DataFrame:
    """The state of each (user_id, event_type): count, last event and its value. Works on batches and, in complete or update mode, on streams."""
    last = F.max(F.struct("event_id", "value"))
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), last.alias("last")).select("user_id", "event_type", "n", F.col("last.event_id").alias("last_id"), F.col("last.value").alias("last_value"))


def fold_conversation(events: DataFrame) -> DataFrame:
    """The state that a conversation's events leave: answer text, steps started and completed, tokens, error. One row per conversation; its tokens join in order of seq."""
    kind = lambda k: F.col("type") == k
    ordered = F.array_sort(F.collect_list(F.when(kind("token"), F.struct("seq", "token"))))
    return events.groupBy("conv_id").agg(
        F.count_if(kind("step-start")).alias("started"), F.count_if(kind("step-complete")).alias("completed"), F.coalesce(F.sum(F.when(kind("step-complete"), F.col("tokens_used"))), F.lit(0)).alias("tokens_used"),
        F.coalesce(F.max_by("content", F.when(kind("response"), F.col("seq"))), F.array_join(F.transform(ordered, lambda s: s.token), "")).alias("answer"), F.max_by("error", F.when(kind("error"), F.col("seq"))).alias("error"),
    )


STATE = "conv_id long, started int, completed int, tokens_used long, answer string, done boolean"


def fold_stream(events: DataFrame):
    """The same as a stream: a state for each conversation, updated with every micro-batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        started, completed, used, answer, done = state.get if state.exists else (0, 0, 0, "", False)
        for b in batches:
            for r in b.sort_values("seq").itertuples():
                started += r.type == "step-start"
                completed += r.type == "step-complete"
                used += int(r.tokens_used) if r.type == "step-complete" and r.tokens_used == r.tokens_used and r.tokens_used is not None else 0
                if r.type == "token" and not done:
                    answer += r.token
                if r.type == "response":
                    answer, done = r.content, True
        state.update((int(started), int(completed), int(used), answer, bool(done)))
        yield pd.DataFrame([(key[0], started, completed, used, answer, done)], columns=["conv_id", "started", "completed", "tokens_used", "answer", "done"])

    return events.groupBy("conv_id").applyInPandasWithState(step, STATE, "started int, completed int, tokens_used long, answer string, done boolean", "update", GroupStateTimeout.NoTimeout)


def latest_progress(events: DataFrame) -> DataFrame:
    """Per document the last of its enrichment events: doc_id, seq, status."""
    return events.groupBy("doc_id").agg(F.max(F.struct("seq", "status")).alias("s")).select("doc_id", "s.*")


def sse_data(lines: DataFrame) -> DataFrame:
    """stream_id, k, payload of `data: ` lines in order, up to [DONE]."""
    rows = lines.filter(F.col("line").startswith("data: ")).select("stream_id", "k", F.trim(F.substr("line", F.lit(7))).alias("payload"))
    stop = rows.filter("payload = '[DONE]'").groupBy("stream_id").agg(F.min("k").alias("stop"))
    return rows.join(stop, "stream_id", "left").filter("stop IS NULL OR k < stop").drop("stop")


_OPENAI = "struct<choices:array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>,usage:struct<prompt_tokens:long,completion_tokens:long>>"
_ANTHROPIC = "struct<type:string,message:struct<usage:struct<input_tokens:long>>,delta:struct<type:string,text:string,partial_json:string>,usage:struct<output_tokens:long>,index:int>"


def _text(parts):
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda s: s.text), "")


def openai_stream(data: DataFrame) -> DataFrame:
    """stream_id, content, input_tokens, output_tokens of chat-completion chunks."""
    x = data.select("stream_id", "k", F.from_json("payload", _OPENAI).alias("x"))
    return x.groupBy("stream_id").agg(
        _text(F.struct("k", F.coalesce(F.get(F.col("x.choices"), F.lit(0))["delta"]["content"], F.lit("")).alias("text"))).alias("content"), F.max("x.usage.prompt_tokens").alias("input_tokens"), F.max("x.usage.completion_tokens").alias("output_tokens")
    )


def openai_tool_calls(data: DataFrame) -> DataFrame:
    """stream_id, index, id, name, arguments: pieces of each call joined by index."""
    x = data.select("stream_id", "k", F.explode(F.get(F.from_json("payload", _OPENAI)["choices"], F.lit(0))["delta"]["tool_calls"]).alias("t"))
    return x.groupBy("stream_id", F.col("t.index").alias("index")).agg(F.max("t.id").alias("id"), F.max("t.function.name").alias("name"), _text(F.struct("k", F.coalesce("t.function.arguments", F.lit("")).alias("text"))).alias("arguments"))


def anthropic_stream(data: DataFrame) -> DataFrame:
    """stream_id, content, input_tokens, output_tokens of message events."""
    x = data.select("stream_id", "k", F.from_json("payload", _ANTHROPIC).alias("x"))
    return x.groupBy("stream_id").agg(_text(F.struct("k", F.coalesce("x.delta.text", F.lit("")).alias("text"))).alias("content"), F.max("x.message.usage.input_tokens").alias("input_tokens"), F.max("x.usage.output_tokens").alias("output_tokens"))
