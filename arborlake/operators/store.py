"""The relational store as table functions: upserts, deletes, cascades, and the analytics over conversations, traces and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import cost, token_estimate


def upsert(table: DataFrame, new: DataFrame, keys: list[str], order: str, keep_first: list[str] | None = None) -> DataFrame:
    """table with rows of new in the place of those with their keys; of several the latest by order. keep_first names columns, as created_at, whose oldest value stays."""
    rows = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    for c in keep_first or []:
        rows = rows.withColumn(c, F.first(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_new", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn("_rn", latest).filter("_rn = 1").select(*table.columns)


def insert_ignore(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table and the rows of new whose keys it does not have, one for each key."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def update(table: DataFrame, key: str, value, **columns) -> DataFrame:
    hit = F.col(key) == value
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in columns.items()})


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """table without the rows whose keys are in keys."""
    return table.join(keys, keys.columns, "left_anti")


def cascade_delete(conv: DataFrame, conversations: DataFrame, messages: DataFrame, traces: DataFrame, steps: DataFrame, evals: DataFrame, bridge: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table without the conversations in conv (conv_id); their documents stay."""
    victims = traces.join(conv, "conv_id", "left_semi").select(F.col("id").alias("trace_id"))
    return {
        "conversations": conversations.join(conv, conversations["id"] == conv["conv_id"], "left_anti"),
        "messages": messages.join(conv, "conv_id", "left_anti"),
        "traces": traces.join(conv, "conv_id", "left_anti"),
        "steps": steps.join(victims, steps["msg_id"] == victims["trace_id"], "left_anti"),
        "evals": evals.join(victims, "trace_id", "left_anti"),
        "conversation_documents": bridge.join(conv, "conv_id", "left_anti"),
    }


def describe_image(nodes: DataFrame, descriptions: DataFrame) -> DataFrame:
    """nodes (doc_id, pos, summary) with the descriptions (doc_id, pos, description) that came in, and which are described; those described before stay so. Of several for a node the least by text."""
    one = descriptions.groupBy("doc_id", "pos").agg(F.min("description").alias("_text"))
    before = F.coalesce("described", F.lit(False)) if "described" in nodes.columns else F.lit(False)
    out = nodes.join(one, ["doc_id", "pos"], "left").withColumn("summary", F.coalesce("_text", "summary"))
    return out.withColumn("described", before | F.col("_text").isNotNull()).drop("_text")


def history_window(messages: DataFrame, budget: int = fixed.HISTORY_TOKENS, current: Column | None = None) -> DataFrame:
    """The newest messages of each conversation whose estimates sum up to at most budget, as conv_id, turn, role, text, tokens, running."""
    rows = messages if current is None else messages.filter(~((F.col("role") == "user") & (F.col("text") == current)))
    rows = rows.withColumn("tokens", token_estimate(F.col("text"), F.col("role")))
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum("tokens").over(back)).filter(F.col("running") <= budget)


def cost_by_provider(traces: DataFrame) -> DataFrame:
    return traces.filter("provider_name <> ''").groupBy("provider_name").agg(F.sum("total_tokens").alias("total_tokens"), F.sum("total_cost").alias("total_cost"), F.count(F.lit(1)).alias("query_count"))


def session_totals(traces: DataFrame) -> DataFrame:
    return traces.groupBy("conv_id").agg(F.sum("total_tokens").alias("total_tokens"), F.sum("total_cost").alias("total_cost"), F.sum("total_latency_ms").alias("total_latency_ms"), F.sum("steps_count").alias("steps_count"))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens) with cost, by the model's price or the default. prices is the stated table of models."""
    default_in, default_out = fixed.DEFAULT_PRICE
    out = usage.join(F.broadcast(prices), "model", "left")  # a row for each priced model
    return out.withColumn("cost", cost(F.col("input_tokens"), F.col("output_tokens"), F.coalesce("rate_in", F.lit(default_in)), F.coalesce("rate_out", F.lit(default_out)))).drop("rate_in", "rate_out")


def price_table(spark) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in fixed.PRICES.items()], "model string, rate_in double, rate_out double")


def trace_rollup(traces: DataFrame, steps: DataFrame) -> DataFrame:
    """traces with steps_count and step tokens and latency of their steps (msg_id)."""
    sums = steps.groupBy(F.col("msg_id").alias("id")).agg(F.count(F.lit(1)).alias("steps_count"), F.sum("tokens_used").alias("step_tokens"), F.sum("latency_ms").alias("step_latency_ms"))
    return traces.join(sums, "id", "left").na.fill(0, ["steps_count", "step_tokens", "step_latency_ms"])


def documents_per_conversation(conversations: DataFrame, bridge: DataFrame) -> DataFrame:
    counted = bridge.groupBy("conv_id").agg(F.count(F.lit(1)).alias("doc_count"))
    return conversations.join(counted, conversations["id"] == counted["conv_id"], "left").select("id", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def conversation_documents(bridge: DataFrame, documents: DataFrame) -> DataFrame:
    return bridge.join(documents, bridge["doc_id"] == documents["id"]).drop(documents["id"])


def latest_user_turn(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("turn"))).alias("latest_user_turn"))


def titled(conversations: DataFrame, search: str) -> DataFrame:
    """Conversations whose title contains the search text, whatever the case of both; all for a blank one, none without a title for others."""
    return conversations.filter(F.contains(F.lower("title"), F.lit(search.lower()))) if search.strip() else conversations


def listing(table: DataFrame, by: str, *keys: str, newest: bool = True) -> DataFrame:
    """table by time, newest first or oldest first, ties by keys; rows without a time are the oldest."""
    return table.orderBy(F.desc_nulls_last(by) if newest else F.asc_nulls_first(by), *keys)


def visited_nodes(steps: DataFrame) -> DataFrame:
    """conv_id, node_id, place of the nodes that a conversation's steps (conv_id, step_number, node_ids) visit, each once, numbered from 1 in the order of their first visits. Null ids are no nodes."""
    seen = steps.select("conv_id", "step_number", F.posexplode("node_ids").alias("k", "node_id")).filter("node_id IS NOT NULL")
    first = seen.groupBy("conv_id", "node_id").agg(F.min(F.struct("step_number", "k")).alias("at"))
    return first.select("conv_id", "node_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "node_id")).alias("place"))


def overlapping_steps(steps: DataFrame, sections: DataFrame) -> DataFrame:
    """step_id, section_id of steps and sections that share a node; each has node_ids."""
    a = steps.select("step_id", F.explode("node_ids").alias("node"))
    b = sections.select("section_id", F.explode("node_ids").alias("node"))
    return a.join(b, "node").select("step_id", "section_id").distinct()


def schema_version(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def rendered_rows(table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, row_index, row_text: each row as `Column: value | ...`, in order of key."""
    from ..functions.text import keyed_row

    return table.select(key, keyed_row(columns, [F.col(c).cast("string") for c in columns]).alias("row_text"))


def column_samples(table: DataFrame, order: str, columns: list[str], most: int = 3) -> DataFrame:
    """column, samples: `column (e.g. a, b, c)` from the first rows by order; empty values drop out."""
    first = table.orderBy(order).limit(most).select(F.col(order).alias("_k"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))
    long = first.select("_k", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))).alias("x")).select("_k", "x.*").filter("value <> ''")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "value"))), lambda s: s.value), ", ")
    return long.groupBy("column").agg(F.concat(F.first("column"), F.lit(" (e.g. "), listed, F.lit(")")).alias("samples"))
