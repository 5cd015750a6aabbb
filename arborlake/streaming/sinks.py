"""A sink for several tables that are saved together, and the last state of a stream.

Each batch has a folder of its own below the sink, a table in each of its folders, and is committed by one empty marker, made once all of them are written. Readers take
committed batches only. So a crash between two tables shows neither; a batch that is run again, as a restarted stream does with its last one, finds its marker and
writes nothing, or clears what an earlier attempt left. The marker is made without overwriting, so of two writers of a batch one commits.

    sink/batch=00000000000000000007/attempt-<id>/traces/*.parquet
    sink/batch=00000000000000000007/attempt-<id>/steps/*.parquet
    sink/commits/00000000000000000007-<id>
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import files, shared_dir
from ..operators.store import price_table, priced


def committed(spark: SparkSession, sink: str) -> dict[int, str]:
    """The folder of each committed batch: the attempt whose marker came first by name, should there be two."""
    fs, commits = files(spark, f"{sink}/commits")
    if not fs.exists(commits):
        return {}
    out: dict[int, str] = {}
    for status in sorted(str(s.getPath().getName()) for s in fs.listStatus(commits)):
        batch, attempt = status.split("-", 1)
        out.setdefault(int(batch), f"{sink}/batch={batch}/attempt-{attempt}")
    return out


def save_batch(sink: str, batch: int, tables: Mapping[str, DataFrame]) -> bool:
    """Write all tables of a batch, or nothing if it is committed; whether it was this call that wrote them."""
    spark = next(iter(tables.values())).sparkSession
    if batch in committed(spark, sink):
        return False
    name, attempt = f"{batch:020d}", uuid.uuid4().hex
    for table, df in tables.items():
        df.write.parquet(f"{sink}/batch={name}/attempt-{attempt}/{table}")
    fs, marker = files(spark, f"{sink}/commits/{name}-{attempt}")
    fs.create(marker, False).close()
    return committed(spark, sink)[batch].endswith(attempt)


def clear_uncommitted(spark: SparkSession, sink: str) -> int:
    """Delete what failed attempts left, once no writer is at work; how many there were."""
    fs, root = files(spark, sink)
    kept, gone = {path.rsplit("/", 1)[1] for path in committed(spark, sink).values()}, 0
    for batch in fs.listStatus(root) if fs.exists(root) else []:
        if batch.getPath().getName().startswith("batch="):
            for attempt in fs.listStatus(batch.getPath()):
                if attempt.getPath().getName() not in kept:
                    fs.delete(attempt.getPath(), True)
                    gone += 1
    return gone


def read_batches(spark: SparkSession, sink: str, table: str, schema, last: bool = False) -> DataFrame:
    """A table's rows of all committed batches, or of the last one only; no rows before the first."""
    found = committed(spark, sink)
    paths = [f"{found[max(found)]}/{table}"] if found and last else [f"{p}/{table}" for p in found.values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_to(result: DataFrame, sink: str, tables: Callable[[DataFrame], Mapping[str, DataFrame]], mode: str = "append") -> None:
    """Run a stream until it has caught up; each of its micro-batches is saved as the tables made of it, once."""

    def save(df: DataFrame, batch: int) -> None:
        parts = tables(df)
        if len(parts) > 1:
            df.persist()  # one micro-batch, read by each of its tables
        try:
            save_batch(sink, batch, parts)
        finally:
            df.unpersist()

    result.writeStream.outputMode(mode).option("checkpointLocation", f"{sink}/progress").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def run_to_table(result: DataFrame, sink: str | None = None) -> DataFrame:
    """Run a stream's aggregate until it has caught up, and read the state that its last committed batch left; progress and states are in the shared folder, so a lost driver can go on."""
    spark = result.sparkSession
    sink = sink or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream_to(result, sink, lambda df: {"state": df}, "complete")
    return read_batches(spark, sink, "state", result.schema, last=True)


def traces_and_steps(events: DataFrame) -> dict[str, DataFrame]:
    """Finished queries' events (trace_id, conv_id, model, step_number, tool, input, output, input_tokens, output_tokens, latency_ms) as the two tables that are saved together.

    traces: id, conv_id, provider_name, input_tokens, output_tokens, total_tokens, total_cost, total_latency_ms, steps_count. steps: id, msg_id, step_number, tool_name, input_json, output_json,
    tokens_used, latency_ms. Ids come from what a row holds, so a batch run again makes the same. A trace's events are in one batch; nulls count as no tokens and no time.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = events.select("trace_id", "conv_id", "model", "step_number", "tool", "input", "output", *(some(c).alias(c) for c in ("input_tokens", "output_tokens", "latency_ms")))
    sums = rows.groupBy("trace_id", "conv_id", "model").agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "latency_ms")), F.count(F.lit(1)).alias("steps_count"))
    traces = priced(sums, price_table(events.sparkSession)).select(
        F.col("trace_id").alias("id"), "conv_id", F.col("model").alias("provider_name"), "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.col("cost").alias("total_cost"),
        F.col("latency_ms").alias("total_latency_ms"), "steps_count",
    )
    key = F.sha2(F.concat_ws("|", F.col("trace_id").cast("string"), F.col("step_number").cast("string")), 256)
    steps = rows.select(key.alias("id"), F.col("trace_id").alias("msg_id"), "step_number", F.col("tool").alias("tool_name"), F.col("input").alias("input_json"), F.col("output").alias("output_json"), (F.col("input_tokens") + F.col("output_tokens")).alias("tokens_used"), "latency_ms")
    return {"traces": traces, "steps": steps}
