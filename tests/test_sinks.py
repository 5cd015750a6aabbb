"""Tables saved together: crashes between them, batches run again, streams restarted."""

import pytest
from pyspark.sql import functions as F

from arborlake.streaming import sinks as SI

EVENT = "trace_id long, conv_id long, model string, step_number int, tool string, input string, output string, input_tokens long, output_tokens long, latency_ms long"


def rows(spark, *traces):
    return spark.createDataFrame([(t, 1, "unknown", k, "search", "i", "o", 1000 * k, None, 5) for t in traces for k in (1, 2, 3)], EVENT)


def read(spark, sink):
    made = SI.traces_and_steps(spark.createDataFrame([], EVENT))
    return {t: sorted(map(tuple, SI.read_batches(spark, sink, t, made[t].schema).collect())) for t in made}


def test_batches_are_saved_once(spark, tmp_path):
    sink = f"{tmp_path}/sink"
    assert read(spark, sink) == {"traces": [], "steps": []}
    assert SI.save_batch(sink, 0, SI.traces_and_steps(rows(spark, 7)))
    first = read(spark, sink)
    assert [t[:3] + t[5:6] + t[7:] for t in first["traces"]] == [(7, 1, "unknown", 6000, 15, 3)] and first["traces"][0][6] == pytest.approx(0.003) and len(first["steps"]) == 3
    assert not SI.save_batch(sink, 0, SI.traces_and_steps(rows(spark, 7)))
    assert read(spark, sink) == first
    assert SI.save_batch(sink, 1, SI.traces_and_steps(rows(spark, 8, 9)))
    assert len(read(spark, sink)["traces"]) == 3 and SI.clear_uncommitted(spark, sink) == 0


def test_crash_between_tables_shows_neither(spark, tmp_path):
    sink = f"{tmp_path}/sink"
    SI.save_batch(sink, 0, SI.traces_and_steps(rows(spark, 7)))
    before = read(spark, sink)
    broken = SI.traces_and_steps(rows(spark, 8))
    broken["steps"] = broken["steps"].withColumn("id", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        SI.save_batch(sink, 1, broken)
    assert read(spark, sink) == before
    assert SI.save_batch(sink, 1, SI.traces_and_steps(rows(spark, 8)))
    after = read(spark, sink)
    assert [t[0] for t in after["traces"]] == [7, 8] and len(after["steps"]) == 6
    assert SI.clear_uncommitted(spark, sink) == 1 and read(spark, sink) == after


def test_stream_goes_on_after_a_crash(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/sink"
    stream = lambda: spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    rows(spark, 1).coalesce(1).write.parquet(source)
    SI.stream_to(stream(), sink, SI.traces_and_steps)
    rows(spark, 2).coalesce(1).write.mode("append").parquet(source)

    def fails(df):
        out = SI.traces_and_steps(df)
        return out | {"steps": out["steps"].withColumn("id", F.raise_error(F.lit("lost")))}

    with pytest.raises(Exception, match="lost"):
        SI.stream_to(stream(), sink, fails)
    assert [t[0] for t in read(spark, sink)["traces"]] == [1]
    for _ in range(2):  # the second run finds nothing new
        SI.stream_to(stream(), sink, SI.traces_and_steps)
        got = read(spark, sink)
        assert [t[0] for t in got["traces"]] == [1, 2] and len(got["steps"]) == 6


def test_last_state(spark, tmp_path):
    source, sink = f"{tmp_path}/in", f"{tmp_path}/sink"
    count = lambda: spark.readStream.schema(EVENT).parquet(source).groupBy("trace_id").count()
    rows(spark, 1).write.parquet(source)
    assert sorted(map(tuple, SI.run_to_table(count(), sink).collect())) == [(1, 3)]
    rows(spark, 1, 2).write.mode("append").parquet(source)
    assert sorted(map(tuple, SI.run_to_table(count(), sink).collect())) == [(1, 6), (2, 3)]
