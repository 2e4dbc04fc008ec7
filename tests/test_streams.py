"""Streams give what the batch form of the same operators gives."""

from pyspark.sql import functions as F

from streamledger.operators.windows import time_windows
from streamledger.streaming import streams


def test_windows_over_a_stream_equal_batch(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    aggregates = [F.count("event_id").alias("n"), F.round(F.sum("value"), 2).alias("total")]
    stream = streams.follow(spark, sf_dir, batch.schema, "events.parquet")
    got = streams.to_memory(streams.windowed(stream, "1 hour", "event_type", aggregates=aggregates), "hourly")
    expected = time_windows(streams.timed(batch), "1 hour", "event_type", aggregates=aggregates)
    key = lambda df: sorted(tuple(r) for r in df.select("window_start", "event_type", "n", "total").collect())
    assert key(got) == key(expected)


def test_row_windows_over_a_stream(spark, sf_dir):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = streams.follow(spark, sf_dir, batch.schema, "events.parquet")
    got = streams.to_memory(streams.row_windows(stream, "event_type", 10, "value"), "by_rows", "append").collect()
    sizes = {r["event_type"]: r["count"] for r in batch.groupBy("event_type").count().collect()}
    assert all(r["n"] == 10 for r in got)
    for kind, n in sizes.items():
        assert sorted(r["window_no"] for r in got if r["event_type"] == kind) == list(range(n // 10))


def test_file_sink_and_restart(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    for _ in range(2):  # the second run finds nothing new
        stream = streams.follow(spark, sf_dir, batch.schema, "events.parquet")
        streams.to_files(stream.where("event_type = 'error'"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.where("event_type = 'error'").count()
    assert not streams.stop(spark, "no such stream")
