"""The same operators over Structured Streaming: sources, windows by time and by rows, sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from streamledger.operators.windows import time_windows


def follow(spark: SparkSession, folder: str, schema: StructType, files: str = "*", per_trigger: int = 8) -> DataFrame:
    """The Parquet files of a folder as a stream, new ones as they come; ``per_trigger`` files at a time hold back the source."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def timed(df: DataFrame, time: str = "ts", delay: str | None = None) -> DataFrame:
    """With ``time`` as an instant, and a watermark if late rows are to be dropped."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, delay) if delay else df


def windowed(df: DataFrame, size: str, *groups: str, aggregates: list[Column], time: str = "ts") -> DataFrame:
    return time_windows(timed(df, time), size, *groups, aggregates=aggregates, time=time)


def row_windows(df: DataFrame, group: str, rows: int, value: str) -> DataFrame:
    """``group, window_no, n, total``: tumbling windows of ``rows`` rows within each group, put out as they fill.

    The state of a group is one open window: its number, rows and sum.
    """

    def fill(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, n, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        for batch in batches:
            values = batch[value].to_numpy()
            while n + len(values) >= rows:
                taken, values = values[: rows - n], values[rows - n :]
                out.append((key[0], number, rows, total + float(taken.sum())))
                number, n, total = number + 1, 0, 0.0
            n, total = n + len(values), total + float(values.sum())
        state.update((number, n, total))
        yield pd.DataFrame(out, columns=[group, "window_no", "n", "total"])

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandasWithState(
        fill, f"{group} {kind}, window_no long, n long, total double", "window_no long, n long, total double", "append", GroupStateTimeout.NoTimeout
    )


def to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what its source has now and return the named result."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def to_files(stream: DataFrame, folder: str, checkpoint: str, period: str | None = None):
    """Start appending a stream to Parquet files, exactly once; the checkpoint is its log of intents."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=period).start() if period else writer.trigger(availableNow=True).start()


def stop(spark: SparkSession, name: str) -> bool:
    """Drop a named stream; whether there was one."""
    found = [q for q in spark.streams.active if q.name == name]
    for q in found:
        q.stop()
    return bool(found)
