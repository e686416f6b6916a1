"""Structured Streaming over folders in which JSON lines of test cases land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from schemaloom.functions.text import py_strip


def landing_lines(spark: SparkSession, path: str, files_each: int = 100) -> DataFrame:
    """A stream of the JSON lines of new files; blank and broken ones are left out. It holds no state, so needs no watermark."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_each).text(path)
    good = F.from_json("value", "map<string,string>").isNotNull() & (py_strip(F.col("value")) != "")
    return lines.where(good).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def each_batch(lines: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run a batch operator on what has landed and write its rows, each micro-batch to a folder of its own number.

    A batch that is run again after a failure overwrites its own folder, so rows are written once.
    """

    def put(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by type in tumbling windows of event time; events later than the watermark are dropped."""
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    counted = windowed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")
