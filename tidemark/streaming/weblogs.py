"""Web logs as streams. The same functions run on batch and streaming DataFrames; the transport is a parameter.

Stateful steps can follow each other in one query (duplicates out, then sessions or windows): event_timestamp carries one watermark
from the first of them on, and none sets another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.cleaning import clean_web_logs
from tidemark.sources import lake
from tidemark.sources.schemas import WEB_LOG

REQUIRED = ["event_id", "event_type", "timestamp", "session_id"]


def valid(raw: DataFrame) -> DataFrame:
    return raw.dropna(subset=REQUIRED)


def read_topic(spark: SparkSession, fmt: str = "kafka", streaming: bool = True, path: str | None = None, **options: str) -> DataFrame:
    """Rows with a `value` string: a topic from its earliest offset, or files of (key, value) for tests and replays."""
    reader = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
    if fmt == "kafka":
        reader = reader.option("startingOffsets", options.get("startingOffsets", "earliest"))
    else:
        reader = reader.schema("key string, value string")
    df = reader.load(path) if path else reader.load()
    return df.select(F.col("value").cast("string").alias("value"))


def parse(df: DataFrame) -> DataFrame:
    """Bronze rows of a topic's values."""
    rows = df.select(F.from_json("value", WEB_LOG).alias("data")).select("data.*")
    ts = F.try_to_timestamp("timestamp")
    return rows.withColumns({"event_timestamp": ts, "processing_timestamp": F.current_timestamp(), "data_source": F.lit("web_logs"), "year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)})


def watermarked(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream with a watermark on event_timestamp, unless it has one already; a batch as it is."""
    marked = not df.isStreaming or "spark.watermarkDelayMs" in df.schema["event_timestamp"].metadata
    return df if marked else df.withWatermark("event_timestamp", delay)


def deduplicated(clean: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops events seen before within the watermark; on a batch, duplicates by event_id."""
    if clean.isStreaming:
        return watermarked(clean, delay).dropDuplicatesWithinWatermark(["event_id"])
    return clean.dropDuplicates(["event_id"])


def silver(df: DataFrame, delay: str = "1 hour") -> DataFrame:
    return deduplicated(clean_web_logs(df), delay)


def session_windows(clean: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions by inactivity for logs without a session_id; of a stream, those that the watermark has passed."""
    out = watermarked(clean, delay).groupBy("user_id", F.session_window("event_timestamp", gap).alias("w")).agg(F.count("*").alias("event_count"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "event_count")


def windowed_counts(clean: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts by event type and window; of a stream, of the windows that the watermark has passed."""
    out = watermarked(clean, delay).groupBy(F.window("event_timestamp", window).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events")


def to_parquet(df: DataFrame, path: str, checkpoint: str, partition_by: list[str], every: str | None = None) -> StreamingQuery:
    """Appends to Parquet; every: a trigger interval, or all that is available and then stop."""
    writer = df.writeStream.format("parquet").outputMode("append").partitionBy(*partition_by).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def to_parquet_once(df: DataFrame, path: str, checkpoint: str, partition_by: list[str], every: str | None = None, written: Callable[[int], None] | None = None) -> StreamingQuery:
    """to_parquet for sinks whose files have no commit log of Spark's: each micro-batch is a partition `batch_id` of the table, which a
    replay of the batch after a failure replaces, so readers of plain Parquet find each row once. written: called with the batch's
    number when its files are there. compacted() merges the batches of the past."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_id", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *partition_by).parquet(path)
        if written:
            written(number)

    writer = df.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def compacted(spark: SparkSession, path: str, before: int, out: str, partition_by: list[str]) -> None:
    """Writes the rows of to_parquet_once()'s batches up to `before` as one table without batches; a rerun replaces its partitions."""
    rows = spark.read.parquet(path).filter(F.col("batch_id") < before).drop("batch_id")
    lake.write(rows.repartition(*partition_by), out, partition_by)
