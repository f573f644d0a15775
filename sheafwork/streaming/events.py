"""Windowed aggregates, sessions and state. Each function takes a batch or a streaming DataFrame alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which needs a time with zone; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count, sum and mean of value by window and type; rows later than `late` are dropped from a stream."""
    kept = marked(events, late)
    out = kept.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "mean")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", late: str = "1 day") -> DataFrame:
    kept = marked(events, late)
    return kept.groupBy(F.window("ts", size, step).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """One row for each user and run of events without a longer pause."""
    kept = marked(events, late)
    out = kept.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n", "total")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    return marked(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def conversation_state(messages: DataFrame, keep: int = 10, ttl_ms: int = 3_600_000) -> DataFrame:
    """Streaming session state: for each conversation its number of messages and the last `keep` texts, dropped after
    `ttl_ms` without a message."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, [])
        for f in frames:
            f = f.sort_values("turn")
            n, last = n + len(f), (list(last) + f["text"].tolist())[-keep:]
        state.update((n, last))
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "n_messages": [n], "last_texts": [list(last)]})

    return messages.groupBy("conv_id").applyInPandasWithState(update, "conv_id long, n_messages long, last_texts array<string>", "n long, last array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def index_new_files(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> None:
    """Append files that arrived since the last call to `target` with their content hash; the checkpoint remembers
    which were seen, so a failed call can be repeated."""
    stream = spark.readStream.schema(schema).parquet(source).withColumn("source_file", F.input_file_name())
    hashed = stream.withColumn("content_hash", F.sha2(F.to_json(F.struct("*")), 256))
    hashed.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
