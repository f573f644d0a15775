"""State that outlives batches: the last messages of conversations in any order of arrival, and traces whose ends are matched in time.

Arbitrary state needs the RocksDB state store: ``use_rocksdb(spark)`` sets it before a query starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = "conv_id long, n_messages long, turns array<long>, last_texts array<string>, closed boolean"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class LastMessages(StatefulProcessor):
    """The `keep` latest messages by turn as list state, and the number of all; both expire `ttl_ms` after their last change.

    A message that arrives late takes its place by turn, so shuffled arrival ends in the same rows. A turn that comes again replaces the text
    and isn't counted if it is still kept. A timer closes a conversation that was idle for `idle_ms`: its last row says `closed`, its state goes.
    """

    def __init__(self, keep: int, ttl_ms: int, idle_ms: int | None):
        self.keep, self.ttl_ms, self.idle_ms = keep, ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "turn long, text string", self.ttl_ms)
        self.count = handle.getValueState("count", "n long", self.ttl_ms)

    def _row(self, key, closed: bool) -> pd.DataFrame:
        kept = sorted(tuple(r) for r in self.last.get())
        n = self.count.get()[0] if self.count.exists() else 0
        return pd.DataFrame({"conv_id": [key[0]], "n_messages": [n], "turns": [[t for t, _ in kept]], "last_texts": [[x for _, x in kept]], "closed": [closed]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = {t: x for t, x in (tuple(r) for r in self.last.get())} if self.last.exists() else {}
        n = self.count.get()[0] if self.count.exists() else 0
        for frame in rows:
            for turn, text in zip(frame["turn"].tolist(), frame["text"].tolist()):
                n += turn not in kept
                kept[turn] = text
            for turn in sorted(kept)[: -self.keep]:
                del kept[turn]
        self.last.put(sorted(kept.items()))
        self.count.update((n,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            row = self._row(key, True)
            self.last.clear()
            self.count.clear()
            yield row

    def close(self) -> None:
        pass


def last_messages(messages: DataFrame, keep: int = 10, ttl_ms: int = 3_600_000, idle_ms: int | None = None) -> DataFrame:
    """A stream of conv_id, turn, text as updates of each conversation's last `keep` messages by turn.

    Time to live and timers go by the clock, so batches go on without data: start it with a processing-time trigger, not with availableNow.
    """
    own = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    return own.groupBy("conv_id").transformWithStateInPandas(statefulProcessor=LastMessages(keep, ttl_ms, idle_ms), outputStructType=COLUMNS, outputMode="Update", timeMode="processingTime")


def traces(starts: DataFrame, ends: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """trace_id, started, ended, seconds: each start with the end that came at most `within` after it; null where none came.

    starts: trace_id, started; ends: trace_id, ended. For streams both sides have watermarks, so state older than the interval is dropped and
    an unfinished trace comes out once no end can follow.
    """
    a = starts.select(F.col("trace_id"), F.col("started").cast("timestamp").alias("started"))
    b = ends.select(F.col("trace_id").alias("_id"), F.col("ended").cast("timestamp").alias("ended"))
    if starts.isStreaming:
        a, b = a.withWatermark("started", late), b.withWatermark("ended", late)
    near = (F.col("trace_id") == F.col("_id")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"interval {within}"))
    seconds = F.unix_micros("ended") - F.unix_micros("started")
    return a.join(b, near, "left_outer").select("trace_id", "started", "ended", (seconds / 1e6).alias("seconds"))
