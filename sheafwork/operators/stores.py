"""Versioned, append-only and keyed metadata: versions, feedback, traces, lineage, caches, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the largest version of each key: a map-side maximum instead of a window over every row."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), version).alias("r")).select("r.*")


def version_at(df: DataFrame, key: str, version: str, created: str, moment: Column) -> DataFrame:
    return latest(df.where(F.col(created) <= moment), key, version)


def history(df: DataFrame, key: str, value, version: str, limit: int | None = None) -> DataFrame:
    out = df.where(F.col(key) == value).orderBy(F.desc(version))
    return out if limit is None else out.limit(limit)


def next_version(df: DataFrame, key: str, version: str) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def rollback(df: DataFrame, key: str, value, version: str, target: int) -> DataFrame:
    """A copy of the target version as the newest one, to append."""
    newest = df.where(F.col(key) == value).agg((F.max(version) + 1).alias("_next"))
    return df.where((F.col(key) == value) & (F.col(version) == target)).join(F.broadcast(newest)).withColumn(version, F.col("_next")).drop("_next")


def feedback_stats(df: DataFrame, key: str, rating: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_distinct(key).alias("rated"), F.avg(rating).alias("mean_rating"), F.count_if(F.col(rating) <= 2).alias("negative"))


def feedback_by_key(df: DataFrame, key: str, rating: str, at: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(rating).alias("mean_rating"), F.count_if(F.col(rating) <= 2).alias("negative"), F.max(at).alias("latest"))


def flagged(df: DataFrame, key: str, rating: str, threshold: int = 3) -> DataFrame:
    return df.where(F.col(rating) <= 2).groupBy(key).agg(F.count("*").alias("negative")).where(F.col("negative") >= threshold)


def top_problematic(df: DataFrame, key: str, rating: str, n: int = 10) -> DataFrame:
    return df.where(F.col(rating) <= 2).groupBy(key).agg(F.count("*").alias("negative")).orderBy(F.desc("negative"), key).limit(n)


def assemble_traces(steps: DataFrame, trace: str, step: str, at: str, value: str) -> DataFrame:
    """One row for each trace: steps, first and last moment, the last value and whether it ended."""
    return steps.groupBy(trace).agg(F.count("*").alias("steps"), F.min(at).alias("started"), F.max(at).alias("ended"), F.max_by(value, at).alias("last_value"), F.bool_or(F.col(step).isin("complete", "abort")).alias("finished"))


def staleness(lineage: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """stale where flagged, where the file is gone, or where it changed after it was indexed."""
    known = files.select(key, F.col("modified").alias("_modified"))
    out = lineage.join(known, key, "left")
    return out.withColumn("stale", F.col("is_stale") | F.col("_modified").isNull() | (F.col("_modified") > F.col("indexed"))).drop("_modified")


def unexpired(df: DataFrame, expires: str, now: Column) -> DataFrame:
    return df.where(F.col(expires) >= now)


def invalidate(cache: DataFrame, gone: DataFrame, files: str = "file_ids") -> DataFrame:
    """Cache rows that rest on none of the files in `gone` (file_id)."""
    bad = cache.select("cache_key", F.explode(files).alias("file_id")).join(gone, "file_id", "left_semi").select("cache_key").distinct()
    return cache.join(bad, "cache_key", "left_anti")


def next_run(at: Column, frequency: Column) -> Column:
    """Daily, weekly and monthly runs: 1, 7 and 30 days later."""
    return F.timestamp_add("DAY", F.when(frequency == "daily", 1).when(frequency == "weekly", 7).when(frequency == "monthly", 30), at)


def due(schedules: DataFrame, now: Column) -> DataFrame:
    return schedules.where(F.col("is_active") & (F.col("next_run_at") <= now)).orderBy("next_run_at", "schedule_id")


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next delivery: 1, 2, 4, ... 30 at most."""
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(30.0))


def progress(batch: DataFrame, key: str, status: str) -> DataFrame:
    done = F.count_if(F.col(status) == "completed")
    return batch.groupBy(key).agg(F.count("*").alias("total"), done.alias("completed"), F.count_if(F.col(status) == "failed").alias("failed"), F.round(done / F.count("*"), 6).alias("share"))
