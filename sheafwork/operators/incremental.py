"""Change detection and merges of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.select(key, F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256).alias("hash"))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and change (added, modified, no_change, removed) of two (key, hash) tables: one full outer join."""
    met = old.select(key, F.col("hash").alias("_old")).join(new.select(key, F.col("hash").alias("_new")), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "no_change").otherwise("modified")
    return met.select(key, change.alias("change"))


def changed(current: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Rows that are new, whose hash differs, or whose last run failed."""
    known = indexed.select(key, F.col("hash").alias("_hash"), F.col("status").alias("_status"))
    return current.join(known, key, "left").where(F.col("_hash").isNull() | (F.col("_hash") != F.col("hash")) | (F.col("_status") == "failed")).drop("_hash", "_status")


def deleted(current: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    return indexed.select(key).join(current.select(key), key, "left_anti")


def upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Updates replace rows of the same key; the rest stays. An anti-join and a union: no row is compared twice."""
    return target.join(updates.select(key), key, "left_anti").unionByName(updates)


def delete_keys(target: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return target.join(gone.select(key), key, "left_anti")


def split_existing(target: DataFrame, updates: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Updates of keys that exist, and of keys that don't."""
    return updates.join(target.select(key), key, "left_semi"), updates.join(target.select(key), key, "left_anti")
