"""Metrics: histograms, performance by operation, text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import profile


def histogram_stats(df: DataFrame, name: str, value: str, newest: list | None = None, keep: int = 1000) -> DataFrame:
    """count, sum, least, largest and exact interpolated p50, p95, p99 for each name.

    With an order (`newest` first) only each name's `keep` newest values count. Percentiles come from counted values laid out in
    ranges, so no name's values are gathered in one task.
    """
    if newest is not None:
        df = last_n(df, name, newest, keep)
    rank = profile.percentiles(df, F.col(value), {"p50": 0.5, "p95": 0.95, "p99": 0.99}, [name]).drop("n").withColumnRenamed(name, "_name")
    out = df.groupBy(name).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("largest"))
    return out.join(rank, F.col(name).eqNullSafe(F.col("_name")), "left").drop("_name")


def last_n(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The n newest rows of each key. A row_number filter: Spark keeps at most n of a key in each task before the
    shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def performance(df: DataFrame, operation: str, value: str, limit: Column) -> DataFrame:
    over = F.count_if(F.col(value) > limit)
    return df.groupBy(operation).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("largest"), F.avg(value).alias("mean"), over.alias("exceeded"), F.round(over / F.count("*") * 100, 4).alias("exceeded_pct"))


def recent_records(df: DataFrame, order: list, operation: str | None = None, name: str = "operation", limit: int = 100) -> DataFrame:
    """The newest records, of one operation or of all: each task keeps `limit` of them."""
    return (df if operation is None else df.where(F.col(name) == operation)).orderBy(*order).limit(limit)


def exceeded_records(df: DataFrame, value: str, limit_of: Column, order: list, limit: int = 100) -> DataFrame:
    """The newest records over their limit."""
    return df.where(F.col(value) > limit_of).orderBy(*order).limit(limit)


def exposition(df: DataFrame, metric: str, label: str, value: str) -> DataFrame:
    return df.select(F.format_string(f"{metric}{{{label}=\"%s\"}} %s", F.col(label), F.col(value).cast("string")).alias("line"))
