"""Comparison of two entities and of a sequence of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import percent_change, plain_number, trend


def compare(df: DataFrame, metrics: list[str], is_a: Column, is_b: Column, temporal: bool = False) -> DataFrame:
    """metric, value_a, value_b, absolute_diff, percentage_diff, trend [, growth_rate]: sums over both entities in
    one scan by conditional aggregation; a - b, against |b|."""
    types = dict(df.dtypes)
    number = {m: plain_number(F.col(f"`{m}`"), types[m]) for m in metrics}
    sums = df.agg(*[F.sum(F.when(on, number[m])).alias(f"{i}_{k}") for i, m in enumerate(metrics) for k, on in (("a", is_a), ("b", is_b))])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{i}_a").alias("value_a"), F.col(f"{i}_b").alias("value_b")) for i, m in enumerate(metrics)])
    out = sums.select(F.explode(rows).alias("r")).select("r.*")
    diff = F.col("value_a") - F.col("value_b")
    out = out.withColumn("absolute_diff", F.round(diff, 6)).withColumn("percentage_diff", F.round(F.try_divide(diff, F.abs("value_b")) * 100, 2))
    out = out.withColumn("trend", F.when(diff > 0, "increasing").when(diff < 0, "decreasing").otherwise("stable"))
    return out.withColumn("growth_rate", F.col("percentage_diff")) if temporal else out


def compare_modes(df: DataFrame, column: str, is_a: Column, is_b: Column) -> DataFrame:
    """The most frequent text in each entity; ties go to the smaller text."""
    counted = df.where(is_a | is_b).groupBy(F.when(is_a, "a").otherwise("b").alias("entity"), F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("n"))
    return counted.where(F.col("value").isNotNull()).groupBy("entity").agg(F.max(F.struct("n", F.col("value"))).alias("m"), F.max("n").alias("top")).join(counted, "entity").where("n = top").groupBy("entity").agg(F.min("value").alias("value"), F.max("top").alias("occurrences"))


def comparison_summary(result: DataFrame) -> DataFrame:
    up, down = F.col("absolute_diff") > 0, F.col("absolute_diff") < 0
    return result.agg(
        F.count_if(up).alias("increasing"), F.count_if(down).alias("decreasing"), F.count_if(F.col("absolute_diff") == 0).alias("stable"),
        F.max_by(F.when(up, F.col("metric")), F.when(up, F.col("absolute_diff"))).alias("largest_increase"), F.min_by(F.when(down, F.col("metric")), F.when(down, F.col("absolute_diff"))).alias("largest_decrease"),
    )


def halves(df: DataFrame, order: str, rows: int) -> tuple[Column, Column]:
    """First floor(n/2) rows against the rest, by a dense row number column."""
    return F.col(order) < rows // 2, F.col(order) >= rows // 2


def sequence_differences(df: DataFrame, period: str, metric: str) -> DataFrame:
    """For each period its mean, and against the one before the difference, the per cent change and the trend.

    Rows are reduced to one for each period before the window, which has no more rows than there are periods.
    """
    value = plain_number(F.col(f"`{metric}`"), dict(df.dtypes)[metric])
    means = df.groupBy(period).agg(F.avg(value).alias("mean"))
    before = F.lag("mean").over(Window.orderBy(period))
    out = means.withColumn("previous", before)
    change = percent_change(F.col("previous"), F.col("mean"))
    return out.withColumn("difference", F.col("mean") - F.col("previous")).withColumn("percentage_change", change).withColumn("trend", trend(change))


def majority_trend(differences: DataFrame) -> DataFrame:
    counted = differences.where(F.col("previous").isNotNull()).groupBy("trend").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "trend").limit(1)


def key_differences(differences: DataFrame, period: str, n: int = 5) -> DataFrame:
    return differences.where(F.col("difference").isNotNull()).orderBy(F.desc(F.abs("difference")), period).limit(n).select(period, "difference", "percentage_change")
