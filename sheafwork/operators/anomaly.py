"""Anomalies: outliers, missing cells, format drift, duplicate and empty rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import is_missing, num_anom, plain_number, value_type
from .profile import quartiles


def iqr_severity(value: Column, low: Column, high: Column, iqr: Column) -> Column:
    distance = F.try_divide(F.greatest(low - value, value - high), iqr)
    return F.when(iqr == 0, "medium").when(distance > 3, "critical").when(distance > 2, "high").when(distance > 1, "medium").otherwise("low")


def z_severity(z: Column) -> Column:
    return F.when(z > 5, "critical").when(z > 4, "high").when(z > 3.5, "medium").otherwise("low")


def iqr_outliers(df: DataFrame, column: str, keep: list[str], factor: float = 1.5, least: int = 10) -> DataFrame:
    """Rows outside the positional quartiles by `factor` ranges; none under `least` values."""
    value = plain_number(F.col(f"`{column}`"), dict(df.dtypes)[column], num_anom)
    bounds = quartiles(df, value).where(F.col("n") >= least).select((F.col("q1") - factor * F.col("iqr")).alias("low"), (F.col("q3") + factor * F.col("iqr")).alias("high"), "iqr")
    found = df.select(*keep, value.alias("value")).join(F.broadcast(bounds)).where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))
    return found.select(*keep, F.lit("outlier").alias("anomaly_type"), F.lit(column).alias("column"), "value", iqr_severity(F.col("value"), F.col("low"), F.col("high"), F.col("iqr")).alias("severity"))


def z_outliers(df: DataFrame, column: str, keep: list[str], limit: float = 3.0) -> DataFrame:
    """Rows more than `limit` sample deviations from the mean; none where all values are equal."""
    value = plain_number(F.col(f"`{column}`"), dict(df.dtypes)[column], num_anom)
    stats = df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).where(F.col("std") > 0)
    found = df.select(*keep, value.alias("value")).join(F.broadcast(stats)).withColumn("z", F.abs((F.col("value") - F.col("mean")) / F.col("std"))).where(F.col("z") > limit)
    return found.select(*keep, F.lit("outlier").alias("anomaly_type"), F.lit(column).alias("column"), "value", z_severity(F.col("z")).alias("severity"))


def missing_cells(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """One row for each missing cell, from one scan."""
    named = F.array(*[F.when(is_missing(F.col(f"`{c}`")), F.lit(c)) for c in columns])
    return df.select(*keep, F.explode(F.array_compact(named)).alias("column")).withColumn("anomaly_type", F.lit("missing_value"))


def format_drift(df: DataFrame, column: str, keep: list[str], share: float = 0.8, least: int = 3) -> DataFrame:
    """Cells of another kind than the one that at least `share` of the column's filled cells have."""
    kinds = df.select(*keep, F.col(f"`{column}`").cast("string").alias("value"), value_type(F.col(f"`{column}`")).alias("kind")).where("kind != 'null'")
    counts = kinds.groupBy("kind").agg(F.count("*").alias("n"))  # five kinds
    whole = counts.agg(F.sum("n").alias("total"), F.max_by("kind", "n").alias("main"), F.max("n").alias("top")).where((F.col("total") >= least) & (F.col("top") >= share * F.col("total")))
    return kinds.join(F.broadcast(whole)).where(F.col("kind") != F.col("main")).select(*keep, F.lit("inconsistent_format").alias("anomaly_type"), F.lit(column).alias("column"), "value", "kind", F.col("main").alias("expected"))


def duplicate_rows(df: DataFrame, index: str, columns: list[str]) -> DataFrame:
    """index and first_index of rows equal in all `columns` to an earlier one; rows with under two filled cells
    don't count. First rows are found by a map-side minimum of a 128-bit key, and joined back."""
    filled = reduce(lambda a, b: a + b, [(~is_missing(F.col(f"`{c}`"))).cast("int") for c in columns])
    texts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]
    cells = F.concat_ws(":", *[x for t in texts for x in (F.length(t).cast("string"), t)])  # lengths keep cells apart
    keyed = df.where(filled >= 2).select(F.col(index), F.md5(cells.cast("binary")).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min(index).alias("first_index"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return keyed.join(first, "_key").where(F.col(index) > F.col("first_index")).select(index, "first_index")


def empty_rows(df: DataFrame, index: str, columns: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [is_missing(F.col(f"`{c}`")) for c in columns])).select(index)


def empty_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*[F.count_if(~is_missing(F.col(f"`{c}`"))).alias(c) for c in columns])
    return row.unpivot([], columns, "column", "filled").where("filled = 0").select("column")


def report(df: DataFrame, index: str, columns: list[str], numeric: list[str]) -> DataFrame:
    """anomaly_type and count over all checks."""
    plain = lambda d: d.select("anomaly_type")
    parts = [plain(missing_cells(df, [index], columns)), duplicate_rows(df, index, columns).select(F.lit("duplicate_row").alias("anomaly_type")), empty_rows(df, index, columns).select(F.lit("empty_row").alias("anomaly_type"))]
    for c in numeric:
        iqr, z = iqr_outliers(df, c, [index]), z_outliers(df, c, [index])
        parts += [plain(iqr), plain(z.join(iqr, index, "left_anti"))]
    parts += [plain(format_drift(df, c, [index])) for c in columns if dict(df.dtypes)[c] == "string"]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("anomaly_type").agg(F.count("*").alias("n"))
