"""Aggregation of one column, whole or by groups, with processed and skipped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import plain_number
from . import profile
from .filters import apply_filters

FUNCTIONS = {
    "sum": F.sum, "average": F.avg, "min": F.min, "max": F.max,
    "count": lambda v: F.count(F.lit(1)),
}


def aggregate(df: DataFrame, function: str, column: str, filters: list[tuple] = (), by: list[str] | None = None) -> DataFrame:
    """aggregation, target_column, value, rows_processed, rows_skipped [, group columns].

    Cells that aren't numbers are skipped and counted; COUNT counts the filtered rows themselves. One scan, one
    partial and one final aggregation.
    """
    kept = apply_filters(df, list(filters))
    value = plain_number(F.col(f"`{column}`"), dict(df.dtypes)[column])
    if function == "median":
        # Spark's exact percentile would hold every distinct value of the column, or of a group, in one task
        names = by or []
        found = profile.median(kept, value, names).select(*[F.col(f"`{b}`").alias(f"_{i}") for i, b in enumerate(names)], F.col("n").alias("rows_processed"), F.col("median").alias("value"))
        every = kept.groupBy(*[F.col(f"`{b}`") for b in names]).agg(F.count("*").alias("_all"))
        same = [F.col(f"`{b}`").eqNullSafe(F.col(f"_{i}")) for i, b in enumerate(names)]
        met = every.join(found, same, "left") if names else every.crossJoin(found)  # one row each
        n = F.coalesce("rows_processed", F.lit(0).cast("long"))
        return met.select(*names, F.lit(function).alias("aggregation"), F.lit(column).alias("target_column"), "value", n.alias("rows_processed"), (F.col("_all") - n).alias("rows_skipped"))
    groups = [F.col(f"`{b}`") for b in by or []]
    out = kept.groupBy(*groups).agg(
        FUNCTIONS[function](value).cast("double").alias("value"),
        (F.count("*") if function == "count" else F.count(value)).alias("rows_processed"),
        (F.lit(0).cast("long") if function == "count" else F.count("*") - F.count(value)).alias("rows_skipped"),
    )
    return out.select(*(by or []), F.lit(function).alias("aggregation"), F.lit(column).alias("target_column"), "value", "rows_processed", "rows_skipped")


def skipped_samples(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """Up to n different cells of a text column that aren't numbers."""
    value = plain_number(F.col(f"`{column}`"), dict(df.dtypes)[column])
    return df.where(value.isNull() & F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").cast("string").alias("sample")).distinct().orderBy("sample").limit(n)


def numeric_share(df: DataFrame) -> DataFrame:
    """For each column the share of its non-null cells that are numbers."""
    types = dict(df.dtypes)
    row = df.agg(*[F.try_divide(F.count(plain_number(F.col(f"`{c}`"), types[c])), F.count(f"`{c}`")).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column", "share")
