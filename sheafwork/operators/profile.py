"""Column profiles: counts, statistics, outliers, trends, patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import is_missing, num_cmp, plain_number
from . import staging


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: n, missing, distinct_values, numeric statistics (null where under half of the cells
    are numbers) and text length range. One scan for all columns; distinct counts are exact."""
    columns, types = columns or df.columns, dict(df.dtypes)
    parts = []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        value = plain_number(col, types[c], num_cmp)
        parts += [
            F.count("*").alias(f"{i}_n"), F.count_if(is_missing(col) if types[c] == "string" else col.isNull()).alias(f"{i}_missing"), F.count_distinct(col).alias(f"{i}_distinct"), F.count(value).alias(f"{i}_numeric"),
            F.min(value).alias(f"{i}_min"), F.max(value).alias(f"{i}_max"), F.avg(value).alias(f"{i}_mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"{i}_std"),
        ]
    row = df.agg(*parts)
    items = []
    for i, c in enumerate(columns):
        numeric = F.col(f"{i}_numeric") * 2 > F.col(f"{i}_n") - F.col(f"{i}_missing")
        items.append(F.struct(F.lit(c).alias("column"), F.when(numeric, "number").otherwise("text").alias("kind"), F.col(f"{i}_n").alias("n"), F.col(f"{i}_missing").alias("missing"), F.col(f"{i}_distinct").alias("distinct_values"), *[F.when(numeric, F.col(f"{i}_{k}")).alias(k) for k in ("min", "max", "mean", "std")]))
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def totals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: kind, filled, total and mean (numbers; text is read as numbers), first and last (dates and
    times), all in one scan; what doesn't apply is null."""
    columns, types = columns or df.columns, dict(df.dtypes)
    parts, items = [], []
    for i, c in enumerate(columns):
        col = F.col(f"`{c}`")
        dated = types[c] in ("date", "timestamp", "timestamp_ntz")
        value, moment = (F.lit(None).cast("double"), col.cast("timestamp")) if dated else (plain_number(col, types[c], num_cmp), F.lit(None).cast("timestamp"))
        held = {"filled": F.count(moment if dated else value), "total": F.sum(value), "mean": F.avg(value), "first": F.min(moment), "last": F.max(moment)}
        parts += [f.alias(f"{i}_{k}") for k, f in held.items()]
        kind = F.lit("date") if dated else F.when(F.col(f"{i}_filled") > 0, "number").otherwise("text")
        items.append(F.struct(F.lit(c).alias("column"), kind.alias("kind"), *[F.col(f"{i}_{k}").alias(k) for k in held]))
    return df.agg(*parts).select(F.inline(F.array(*items)))


def patterns(profiles: DataFrame) -> DataFrame:
    """unique_identifier, few_categories (5 at most), many_missing (over 10 %) for each profiled column."""
    filled = F.col("n") - F.col("missing")
    return profiles.select("column", ((F.col("distinct_values") == filled) & (filled > 1)).alias("unique_identifier"), ((F.col("kind") == "text") & (F.col("distinct_values") <= 5)).alias("few_categories"), (F.col("missing") > 0.1 * F.col("n")).alias("many_missing"))


def at_ranks(df: DataFrame, value: Column, by: list[str] | None = None, **ranks) -> DataFrame:
    """n and, for each name, the value whose rank from 0 is floor(function(n)); for each group of `by` columns if there are any.

    Equal values are counted first, map-side; the counts are laid out in ranges of (group, value) and written once. Running totals go
    over one range each and every range's total is carried to the next, so neither a column nor a hot group is ever in one task.
    """
    groups = [F.col(f"`{b}`") for b in by or []]
    names = [f"g{i}" for i in range(len(groups))]
    counts = df.select(*[g.alias(n) for g, n in zip(groups, names)], value.cast("double").alias("v")).where("v is not null").groupBy(*names, "v").agg(F.count("*").alias("c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = counts.repartitionByRange(parts, *names, "v").withColumn("p", F.spark_partition_id())
    laid = staging.stage_table(laid, "ranks")
    inside = Window.partitionBy(*names, "p").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = laid.groupBy(*names, "p").agg(F.sum("c").alias("s"))  # a row for each range, and for each group in it
    earlier = Window.partitionBy(*names).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_{k}") for k in [*names, "p"]], F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("o"), F.sum("s").over(Window.partitionBy(*names)).alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*names, "p"]]
    ranked = laid.withColumn("upto", F.sum("c").over(inside)).join(offsets, same).withColumn("upto", F.col("upto") + F.col("o"))
    at = lambda f: F.min(F.when(F.col("upto") > F.floor(f(F.col("n"))), F.col("v")))
    found = ranked.groupBy(*names) if names else ranked
    out = found.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[at(f).alias(name) for name, f in ranks.items()])
    return out.select(*[F.col(n).alias(b) for n, b in zip(names, by or [])], "n", *ranks)


def quartiles(df: DataFrame, value: Column) -> DataFrame:
    """n, q1, q3 and iqr by position: the values ranked n div 4 and 3n div 4 from 0."""
    return at_ranks(df, value, q1=lambda n: n / 4, q3=lambda n: 3 * n / 4).withColumn("iqr", F.col("q3") - F.col("q1"))


def median(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """n and the mean of the two middle values, for each group of `by`."""
    middle = at_ranks(df, value, by, low=lambda n: (n - 1) / 2, high=lambda n: n / 2)
    return middle.select(*[F.col(f"`{b}`") for b in by or []], "n", ((F.col("low") + F.col("high")) / 2).alias("median"))


def percentiles(df: DataFrame, value: Column, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """n and exact percentiles, interpolated between the two nearest ranks, for each group of `by`."""
    ranks = {}
    for name, share in shares.items():
        ranks |= {f"{name}_low": lambda n, s=share: s * (n - 1), f"{name}_high": lambda n, s=share: F.ceil(s * (n - 1))}
    found = at_ranks(df, value, by, **ranks)
    between = lambda name, s: F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (s * (F.col("n") - 1) - F.floor(s * (F.col("n") - 1)))
    return found.select(*[F.col(f"`{b}`") for b in by or []], "n", *[between(name, share).alias(name) for name, share in shares.items()])


def slope_trend(df: DataFrame, value: str, index: str) -> DataFrame:
    """Least-squares slope over the row index, relative to |mean|; beyond 0.1 it is a trend, from 5 values on."""
    out = df.agg(F.count(value).alias("n"), F.regr_slope(value, index).alias("slope"), F.avg(value).alias("mean"))
    relative = F.try_divide(F.col("slope"), F.abs("mean"))
    return out.withColumn("relative_slope", relative).withColumn("trend", F.when(F.col("n") < 5, None).when(relative > 0.1, "increasing").when(relative < -0.1, "decreasing").otherwise("stable"))


def sample_rows(df: DataFrame, index: str, rows: int, n: int = 100, seed: int = 1) -> DataFrame:
    """All rows up to 1000; else the first, the last and n - 2 others by a seeded hash of the index."""
    if rows <= 1000:
        return df
    ends = df.where(F.col(index).isin(0, rows - 1))
    rest = df.where(~F.col(index).isin(0, rows - 1)).orderBy(F.xxhash64(index, F.lit(seed)), index).limit(n - 2)
    return ends.unionByName(rest)
