"""Sharding by Hilbert-curve order [DataFrame functions only].

Several metadata dimensions are quantised to `bits` bits each; a row's place on the Hilbert curve through
that grid is its sort key, so that rows close in *all* dimensions lie close in the order. The order is cut
into shards of equal counts, and a manifest of each shard's ranges lets a reader skip shards.

Nulls quantise to 0 and an empty or null text has size 1. Rows alike in every column are told apart by their
place in the input. An empty table gives an empty result. Other columns of the input are not needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, table


def by_hash(value: Column, bits: int) -> Column:
    """A category's cell: equal values share one, others are spread evenly."""
    return (F.coalesce(F.crc32(value.cast("string").cast("binary")), F.lit(0)) % (1 << bits)).cast("int")


def by_magnitude(value: Column, bits: int) -> Column:
    """A size's cell: its number of binary digits (0 for null or less than 1), at most 2^bits - 1."""
    digits = F.length(F.bin(F.greatest(value.cast("long"), F.lit(0))))
    return F.when(value >= 1, F.least(digits, F.lit((1 << bits) - 1))).otherwise(0).cast("int")


def by_range(value: Column, low: float, high: float, bits: int) -> Column:
    """A number's cell among 2^bits of equal width between low and high; beyond them the outer ones."""
    cells = 1 << bits
    cell = F.floor((value.cast("double") - low) / (high - low) * cells)
    return F.coalesce(F.least(F.greatest(cell, F.lit(0)), F.lit(cells - 1)), F.lit(0)).cast("int")


def with_hilbert_index(df: DataFrame, dims: list[str], bits: int, to: str = "hilbert") -> DataFrame:
    """Add the Hilbert index (bits * len(dims) bits, at most 62) of integer columns `dims` in [0, 2^bits).

    The bitwise transpose of the coordinates is undone one bit plane at a time, from the highest; each step
    is a projection over the last one's columns, so expressions stay small.
    """
    n = len(dims)
    if n < 2 or bits * n > 62:
        raise ValueError("between 2 dimensions and 62 bits in all")
    axes = [f"_x{i}" for i in range(n)]
    keep = df.columns
    out = df.select(*keep, *[F.col(f"`{c}`").cast("long").alias(x) for c, x in zip(dims, axes)])

    def step(**new: Column) -> None:
        nonlocal out
        out = out.select(*keep, *[new.get(x, F.col(x)).alias(x) for x in axes])

    for plane in range(bits - 1, 0, -1):
        low = (1 << plane) - 1
        for i, x in enumerate(axes):
            is_set = F.col(x).bitwiseAND(1 << plane) != 0
            flip = F.col("_x0").bitwiseXOR(F.lit(low))
            if i == 0:
                step(_x0=F.when(is_set, flip).otherwise(F.col("_x0")))
                continue
            swap = F.col("_x0").bitwiseXOR(F.col(x)).bitwiseAND(low)
            step(**{"_x0": F.when(is_set, flip).otherwise(F.col("_x0").bitwiseXOR(swap)), x: F.when(is_set, F.col(x)).otherwise(F.col(x).bitwiseXOR(swap))})
    for before, x in zip(axes, axes[1:]):
        step(**{x: F.col(x).bitwiseXOR(F.col(before))})
    turn = F.lit(0).cast("long")
    for plane in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(axes[-1]).bitwiseAND(1 << plane) != 0, (1 << plane) - 1).otherwise(0).cast("long"))
    step(**{x: F.col(x).bitwiseXOR(turn) for x in axes})
    index = F.lit(0).cast("long")
    for plane in range(bits - 1, -1, -1):
        for i, x in enumerate(axes):
            bit = F.shiftright(x, plane).bitwiseAND(1)
            index = index.bitwiseOR(F.shiftleft(bit, plane * n + n - 1 - i))
    return out.select(*keep, index.alias(to))


def hilbert_shards(df: DataFrame, dims: list[str], bits: int, shards: int, ties: list[str]) -> DataFrame:
    """Columns of df plus hilbert, shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Law `rows`: the counts of any two shards differ by one at most. Rows of one cell, however many, may lie
    in several shards and several tasks; equal `ties` stay neighbours.
    """
    placed = ranked(with_hilbert_index(df, dims, bits), ["hilbert", *ties], "hilbert")
    size, more = F.floor(F.col("total_rows") / shards), F.col("total_rows") % shards
    wide = more * (size + 1)  # rows in the shards that have one row more
    rank = F.col("rank")
    shard = F.when(rank < wide, F.floor(rank / (size + 1))).otherwise(more + F.floor((rank - wide) / F.greatest(size, F.lit(1))))
    out = placed.withColumn("shard", shard.cast("int"))
    start = F.col("shard") * size + F.least(F.col("shard").cast("long"), more)
    return out.withColumn("slot", F.col("rank") - start).drop("rank", "total_rows")


def shard_manifest(placed: DataFrame, dims: list[str]) -> DataFrame:
    """One row for each shard: its rows, its stretch of the curve and each dimension's range."""
    ranges = [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))]
    return placed.groupBy("shard").agg(F.count("*").alias("rows"), F.min("hilbert").alias("min_hilbert"), F.max("hilbert").alias("max_hilbert"), *ranges)


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; its files hold consecutive stretches of the curve."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


SHARDS, BITS = 16, 5


def document_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """documents ordered by language, source and size."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(body) + 1).cast("long")
    thin = docs.select("doc_id", size.alias("size"), F.crc32(body).alias("text_crc32"), by_hash(F.col("lang"), BITS).alias("d_lang"), by_hash(F.col("source"), BITS).alias("d_source"), by_magnitude(size, BITS).alias("d_size"))
    return hilbert_shards(thin, ["d_lang", "d_source", "d_size"], BITS, shards, ["text_crc32", "doc_id"])


def op3_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = document_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert", "d_lang", "d_source", "d_size")
