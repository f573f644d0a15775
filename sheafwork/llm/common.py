"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space (space, \t, \n, \v, \f, \r).
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster session is refused, because
    its executors could not see such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and return it read back: lineage ends here, and a lost
    executor costs only a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *inputs: str) -> DataFrame:
    """All columns as one struct `row`, whatever their names, next to the named inputs of a Python stage."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`") for c in inputs])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold_of(doc_id, folds: int):
    """crc32(doc_id as text) mod folds; null ids count as fold of the empty text (0)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds


#: Bytes of text that a sample may hold for each class, and how many of its texts' sizes fit in.
SAMPLE_BYTES, SAMPLE_SHARE = 1 << 26, 16


def bounded_sample(df: DataFrame, of: str, cap: int, octets: int = SAMPLE_BYTES) -> DataFrame:
    """`of` and text: for each value of `of` at most `cap` different (doc_id, text) and at most `octets` bytes, chosen by a hash.

    Equal rows are one before anything else, texts over octets / SAMPLE_SHARE aren't learnt from, and Spark drops
    what can't be among the first `cap` of its class before the shuffle, so no repeated id, text or class gathers.
    Null texts count as empty.
    """
    rows = df.select(of, "doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= octets // SAMPLE_SHARE)
    each = rows.groupBy(of, F.xxhash64("doc_id", "text", F.lit(31)).alias("_hash")).agg(F.min("text").alias("text"))
    first = Window.partitionBy(of).orderBy("_hash")
    top = each.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= cap)
    size = F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return top.withColumn("_size", size).where(F.col("_size") <= octets).select(of, "text")


def ranked(df: DataFrame, order: list, label: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Global ranks without a single-task window.

    Rows are range-partitioned and sorted by `order` (ties: input order), written once to the shared
    folder, and numbered inside their partition; a table with one row for each partition (its size is the
    number of shuffle partitions, whatever the data) carries the partitions' offsets.
    Adds `rank` (gapless from 0) and, for each name in `sums`, nothing but `total_<name>`: its total.
    Also adds `total_rows`.
    """
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    marked = df.withColumn("_tie", F.monotonically_increasing_id())
    laid = marked.repartitionByRange(shuffle_parts(df.sparkSession), *sort, "_tie").sortWithinPartitions(*sort, "_tie")
    laid = stage_table(laid.drop("_tie").withColumn("_mid", F.monotonically_increasing_id()), label)
    part = F.shiftrightunsigned("_mid", 33)
    counts = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("total_rows"),
        *[F.sum(f"_s_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    out = laid.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn("rank", F.col("_offset") + F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_part", "_offset", "_mid")
