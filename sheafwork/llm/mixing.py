"""Temperature mixing of sources.

A source with token share p gets weight p^a / sum(p^a). The exponent a in [0, 1] is bisected: the largest that
reaches a target entropy (a share of that of equal weights), but no smaller than a limit on how often any source
is repeated allows. Weights times the token budget give each source its own budget, which it spends in whole
passes over a fresh permutation of its documents and one last pass cut at the budget; copies are then laid out in
blocks that each hold the sources in their proportions.

No source passes through one task: permutations are range-partitioned over (source, pass, key) and summed by
partition. Only figures over sources, never over documents, reach the driver. Null sources count as ''. Documents
without a token (null or empty texts) have weight 0 and follow the documents before them; repeated rows with
equal keys stay neighbours. An empty table gives an empty result. Very long texts are encoded whole and count as one
document; extra columns are ignored by the schedule and pass through the pipeline stage.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stage_table, table
from .tokens import token_counts

#: Target entropy as a share of that of equal weights, most passes over a source, fewest blocks and most tokens of a block on average.
EVENNESS, REPEATS, BLOCKS, BLOCK_TOKENS, SEED = 0.999, 4.0, 64, 1 << 26, 5


def find_exponent(shares: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS, budget: float = 1.0) -> float:
    """Over rows with `share`: the exponent as described above. `budget` is in multiples of all tokens.

    Each step takes entropy and largest repetition at 31 inner points of the interval in one aggregation, so
    four steps halve the interval twenty times, however many sources there are.
    """
    known = shares.where(F.col("share") > 0)
    n = known.count()
    if n < 2:
        return 1.0
    target = evenness * math.log(n)

    def figures(points: list[float]) -> list[tuple[float, float]]:
        p = F.col("share")
        row = known.agg(*[f for i, a in enumerate(points) for f in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"m{i}"))]).first()
        return [(math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"], budget * row[f"m{i}"] / row[f"z{i}"]) for i, a in enumerate(points)]

    def largest_even(low: float, high: float) -> float:
        for _ in range(4):
            points = [low + (high - low) * i / 32 for i in range(33)]
            ok = [h >= target for h, _ in figures(points)]
            at = max((i for i, x in enumerate(ok) if x), default=0)
            low, high = points[at], points[min(at + 1, 32)]
        return low

    def least_repeated(low: float, high: float) -> float:
        for _ in range(4):
            points = [low + (high - low) * i / 32 for i in range(33)]
            ok = [r <= repeats for _, r in figures(points)]
            at = next((i for i, x in enumerate(ok) if x), 32)
            low, high = points[max(at - 1, 0)], points[at]
        return high

    return max(largest_even(0.0, 1.0), least_repeated(0.0, 1.0))


def source_budgets(sized: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS, budget: float = 1.0) -> DataFrame:
    """From (source, n_tokens): for each source its tokens, share, weight, budget, whole passes and the tokens
    of the last, partial pass."""
    sums = stage_table(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mixing-sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    exponent = find_exponent(shares, evenness, repeats, budget)
    z = shares.where(F.col("share") > 0).agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0] or 1.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)) / F.lit(float(z))).otherwise(0.0)
    out = shares.withColumn("exponent", F.lit(exponent)).withColumn("weight", weight).withColumn("budget", F.floor(F.col("weight") * F.lit(float(total * budget)) + 1e-6))
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.greatest(F.col("tokens"), F.lit(1)))).otherwise(0)
    return out.withColumn("passes", passes).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("passes") * F.col("tokens")).otherwise(0))


def schedule(sized: DataFrame, budgets: DataFrame, blocks: int | None = None, seed: int = SEED) -> DataFrame:
    """From (doc_id, source, n_tokens, key): one row for each copy with its pass, the tokens before it in its
    source's schedule, its place in [0, 1) and its block. A document starts in the last pass if the rest of the
    budget isn't used up before it. Without a number of blocks there are BLOCKS, or as many as make BLOCK_TOKENS each."""
    if blocks is None:
        blocks = max(BLOCKS, math.ceil((budgets.agg(F.sum("budget")).first()[0] or 0) / BLOCK_TOKENS))
    each = sized.join(budgets.select("source", "tokens", "budget", "passes", "rest"), "source")
    copies = each.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)))).where(F.col("budget") > 0)
    copies = copies.withColumn("place_key", F.xxhash64("key", "pass", F.lit(seed)))
    order = ["source", "pass", "place_key", "doc_id"]
    laid = copies.repartitionByRange(shuffle_parts(sized.sparkSession), *order).sortWithinPartitions(*order)
    names = ["doc_id", "source", "n_tokens", "tokens", "budget", "passes", "rest", "pass", "place_key", "key"]

    def summed(batches):
        part, last, run = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            of, number, n = (np.asarray(batch.column(names.index(x))) for x in ("source", "pass", "n_tokens"))
            new = np.concatenate([[(of[0], number[0]) != last], (of[1:] != of[:-1]) | (number[1:] != number[:-1])])
            total, first = np.cumsum(n) - n, np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            before = np.where(first < 0, total + run, total - total[first])
            last, run = (of[-1], number[-1]), int(before[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part), pa.int64()), pa.array(before, pa.int64())], names=[*names, "_part", "_before"])

    plain = laid.select(*names)
    schema = ", ".join(f"{c} {t}" for c, t in plain.dtypes) + ", _part long, _before long"
    staged = stage_table(plain.mapInArrow(summed, schema), "mixing")
    sums = staged.groupBy("source", "pass", "_part").agg(F.sum("n_tokens").alias("_sum"))  # a row for each partition and each source and pass that it holds
    earlier = Window.partitionBy("source", "pass").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "pass", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    before = F.col("_before") + F.col("_offset")
    out = staged.join(offsets, ["source", "pass", "_part"]).withColumn("_before", before)
    out = out.where((F.col("pass") < F.col("passes")) | (F.col("_before") < F.col("rest")))
    out = out.withColumn("source_start", F.col("pass") * F.col("tokens") + F.col("_before"))
    place = F.col("source_start") / F.col("budget")
    return out.select("doc_id", "source", "n_tokens", "key", "pass", "place_key", "source_start", place.alias("place"), F.least(F.floor(place * blocks), F.lit(blocks - 1)).cast("int").alias("block"))


def row_key(text: Column) -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce(text, F.lit("")))


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source ('' for null), n_tokens and key of every whole text, written once."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source"), F.lit("")).alias("source"), row_key(F.col("text")).alias("key"))

    def counted(batches):
        from .tokens import encoder

        own = encoder()
        for batch in batches:
            n = pa.array([len(own.ids(x.as_py())) // 4 for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), n], names=["doc_id", "source", "key", "n_tokens"])

    return stage_table(plain.mapInArrow(counted, "doc_id long, source string, key long, n_tokens long"), "mixing-sizes")


def mix(docs: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS, budget: float = 1.0) -> DataFrame:
    sized = sized_documents(docs)
    return schedule(sized, source_budgets(sized, evenness, repeats, budget))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of `documents` in their sources' schedules; nulls, ties, repeated rows and empty tables as above."""
    return mix(table(spark, sf_dir, "documents")).drop("key", "place_key")


def mixed_documents(docs: DataFrame, evenness: float = EVENNESS, repeats: float = REPEATS) -> DataFrame:
    """Pipeline stage: the documents themselves, each as often as the mixture takes it (maybe never).

    The schedule's last pass is a prefix of its permutation, so one bound on the key for each source tells which
    documents are in it: texts need no shuffle. Documents with equal keys stay together.
    """
    sized = sized_documents(docs)
    budgets = source_budgets(sized, evenness, repeats)
    taken = schedule(sized, budgets)
    last = taken.join(budgets.select("source", "passes"), "source").where(F.col("pass") == F.col("passes")).groupBy("source").agg(F.max("place_key").alias("bound"))
    rule = stage_table(budgets.select("source", "budget", "passes", "rest").join(last, "source", "left"), "mixing-rule").withColumnRenamed("source", "_source")
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col("source"), F.lit("")).alias("_source"), row_key(F.col("text")).alias("_key"))
    joined = row.join(rule, "_source")
    extra = (F.col("rest") > 0) & F.col("bound").isNotNull() & (F.xxhash64("_key", "passes", F.lit(SEED)) <= F.col("bound"))
    copies = F.when(F.col("budget") > 0, F.col("passes") + extra.cast("long")).otherwise(0)
    return joined.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select("row.*")
