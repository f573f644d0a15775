"""A stored inverted index: postings in blocks with their best possible part of a score, and top-k that skips blocks.

Documents are laid out by length and cut into blocks of BLOCK; a term's postings in a block are one row (term, block, ids, counts,
lengths, best), sorted by term, so a query reads the row groups of its terms and nothing else. `best` is the largest part of a BM25 score that
the term can give in the block, without its idf.

A search adds up the terms' `best` for each block (a read of three thin columns), scores the most promising blocks, takes the k-th
score found as the bar, and then reads only blocks whose sum can reach it. The result is that of scoring every document.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from . import staging

BLOCK, PROMISING, ROW_GROUP = 128, 8, 1 << 20


def _part(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _tokens(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """id, length, terms and counts: each text's different words, counted where the text is read, so no single word is shuffled."""
    read = docs.select(F.col(id_column).alias("id"), F.encode(F.lower(F.coalesce(F.col(text), F.lit(""))), "UTF-8").alias("text"))

    def counted(batches):
        for batch in batches:
            lengths, terms, counts = [], [], []
            for value in batch.column(1):
                words = value.as_py().split()  # of bytes: at ASCII white space alone
                n = Counter(words)
                lengths.append(len(words))
                terms.append([w.decode("utf-8", "replace") for w in n])
                counts.append(list(n.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "length", "terms", "counts"])

    return read.mapInArrow(counted, StructType([read.schema["id"], *StructType.fromDDL("length int, terms array<string>, counts array<bigint>")]))


def _blocks(laid: DataFrame, mean: float, k1: float, b: float) -> DataFrame:
    """The postings of documents that lie sorted in partitions: a row for each term of a block, and one without a term for the block.

    A block is cut within a partition, so it is whole where it is made; the last one of a partition may be shorter.
    """

    def one(docs: pa.Table, block: int) -> pa.RecordBatch:
        ids, length = docs["id"].combine_chunks(), docs["length"].to_numpy()
        terms = pc.list_flatten(docs["terms"]).combine_chunks().dictionary_encode()
        tf = pc.list_flatten(docs["counts"]).to_numpy()
        doc = np.repeat(np.arange(docs.num_rows), pc.list_value_length(docs["terms"]).to_numpy())
        code = terms.indices.to_numpy()
        order = np.argsort(code, kind="stable")  # each term's documents stay in order
        starts = np.searchsorted(code[order], np.arange(len(terms.dictionary)))
        doc, tf = doc[order], tf[order]
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))
        best = np.maximum.reduceat(part, starts) if len(starts) else np.zeros(0)
        offsets = pa.array(np.r_[starts, len(doc), len(doc) + docs.num_rows].astype(np.int32))
        rows = np.r_[doc, np.arange(docs.num_rows)]
        lists = [ids.take(pa.array(rows)), pa.array(np.r_[tf, np.zeros(docs.num_rows, np.int64)]), pa.array(length[rows].astype(np.int32))]
        names = pa.concat_arrays([terms.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
        columns = [names, pa.array(np.full(len(names), block)), *[pa.ListArray.from_arrays(offsets, x) for x in lists], pa.array(np.r_[best, 0.0])]
        return pa.RecordBatch.from_arrays(columns, names=["term", "block", "ids", "counts", "lengths", "best"])

    def cut(batches):
        block, rest = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if rest is None else pa.concat_tables([rest, now])
            whole = now.num_rows - now.num_rows % BLOCK
            for at in range(0, whole, BLOCK):
                yield one(now.slice(at, BLOCK), block)
                block += 1
            rest = now.slice(whole)
        if rest is not None and rest.num_rows:
            yield one(rest, block)

    kind = laid.schema["id"].dataType.simpleString()
    return laid.mapInArrow(cut, f"term string, block bigint, ids array<{kind}>, counts array<bigint>, lengths array<int>, best double")


@dataclass
class PostingIndex:
    spark: SparkSession
    path: str
    k1: float = 1.5
    b: float = 0.75

    @classmethod
    def build(cls, docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75) -> PostingIndex:
        """Write the index of lower-case white-space words. Null texts are empty; ids are kept as they are."""
        spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tokens = staging.stage_table(_tokens(docs, id_column, text), "tokens")
        tokens.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("mean")).write.parquet(f"{path}/statistics")
        mean = spark.read.parquet(f"{path}/statistics").first().mean or 1.0
        laid = tokens.repartitionByRange(parts, "length", "id").sortWithinPartitions("length", "id")
        blocks = staging.stage_table(_blocks(laid, mean, k1, b), "blocks")
        whole = blocks.where("term is null").select(F.explode(F.arrays_zip("ids", "lengths")).alias("p"), "block")
        whole.select(F.col("p.ids").alias("id"), F.col("p.lengths").alias("length"), "block").write.parquet(f"{path}/documents")
        ranged = blocks.where("term is not null").repartitionByRange(parts, "term", "block").sortWithinPartitions("term", "block")
        ranged.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.row.count.limit", 2000).parquet(f"{path}/postings")
        index = cls(spark, path, k1, b)
        terms = index.postings().groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
        terms.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "term").sortWithinPartitions("term").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/terms")
        return index

    @classmethod
    def stored(cls, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> PostingIndex:
        """The index of a table in files: built once in the shared folder, found again as long as no file of the table changes."""
        spark = docs.sparkSession
        files = sorted(docs.inputFiles())
        state = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime").orderBy("path").collect()  # no content
        mark = hashlib.sha256(repr([tuple(r) for r in state] + [id_column, text, BLOCK]).encode()).hexdigest()[:24]
        path = f"{staging.shared_dir(spark)}/postings-{mark}"
        try:
            spark.read.parquet(f"{path}/terms").limit(1).collect()  # written last
            return cls(spark, path)
        except AnalysisException:
            return cls.build(docs, path, id_column, text)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def weights(self, terms: list[str], epsilon: float = 0.25) -> dict[str, float]:
        """Each term's idf; what is below zero becomes epsilon times the mean."""
        n = self.spark.read.parquet(f"{self.path}/statistics").first().n
        known = {r.term: r.df for r in self.spark.read.parquet(f"{self.path}/terms").where(F.col("term").isin(terms)).collect()}
        idf = {t: math.log(n - known.get(t, 0) + 0.5) - math.log(known.get(t, 0) + 0.5) for t in terms}
        mean = sum(idf.values()) / len(idf)
        return {t: v if v >= 0 else epsilon * mean for t, v in idf.items()}

    def _scores(self, weights: dict[str, float], blocks: Column) -> DataFrame:
        """id, score of the documents of some blocks that hold a term."""
        mean = self.spark.read.parquet(f"{self.path}/statistics").first().mean or 1.0
        weight = F.create_map(*[F.lit(v) for t, w in weights.items() for v in (t, w)])
        read = self.postings().where(F.col("term").isin(list(weights)) & blocks)
        each = read.select("term", F.explode(F.arrays_zip("ids", "counts", "lengths")).alias("p"))
        part = weight[F.col("term")] * _part(F.col("p.counts"), F.col("p.lengths"), mean, self.k1, self.b)
        return each.select(F.col("p.ids").alias("id"), part.alias("part"), "term").groupBy("id").agg(F.sum("part").alias("score"))

    def bounds(self, weights: dict[str, float]) -> DataFrame:
        """block, bound: no document of the block has a higher score."""
        weight = F.create_map(*[F.lit(v) for t, w in weights.items() for v in (t, max(w, 0.0))])
        thin = self.postings().where(F.col("term").isin(list(weights))).select("term", "block", "best")
        return thin.groupBy("block").agg(F.sum(weight[F.col("term")] * F.col("best")).alias("bound"))

    def search(self, terms: list[str], k: int, id_column: str = "doc_id") -> DataFrame:
        """The k documents with the best BM25 scores (6 decimals), ties to the smaller id; documents without a term score 0."""
        weights = self.weights(sorted({t.lower() for t in terms}))
        bound = self.bounds(weights)
        first = [r.block for r in bound.orderBy(F.desc("bound"), "block").limit(PROMISING).collect()]
        top = [r.score for r in self._scores(weights, F.col("block").isin(first)).orderBy(F.desc("score")).limit(k).collect()]
        bar = top[-1] - 1e-6 if len(top) == k else None
        reach = bound if bar is None else bound.where((F.col("bound") >= bar) & ~F.col("block").isin(first))
        rest = [r.block for r in reach.select("block").limit(10_000).collect()]  # few enough for a pushed list, else a join
        read = [*first, *rest]
        if bar is not None and len(rest) < 10_000:
            found = self._scores(weights, F.col("block").isin(read))
        else:
            found = self._scores(weights, F.lit(True))
        found = found.withColumn("score", F.round("score", 6))
        if bar is None or bar <= 0 or min(weights.values()) < 0:  # documents without any term may be among the first
            held = self.postings().where(F.col("term").isin(list(weights))).select(F.explode("ids").alias("id"))
            others = self.spark.read.parquet(f"{self.path}/documents").select("id").join(held, "id", "left_anti")
            found = found.unionByName(others.select("id", F.lit(0.0).alias("score")))
        return found.orderBy(F.desc("score"), "id").limit(k).select(F.col("id").alias(id_column), "score")
