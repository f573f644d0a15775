"""Stored vector lists: coarse centroids, product-quantised residuals, and exact reranking.

Vectors of length one are dealt to the list of their nearest centroid; what the centroid leaves over is cut into parts of PART dimensions
and each part becomes the number of its nearest codeword, one byte. A list is a folder, so a search prunes to the lists it
probes; it scores codes alone by adding table entries, keeps `refine` of them, reads only those vectors, and ranks by exact cosine.

Centroids and codewords are fitted on a bounded sample (SAMPLE rows, SAMPLE_BYTES); all vectors are stored. The number of lists to
probe is measured when the index is built: AUDIT sampled vectors, exactly compared with the sample, must find RECALL of their nearest within them. Vectors that are
null, zero or hold null or non-finite parts or have another length than the first are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine_to

LISTS, LIST, PART, CODEWORDS = 256, 1024, 4, 256
SAMPLE, SAMPLE_BYTES, AUDIT, RECALL, REFINE = 16_384, 1 << 26, 128, 0.98, 20


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(5).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds if k > 1 else 1):
        home = _nearest(x, centres)
        sizes = np.bincount(home, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


@dataclass
class Model:
    """Centroids (lists x dimensions) and codewords (parts x words x PART); dimensions are padded with zeros to whole parts."""

    size: int
    centroids: np.ndarray
    words: np.ndarray
    probes: int

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.centroids.shape[1] - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.padded(x)
        home = _nearest(x, self.centroids)
        rest = (x - self.centroids[home]).reshape(len(x), -1, PART)
        return home, np.stack([_nearest(rest[:, m], self.words[m]) for m in range(rest.shape[1])], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of a query with all centroids and, by part, with all codewords."""
        q = self.padded(q[None])[0]
        return self.centroids @ q, np.einsum("mwd,md->mw", self.words, q.reshape(-1, PART))


def _fit(x: np.ndarray, total: int) -> Model:
    size = x.shape[1]
    x = np.pad(x, ((0, 0), (0, -size % PART)))
    centroids = _kmeans(x, min(LISTS, math.ceil(total / LIST)))
    rest = (x - centroids[_nearest(x, centroids)]).reshape(len(x), -1, PART)
    words = np.stack([np.resize(w := _kmeans(rest[:, m], CODEWORDS, 6), (CODEWORDS, PART)) if len(x) else np.zeros((CODEWORDS, PART)) for m in range(rest.shape[1])])
    model = Model(size, centroids, words, 1)
    asked = x[:: max(1, len(x) // AUDIT)][:AUDIT]
    near = np.argsort(-(asked @ x.T), axis=1)[:, 1:11]
    order = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    places = np.take_along_axis(order, _nearest(x, centroids)[near], 1).ravel() + 1
    model.probes = int(np.quantile(places, RECALL, method="higher")) if places.size else len(centroids)
    return model


@dataclass
class VectorLists:
    spark: SparkSession
    path: str
    model: Model
    id_column: str
    embedding: str

    @classmethod
    def build(cls, df: DataFrame, path: str, id_column: str = "vec_id", embedding: str = "embedding") -> VectorLists:
        """Write the lists with all columns of df, so that a search can filter by any of them."""
        spark, vector = df.sparkSession, F.col(f"`{embedding}`").cast("array<double>")
        fine = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))) & F.exists(vector, lambda v: v != 0)
        usable = df.where(F.col(f"`{embedding}`").isNotNull() & fine)
        total, size = usable.agg(F.count("*"), F.coalesce(F.first(F.size(embedding)), F.lit(1))).first()
        usable = usable.where(F.size(embedding) == size)
        cap = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
        rows = usable.select(vector.alias("v"), F.col(f"`{id_column}`").alias("id")).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(cap).toArrow()
        model = _fit(_unit(rows.column("v"), size), total)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                home, codes = model.encode(_unit(batch.column(1), size))
                columns = [batch.column(0), pa.array(home, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "_list", "_code"])

        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        coded = usable.select(row.alias("row"), vector.alias("v")).mapInArrow(code, f"row {df.select(row.alias('r')).schema['r'].dataType.simpleString()}, _list int, _code binary")
        # hot lists are dealt to several tasks by id; a list's files are what a probe reads
        coded.select("row.*", "_list", "_code").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_list", F.pmod(F.xxhash64(f"row.{id_column}"), F.lit(4))).write.partitionBy("_list").parquet(f"{path}/lists")
        return cls(spark, path, model, id_column, embedding)

    def lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def search(self, query: list[float], k: int, where: Column | None = None, probes: int | None = None, refine: int = REFINE) -> DataFrame:
        """The k nearest found by cosine (6 decimals), ties by id, after an optional filter on other columns."""
        q = np.asarray(query, np.float64)
        by_list, by_word = self.model.tables(q / np.linalg.norm(q))
        probed = np.argsort(-by_list, kind="stable")[: probes or self.model.probes].tolist()
        rows = self.lists().where(F.col("_list").isin(probed))
        rows = rows if where is None else rows.where(where)
        keep = k * refine

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, scores = np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                own = by_list[np.asarray(batch.column(1))] + by_word[np.arange(codes.shape[1]), codes].sum(1)
                ids, scores = np.concatenate([ids, np.asarray(batch.column(0))]), np.concatenate([scores, own])
                if len(ids) > keep:
                    best = np.argpartition(-scores, keep - 1)[:keep]
                    ids, scores = ids[best], scores[best]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(scores)], ["id", "near"])

        coded = rows.select(F.col(self.id_column).cast("long").alias("id"), "_list", "_code").mapInArrow(score, "id long, near double")
        kept = [r.id for r in coded.orderBy(F.desc("near"), "id").limit(keep).collect()]  # k x refine ids
        exact = rows.where(F.col(self.id_column).isin(kept)).withColumn("score", F.round(cosine_to(F.col(self.embedding), query), 6))
        return exact.orderBy(F.desc("score"), self.id_column).limit(k).drop("_list", "_code", self.embedding)


def _unit(column, size: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(lists.flatten(), np.float64).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def search_collections(collections: dict[str, tuple[VectorLists, int]], query: list[float]) -> DataFrame:
    """collection, id, score: each collection's own number of nearest rows, best first."""
    parts = [index.search(query, k).select(F.lit(name).alias("collection"), F.col(index.id_column).cast("long").alias("id"), "score") for name, (index, k) in collections.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).orderBy(F.desc("score"), "collection", "id")
