"""Nearest neighbours by inner product with randomly rotated one-bit codes.

1. Candidates are the usable rows, equal rows once, and of equal vectors the NEAREST + 1 rows with the smallest ids: no other copy
   can be among a query's nearest. A window with a limit finds them, so a vector that a third of all rows share is cut before it is shuffled.
2. A bounded sample gives centroids (k-means) and, for each query, a score that its NEAREST nearest reach at least. The difference of
   each vector to its centroid is rotated at random and kept as one sign a dimension, packed into 64-bit words, with two scalars: its length, and the inner product of the
   unit difference with its own code. Rows of a cell are dealt by hash into blocks of about BLOCK rows.
3. A query is rotated and cut into PLANES bits a dimension; counting common bits plane by plane estimates its inner product with every vector of
   a block, unbiased after division by the second scalar. The error's standard deviation is known from that scalar, so each estimate has an upper and a
   lower bound of EPSILON deviations. Vectors whose upper bound reaches the query's threshold (the sample's, the NEAREST-th lower bound in the
   block, or the NEAREST-th score so far) are reranked: their inner product is computed from the original vectors in double precision.
4. AUDIT queries are held against brute force over all candidates. That tells how many cells, best first, a query must look into for the
   target recall; after the search the audited queries' recall is measured and logged, and as long as it is below the target the search is made again
   with twice the cells and wider bounds, at last with all cells.

Every vector is indexed, every query is searched; only queries and blocks that meet are shuffled, in blocks of both. Vectors that are null, empty, zero or hold null or
non-finite parts and rows without an id take no part. Vectors of different lengths never meet. A query doesn't find rows of its own id; equal rows are one
row; rows that share an id but not a vector are queries and candidates of their own. Ties go to the smaller id. An empty table gives an empty
result, extra columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stage_table, table

log = logging.getLogger(__name__)

NEAREST, BLOCK, CELL, CELLS, PILE, SEGMENTS = 20, 1024, 4096, 1024, 512, 8
SAMPLE, SAMPLE_BYTES, AUDIT, RECALL, EPSILON, PLANES = 16_384, 1 << 26, 128, 0.97, 3.0, 6


class Cells:
    """Centroids of the vectors of one length and what their cells' rows are like."""

    def __init__(self, x: np.ndarray, count: int):
        rng = np.random.default_rng(11)
        self.centroids = x[rng.choice(len(x), min(count, len(x)), replace=False)] if len(x) else np.zeros((1, x.shape[1]))
        for _ in range(8 if len(self.centroids) > 1 else 1):
            home = self.home(x) if len(x) else np.zeros(0, np.int64)
            sizes = np.bincount(home, minlength=len(self.centroids))
            sums = np.zeros_like(self.centroids)
            np.add.at(sums, home, x)
            self.centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], self.centroids)
        home = self.home(x)
        square = ((x - self.centroids[home]) ** 2).sum(1)
        total = np.bincount(home, weights=square, minlength=len(self.centroids))
        self.spread = np.sqrt(total / np.maximum(np.bincount(home, minlength=len(self.centroids)), 1))

    def home(self, x: np.ndarray) -> np.ndarray:
        return np.argmin((self.centroids**2).sum(1) - 2 * x @ self.centroids.T, axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """For each query its cells, those first where a large inner product is likeliest."""
        reach = np.linalg.norm(q, axis=1)[:, None] * self.spread * 2 / math.sqrt(q.shape[1])
        return np.argsort(-(q @ self.centroids.T + reach), axis=1, kind="stable")


_rotations: dict[int, np.ndarray] = {}


def rotate(x: np.ndarray) -> np.ndarray:
    """x in a random orthogonal basis, with zeros up to a whole number of 64-bit words."""
    size = -(-x.shape[1] // 64) * 64
    if size not in _rotations:
        _rotations[size] = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]
    return x @ _rotations[size][: x.shape[1]]


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def encode(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (words of 64 signs), lengths and the inner products of unit residuals with their codes."""
    turned = rotate(residual)
    length = np.linalg.norm(turned, axis=1)
    own = np.abs(turned).sum(1) / (np.sqrt(turned.shape[1]) * np.where(length > 0, length, 1))
    return _pack(turned > 0), length, np.where(length > 0, own, 1.0)


def bounds(q: np.ndarray, centre: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of all queries with all coded rows of a cell."""
    turned = rotate(q)
    size = turned.shape[1]
    low = turned.min(1)
    step = np.maximum((turned.max(1) - low) / ((1 << PLANES) - 1), 1e-300)
    cut = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    common = np.zeros((len(q), len(codes)), np.int64)
    for plane in range(PLANES):
        bits = _pack((cut >> plane & 1).astype(bool))
        for word in range(codes.shape[1]):
            common += np.bitwise_count(bits[:, word, None] & codes[None, :, word]).astype(np.int64) << plane
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    dot = (2 * step[:, None] * common + 2 * low[:, None] * ones - (step * cut.sum(1) + low * size)[:, None]) / math.sqrt(size)
    middle = (q @ centre)[:, None] + dot * (length / own)
    norm = np.linalg.norm(q, axis=1)[:, None]
    deviation = np.sqrt(np.maximum(1 - own**2, 0)) / (own * math.sqrt(max(size - 1, 1)))
    cutting = math.sqrt(size) * step[:, None] / 2 / own
    wide = length * (epsilon * norm * deviation + cutting) + 1e-9 * norm * (length + np.linalg.norm(centre))
    return middle - wide, middle + wide


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding of the rows that take part, equal rows once; parts stay float where they are."""
    kind = "array<float>" if df.schema[embedding].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast(kind).alias("embedding"))
    part = lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))
    fine = F.forall("embedding", part) & F.exists("embedding", lambda v: v != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).dropDuplicates()


def _matrix(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column side by side, and where each list starts."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(lists.flatten(), dtype), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)


def _by_length(batch, dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors in double precision) of a batch whose column 1 holds the vectors."""
    flat, at = _matrix(batch.column(1), dtype)
    sizes = np.diff(at)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, flat[at[rows][:, None] + np.arange(size)].astype(np.float64)


def _top(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each who's k best scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores, who))
    who = who[order]
    start = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
    place = np.arange(len(who)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(who) else np.arange(0)
    return order[place < k]


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs; summed row by row, so that equal vectors have equal scores wherever they are."""
    out = np.empty(len(qi))
    step = max(1, (1 << 22) // max(q.shape[1], 1))
    for i in range(0, len(qi), step):
        out[i : i + step] = (q[qi[i : i + step]] * x[xi[i : i + step]]).sum(1)
    return out


class Layout(dict):
    """Cells by vector length; lengths that the sample lacks have one cell around zero."""

    def __missing__(self, length: int) -> Cells:
        return Cells(np.zeros((0, length)), 1)


class Index:
    """The cells and blocks of a table of vectors, and the search in them."""

    def __init__(self, df: DataFrame, nearest: int = NEAREST):
        self.spark, self.nearest = df.sparkSession, nearest
        self.float = df.schema["embedding"].dataType.simpleString() == "array<float>"
        self.dtype = np.float32 if self.float else np.float64
        same = Window.partitionBy("embedding").orderBy("vec_id")
        copies = df.withColumn("_copy", F.row_number().over(same)).where(F.col("_copy") <= nearest + 1).drop("_copy")
        self.rows = stage_table(copies, "one-bit-rows")
        size = F.size("embedding")
        count, longest = self.rows.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0))).first()
        cap = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(longest, 1))))
        sample = self.rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(cap).toArrow()
        self.cells = Layout()
        self.sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        ids = np.asarray(sample.column(0))
        for length, rows, x in _by_length(sample, self.dtype):
            share = count * len(rows) / max(len(ids), 1)
            self.cells[length] = Cells(x, min(CELLS, math.ceil(share / CELL)))
            self.sample[length] = ids[rows], x
        self.blocks = self._blocks()

    def _blocks(self) -> DataFrame:
        cells, dtype = self.cells, self.dtype

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for length, rows, x in _by_length(batch, dtype):
                    of = cells[length]
                    home = of.home(x)
                    codes, far, own = encode(x - of.centroids[home])
                    raw = [v.tobytes() for v in x.astype(dtype)]
                    columns = [pa.array(np.full(len(rows), length), pa.int32()), pa.array(home, pa.int32()), batch.column(0).take(pa.array(rows))]
                    columns += [pa.array(raw, pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(own)]
                    yield pa.RecordBatch.from_arrays(columns, ["length", "cell", "vec_id", "vector", "code", "far", "own"])

        coded = self.rows.mapInArrow(code, "length int, cell int, vec_id long, vector binary, code binary, far double, own double")
        coded = stage_table(coded, "one-bit-codes")
        sizes = coded.groupBy("length", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
        dealt = coded.join(sizes, ["length", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("n_blocks")).cast("int"))

        def gather(rows: pa.Table) -> pa.Table:
            first = rows.slice(0, 1)
            whole = [pa.array([b"".join(rows.column(c).to_pylist())], pa.binary()) for c in ("vector", "code")]
            whole += [pa.array([np.asarray(rows.column(c)).tobytes()], pa.binary()) for c in ("vec_id", "far", "own")]
            keys = [first.column(c).combine_chunks() for c in ("length", "cell", "block")]
            return pa.Table.from_arrays(keys + whole, ["length", "cell", "block", "vectors", "codes", "ids", "fars", "owns"])

        schema = "length int, cell int, block int, vectors binary, codes binary, ids binary, fars binary, owns binary"
        blocks = dealt.drop("n_blocks").groupBy("length", "cell", "block").applyInArrow(gather, schema)
        return stage_table(blocks, "one-bit-blocks")

    def truth(self, queries: list[tuple[int, bytes, int]]) -> list:
        """(number of the query, vec_id, length, cell) of the nearest rows of a few queries by brute force over all rows."""
        k, dtype, cells = self.nearest, self.dtype, self.cells
        of: dict[int, list] = {}
        for number, (own, raw) in enumerate(queries):
            of.setdefault(len(raw) // np.dtype(dtype).itemsize, []).append((number, own, np.frombuffer(raw, dtype).astype(np.float64)))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                all_ids = np.asarray(batch.column(0))
                for length, rows, x in _by_length(batch, dtype):
                    if length not in of:
                        continue
                    ids, home = all_ids[rows], cells[length].home(x)
                    scores = np.stack([v for *_, v in of[length]]) @ x.T
                    scores[np.array([own for _, own, _ in of[length]])[:, None] == ids] = -np.inf
                    few = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
                    who = np.repeat([number for number, *_ in of[length]], few.shape[1])
                    new = who, ids[few.ravel()], np.take_along_axis(scores, few, 1).ravel(), home[few.ravel()]
                    old = best.get(length, tuple(a[:0] for a in new))
                    both = [np.concatenate(p) for p in zip(old, new)]
                    best[length] = tuple(a[_top(*both[:3], k)] for a in both)
            for length, (who, ids, scores, home) in best.items():
                fine = scores > -np.inf
                columns = [pa.array(who[fine], pa.int32()), pa.array(ids[fine]), pa.array(scores[fine]), pa.array(np.full(fine.sum(), length), pa.int32()), pa.array(home[fine], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["who", "vec_id", "score", "length", "cell"])

        found = self.rows.mapInArrow(scan, "who int, vec_id long, score double, length int, cell int")
        place = F.row_number().over(Window.partitionBy("who").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("_place", place).where(F.col("_place") <= k).select("who", "vec_id", "length", "cell").collect()

    def _asked(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """Each query with its home cell, the cells that it looks into and the score that it needs at least."""
        k, dtype, cells, sample = self.nearest, self.dtype, self.cells, self.sample

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                all_ids = np.asarray(batch.column(0))
                for length, rows, q in _by_length(batch, dtype):
                    own = all_ids[rows]
                    need = np.full(len(q), -np.inf)
                    if length in sample and len(sample[length][0]) > k:
                        for i in range(0, len(q), 256):
                            scores = q[i : i + 256] @ sample[length][1].T
                            scores[own[i : i + 256, None] == sample[length][0]] = -np.inf
                            need[i : i + 256] = np.partition(scores, -k, axis=1)[:, -k]
                        need -= 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(sample[length][1], axis=1).max()
                    into = cells[length].order(q)[:, :probes].astype(np.int32)
                    columns = [pa.array(np.full(len(q), length), pa.int32()), pa.array(into[:, 0]), pa.array(own), pa.array([v.tobytes() for v in q.astype(dtype)], pa.binary())]
                    columns += [pa.array(need), pa.array(list(into), pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(columns, ["length", "home", "query_id", "vector", "need", "cells"])

        return queries.mapInArrow(ask, "length int, home int, query_id long, vector binary, need double, cells array<int>")

    def search(self, queries: DataFrame, probes: int | None = None, epsilon: float = EPSILON) -> DataFrame:
        """query_id, rank (from 1), vec_id, score of each query's nearest rows in its first `probes` cells (None: all).

        Queries of one home cell are dealt to piles of about PILE. All blocks of a cell go to the piles that look into it, home cells first,
        cut into SEGMENTS by cell so that a pile isn't one task; a task keeps its piles' best rows so far, so the score that is
        needed rises, and what it gives out is at most the nearest rows of each query.
        """
        k, dtype, cells, parts = self.nearest, self.dtype, self.cells, shuffle_parts(self.spark)
        asked = stage_table(self._asked(queries, probes), "one-bit-asked")
        piles = asked.groupBy("length", "home").agg(F.ceil(F.count("*") / PILE).alias("_piles"))
        dealt = asked.join(piles, ["length", "home"]).withColumn("pile", F.pmod(F.xxhash64("query_id", "vector"), F.col("_piles")).cast("int"))

        def gather(rows: pa.Table) -> pa.Table:
            into = [set(c) for c in rows.column("cells").to_pylist()]
            union = sorted(set().union(*into))
            looks = np.packbits(np.array([[c in own for c in union] for own in into]), axis=0, bitorder="little")
            row = {c: rows.column(c)[0].as_py() for c in ("length", "home", "pile")} | {
                "queries": b"".join(rows.column("vector").to_pylist()), "query_ids": np.asarray(rows.column("query_id")).tobytes(),
                "needs": np.asarray(rows.column("need")).tobytes(), "cells": union, "looks": [looks[:, i].tobytes() for i in range(len(union))],
            }
            kinds = [("length", pa.int32()), ("home", pa.int32()), ("pile", pa.int32()), ("queries", pa.binary()), ("query_ids", pa.binary()), ("needs", pa.binary())]
            return pa.Table.from_pylist([row], pa.schema([*kinds, ("cells", pa.list_(pa.int32())), ("looks", pa.list_(pa.binary()))]))

        schema = "length int, home int, pile int, queries binary, query_ids binary, needs binary, cells array<int>, looks array<binary>"
        piled = stage_table(dealt.drop("_piles").groupBy("length", "home", "pile").applyInArrow(gather, schema), "one-bit-piles")
        key, body = ["length", "home", "pile", "segment"], ["vectors", "codes", "ids", "fars", "owns"]
        segment = F.pmod(F.xxhash64("cell"), F.lit(SEGMENTS)).cast("int")
        visits = piled.select("length", "home", "pile", F.explode(F.arrays_zip("cells", "looks")).alias("v")).select("length", "home", "pile", F.col("v.cells").alias("cell"), F.col("v.looks").alias("look"))
        seen = visits.join(self.blocks, ["length", "cell"]).withColumn("segment", segment)
        seen = seen.select(*key, F.when(F.col("cell") == F.col("home"), 1).otherwise(2).alias("turn"), "cell", "look", *body)
        heads = piled.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)))).select(*key, F.lit(0).alias("turn"), F.col("queries").alias("vectors"), F.col("query_ids").alias("ids"), F.col("needs").alias("fars"))
        met = heads.unionByName(seen, allowMissingColumns=True).repartition(parts, *key).sortWithinPartitions(*key, "turn", "cell")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state = None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["turn"] == 0:
                        if state is not None:
                            yield state.best()
                        state = _Pile(row, dtype, k)
                    else:
                        state.meet(row, cells[row["length"]].centroids[row["cell"]], epsilon)
            if state is not None:
                yield state.best()

        found = met.mapInArrow(meet, "query_id long, vector binary, vec_id long, score double")
        found = found.withColumn("_of", F.xxhash64("vector")).drop("vector")
        place = F.row_number().over(Window.partitionBy("query_id", "_of").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "_of")


class _Pile:
    """Some queries and their nearest rows so far."""

    def __init__(self, row: dict, dtype, k: int):
        self.length, self.dtype, self.k = row["length"], dtype, k
        self.raw = row["vectors"]
        self.q = np.frombuffer(self.raw, dtype).reshape(-1, self.length).astype(np.float64)
        self.own, self.need = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["fars"]).copy()
        self.who, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, row: dict, centre: np.ndarray, epsilon: float) -> None:
        look = np.flatnonzero(np.unpackbits(np.frombuffer(row["look"], np.uint8), bitorder="little")[: len(self.q)])
        q, ids = self.q[look], np.frombuffer(row["ids"], np.int64)
        x = np.frombuffer(row["vectors"], self.dtype).reshape(-1, self.length).astype(np.float64)
        codes = np.frombuffer(row["codes"], np.uint64).reshape(len(ids), -1)
        low, high = bounds(q, centre, codes, np.frombuffer(row["fars"]), np.frombuffer(row["owns"]), epsilon)
        itself = self.own[look, None] == ids
        low[itself] = -np.inf
        need = self.need[look]
        if len(ids) > self.k:
            need = np.maximum(need, np.partition(low, -self.k, axis=1)[:, -self.k])
        qi, xi = np.nonzero((high >= need[:, None]) & ~itself)
        scores, who = _exact(q, x, qi, xi), look[qi]
        enough = scores >= self.need[who]
        who, ids, scores = (np.concatenate(p) for p in ((self.who, who[enough]), (self.ids, ids[xi[enough]]), (self.scores, scores[enough])))
        best = _top(who, ids, scores, self.k)
        self.who, self.ids, self.scores = who[best], ids[best], scores[best]
        # sorted by query: the last of k rows is what a further row must reach
        full = np.flatnonzero(np.bincount(self.who, minlength=len(self.q)) == self.k)
        last = np.searchsorted(self.who, full, side="right") - 1
        self.need[full] = np.maximum(self.need[full], self.scores[last])

    def best(self) -> pa.RecordBatch:
        size = self.length * np.dtype(self.dtype).itemsize
        vectors = [self.raw[i * size : (i + 1) * size] for i in range(len(self.q))]
        columns = [pa.array(self.own[self.who]), pa.array([vectors[w] for w in self.who], pa.binary()), pa.array(self.ids), pa.array(self.scores)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vector", "vec_id", "score"])


def nearest(df: DataFrame, is_query: Column, k: int = NEAREST, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product found for each query row of df.

    is_query is a condition on vec_id. Columns of df are vec_id and embedding (arrays of float or double).
    """
    rows = usable(df)
    index = Index(rows, k)
    queries = stage_table(rows.where(is_query), "one-bit-queries")
    raw = F.xxhash64("vec_id", F.lit(3))
    audit = [(r.vec_id, np.asarray(r.embedding, index.dtype).tobytes(), r._of) for r in queries.orderBy(raw, "vec_id").limit(min(AUDIT, max(1, SAMPLE_BYTES // (8 * 64)))).withColumn("_of", F.lit(0)).collect()]
    truth = index.truth([(own, vector) for own, vector, _ in audit])
    probes = _needed(index, audit, truth, recall)
    epsilon = EPSILON
    while True:
        found = stage_table(index.search(queries, probes, epsilon), "one-bit-found")
        reached = _recall(found, audit, truth)
        log.info("one-bit search: %s cells, bounds of %s deviations, recall %.4f of %d audited neighbours", probes, epsilon, reached, len(truth))
        if reached >= recall or (probes is None and epsilon > 2 * EPSILON):
            return found.drop("_of")
        most = max((len(c.centroids) for c in index.cells.values()), default=1)
        probes, epsilon = (None if probes is None or 2 * probes >= most else 2 * probes), epsilon + 1


def _needed(index: Index, audit: list, truth: list, recall: float) -> int | None:
    """How many cells the audited queries must look into; None: all."""
    if not truth:
        return None
    vectors = [np.frombuffer(vector, index.dtype).astype(np.float64) for _, vector, _ in audit]
    places = []
    for row in truth:
        order = index.cells[row.length].order(vectors[row.who][None])[0]
        places.append(int(np.flatnonzero(order == row.cell)[0]) + 1)
    # half of what may be lost is left to the bounds
    return int(np.quantile(places, (1 + recall) / 2, method="higher"))


def _recall(found: DataFrame, audit: list, truth: list) -> float:
    if not truth:
        return 1.0
    ids = sorted({own for own, *_ in audit})
    got = {(r.query_id, r.vec_id) for r in found.where(F.col("query_id").isin(ids)).select("query_id", "vec_id").collect()}
    return sum((audit[r.who][0], r.vec_id) in got for r in truth) / len(truth)


def op13_one_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row of `embeddings` whose id is divisible by 20; nulls, ties and repeated rows as above."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
