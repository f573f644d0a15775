"""Periodic runs of words by internal pattern matching.

A run is a stretch of consecutive words with smallest period q that holds at least three periods and MIN_LENGTH
words and can't be extended. They are found, not guessed:

1. Texts go through tasks in batches of about BATCH words (a longer text is a batch of its own). Words become numbers of their own document, so
   nothing matches across documents, and doubling sorts all suffixes: after k rounds every position has the rank of its first 2^k words.
   The ranks stay; two of them tell in one comparison whether 2^k words are equal, forwards or backwards, and binary lifting over
   them gives the longest common extension of two positions.
2. A run with 2^k <= q < 2^(k+1) contains a dyadic block of 2^k words, aligned at its own length, and the block's copy q words on.
   The block's occurrences are an interval of the suffix array, and a wavelet tree over that interval answers the range
   successor: the least position at or after a bound. Occurrences that start within 2^k words of each other are a progression, so its first
   two members and the ends of the periodic stretches around it give all candidate periods, at most four a block.
   Periods under 8 come from blocks of 8 words, as a run has 24 words at least.
3. Each candidate is extended both ways to its maximal stretch. Equal stretches keep the smallest period.

Rows are never shuffled and a task holds one batch, so cost is linear in words but for the logarithm of the sort.
Null and empty texts have no words and no runs; a null doc_id stays null; repeated rows each give a row; an empty table gives an empty one; extra
columns are ignored. Texts are read whole, whatever their length. Equal words are told by 64-bit hashes mixed with their document's number.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import Text, mix

MIN_LENGTH, MIN_PERIODS, BATCH, FIRST = 24, 3, 1 << 18, 3
RUNS = "array<struct<start:long,length:long,period:long>>"


class WaveletTree:
    """Range successor over a sequence of numbers: bits of the numbers, highest first, each level stably split by its bit."""

    def __init__(self, values: np.ndarray, bound: int):
        self.depth = max(1, int(bound).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n, rest = len(values), values
        for level in range(self.depth - 1, -1, -1):
            ones = (rest >> level & 1).astype(bool)
            bits = np.zeros((n // 64 + 1) * 64, bool)
            bits[:n] = ones
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(n - int(ones.sum()))
            rest = np.concatenate([rest[~ones], rest[ones]])

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][i >> 6] + np.bitwise_count(self.words[level][i >> 6] & mask)

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers in places lo to hi - 1 are under the bound."""
        count = np.where(bound >> self.depth > 0, hi - lo, 0)
        open_ = bound >> self.depth == 0
        for level in range(self.depth):
            bit = (bound >> (self.depth - 1 - level) & 1).astype(bool)
            lo1, hi1 = self._ones(level, lo), self._ones(level, hi)
            count = count + np.where(bit & open_, (hi - lo) - (hi1 - lo1), 0)
            lo, hi = np.where(bit, self.zeros[level] + lo1, lo - lo1), np.where(bit, self.zeros[level] + hi1, hi - hi1)
        return count

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest number (from 0) in places lo to hi - 1."""
        value = np.zeros(len(lo), np.int64)
        for level in range(self.depth):
            lo1, hi1 = self._ones(level, lo), self._ones(level, hi)
            zeros = (hi - lo) - (hi1 - lo1)
            bit = k >= zeros
            value = value << 1 | bit
            k = np.where(bit, k - zeros, k)
            lo, hi = np.where(bit, self.zeros[level] + lo1, lo - lo1), np.where(bit, self.zeros[level] + hi1, hi - hi1)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray, none: int) -> np.ndarray:
        """The smallest number >= bound in places lo to hi - 1; `none` where there isn't one."""
        k = self.below(lo, hi, bound)
        found = k < hi - lo
        out = np.full(len(lo), none, np.int64)
        out[found] = self.kth(lo[found], hi[found], k[found])
        return out


class Suffixes:
    """Ranks of all positions by their first 2^k words, for each k up to the first at which no two are equal.

    A rank is the number of suffixes that are smaller by those words, so it is also where the interval of equal ones starts.
    """

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - counts)[inverse]
        self.ranks = [rank]
        shared = np.flatnonzero(counts[inverse] > 1)
        while len(shared):
            step = 1 << (len(self.ranks) - 1)
            after = np.where(shared + step < n, rank[np.minimum(shared + step, n - 1)] + 1, 0)
            order = np.argsort(rank[shared] * np.int64(n + 1) + after, kind="stable")
            shared, after = shared[order], after[order]
            group = rank[shared]
            new_group = np.concatenate([[True], group[1:] != group[:-1]])
            new = new_group | np.concatenate([[True], after[1:] != after[:-1]])
            place = np.arange(len(shared))
            start = place[new][np.cumsum(new) - 1]
            rank = rank.copy()
            rank[shared] = group + start - place[new_group][np.cumsum(new_group) - 1]
            size = np.diff(np.append(place[new], len(shared)))[np.cumsum(new) - 1]
            self.ranks.append(rank)
            shared = shared[size > 1]

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For how many words the texts from i and from j > i on are equal."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            a, b = i + length, j + length
            ok = b < self.n
            ok[ok] = self.ranks[k][a[ok]] == self.ranks[k][b[ok]]
            length += np.where(ok, 1 << k, 0)
        return length

    def extend_back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For how many words the texts that end before i and before j > i are equal."""
        length = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            a, b = i - length - (1 << k), j - length - (1 << k)
            ok = a >= 0
            ok[ok] = self.ranks[k][a[ok]] == self.ranks[k][b[ok]]
            length += np.where(ok, 1 << k, 0)
        return length


def runs_in(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """All runs of a sequence as rows (start, end, period), by start, then period.

    Symbols that occur once, such as a document's end, are in no run. min_length is 24 or more: shorter periods
    than 8 are looked for with blocks of 8.
    """
    suffixes = Suffixes(symbols)
    n, top = suffixes.n, len(suffixes.ranks) - 1
    if top <= FIRST:  # no 8 words occur twice in a document
        return np.zeros((0, 3), np.int64)
    # only suffixes whose first 8 words occur again are ever asked for
    base = suffixes.ranks[FIRST]
    again = np.bincount(base, minlength=n)[base] > 1
    order = np.empty(n, np.int64)
    order[suffixes.ranks[top]] = np.arange(n)
    kept = again[order]
    place = np.concatenate([[0], np.cumsum(kept)])
    tree = WaveletTree(order[kept], n)
    found = []
    for k in range(FIRST, top):
        block, rank = 1 << k, suffixes.ranks[k]
        size = np.bincount(rank, minlength=n)
        at = np.arange(0, n, block)
        at = at[size[rank[at]] > 1]
        if not len(at):
            continue
        lo, hi = place[rank[at]], place[rank[at] + size[rank[at]]]
        for near, far in [(1, block), (block, 2 * block)] if k == FIRST else [(block, 2 * block)]:
            first = tree.successor(lo, hi, at + near, n)
            some = first < at + far
            i, x, left, right = at[some], first[some], lo[some], hi[some]
            if not len(i):
                continue
            found.append(_maximal(suffixes, i, x - i))
            second = tree.successor(left, right, x + 1, n)
            more = second < i + far
            i, x, y = i[more], x[more], second[more]
            step = y - x
            ends = x + suffixes.extend(x, y) - i - suffixes.extend(i, i + step)
            starts = x - suffixes.extend_back(x, y) - i + suffixes.extend_back(i, i + step)
            for period in (y - i, ends, starts):
                ok = (period >= near) & (period < far)
                found.append(_maximal(suffixes, i[ok], period[ok]))
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    length = runs[:, 1] - runs[:, 0]
    runs = runs[(length >= min_length) & (length >= MIN_PERIODS * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    same = np.zeros(len(runs), bool)
    same[1:] = (runs[1:, :2] == runs[:-1, :2]).all(1)
    runs = runs[~same]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _maximal(suffixes: Suffixes, i: np.ndarray, period: np.ndarray) -> np.ndarray:
    ok = i + period < suffixes.n
    i, period = i[ok], period[ok]
    return np.stack([i - suffixes.extend_back(i, i + period), i + period + suffixes.extend(i, i + period), period], 1)


def _batch(docs: list[tuple], arrange) -> tuple[list, list]:
    """Runs (starts counted in each document) and collapsed texts of some documents."""
    symbols, words, first = [], [], [0]
    for number, (doc_id, data) in enumerate(docs):
        text = Text(data)
        of, hashes = data.split(), text.hashes
        to = arrange(doc_id, len(of)) if arrange else None
        if to is not None:
            of, hashes = [of[t] for t in to], hashes[to]
        words.append(of)
        # a document's number keeps its words apart from the others'; its end occurs once
        salt = mix(np.array([2 * number + 1, 2 * number + 2], np.uint64))
        symbols += [mix(hashes ^ salt[0]), salt[1:]]
        first.append(first[-1] + len(of) + 1)
    runs = runs_in(np.concatenate(symbols))
    bounds = np.searchsorted(runs[:, 0], first)
    out, collapsed = [], []
    for number, of in enumerate(words):
        mine = runs[bounds[number] : bounds[number + 1]] - [first[number], first[number], 0]
        if len(mine):
            depth = np.zeros(len(of) + 1, np.int64)
            np.add.at(depth, mine[:, 0] + mine[:, 2], 1)
            np.add.at(depth, mine[:, 1], -1)
            of = [of[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
        out.append([{"start": s, "length": e - s, "period": q} for s, e, q in mine.tolist()])
        collapsed.append(b" ".join(of))
    return out, collapsed


def periodic_runs(docs: DataFrame, arrange: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """For each row of docs: doc_id, `runs` (start and length in words, smallest period; by start, then period) and `collapsed`.

    `collapsed` holds the words, one blank between two, that no run contains after its first period (UTF-8 bytes).
    `arrange(doc_id, n)` may name for each of n words the place of the word to take instead; None leaves a text as it is.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = [], 0

        def flush():
            runs, collapsed = _batch(docs, arrange)
            names = ["doc_id", "runs", "collapsed"]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            columns = [pa.array([d for d, _ in docs], pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                docs.append((doc_id, data))
                size += len(data) // 6 + 16
                if size >= BATCH:
                    yield flush()
                    docs, size = [], 0
        if docs:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(find, f"doc_id long, runs {RUNS}, collapsed binary")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The periodic tail that op12's contract gives every tenth document; documents without an id have none."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def _digests(found: DataFrame) -> DataFrame:
    # exact comparison of length / period: products stay far below 2^63
    better = lambda r, b: b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda b, r: F.when(better(r, b), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.expr("best.length * 1000 div best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after the contract's planting, as counts, the strongest run and digests.

    A document without words or runs has no strongest run (four nulls) and the digest of no text where nothing is left.
    Rows with a null doc_id get no planted tail; repeated rows give repeated results; an empty table gives none.
    """
    return _digests(periodic_runs(table(spark, sf_dir, "documents"), planted))
