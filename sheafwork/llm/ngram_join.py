"""N-gram Jaccard self-join of documents by a MinHash LSH forest.

Documents are sets of runs of five words (a text of one to four words is one run). Texts with equal words are one
class with a number of its own, and only classes are compared; ids come back last.

1. Every class gets a signature of TREES x DEPTH MinHash values. Tree t orders the classes by the values of its own
   DEPTH places: the sorted form of a prefix trie, in which a node of depth d is the run of classes that share d values.
2. Prefixes are matched at the longest depth at which every pair at the threshold meets with a chance of RECALL or more, by the
   formula of MinHash: more similar pairs meet more surely, whatever the corpus. Nothing is estimated from a sample; `audit` is kept
   for measuring what a depth meets.
3. Classes that share a node of that depth are candidates. Nodes that one class alone holds are dropped by a count.
   A node of very many classes is cut into blocks and each pair of blocks is a cell of its own, so no cell is larger
   than two blocks.
4. A pair belongs to the first tree in which it meets, which any cell can tell from the two signatures: no pair is
   looked at twice or has to be sent anywhere. Cells drop pairs whose signatures agree in far fewer places than
   the threshold asks for, and name the classes that still have a partner there.
5. Only those classes' texts are read again and go to those cells, where the sets are compared exactly. Out come
   link counts for each class and links that span the cell's groups, never all pairs of a group.

n_links counts the other *documents* (rows) within the threshold, equal texts included. Null and empty texts have no
set: no links, each its own class. Repeated rows (equal doc_id and text) are further members of the class; rows that share
an id but not a text are told apart. Rows without an id count as links of others; class_id and component_id are the
smallest ids there are, else null. Very long texts are used whole. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, stage_table, table
from .components import components
from .words import Text, mix, windows

WORDS, JACCARD, RECALL = 5, 0.8, 0.9995
TREES, DEPTH, BLOCK = 16, 8, 1024
AUDIT, PRIOR = 512, 8
_odd = lambda r, n: r.integers(1, 1 << 31, size=n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SEEDS, _STIR = _odd(np.random.default_rng(11), TREES * DEPTH), _odd(np.random.default_rng(12), TREES * DEPTH)


def meeting_chance(jaccard: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair of that similarity shares a prefix of `depth` values in some tree."""
    return 1 - (1 - jaccard**depth) ** trees


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct runs of words, and the hashes of all words in order."""
    all_words = Text((text or "").encode("utf-8", "surrogatepass")).hashes
    runs = windows(all_words, min(words, len(all_words))) if len(all_words) else all_words
    return np.unique(runs), all_words


def signature(runs: np.ndarray) -> bytes:
    """TREES x DEPTH MinHash values, each kept as 16 bits that any bit of its minimum changes."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    short = (runs >> np.uint64(32)).astype(np.uint32)[:, None]
    for at in range(0, len(short), 256):
        x = short[at : at + 256] * _SEEDS
        x ^= x >> np.uint32(15)
        x *= _STIR
        np.minimum(low, x.min(0), out=low)
    low *= np.uint32(0x9E3779B1)
    low ^= low >> np.uint32(15)
    low *= np.uint32(0x85EBCA6B)
    return (low >> np.uint32(16)).astype(np.uint16).tobytes()


def fingerprint(all_words: np.ndarray) -> bytes:
    """128 bits of the word sequence."""
    place = np.arange(1, len(all_words) + 1, dtype=np.uint64)
    a = mix(all_words + place * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)
    b = mix((all_words ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0xC2B2AE3D27D4EB4F) + mix(place)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text), print (of the words; null without words) and signature."""

    def signed(batches):
        for batch in batches:
            prints, signs = [], []
            for text in batch.column(2):
                runs, all_words = shingles(text.as_py())
                prints.append(fingerprint(all_words) if len(runs) else None)
                signs.append(signature(runs) if len(runs) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "hash", "print", "signature"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("hash"), "text")
    return thin.mapInArrow(signed, "doc_id long, hash long, print binary, signature binary")


def _values(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint16).reshape(len(signs), TREES * DEPTH)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places (by their low bytes) each row of a agrees with each of b."""
    a, b = np.ascontiguousarray(a.astype(np.uint8).T), np.ascontiguousarray(b.astype(np.uint8).T)
    out = np.zeros((a.shape[1], b.shape[1]), np.uint8)  # TREES * DEPTH is under 256
    for x, y in zip(a, b):
        out += x[:, None] == y[None]
    return out


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of a and b the longest prefix that they share in any tree."""
    same = (a == b).reshape(-1, TREES, DEPTH)
    return np.cumprod(same, axis=2, dtype=np.int8).sum(2).max(1, initial=0)


def audit(classes: DataFrame, jaccard: float = JACCARD, sample: int = AUDIT) -> dict[int, float]:
    """For each prefix length the weight of the audited pairs whose longest shared prefix it is. The queries are `sample`
    classes by hash; every other class is compared with them."""
    width = TREES * DEPTH
    asked = classes.select("cls", "signature").orderBy(F.xxhash64("cls", F.lit(5)), "cls").limit(sample).collect()
    if not asked:
        return {}
    spread = math.sqrt(jaccard * (1 - jaccard) / width)
    held = classes.sparkSession.sparkContext.broadcast((np.array([r["cls"] for r in asked]), _values([bytes(r["signature"]) for r in asked])))

    def looked(batches):
        own, signs = held.value
        total = np.zeros(DEPTH + 1)
        for batch in batches:
            cls, rows = batch.column(0).to_numpy(), _values(batch.column(1).to_pylist())
            for a in range(0, len(rows), 64):
                i, j = np.nonzero(_agreement(rows[a : a + 64], signs) >= (jaccard - 4 * spread) * width)
                i, j = i[cls[i + a] != own[j]] + a, j[cls[i + a] != own[j]]
                if len(i):
                    share = (rows[i] == signs[j]).mean(1)
                    weight = np.array([0.5 * math.erfc((jaccard - x) / spread / math.sqrt(2)) for x in share])
                    total += np.bincount(shared_prefix(rows[i], signs[j]), weight, DEPTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(DEPTH + 1), pa.int32()), pa.array(total)], names=["depth", "weight"])

    sums = classes.select("cls", "signature").mapInArrow(looked, "depth int, weight double").groupBy("depth").agg(F.sum("weight").alias("weight"))
    return {r["depth"]: r["weight"] for r in sums.collect()}  # DEPTH + 1 rows


def prefix_depth(weights: dict[int, float], jaccard: float = JACCARD, recall: float = RECALL) -> tuple[int, float]:
    """The longest prefix, from DEPTH down, at which the weights of an audit reach `recall`, and the recall measured there; without
    weights the longest at which a pair at the threshold meets with that chance."""
    total = sum(weights.values())
    for d in range(DEPTH, 0, -1):
        met = sum(w for k, w in weights.items() if k >= d)
        if met + PRIOR * meeting_chance(jaccard, d) >= recall * (total + PRIOR):
            break
    return d, met / total if total else 1.0


def candidate_cells(classes: DataFrame, depth: int) -> DataFrame:
    """cls, signature and the cells (tree, prefix, first, second, side) it belongs to. A node of up to BLOCK
    classes is one cell (0, 0); a larger one is cut into b blocks and has a cell for each pair of blocks."""
    prefix = lambda t: F.xxhash64(F.substring("signature", 2 * t * DEPTH + 1, 2 * depth))
    trees = F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), prefix(t).alias("prefix")) for t in range(TREES)]))
    held = classes.select("cls", trees.alias("t")).select("cls", "t.*")
    sizes = held.groupBy("tree", "prefix").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    placed = held.join(sizes, ["tree", "prefix"])
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("blocks")).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("cls", "tree", "prefix", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own")
    return cells.join(classes.select("cls", "signature"), "cls")


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it; a cell is bounded, so this is all that is held."""
    rest: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        if not now.num_rows:
            continue
        change = np.zeros(now.num_rows - 1, bool)
        for k in keys:
            v = now[k].to_numpy()
            change |= v[1:] != v[:-1]
        cuts = np.r_[0, np.flatnonzero(change) + 1, now.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            yield now.slice(a, b - a)
        rest = now.slice(cuts[-2]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


CELL = ("tree", "prefix", "first", "second")


def _own_pairs(t: pa.Table, depth: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j that this cell is the first to hold and whose signatures agree in `least` of all places."""
    n = t.num_rows
    signs = _values(t["signature"].to_pylist())
    nodes = np.zeros((TREES, n), np.uint64)
    for k in range(depth):
        nodes = mix(nodes + signs.reshape(n, TREES, DEPTH)[:, :, k].T.astype(np.uint64))
    own, tree, across = t["own"].to_numpy(), t["tree"][0].as_py(), t["first"][0].as_py() != t["second"][0].as_py()
    left, right = [], []
    step = max(1, (1 << 20) // max(n, 1))
    for a in range(0, n - 1, step):
        i = np.arange(a, min(a + step, n - 1))
        ok = (nodes[tree, i, None] == nodes[tree][None]) & (np.arange(n)[None] > i[:, None])
        for before in range(tree):
            ok &= nodes[before, i, None] != nodes[before][None]
        if across:
            ok &= own[i, None] != own[None]
        if ok.any():
            ok &= _agreement(signs[i], signs) >= least * TREES * DEPTH
            x, y = np.nonzero(ok)
            left.append(i[x])
            right.append(y)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def partners(cells: DataFrame, depth: int, least: float) -> DataFrame:
    """The rows of `cells` whose class has a pair there that is worth an exact look."""
    kept = cells.select("cls", "signature", *CELL, "own")
    laid = kept.repartition(shuffle_parts(cells.sparkSession), *CELL).sortWithinPartitions(*CELL, "cls")

    def looked(batches):
        for t in _runs(batches, CELL):
            i, j = _own_pairs(t, depth, least)
            if len(i):
                yield from t.take(pa.array(np.union1d(i, j))).to_batches()

    return laid.mapInArrow(looked, kept.schema)


def exact_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, jaccard: float) -> np.ndarray:
    """Which of the pairs are similar enough. Only runs that two of the sets share are compared; where there are
    many pairs the sets become rows of 0 and 1, and products of blocks of columns add up the common runs."""
    if not len(i):
        return np.zeros(0, bool)
    sizes = np.array([len(s) for s in sets])
    common = np.zeros(len(i), np.int64)
    if len(i) <= 4 * len(sets):
        for k, (a, b) in enumerate(zip(i, j)):
            common[k] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        runs, where, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = many[where] > 1
        column = (np.cumsum(many > 1) - 1)[where[shared]]
        row, order = row[shared], np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = 4096
        total = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, [a, a + width])
            block = np.zeros((len(sets), width), np.float32)
            block[row[lo:hi], column[lo:hi] - a] = 1
            total += block @ block.T
        common = total[i, j].astype(np.int64)
    return common >= jaccard * (sizes[i] + sizes[j] - common) - 1e-9


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items the smallest index in its group."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def verified(named: DataFrame, docs: DataFrame, classes: DataFrame, depth: int, least: float, jaccard: float) -> DataFrame:
    """For each class in each cell: cls, links (documents within the threshold, by the classes' size) and root, a class
    linked with it through the cell."""
    wanted = classes.join(named.select("cls").distinct(), "cls", "left_semi").select("cls", "size", "row")
    read = docs.select(F.col("doc_id").cast("long").alias("_id"), text_hash(F.col("text")).alias("_hash"), F.coalesce("text", F.lit("")).alias("text"))
    same = read["_id"].eqNullSafe(wanted["row.doc_id"]) & (read["_hash"] == wanted["row.hash"])
    texts = read.join(wanted, same).groupBy("cls").agg(F.first("size").alias("size"), F.min("text").alias("text"))  # repeated rows have one text
    full = named.join(texts, "cls")
    laid = full.select("cls", "signature", *CELL, "own", "size", "text").repartition(shuffle_parts(docs.sparkSession), *CELL).sortWithinPartitions(*CELL, "cls")

    def compared(batches):
        for t in _runs(batches, CELL):
            i, j = _own_pairs(t, depth, least)
            ok = exact_pairs([shingles(x)[0] for x in t["text"].to_pylist()], i, j, jaccard)
            i, j = i[ok], j[ok]
            cls, size = t["cls"].to_numpy(), t["size"].to_numpy()
            links = np.bincount(i, size[j], len(cls)) + np.bincount(j, size[i], len(cls))
            at = np.flatnonzero(links)
            if len(at):
                root = cls[_forest(len(cls), i, j)]
                yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(links[at].astype(np.int64)), pa.array(root[at])], names=["cls", "links", "root"])

    return laid.mapInArrow(compared, "cls long, links long, root long")


def joined(docs: DataFrame, jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """For each document doc_id, hash (of its text), class_id, n_links, component (a number; null without words) and component_id."""
    signed = stage_table(signatures(docs), "ngram-signatures")
    known = signed.where(F.col("print").isNotNull()).groupBy("print")
    classes = known.agg(F.min("doc_id").alias("class_id"), F.min(F.struct("doc_id", "hash")).alias("row"), F.count("*").alias("size"), F.first("signature").alias("signature"))
    classes = stage_table(classes.withColumn("cls", F.monotonically_increasing_id()), "ngram-classes")
    depth, _ = prefix_depth({}, jaccard, recall)  # no sample has a say in it
    logging.getLogger(__name__).info("prefixes of %d values, a pair at the threshold meets with chance %.5f", depth, meeting_chance(jaccard, depth))
    least = jaccard - 5.5 * math.sqrt(jaccard * (1 - jaccard) / (TREES * DEPTH))
    named = stage_table(partners(candidate_cells(classes, depth), depth, least), "ngram-named")
    found = stage_table(verified(named, docs, classes, depth, least, jaccard), "ngram-links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    grouped = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "ngram-components").withColumnRenamed("node", "cls")
    each = classes.select("print", "cls", "class_id", "size").join(links, "cls", "left").join(grouped, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least_id = each.groupBy("component").agg(F.min("class_id").alias("component_id"))
    of = each.join(least_id, "component").select("print", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component", "component_id")
    # equal texts in many rows: the classes side has one row for each print, and Spark may split the other
    out = signed.select("doc_id", "hash", "print").join(of, "print", "left")
    alone = F.col("component").isNull()
    return out.select("doc_id", "hash", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def jaccard_join(docs: DataFrame, jaccard: float = JACCARD, recall: float = RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest doc_id with the same words), n_links, component_id
    (smallest doc_id reachable by links) and kept (doc_id = component_id)."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return joined(docs, jaccard, recall).select("doc_id", "class_id", "n_links", "component_id", kept.alias("kept"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_join over the whole of `documents`: doc_id, class_id, n_links, component_id, kept."""
    return jaccard_join(table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each group of linked documents one row stays, that with the smallest doc_id (then the
    smallest hash of its text); a row repeated with all of doc_id and text stays once. Documents without a word stay.
    Rows that share an id but neither words nor links all stay."""
    keys = joined(docs).where(F.col("component").isNotNull()).groupBy("component", "doc_id", "hash").agg(F.count("*").alias("n"))
    keys = stage_table(keys.withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")), "ngram-keys")
    first = keys.groupBy("component").agg(F.min("key").alias("first"))
    ranked = stage_table(keys.join(first, "component").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "n", (F.col("key") != F.col("first")).alias("goes")), "ngram-kept")
    going, again = ranked.where("goes"), ranked.where("not goes and n > 1")

    def same(other: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(other["_id"]) & (text_hash(docs["text"]) == other["_hash"])

    out = docs.join(going, same(going), "left_anti")
    if again.isEmpty():
        return out
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    once = out.join(again, same(again), "left_semi").select(row, docs["doc_id"].alias("_id"), text_hash(docs["text"]).alias("_hash")).dropDuplicates(["_id", "_hash"]).select("row.*")
    return out.join(again, same(again), "left_anti").unionByName(once)
