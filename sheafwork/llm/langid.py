"""Language identification by nearest centroid.

A text becomes a vector of hashed character 1- to 3-grams, weighted by damped counts times inverse document
frequency and normalised. Each language has several centroids (spherical k-means over its sample); a text
takes the language of the centroid with the largest cosine and is *rejected* where that cosine is far below
what that centroid's own texts reach.

Null texts and texts without a letter: `und`, score 0, rejected. Ties between centroids go to the
alphabetically first language. With nothing to learn from, every text is `und`. Any other columns of the
input are ignored; repeated rows are judged alike; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import bounded_sample, fold_of, packed, stage_table, table

BINS, LANGUAGES = 1 << 13, 1000
#: Texts of fewer grams than this are sparse: the least cosine asked of them falls with the root of their size.
FULL = 600
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the whole text's hashed 1- to 3-grams of letters, with one blank for whatever lies between
    words; None without a letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letter_table()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.concatenate([np.array([32], np.uint32), code[keep], np.array([32], np.uint32)])
    out = np.zeros(BINS, np.int64)
    one = code * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + one[2:]
    for gram in (one, two, three):
        gram = (gram ^ (gram >> np.uint32(16))) * np.uint32(0x27D4EB2F)
        out += np.bincount(gram >> np.uint32(32 - 13), minlength=BINS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Model:
    """idf, centroids (rows), their languages and least cosines."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], least: np.ndarray):
        self.idf, self.centroids, self.languages, self.least = idf, centroids, languages, least

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = gram_counts(text)
        if counts is None or not self.languages:
            return "und", 0.0, True
        v = np.log1p(counts).astype(np.float32) * self.idf
        cos = self.centroids @ v / max(float(np.sqrt(v @ v)), 1e-12)
        best = int(np.argmax(cos))
        return self.languages[best], float(np.clip(cos[best], 0, 1)), bool(cos[best] < self.least[best])


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Up to k unit centroids of unit rows, and each row's cosine with its own. The first seed is the row
    nearest to the mean, each next one the row farthest from all seeds."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        nearest = (x @ x[seeds].T).max(1)
        if nearest.min() > 1 - 1e-6:
            break
        seeds.append(int(np.argmin(nearest)))
    centres = x[seeds].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = _unit(x[own == j].mean(0))
    return centres, (x @ centres.T).max(1)


def sample_by_class(docs: DataFrame, of: str, cap: int) -> DataFrame:
    """`of` and text: about `cap` rows for each value of `of` (the whole class if it is smaller), chosen by a hash of
    doc_id and text, so that most texts are never shuffled; bounded_sample then keeps at most 2 * cap different ones."""
    sizes = docs.groupBy(of).agg(F.count("*").alias("_size")).limit(LANGUAGES + 1)
    found = sizes.collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    sizes = docs.sparkSession.createDataFrame(found, sizes.schema)  # LANGUAGES rows at most
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    likely = docs.join(F.broadcast(sizes), of).where(share < cap / F.col("_size")).drop("_size")
    return bounded_sample(likely, of, 2 * cap)


def _frequencies(batches):
    """One row for each task: texts, and in how many of them each gram occurs."""
    n, seen = 0, np.zeros(BINS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            if (counts := gram_counts(text.as_py())) is not None:
                n, seen = n + 1, seen + (counts > 0)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([seen.tobytes()], pa.binary())], names=["n", "seen"])


def fit(sample: DataFrame, centroids: int = 4) -> Model:
    """From sample_by_class(): tasks count document frequencies, and one task a language fits its centroids to its bounded sample.

    The driver adds up one row for each task of the sample and holds the model alone, 32 KB a centroid; more than LANGUAGES values of `lang` are refused.
    """
    sample = stage_table(sample.select("lang", "text"), "langid-sample")
    counts = sample.select("text").mapInArrow(_frequencies, "n long, seen binary").collect()
    n, seen = sum(r.n for r in counts), sum((np.frombuffer(r.seen, np.int64) for r in counts), np.zeros(BINS, np.int64))
    idf = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.1)

    def one_language(rows: pa.Table) -> pa.Table:
        lang = rows.column("lang")[0].as_py()
        counts = [c for text in sorted(rows.column("text").to_pylist()) if (c := gram_counts(text)) is not None]
        found: list[dict] = []
        if counts:
            x = _unit(np.stack([np.log1p(c).astype(np.float32) for c in counts]) * idf)
            centres, cos = spherical_means(x, centroids)
            own = (x @ centres.T).argmax(1)
            # the loosest bound of a language holds for all of its centroids: a small cluster must not reject
            least = min(0.5 * float(np.quantile(cos[own == j], 0.01)) if (own == j).any() else 0.0 for j in range(len(centres)))
            found = [{"lang": lang, "place": j, "centroid": c.astype(np.float32).tobytes(), "least": least} for j, c in enumerate(centres)]
        return pa.Table.from_pylist(found, pa.schema([("lang", pa.string()), ("place", pa.int32()), ("centroid", pa.binary()), ("least", pa.float64())]))

    rows = sorted(sample.groupBy("lang").applyInArrow(one_language, "lang string, place int, centroid binary, least double").collect())
    if not rows:
        return Model(np.ones(BINS, np.float32), np.zeros((0, BINS), np.float32), [], np.zeros(0))
    return Model(idf, np.stack([np.frombuffer(r.centroid, np.float32) for r in rows]), [r.lang for r in rows], np.array([r.least for r in rows]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns of docs), lang_pred, score and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 4 x 32 KB a language at most, LANGUAGES at most
    plain = packed(docs, "text")
    schema = StructType([plain.schema["row"], *(StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType())))])

    def predicted(batches):
        own = held.value
        for batch in batches:
            rows = [own.predict(x.as_py()) for x in batch.column(1)]
            more = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["row", "lang_pred", "score", "rejected"])

    return plain.mapInArrow(predicted, schema)


def identify(docs: DataFrame, learn_from: Column, per_language: int = 400) -> DataFrame:
    """predict() over docs. Learns from the text and non-null lang of rows where `learn_from`
    holds, about `per_language` of them for each language (the bound of the classifier's sample)."""
    known = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    return predict(docs, fit(sample_by_class(known, "lang", per_language)))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of `documents`, learnt without the held-out third; nulls, ties and empty tables as above."""
    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 3)
    found = identify(docs.select("doc_id", "text", "lang"), fold != 1)
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), (fold_of(doc_id, 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, per_language: int = 400) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; the others stay as they are."""
    return identify(docs, fold_of(F.col("doc_id"), 3) != 1, per_language).where(~F.col("rejected")).select("row.*")
