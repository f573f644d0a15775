"""Toxicity by multiple-instance learning.

Only documents carry labels. A document is a bag of sentences; sentence j has probability p_j = sigmoid(w x_j + b)
and the document's is their noisy-or, 1 - prod(1 - p_j). The weights are trained from document labels through
that formula, so the trained model also says *which* sentences offend.

Features of a sentence are its words (lower case) and their first 3 to 7 bytes, by hash. Sentences end at
. ! ? and line breaks. Null and empty texts have no sentence: score 0. Repeated rows are scored alike. Without
labels of both kinds every score is 0. Extra columns are ignored. An empty table gives an empty result; very long texts are read
whole. Only these ASCII marks end a sentence: a text of a script that has others is one sentence, scored as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import bounded_sample, fold_of, packed, table
from .words import NON_WORD, Text

PREFIXES = (3, 4, 5, 6, 7)
_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True


def encode(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


class Bag:
    """The sentences of one text: for each word its sentence (0, 1, ...) and the hashes of its features."""

    def __init__(self, data: bytes):
        self.text = Text(data, NON_WORD)
        stops = np.flatnonzero(_END[self.text.bytes])
        _, self.sentence = np.unique(np.searchsorted(stops, self.text.starts), return_inverse=True)
        self.count = int(self.sentence[-1]) + 1 if len(self.sentence) else 0

    def features(self):
        yield self.text.hashes
        long = self.text.ends - self.text.starts
        for size in PREFIXES:
            yield np.where(long > size, self.text.prefixes(size), np.uint64(0))

    def spans(self) -> np.ndarray:
        """First and last byte of each sentence's words, in the encoded text."""
        first = np.searchsorted(self.sentence, np.arange(self.count))
        last = np.append(first[1:], len(self.sentence)) - 1
        return np.stack([self.text.starts[first], self.text.ends[last]], 1)


class Model:
    """Sorted feature hashes with their weights, and the bias of a sentence; None of them without training."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float | None):
        self.keys, self.weights, self.bias = keys, weights, bias
        self._hit = np.zeros(1 << 20, bool)
        self._hit[keys >> np.uint64(44)] = True

    def __getstate__(self):
        return self.keys, self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` of known features, and their indices."""
        maybe = np.flatnonzero(self._hit[hashes >> np.uint64(44)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        real = self.keys[at] == hashes[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
        return maybe[real], at[real]

    def cells(self, bag: Bag) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (sentence, known feature) pairs."""
        found = [self.find(h) for h in bag.features()]
        pair = np.unique(np.concatenate([bag.sentence[w].astype(np.int64) << 32 | k for w, k in found]))
        return pair >> 32, pair & 0xFFFFFFFF

    def sentences(self, bag: Bag) -> np.ndarray:
        """Each sentence's probability."""
        if self.bias is None:
            return np.zeros(bag.count)
        sentence, feature = self.cells(bag)
        z = np.bincount(sentence, self.weights[feature], bag.count) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def score(self, text: str | None) -> tuple[float, int, float, int, int]:
        """Noisy-or of the whole text; its number of sentences; the worst one's probability and span."""
        bag = Bag(encode(text or ""))
        if not bag.count:
            return 0.0, 0, 0.0, 0, 0
        p = self.sentences(bag)
        worst = int(np.argmax(p))
        start, end = bag.spans()[worst]
        whole = -np.expm1(np.log1p(-np.minimum(p, 1 - 1e-15)).sum())
        return float(np.clip(whole, 0, 1)), bag.count, float(p[worst]), int(start), int(end)


def vocabulary(texts: list[str], toxic: np.ndarray, most: int = 20_000, least: int = 4) -> np.ndarray:
    """The `most` features by chi-square with the label among those in at least `least` texts."""
    keys, tally = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
    for at in range(0, len(texts), 200):
        part = [np.unique(np.concatenate(list(Bag(encode(x)).features()))) for x in texts[at : at + 200]]
        label = np.repeat(toxic[at : at + 200], [len(x) for x in part])
        both = np.concatenate([keys, *part])
        keys, where = np.unique(both, return_inverse=True)
        counts = np.stack([np.concatenate([tally[y], label == y]) for y in (0, 1)])
        tally = np.stack([np.bincount(where, c, len(keys)).astype(np.int64) for c in counts])
    n1, n0 = max(int(toxic.sum()), 1), max(int((1 - toxic).sum()), 1)
    often = (tally.sum(0) >= least) & (keys != 0)
    keys, tally = keys[often], tally[:, often]
    share = tally.sum(0) / (n0 + n1)
    gain = (tally[1] / n1 - tally[0] / n0) ** 2 / np.maximum(share * (1 - share), 1e-9)
    return np.sort(keys[np.argsort(-gain, kind="stable")[:most]])


def train(texts: list[str], toxic: np.ndarray, prior: float | None = None, rounds: int = 300, sparse: float = 0.3, rate_w: float = 1.0, rate_b: float = 3.0) -> Model:
    """Adagrad on the noisy-or log loss with an L1 penalty of `sparse` documents' weight. `prior` is the share of toxic documents outside
    the sample; the two kinds are weighted to it."""
    toxic = np.asarray(toxic, np.int64)
    if not len(texts) or toxic.min() == toxic.max():
        return Model(np.zeros(0, np.uint64), np.zeros(0), None)
    model = Model(vocabulary(texts, toxic), np.zeros(0), -6.0)
    cells, sizes, docs, n = [], [], [], 0
    for i, text in enumerate(texts):
        bag = Bag(encode(text))
        sentence, feature = model.cells(bag)
        cells.append((sentence + n, feature))
        n += bag.count
        sizes.append(bag.count)
    sentence, feature = (np.concatenate(x) for x in zip(*cells))
    docs = np.repeat(np.arange(len(texts)), sizes)
    rate = toxic.mean()
    prior = rate if prior is None else min(max(prior, 0.02), 0.98)
    weight = np.where(toxic == 1, prior / rate, (1 - prior) / (1 - rate)) / len(texts)
    w, b = np.zeros(len(model.keys)), -6.0
    gw, gb = np.full(len(w), 1e-8), 1e-8
    for _ in range(rounds):
        z = np.clip(np.bincount(sentence, w[feature], n) + b, -60, 60)
        p = 1 / (1 + np.exp(-z))
        s = np.maximum(np.bincount(docs, np.logaddexp(0, z), len(texts)), 1e-9)  # -log of the chance of no toxic sentence
        slope = np.where(toxic == 1, -1 / np.expm1(np.minimum(s, 50)), 1.0) * weight
        dz = p * slope[docs]
        dw, db = np.bincount(feature, dz[sentence], len(w)), dz.sum()
        gw += dw**2
        gb += db**2
        step = rate_w / np.sqrt(gw)
        w -= step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse / len(texts), 0)  # most features end at 0
        b -= rate_b * db / np.sqrt(gb)
    keep = w != 0
    return Model(model.keys[keep], w[keep], float(b))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500) -> Model:
    """Train on a bounded sample: of at most `per_class` ids of each label (doc_id, toxic), chosen by a hash, at most `per_class`
    different texts and SAMPLE_BYTES reach the driver. Contradicting labels of one document count as toxic."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id", F.lit(29)), "doc_id"]
    chosen = [known.where(F.col("toxic") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    wanted = chosen[0].union(chosen[1])  # at most 2 * per_class rows
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    rows = sorted(tuple(r) for r in bounded_sample(found, "toxic", per_class).select("text", "toxic").collect())
    return train([text for text, _ in rows], np.array([toxic for _, toxic in rows]), sizes.get(1, 0) / max(sum(sizes.values()), 1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """row (a struct of all columns of docs), score, sentences, worst, worst_start and worst_end (bytes of the
    lower-cased text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most 20,000 weights
    plain = packed(docs, "text")
    kinds = {"score": DoubleType(), "sentences": LongType(), "worst": DoubleType(), "worst_start": LongType(), "worst_end": LongType()}
    schema = StructType([plain.schema["row"], *(StructField(n, t) for n, t in kinds.items())])

    def scored(batches):
        own = held.value
        for batch in batches:
            rows = [own.score(x.as_py()) for x in batch.column(1)]
            more = [pa.array([r[i] for r in rows], pa.float64() if isinstance(t, DoubleType) else pa.int64()) for i, t in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["row", *kinds])

    return plain.mapInArrow(scored, schema)


def toxic_sentences(docs: DataFrame, model: Model, at_least: float = 0.5) -> DataFrame:
    """One row for each offending sentence: doc_id, sentence (its number), start, end (bytes of the
    lower-cased text), words and probability."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def located(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = encode(text.as_py() or "")
                bag = Bag(data)
                if not bag.count:
                    continue
                p, spans = held.value.sentences(bag), bag.spans()
                out += [(doc_id.as_py(), int(j), int(spans[j, 0]), int(spans[j, 1]), data[spans[j, 0] : spans[j, 1]].decode("utf-8", "replace"), float(p[j])) for j in np.flatnonzero(p >= at_least)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["doc_id", "sentence", "start", "end", "words", "probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(located, "doc_id long, sentence long, start long, end long, words string, probability double")


def learnable(doc_id: Column) -> Column:
    return fold_of(doc_id, 5) != 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = score(docs.select("doc_id", "text"), fit(docs, labels.where(learnable(F.col("doc_id")))))
    doc_id = F.col("row.doc_id")
    return found.select(doc_id.alias("doc_id"), (~learnable(doc_id)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences", "worst", "worst_start", "worst_end")


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Pipeline stage: documents that score `limit` or more go; the others stay as they are."""
    return score(docs, fit(docs, labels.where(learnable(F.col("doc_id"))))).where(F.col("score") < limit).select("row.*")
