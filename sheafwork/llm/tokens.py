"""Token ids of whole texts, and the exact length histogram.

Ids are those of a byte-level vocabulary from a public tokenizer file (a parameter; nothing is trained).
Texts are split before every single blank between two visible characters: this vocabulary's own splitting
pattern never joins anything across such a blank, so pieces can be encoded once and remembered.

Null texts are empty; repeated rows count each time; very long texts are encoded whole; extra columns are ignored; an empty table has an empty
histogram. Suffix sums go over the different lengths in one task: they are no more than the longest text has ids.
"""

from __future__ import annotations

import base64
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces remembered at once in a task (about 150 bytes each).
MEMORY = 400_000


#: The vocabulary's special tokens and their ids (fixed values).
SPECIAL = {"<|endoftext|>": 50256}

#: White space at either end, or two of it in a row.
_UNEVEN = re.compile(r"^\s|\s\s|\s\Z")


class _Known(dict):
    """Pieces to ids, emptied when MEMORY is reached; long pieces aren't kept."""

    def __init__(self, encode):
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self._encode(piece)).tobytes()
        if len(piece) < 64:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, name: str = RANKS, special: dict[str, int] | None = None):
        import public_tokenizers
        import tiktoken

        self._special = SPECIAL if special is None else special
        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._of = _Known(encode).__getitem__

    def ids(self, text: str | None) -> bytes:
        """The ids of a text, in which a special token's string is that token's id."""
        for token, number in self._special.items():
            if text and token in text:
                return number.to_bytes(4, "little").join(map(self.ids, text.split(token)))
        if not text:
            return b""
        if "\x00" not in text and not _UNEVEN.search(text):
            return b"".join(map(self._of, text.replace(" ", "\x00 ").split("\x00")))
        pieces = text.split(" ")
        # a blank beside white space or at either end belongs to a longer run: such pieces stay together
        joined = [pieces[0]]
        for piece in pieces[1:]:
            before = joined[-1]
            if piece and before and not piece[0].isspace() and not before[-1].isspace():
                joined.append(" " + piece)
            else:
                joined[-1] = before + " " + piece
        return b"".join(map(self._of, joined))


_encoder: dict[str, Encoder] = {}


def encoder(name: str = RANKS) -> Encoder:
    """The task's encoder, made once for each Python worker."""
    if name not in _encoder:
        _encoder[name] = Encoder(name)
    return _encoder[name]


def token_counts(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every whole text; null and empty texts have 0."""

    def counted(batches):
        own = encoder(name)
        for batch in batches:
            n = pa.array([len(own.ids(x.as_py())) // 4 for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """From n_tokens of each document, one row for each length that occurs:

    length, n_docs and n_tokens at that length; docs_longer (documents over it) and docs_upto; tokens_upto (of
    documents no longer); total_upto_limit, the corpus' tokens if every document is cut at that length (tokens_upto +
    length * docs_longer); share_upto, the documents' cumulative share, from which any quantile is read. The
    histogram is aggregated map-side and is as long as there are different lengths, not documents.
    An empty table gives no rows; null lengths count as 0.
    """
    bins = lengths.groupBy(F.coalesce(F.col("n_tokens"), F.lit(0)).alias("length")).agg(F.count("*").alias("n_docs"))
    bins = bins.withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    upto = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    out = bins.select("length", "n_docs", "n_tokens", F.coalesce(F.sum("n_docs").over(after), F.lit(0)).alias("docs_longer"), F.sum("n_docs").over(upto).alias("docs_upto"), F.sum("n_tokens").over(upto).alias("tokens_upto"))
    return out.withColumn("total_upto_limit", F.col("tokens_upto") + F.col("length") * F.col("docs_longer")).withColumn("share_upto", F.col("docs_upto") / (F.col("docs_upto") + F.col("docs_longer")))


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents over it, whole tokens and tokens left after cutting at it. Limits
    need not be lengths that occur; above the longest document nothing is cut, below the shortest all are."""
    context = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))]))
    sums = histogram.select("length", "n_docs", "n_tokens", context.alias("context"))
    over = F.col("length") > F.col("context")
    return sums.groupBy("context").agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.sum("n_tokens").alias("tokens"),
        F.sum(F.when(over, F.col("context") * F.col("n_docs")).otherwise(F.col("n_tokens"))).alias("tokens_cut"),
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least `share` of the documents don't exceed."""
    return histogram.where(F.col("share_upto") >= share).agg(F.min("length").alias("length"))


def op1_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_counts(table(spark, sf_dir, "documents")))
