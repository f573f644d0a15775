"""Vector bin packing of token pieces into training sequences.

Every piece asks for tokens, segments and loss-bearing tokens at once, and every sequence has a limit on each.
The open sequence takes, of all pieces that still fit, the one whose demand has the largest dot product with
what is left of the limits, until none fits. Documents are cut into full sequences and one tail first. A document may have a
prompt whose ids bear no loss, as in instruction data: `exchanges` makes such rows of conversations.

Documents are dealt to groups of about GROUP by a hash of their place in the input, so that no id, source or
text can fill a group; each group packs its own tails, at the price of one part-filled sequence. Null and empty
texts have only the closing id. Repeated rows are packed each on its own. An empty table gives no piece; extra
columns are ignored. Very long texts are encoded whole and cut into full sequences.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_table, table
from .tokens import RANKS, encoder

#: Plain documents have as many segments as ids at most, so that short texts fill sequences; instruction data takes INSTRUCTION_SEGMENTS.
LENGTH, SEGMENTS, INSTRUCTION_SEGMENTS, GROUP = 1024, 1024, 64, 4096


def pack_vectors(demands: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of `demands` (non-negative whole numbers, none over its limit) its bin and its place there.

    Rows alike are one kind with a count, so the cost of a step follows the number of kinds, not of rows.
    """
    demands, top = np.asarray(demands, np.int64), np.asarray(limits, np.int64)
    if (demands > top).any():
        raise ValueError("a piece is over a limit")
    kinds, which, left = np.unique(demands, axis=0, return_inverse=True, return_counts=True)
    rows = np.split(np.argsort(which.reshape(-1), kind="stable"), np.cumsum(left)[:-1])
    share = kinds / top
    bins, places = np.zeros(len(demands), np.int64), np.zeros(len(demands), np.int64)
    number, room, place, todo = 0, top.copy(), 0, len(demands)
    while todo:
        fits = np.flatnonzero((left > 0) & (kinds <= room).all(1))
        if not len(fits):
            number, room, place = number + 1, top.copy(), 0
            continue
        best = fits[np.argmax(share[fits] @ (room / top))]
        left[best] -= 1
        row = rows[best][left[best]]
        bins[row], places[row] = number, place
        room, place, todo = room - kinds[best], place + 1, todo - 1
    return bins, places


def cut_points(total: int, quiet: int, length: int, loss: int) -> list[int]:
    """Where the pieces of a document end, by both limits; its first `quiet` ids and its last one bear no loss."""
    ends, at = [], 0
    while at < total:
        most = max(at, quiet) + loss
        at = min(at + length, total if most >= total - 1 else most)
        ends.append(at)
    return ends


def cut_documents(docs: DataFrame, length: int = LENGTH, loss: int = LENGTH, prompt: str | None = None, name: str = RANKS, end: int = 0) -> DataFrame:
    """doc_id, doc_tokens and for its pieces in order their sizes, losses and crcs (checksums)."""
    closing = end.to_bytes(4, "little")

    def cut(batches):
        own = encoder(name)
        for batch in batches:
            out = []
            for before, text in zip(batch.column(1), batch.column(2)):
                quiet = own.ids(before.as_py())
                ids, quiet = quiet + own.ids(text.as_py()) + closing, len(quiet) // 4
                total = len(ids) // 4
                ends = cut_points(total, quiet, length, loss)
                spans = list(zip([0, *ends], ends))
                bear = [max(0, min(b, total - 1) - max(a, quiet)) for a, b in spans]
                out.append((total, [b - a for a, b in spans], bear, [zlib.crc32(ids[4 * a : 4 * b]) for a, b in spans]))
            columns = [pa.array([r[i] for r in out], pa.list_(pa.int64()) if i else pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "doc_tokens", "sizes", "losses", "crcs"])

    before = (F.col(prompt) if prompt else F.lit(None)).cast("string").alias("prompt")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), before, F.col("text")).mapInArrow(cut, "doc_id long, doc_tokens long, sizes array<long>, losses array<long>, crcs array<long>")


def exchanges(conversations: DataFrame) -> DataFrame:
    """Instruction data from (conv_id, turn, role, text): for each assistant turn doc_id (its conversation), turn, prompt
    (the turn before it, null for the first) and text. A join on both keys: a long conversation fills no task.
    Repeated turns answer and are answered once for each different text."""
    turns = conversations.select(F.col("conv_id").alias("doc_id"), "turn", "role", "text").distinct()
    before = turns.groupBy("doc_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    return turns.where(F.col("role") == "assistant").join(before, ["doc_id", "turn"], "left").select("doc_id", "turn", "prompt", "text")


def pack(docs: DataFrame, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, prompt: str | None = None, name: str = RANKS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    A piece is one segment. The ids of the column `prompt`, which come before the text's, and the closing one bear no
    loss; all others do. A sequence holds at most `length` ids, `segments` pieces and `loss` ids that bear loss
    (`length` of them unless told otherwise); documents are cut by whichever is met first.
    """
    loss = length if loss is None else loss
    if min(length, segments, loss) < 1:
        raise ValueError("limits must be 1 or more")
    cut = stage_table(cut_documents(docs, length, loss, prompt, name).withColumn("_at", F.xxhash64(F.monotonically_increasing_id())), "packing")
    groups = max(1, math.ceil(cut.count() / GROUP))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def packed(key, t):
        order = np.lexsort((t["_at"].to_numpy(), t["doc_tokens"].to_numpy()))
        t = t.take(pa.array(order))
        tokens, crcs = t["doc_tokens"].to_numpy(), t["crcs"].combine_chunks()
        size, lossy = (t[c].combine_chunks().flatten().to_numpy() for c in ("sizes", "losses"))
        doc = np.repeat(np.arange(len(tokens)), np.diff(t["sizes"].combine_chunks().offsets.to_numpy()))
        start = np.cumsum(size) - size - (np.cumsum(tokens) - tokens)[doc]
        bins, places = np.arange(len(doc)), np.zeros(len(doc), np.int64)
        tails = np.flatnonzero(size < length)
        if len(tails):
            of, at = pack_vectors(np.stack([size[tails], np.ones(len(tails), np.int64), lossy[tails]], 1), (length, segments, loss))
            bins[tails], places[tails] = of + len(doc), at
        by = np.lexsort((places, bins))
        before = np.cumsum(size[by]) - size[by]
        first = np.r_[True, bins[by][1:] != bins[by][:-1]] if len(by) else np.zeros(0, bool)
        offset = np.zeros(len(doc), np.int64)
        offset[by] = before - np.maximum.accumulate(np.where(first, before, 0))
        sequence = np.unique(bins, return_inverse=True)[1] + (np.int64(key[0].as_py()) << 32)
        ids = t["doc_id"].combine_chunks().take(pa.array(doc))
        return pa.table([ids, *(pa.array(x, pa.int64()) for x in (start, size)), crcs.flatten(), *(pa.array(x, pa.int64()) for x in (tokens[doc], sequence, offset, lossy))], names=names)

    dealt = cut.withColumn("_group", F.pmod(F.col("_at"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(packed, ", ".join(f"{n} long" for n in names))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
