"""Quality by weak supervision: rules vote good, bad or nothing; expectation-maximisation over the vote
patterns of *all* documents estimates each rule's accuracy in both classes; the posterior probability of
good, not the unanimity of the rules, keeps a document.

Only vote patterns and their counts reach the driver: with m rules at most 3^m rows, whatever the corpus.
Null and empty texts have no words: they fail the base rule and every count is 0. Repeated rows are judged
alike, each on its own. An empty table gives an empty result. Extra columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_table, table
from .words import Text, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Different words are counted in blocks of so many words, so that their share doesn't fall with a text's length.
DISTINCT_BLOCK = 1000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters", "n_stops", "n_bangs", "n_distinct", "n_marked", "n_alphas")


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of one whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    t = Text(data)
    b, n = t.bytes, len(t.starts)
    if not n:
        return (0,) * (len(COUNTS) + len(MORE))
    tally = np.bincount(b, minlength=256)
    blank = int(tally[9:14].sum() + tally[32])
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    keys = windows(t.hashes, 8)
    repeated = 0
    if len(keys):
        _, where, many = np.unique(keys, return_inverse=True, return_counts=True)
        if len(many) < len(keys):
            twice = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(many[where] > 1)
            np.add.at(twice, at, 1)
            np.add.at(twice, at + 8, -1)
            repeated = int((np.cumsum(twice)[:n] > 0).sum())
    marks = np.zeros(len(b) + 1, np.int64)
    np.cumsum(_SYMBOL[b], out=marks[1:])
    block = (np.arange(n) // DISTINCT_BLOCK).astype(np.uint64)
    distinct = len(np.unique(t.hashes + block * np.uint64(0x9E3779B97F4A7C15)))
    upper, letters = int(tally[65:91].sum()), int(tally[65:91].sum() + tally[97:123].sum())
    return (
        n, len(b) - int(tally[0x80:0xC0].sum()) - blank, int(tally[_SYMBOL].sum()), len(lines) - len(set(lines)), repeated,
        len(lines), upper, letters, int(tally[ord(".")] + tally[ord("?")]), int(tally[ord("!")]), distinct,
        int((marks[t.ends] > marks[t.starts]).sum()), letters + int(tally[0xC0:].sum()),
    )


def count_texts(docs: DataFrame) -> DataFrame:
    """doc_id with COUNTS and MORE of every whole text."""

    def counted(batches):
        for batch in batches:
            rows = [text_counts(x.as_py()) for x in batch.column(1)]
            cols = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS) + len(MORE))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *COUNTS, *MORE])

    schema = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS + MORE]])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(counted, schema)


def rule_votes() -> dict:
    """Each rule's vote as a column over COUNTS and MORE: 1 good, 0 bad, -1 abstains.

    Two rules know good prose and never vote bad; the others each know one kind of bad text, vote bad or
    abstain, and come in overlapping groups, from whose agreement the accuracies can be told.
    """
    words, lines, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "n_lines", "word_chars"))
    long_enough = F.col("n_words") >= 20
    symbols, marked, letters = F.col("n_symbols") / words, F.col("n_marked") / words, F.col("n_alphas") / chars
    capitals, bangs, stops = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1)), F.col("n_bangs") / words, F.col("n_stops") / words
    size, distinct, repeats = F.col("word_chars") / words, F.col("n_distinct") / words, F.col("n_repeat_words") / words

    def good(when):
        return F.when(when, 1).otherwise(-1)

    def bad(when):
        return F.when(when, 0).otherwise(-1)

    return {
        "prose": good(long_enough & size.between(2.5, 10) & (stops >= 0.01) & (capitals < 0.2) & (marked < 0.05) & (repeats < 0.5) & (bangs < 0.05)),
        "plain_letters": good(long_enough & (letters > 0.85) & (capitals < 0.2) & (distinct > 0.05)),
        "length": bad(~long_enough),
        "word_length": bad((size < 2) | (size > 14)),
        "symbols": bad(symbols > 0.1),
        "marked_words": bad(marked > 0.25),
        "letters": bad(letters < 0.75),
        "line_copies": bad(F.col("n_dup_lines") / lines > 0.3),
        "repeats": bad(repeats > 0.3),
        "capitals": bad(capitals > 0.4),
        "shouting": bad(bangs > 0.1),
        "no_sentences": bad(long_enough & (stops < 0.004)),
        "variety": bad(long_enough & (distinct < 0.1)),
    }


def fit_rules(patterns: list[tuple[int, ...]], counts: list[int], rounds: int = 200, prior: float = 0.8, false_alarm: float = 0.02) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: the posterior of good for each pattern, the outcome probabilities [class, rule,
    outcome (bad, good, abstains)] and the share of good.

    Rules start as better than chance with the given share of good, which fixes which class is which, and
    every count is smoothed by four votes spread as first believed, so that a rule that never votes stays
    harmless. A rule is taken to call at most `false_alarm` of the good documents bad: without that bound
    two classes can't hold several unlike kinds of bad documents, and rules that share one kind lose to the rest.
    """
    votes, n = np.array(patterns, np.int64).reshape(len(patterns), -1), np.array(counts, float)
    m = votes.shape[1]
    cell = np.where(votes < 0, 2, votes)
    for_good = (votes == 1).any(0)  # rules that vote good when they vote
    approves, alarms = [[[0.0, 0.1, 0.9]], [[0.0, 0.9, 0.1]]], [[[0.4, 0.0, 0.6]], [[0.01, 0.0, 0.99]]]  # [class bad, good][outcome]
    belief = np.where(for_good[None, :, None], approves, alarms) + 1e-3
    table_ = belief / belief.sum(2, keepdims=True)
    share = prior
    post = np.full(len(n), prior)
    rule = np.arange(m)
    for _ in range(rounds):
        logs = np.log(table_)[:, rule[None, :], cell].sum(2) + np.log([1 - share, share])[:, None]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        done, post = np.abs(new - post).max(initial=0) < 1e-9, new
        total = max(n.sum(), 1.0)
        share = float(np.clip((post @ n + 8) / (total + 10), 1e-4, 1 - 1e-4))
        weight = np.stack([(1 - post) * n, post * n])
        for k in range(3):
            table_[:, :, k] = weight @ (cell == k) + 4 * belief[:, :, k]
        table_ /= table_.sum(2, keepdims=True)
        alarm = np.minimum(table_[1, :, 0], false_alarm)
        table_[1, :, 1:] *= ((1 - alarm) / (1 - table_[1, :, 0]))[:, None]
        table_[1, :, 0] = alarm
        if done:
            break
    return post, table_, share


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, pattern, quality (posterior) and kept."""
    spark = docs.sparkSession
    rules = rule_votes()
    pattern = F.concat(*[(v + 1).cast("string") for v in rules.values()])
    counted = stage_table(count_texts(docs).withColumn("pattern", pattern), "quality")
    found = counted.groupBy("pattern").count().collect()  # at most 3^rules rows
    post, _, _ = fit_rules([tuple(int(x) - 1 for x in r["pattern"]) for r in found], [r["count"] for r in found]) if found else ([], None, None)
    model = spark.createDataFrame([(r["pattern"], float(p)) for r, p in zip(found, post)], "pattern string, quality double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.join(F.broadcast(model), "pattern").select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (F.col("quality") >= 0.5)).alias("kept"), "quality", "pattern")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
