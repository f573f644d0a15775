"""Classify questions as columns and answer one as a DataFrame plan.

The classification is a set of column expressions, so a table of questions is classified in one pass like any other
data; `answer` turns one question over one table into operators.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, compare, filters, profile

#: Words that speak for a kind of question: a choice of this library.
KEYWORDS = {
    "aggregation": ("sum", "total", "average", "mean", "count", "how many", "maximum", "minimum", "max", "min", "median", "add up"),
    "lookup": ("what is", "find", "show", "get", "look up", "which", "where", "value of", "details"),
    "summarization": ("summarize", "summary", "overview", "describe", "insights", "key points", "highlights"),
    "comparison": ("compare", "versus", "vs", "difference", "between", "higher than", "lower than", "change from", "growth"),
}
#: The function that a question asks for, by the first pattern that occurs; else a sum (fixed values).
FUNCTIONS = (
    ("sum", r"\b(sum|total)\b"),
    ("average", r"\b(average|avg|mean)\b"),
    ("count", r"\b(count|how many|number of)\b"),
    ("min", r"\b(min|minimum|lowest|smallest)\b"),
    ("max", r"\b(max|maximum|highest|largest|biggest)\b"),
    ("median", r"\b(median)\b"),
)


def _hits(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [text.rlike(rf"\b{re.escape(w)}\b").cast("double") for w in words])


def classify(questions: DataFrame, text: str = "question") -> DataFrame:
    """kind and confidence: keyword hits of each kind, with a boost for its leading phrase, as a share of all. Ties go
    to aggregation, lookup, summarization, comparison in that order; without a hit it is a lookup at 0.25."""
    low = F.lower(F.col(text))
    boost = {
        "aggregation": low.rlike(r"\b(sum|total|average|count|how many|median|maximum|minimum)\b"),
        "lookup": low.rlike(r"^(find|show|get|look up)\b"),
        "summarization": low.rlike(r"^(summari[sz]e|describe|give .*(summary|overview))"),
        "comparison": low.rlike(r"^compare\b|\b(vs|versus)\b"),
    }
    scores = {k: _hits(low, w) + F.when(boost[k], 1.5).otherwise(0.0) for k, w in KEYWORDS.items()}
    out = questions.withColumns({f"_{k}": s for k, s in scores.items()})
    best, total = F.greatest(*[F.col(f"_{k}") for k in scores]), reduce(lambda a, b: a + b, [F.col(f"_{k}") for k in scores])
    kind = reduce(lambda w, k: w.when(F.col(f"_{k}") == best, k), list(scores)[1:], F.when(F.col("_aggregation") == best, "aggregation"))
    out = out.withColumn("kind", F.when(total == 0, "lookup").otherwise(kind)).withColumn("confidence", F.round(F.when(total == 0, 0.25).otherwise(best / total), 6))
    return out.withColumn("function", reduce(lambda w, f: w.when(low.rlike(f[1]), f[0]), FUNCTIONS[1:], F.when(low.rlike(FUNCTIONS[0][1]), FUNCTIONS[0][0])).otherwise("sum")).drop(*[f"_{k}" for k in scores])


def mentioned(question: str, columns: list[str]) -> list[str]:
    """Columns named in the question, where they stand, longer names first."""
    low, found = question.lower(), []
    for c in sorted(columns, key=len, reverse=True):
        if m := re.search(rf"(?<![a-z0-9_]){re.escape(c.lower())}(?![a-z0-9_])", low):
            found.append((m.start(), c))
            low = low[: m.start()] + "\0" * len(c) + low[m.end() :]
    return [c for _, c in sorted(found)]


def answer(df: DataFrame, question: str) -> DataFrame:
    """The plan for one question over one table: `where` clauses joined by `and`, a trailing `by column` as groups."""
    kind, function = df.sparkSession.sql("SELECT :q AS question", args={"q": question}).transform(classify).select("kind", "function").first()
    body, _, where = question.partition(" where ")
    clauses = [c for part in re.split(r"\s+and\s+", where.rstrip("?. ")) if where and (c := filters.parse_filter(part, df.columns))]
    by = [m[1]] if (m := re.search(r"\bby ([A-Za-z0-9_]+)", body)) and m[1] in df.columns else None
    named = [c for c in mentioned(body, df.columns) if c not in (by or [])]
    numeric = [c for c, t in df.dtypes if t in filters.NUMERIC]
    if kind == "aggregation":
        return aggregate.aggregate(df, function, (named or numeric)[0], clauses, by)
    kept = filters.apply_filters(df, clauses)
    if kind == "summarization":
        return profile.profile(kept, named or None)
    if kind == "comparison" and (m := re.search(r"compare (\S+) (?:and|vs|versus|with|to) (\S+)", body, re.I)):
        text = [c for c, t in df.dtypes if t == "string"]
        a, b = (reduce(lambda x, y: x | y, [F.lower(F.col(c)) == v.lower() for c in text]) for v in m.groups())
        return compare.compare(kept, [c for c in named if c in numeric] or numeric, a, b)
    value = re.search(r"(?:for|of|named|called)\s+['\"]?([^'\"?]+)['\"]?\s*\??$", body)
    return filters.lookup(kept, value[1].strip(), (named or [None])[0]) if value else kept.limit(10)
