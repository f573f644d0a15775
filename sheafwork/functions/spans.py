"""Spans of one language inside a text, with offsets, as a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Thai letters, marks and digits; ASCII letters; everything else.
_RUN = re.compile("(?P<th>[฀-๿]+)|(?P<en>[A-Za-z]+)|[^A-Za-z฀-๿]+")


def language_runs(text: str | None) -> Iterator[tuple[str, int, int, str]]:
    """(language, start, end, text): runs of one kind, blank ones left out, neighbours of one language joined by a blank.

    Offsets count characters of the whole text; a joined span runs from its first to its last character. Kinds are th, en and unknown.
    """
    language, start, end, parts = None, 0, 0, []
    for run in _RUN.finditer(text or ""):
        shown = run[0].strip()
        if not shown:
            continue
        of = run.lastgroup or "unknown"
        if of != language:
            if language:
                yield language, start, end, " ".join(parts)
            language, start, parts = of, run.start(), []
        parts.append(shown)
        end = run.end()
    if language:
        yield language, start, end, " ".join(parts)


@udtf(returnType="language string, span_start int, span_end int, span_text string", useArrow=True)
class LanguageSpans:
    """``SELECT doc_id, s.* FROM documents, LATERAL language_spans(text) s``: one pass over each text, a row for each span."""

    def eval(self, text: str):
        yield from language_runs(text)


def register(spark: SparkSession) -> None:
    spark.udtf.register("language_spans", LanguageSpans)
