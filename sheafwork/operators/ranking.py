"""File and sheet scores, decisions, answer confidence, quality and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import recency


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def name_overlap(name: Column, query: str) -> Column:
    """Share of the query's words found among a name's words."""
    wanted = F.array(*[F.lit(w) for w in sorted(set(query.lower().split()))])
    return F.size(F.array_intersect(F.split(F.lower(name), r"[_\-\s.]+"), wanted)) / F.size(wanted)


def temporal_boost(name: Column, references: list[str], each: float = 0.1, most: float = 0.2) -> Column:
    hits = sum([F.lower(name).contains(r.lower()).cast("int") for r in references], F.lit(0))
    return F.least(F.lit(most), hits * each)


def file_scores(files: DataFrame, query: str, references: list[str] = ()) -> DataFrame:
    """score = .5 semantic + .3 name overlap + .2 preference + temporal boost, at most 1; under .2 rejected."""
    score = 0.5 * F.col("semantic") + 0.3 * name_overlap(F.col("file_name"), query) + 0.2 * F.col("preference") + temporal_boost(F.col("file_name"), list(references))
    return files.withColumn("score", F.round(clamp(score), 6)).withColumn("rejected", F.col("score") < 0.2)


def legacy_file_scores(files: DataFrame, reference: Column) -> DataFrame:
    """.4 date match + .3 path match + .3 recency."""
    return files.withColumn("score", F.round(0.4 * F.col("date_match") + 0.3 * F.col("path_match") + 0.3 * recency(F.col("modified_time"), reference), 6))


def file_decision(scored: DataFrame) -> DataFrame:
    """The best file: automatic over .9, clarify from .5 with the top three, else low."""
    top = scored.where(~F.col("rejected")).orderBy(F.desc("score"), "file_id").limit(3)
    out = top.agg(F.max("score").alias("best"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "file_id"))), lambda r: r["file_id"]).alias("candidates"))
    return out.withColumn("action", F.when(F.col("best") > 0.9, "auto").when(F.col("best") >= 0.5, "clarify").otherwise("low_confidence"))


def sheet_scores(sheets: DataFrame, query: str, types: list[str] = ()) -> DataFrame:
    """score = .3 name + .4 headers + .2 data types + .1 content over (sheet_name, headers, data_types, content)."""
    words = F.array(*[F.lit(w) for w in sorted({w for w in query.lower().split() if len(w) > 2})])
    named = F.when(F.lit(query.lower()).contains(F.lower("sheet_name")), 1.0).otherwise(name_overlap(F.col("sheet_name"), query))
    headers = F.size(F.filter("headers", lambda h: F.exists(words, lambda w: F.lower(h).contains(w)))) / F.greatest(F.size("headers"), F.lit(1))
    wanted = F.array(*[F.lit(t) for t in types]) if types else F.array().cast("array<string>")
    kinds = F.when(F.size(wanted) == 0, 0.5).otherwise(F.size(F.array_intersect("data_types", wanted)) / F.size(wanted))
    score = 0.3 * named + 0.4 * headers + 0.2 * kinds + 0.1 * F.col("content")
    return sheets.withColumn("score", F.round(clamp(score), 6))


def sheet_decision(scored: DataFrame) -> DataFrame:
    """multi over one sheet above .7, auto with one, clarify under .5, else moderate."""
    out = scored.agg(F.count_if(F.col("score") > 0.7).alias("strong"), F.max("score").alias("best"))
    return out.withColumn("action", F.when(F.col("strong") > 1, "multi_sheet").when(F.col("strong") == 1, "auto").when(F.col("best") < 0.5, "clarify").otherwise("moderate"))


def answer_confidence(file: Column, sheet: Column, skipped_share: Column, warnings: Column) -> Column:
    """.4 file + .3 sheet + .3 data, where data = 1 - .3 skipped share - min(.05 warnings, .2)."""
    data = clamp(1 - 0.3 * skipped_share - F.least(0.05 * warnings, F.lit(0.2)))
    return 0.4 * file + 0.3 * sheet + 0.3 * data


def quality_score(completeness: Column, clarity: Column, headers: Column, data: Column, errors: Column) -> Column:
    return clamp(0.25 * (headers.cast("double") + data.cast("double") + completeness + clarity) - F.least(0.1 * errors, F.lit(0.5)))


def quality_issues(completeness: Column, clarity: Column, headers: Column, errors: Column) -> Column:
    return F.array_compact(F.array(F.when(completeness < 0.5, "low completeness"), F.when(clarity < 0.3, "unclear structure"), F.when(~headers, "no headers"), F.when(errors > 0, "extraction errors")))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Filled cells / all cells, and clarity = min(columns / 20, 1), over all rows in one scan."""
    filled = [F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")) for c in columns]
    cells = sum(filled[1:], filled[0])
    return df.agg((cells / F.greatest(F.count("*") * len(columns), F.lit(1))).alias("completeness")).withColumn("clarity", F.lit(min(len(columns) / 20, 1.0)))


def query_cost(files: Column, rows: Column, complexity: Column, has_filters: Column) -> Column:
    """A linear model: 1 + 10 for each file + 0.001 for each row, times complexity, times 0.8 with filters."""
    return (1 + 10 * files + 0.001 * rows) * complexity * F.when(has_filters, 0.8).otherwise(1.0)
