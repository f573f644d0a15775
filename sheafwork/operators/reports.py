"""Statistics, admission, preferences, citations and other reports over keyed metadata.

All of them are one aggregation (combined map-side) or one equi-join; null keys form a group of their own, and an
empty table gives an empty result, or one row of zeros where the report is over the whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import decay
from ..functions.text import normal_query

#: Parts of names that make a column a likely key (fixed values).
KEY_PARTS = ("id", "date", "month", "year", "quarter", "week", "category", "name", "region", "department", "product")

#: Words of a question that ask for a kind of data (patterns).
TYPE_WORDS = {"date": r"\b(when|date|day|week|month|quarter|year)s?\b", "number": r"\b(how many|sum|total|average|count|amount|price|cost|revenue)\b", "text": r"\b(who|name|title|text|description)s?\b"}


def chunk_statistics(df: DataFrame, chunk: str, file: str, strategy: str, start: str, end: str) -> DataFrame:
    """Distinct chunks and files, versions and mean rows, for each strategy and (with a null strategy) for all."""
    return df.rollup(strategy).agg(F.count_distinct(chunk).alias("chunks"), F.count_distinct(file).alias("files"), F.count("*").alias("versions"), F.avg(F.col(end) - F.col(start)).alias("mean_rows"))


def index_statistics(df: DataFrame, status: str, at: str) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"), F.max(at).alias("latest"))


def top_preferences(df: DataFrame, file: str, at: str, reference: Column, n: int = 10, days: int = 7) -> DataFrame:
    """The n files chosen most often, with how often in the last days; ties by key."""
    recent = F.col(at) >= reference - F.expr(f"INTERVAL {days} DAYS")
    return df.groupBy(file).agg(F.count("*").alias("chosen"), F.count_if(recent).alias("recent")).orderBy(F.desc("chosen"), file).limit(n)


def majority(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent non-null value of each group, ties to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def expired_counts(df: DataFrame, by: str, at: str, reference: Column, days: int) -> DataFrame:
    """Rows and those older than the retention, by group; a null time never expires."""
    old = F.col(at) < reference - F.expr(f"INTERVAL {days} DAYS")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(old).alias("expired"))


def retained(df: DataFrame, at: str, reference: Column, days: int) -> DataFrame:
    """Rows within the retention; the bound stays a comparison of the column itself, so it reaches the scan."""
    return df.where(F.col(at).isNull() | (F.col(at) >= reference - F.expr(f"INTERVAL {days} DAYS")))


def admission(cost: Column, files: Column, rows: Column, max_cost: float, max_files: int | None = None, max_rows: int | None = None) -> Column:
    """The first limit that is exceeded (cost, files, rows), null within all of them."""
    reason = F.when(cost > max_cost, "cost")
    reason = reason.when(files > max_files, "files") if max_files else reason
    return reason.when(rows > max_rows, "rows") if max_rows else reason


def usage_statistics(df: DataFrame, by: str, cost: str, rejected: Column, high: float) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(cost).alias("mean_cost"), F.max(cost).alias("max_cost"), F.count_if(rejected).alias("rejected"), F.count_if(F.col(cost) > high).alias("high"))


def needs_clarification(hits: DataFrame, question: str, score: str, least: float = 0.7, apart: float = 0.05) -> DataFrame:
    """For each question: best and second score, and whether to ask back: below `least`, or the two nearer than
    `apart`. Only two rows of a question pass the shuffle from each task."""
    place = F.row_number().over(Window.partitionBy(question).orderBy(F.desc(score)))
    top = hits.where(F.col(score).isNotNull()).select(question, score, place.alias("_r")).where("_r <= 2")
    out = top.groupBy(question).agg(F.max(F.when(F.col("_r") == 1, F.col(score))).alias("best"), F.max(F.when(F.col("_r") == 2, F.col(score))).alias("second"))
    return out.withColumn("clarify", (F.col("best") < least) | F.coalesce(F.col("best") - F.col("second") < apart, F.lit(False)))


def preference_matches(stored: DataFrame, query: str, text: str, at: str, reference: Column, least: float = 0.7, n: int = 10) -> DataFrame:
    """Stored questions at least `least` similar to a new one, by similarity times decay. Lengths that rule a text
    out are compared before any distance. Empty texts equal each other only."""
    wanted = F.lit(" ".join(query.lower().split()))
    known = normal_query(F.col(text))
    longest = F.greatest(F.length(known), F.length(wanted), F.lit(1))
    close = stored.where(F.least(F.length(known), F.length(wanted)) >= least * longest)
    scored = close.withColumn("similarity", 1 - F.levenshtein(known, wanted) / longest).where(F.col("similarity") >= least)
    return scored.withColumn("score", F.col("similarity") * decay(F.col(at), reference)).orderBy(F.desc("score"), text, at).limit(n)


def legacy_confidence(data: Column, semantic: Column, ambiguity: Column, selection: Column) -> Column:
    return 0.4 * data + 0.3 * semantic + 0.2 * ambiguity + 0.1 * selection


def date_match(found: Column, wanted: Column, kind: Column) -> Column:
    """1 for the same year, month, quarter or day; .5 for the month of another year; within 7 days (a date) or 30
    (relative) 1 falls to .5 in a line. 0 where a date is missing."""
    same_year, same_month = F.year(found) == F.year(wanted), F.month(found) == F.month(wanted)
    apart = F.abs(F.datediff(found, wanted))
    near = lambda days: F.when(apart <= days, 1 - apart / days * 0.5)
    score = (
        F.when(kind == "year", same_year.cast("double"))
        .when(kind == "month", F.when(same_year & same_month, 1.0).when(same_month, 0.5))
        .when(kind == "quarter", (same_year & (F.quarter(found) == F.quarter(wanted))).cast("double"))
        .when(kind == "date", near(7))
        .when(kind == "relative", near(30))
        .otherwise((apart == 0).cast("double"))
    )
    return F.coalesce(score, F.lit(0.0))


def date_label(value: Column, granularity: Column) -> Column:
    quarter = F.concat(F.lit("Q"), F.quarter(value).cast("string"), F.lit(" "), F.year(value).cast("string"))
    return F.when(granularity == "year", F.date_format(value, "yyyy")).when(granularity == "month", F.date_format(value, "MMMM yyyy")).when(granularity == "quarter", quarter).otherwise(F.date_format(value, "yyyy-MM-dd"))


def temporal_references(text: Column) -> Column:
    """Years and quarters that a text names, each once, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b((?:19|20)[0-9]{2}|Q[1-4])\b"), F.lit(1))))


def best_ranges(ranges: DataFrame, start: str, end: str, confidence: str) -> DataFrame:
    """One row for each (start, end): the one of most confidence, ties to the smallest row."""
    rest = [c for c in ranges.columns if c not in (start, end)]
    kept = F.min_by(F.struct(*rest), F.struct(-F.col(confidence), *[F.col(c) for c in rest])).alias("_r")
    return ranges.groupBy(start, end).agg(kept).select(start, end, "_r.*")


def common_values(catalogue: DataFrame, file: str, column: str) -> DataFrame:
    """Columns that every file has."""
    files = catalogue.agg(F.count_distinct(file).alias("_files"))  # one row
    held = catalogue.groupBy(column).agg(F.count_distinct(file).alias("files"))
    return held.join(F.broadcast(files), F.col("files") == F.col("_files")).select(column, "files")


def missing_columns(catalogue: DataFrame, file: str, column: str) -> DataFrame:
    """Each file with the columns that others have and it has not, sorted. The list of all column names is one row."""
    every = catalogue.where(F.col(column).isNotNull()).agg(F.collect_set(column).alias("_all"))
    own = catalogue.groupBy(file).agg(F.collect_set(column).alias("_own"))
    return own.join(F.broadcast(every)).select(file, F.array_sort(F.array_except("_all", "_own")).alias("missing"))


def alignment_quality(missing: DataFrame) -> DataFrame:
    """1 - files with missing columns / files; 0 without files."""
    return missing.agg(F.count("*").alias("files"), F.coalesce(1 - F.count_if(F.size("missing") > 0) / F.expr("nullif(count(*), 0)"), F.lit(0.0)).alias("quality"))


def is_key_name(column: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(column).contains(p) for p in KEY_PARTS])


def expected_types(question: Column) -> Column:
    """Kinds of data a question asks for, sorted."""
    return F.array_compact(F.array(*[F.when(F.lower(question).rlike(p), k) for k, p in TYPE_WORDS.items()]))


def comparison_table(df: DataFrame, label: str, file: str, value: str, index: str, files: list) -> DataFrame:
    """Labels x files: the value of the first matching row, null where a file lacks the label."""
    return df.groupBy(label).pivot(file, files).agg(F.min_by(value, index))


def citations(df: DataFrame, file: str, sheet: str) -> DataFrame:
    """One text for each file: `file (sheet, sheet)`, sheets once and sorted."""
    sheets = df.select(file, sheet).distinct().groupBy(file).agg(F.array_sort(F.collect_list(F.col(sheet).cast("string"))).alias("_s"))
    return sheets.select(file, F.concat(F.col(file).cast("string"), F.lit(" ("), F.array_join("_s", ", "), F.lit(")")).alias("citation"))


def with_latest(files: DataFrame, versions: DataFrame, key: str, version: str, values: list[str]) -> DataFrame:
    """Files, each with the values of its latest version, or nulls."""
    newest = versions.groupBy(key).agg(F.max_by(F.struct(version, *values), version).alias("_v")).select(key, "_v.*")
    return files.join(newest, key, "left")


def rated_at_least(rows: DataFrame, feedback: DataFrame, key: str, times: int = 2) -> DataFrame:
    """Rows whose key has that many feedback rows."""
    return rows.join(feedback.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= times), key, "left_semi")


def cached(docs: DataFrame, cache: DataFrame, key: str, text: str) -> DataFrame:
    """docs with `hit`: whether the cache holds this key with this very text (by its md5); its words are the cost."""
    known = cache.select(key, F.md5(F.col(text).cast("binary")).alias("_md5")).distinct().withColumn("_hit", F.lit(True))
    out = docs.withColumn("_md5", F.md5(F.col(text).cast("binary"))).join(known, [key, "_md5"], "left")
    words = F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))
    return out.withColumn("hit", F.coalesce("_hit", F.lit(False))).withColumn("words", words).drop("_md5", "_hit")


def subscribed(hooks: DataFrame, events: str, event: str) -> DataFrame:
    return hooks.where(F.array_contains(events, event))


def visible_templates(df: DataFrame, owner: str, user, shared: Column) -> DataFrame:
    """A user's own templates and the shared ones."""
    return df.where((F.col(owner) == user) | shared)


def pending_deliveries(df: DataFrame, attempts: str, created: str, key: str, most: int = 3, limit: int = 50) -> DataFrame:
    """The oldest deliveries with attempts left."""
    return df.where(F.col(attempts) < most).orderBy(created, key).limit(limit)


def last_known(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """`resolved`: the row's own value, or else the last one named before it under the same key."""
    return df.withColumn("resolved", F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def summary_text(profiles: DataFrame) -> DataFrame:
    """One sentence for each profiled column (see profile.profile)."""
    counts = F.format_string("%s: %s rows, %s missing, %s distinct", "column", "n", "missing", "distinct_values")
    numbers = F.when(F.col("kind") == "number", F.format_string(", from %s to %s", F.col("min").cast("string"), F.col("max").cast("string"))).otherwise("")
    return profiles.select("column", F.concat(counts, numbers).alias("sentence"))


def query_suggestions(profiles: DataFrame) -> DataFrame:
    """Questions that a column invites: totals and averages of numbers, lookups of text, groups of few categories."""
    number, few = F.col("kind") == "number", (F.col("kind") == "text") & (F.col("distinct_values") <= 10)
    asked = F.array_compact(F.array(F.when(number, "What is the total {}"), F.when(number, "What is the average {}"), F.when(few, "How many rows by {}"), F.when(~number, "Show {}")))
    return profiles.select("column", F.explode(asked).alias("q")).select("column", F.replace("q", F.lit("{}"), F.col("column")).alias("suggestion"))


def sheet_overview(name: str, df: DataFrame) -> DataFrame:
    """One text for a table: its name, rows and columns."""
    head = F.concat(F.lit(f"Sheet {name}: "), F.count("*").cast("string"), F.lit(f" rows, {len(df.columns)} columns: " + ", ".join(df.columns)))
    return df.agg(head.alias("overview"))


def collection(content_type: Column) -> Column:
    """The collection a text belongs to; unknown and null types are plain chunks."""
    return F.when(content_type == "pivot", "pivots").when(content_type == "chart", "charts").otherwise("chunks")
