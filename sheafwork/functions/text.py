"""Text: similarity, normal forms, keys, keywords, scripts, templates."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

#: Words that are no keywords of a text.
KEYWORD_STOPS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be",
    "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can",
)
#: Words that don't tell one question from another.
QUESTION_STOPS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "ought",
    "used", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "each", "few", "more", "most",
    "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "also", "now", "please", "show", "me",
    "tell", "give",
)
#: A letter, mark or digit of any script, or an underscore.
_WORD = r"\p{L}\p{M}\p{N}_"


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def columns_match(a: Column, b: Column, least: float = 0.85) -> Column:
    return (F.lower(a) == F.lower(b)) | (levenshtein_similarity(F.lower(a), F.lower(b)) >= least)


def normal_query(text: Column) -> Column:
    return F.trim(F.translate(F.regexp_replace(F.lower(text), r"\s+", " "), "?!.,;:", ""))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(text)), r"\s+"), lambda w: w != "")


def keywords(text: Column, least: int = 2) -> Column:
    """Lower-case words of at least `least` letters of any script that aren't stop words, in order, punctuation removed."""
    plain = F.transform(words(text), lambda w: F.regexp_replace(w, f"[^{_WORD}]", ""))
    return F.filter(plain, lambda w: (F.length(w) >= least) & ~w.isin(*KEYWORD_STOPS))


def cache_key(text: Column) -> Column:
    """32 hex digits that don't depend on case, punctuation, stop words or word order; letters of all scripts count."""
    plain = F.regexp_replace(F.lower(text), rf"[^{_WORD}\s.]", " ")
    kept = F.filter(F.split(plain, r"\s+"), lambda w: (w != "") & ~w.isin(*QUESTION_STOPS))
    return F.substring(F.sha2(F.array_join(F.array_sort(kept), " "), 256), 1, 32)


def normal_header(text: Column) -> Column:
    """Lower case, dashes and underscores as blanks, a trailing language mark (th, en) dropped."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[-_]+", " "), r"\s+", " "))
    return F.trim(F.regexp_replace(plain, r" \(?(th|en)\)?$", ""))


def normal_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_dashes(text: Column) -> Column:
    return F.regexp_replace(text, "[‐-―−]", "-")


def script_counts(text: Column) -> Column:
    """total (letters and digits of any script), thai and latin letters of a text; zeros for null."""
    count = lambda p: F.coalesce(F.length(F.regexp_replace(text, p, "")), F.lit(0)).cast("long")
    thai = r"[^\x{0E01}-\x{0E30}\x{0E32}\x{0E33}\x{0E40}-\x{0E46}\x{0E50}-\x{0E59}]"
    return F.struct(count(r"[^\p{L}\p{N}]").alias("total"), count(thai).alias("thai"), count(r"[^A-Za-z]").alias("latin"))


def language_of_counts(total: Column, thai: Column, latin: Column) -> Column:
    """th or en where its letters are over 0.7 of all, mixed where both are over 0.2, else the larger one; en without any."""
    t, a = thai / total, latin / total
    return F.when((total == 0) | total.isNull(), "en").when(t > 0.7, "th").when(a > 0.7, "en").when((t > 0.2) & (a > 0.2), "mixed").when(t > a, "th").otherwise("en")


def script_language(text: Column) -> Column:
    """th or en where its letters and digits are over 0.7 of all, mixed where both are over 0.2, else the larger one;
    en for texts without any."""
    counts = script_counts(text)
    return language_of_counts(counts["total"], counts["thai"], counts["latin"])


def script_spans(text: Column) -> Column:
    """Maximal runs of Thai or Latin letters with their blanks, in order, as an array of texts."""
    return F.regexp_extract_all(text, F.lit(r"([\x{0E00}-\x{0E7F}]+(?:\s+[\x{0E00}-\x{0E7F}]+)*|[A-Za-z0-9]+(?:\s+[A-Za-z0-9]+)*)"), F.lit(1))


def template_parameters(text: Column) -> Column:
    """Distinct names in double braces, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"), F.lit(1)))


def fill_template(text: Column, values: Column) -> Column:
    """Placeholders replaced from a map; null where a name is missing."""
    names = template_parameters(text)
    filled = F.aggregate(names, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"\{\{\s*"), n, F.lit(r"\s*\}\}")), F.regexp_replace(values[n], r"([\\$])", r"\\$1")))
    return F.when(F.forall(names, lambda n: F.map_contains_key(values, n)), filled)


def name_similarity(a: Column, b: Column) -> Column:
    """Column names: equal 1; equal without a trailing `_id` (a set of letters) 0.95; else the mean of the letter
    sets' overlap and the length ratio."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    strip = lambda c: F.rtrim(c, F.lit("_id"))
    sx, sy = F.array_distinct(F.filter(F.split(x, ""), lambda c: c != "")), F.array_distinct(F.filter(F.split(y, ""), lambda c: c != ""))
    overlap = F.size(F.array_intersect(sx, sy)) / F.greatest(F.size(F.array_union(sx, sy)), F.lit(1))
    ratio = F.least(F.length(x), F.length(y)) / F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.when(x == y, 1.0).when(strip(x) == strip(y), 0.95).otherwise((overlap + ratio) / 2)


def sequence_ratio(target: str):
    """A pandas UDF: Ratcliff-Obershelp similarity of each text with `target`, both in lower case. For distinct
    values only: Spark has no such function."""
    wanted = target.lower()

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        match = SequenceMatcher(autojunk=True)
        match.set_seq2(wanted)
        for values in batches:
            out = []
            for v in values:
                match.set_seq1((v or "").lower())
                out.append(match.ratio())
            yield pd.Series(out, dtype="float64")

    return ratio


def sorted_tokens(text: Column) -> Column:
    """Lower-case words in alphabetical order, for comparisons that ignore the order of words."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")), " ")


_DIFF = StructType([*(StructField(n, LongType()) for n in ("added", "removed", "unchanged")), StructField("similarity", DoubleType())])


def line_diff(old: Column, new: Column) -> Column:
    """A struct: added, removed and unchanged lines and the texts' line similarity (4 places)."""
    return F.pandas_udf(_line_diff, _DIFF)(old, new)


def _line_diff(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(old.fillna(""), new.fillna("")):
        x, y = a.split("\n"), b.split("\n")
        match = SequenceMatcher(None, x, y)
        same = sum(n for _, _, n in match.get_matching_blocks())
        rows.append((len(y) - same, len(x) - same, same, round(match.ratio(), 4)))
    return pd.DataFrame(rows, columns=["added", "removed", "unchanged", "similarity"])


def change_summary(old: Column, new: Column) -> Column:
    """How many lines were added, removed and modified, as a sentence; null texts count as empty."""
    return F.pandas_udf(_change_summary, "string")(old, new)


def _change_summary(old: pd.Series, new: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(old.fillna(""), new.fillna("")):
        count = dict.fromkeys(("insert", "delete", "replace"), 0)
        for tag, i, j, k, n in SequenceMatcher(None, a.split("\n"), b.split("\n")).get_opcodes():
            if tag != "equal":
                count[tag] += max(j - i, n - k)
        parts = [f"{n} line(s) {word}" for n, word in zip(count.values(), ("added", "removed", "modified")) if n]
        out.append(", ".join(parts) or "No changes detected")
    return pd.Series(out, dtype="object")
