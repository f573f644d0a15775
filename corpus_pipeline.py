"""The corpus pipeline: toxicity, language, near duplicates, source mixture, packing.

Each stage takes (spark, docs, sf_dir), works on every document that the stage before it kept, and returns the
columns of `documents`; the last returns the packed pieces. ``run`` writes each stage's rows as Parquet in the
shared folder and reads them again as the next one's input, so a lost executor never costs more than one stage.

Every stage takes null texts, languages, sources and ids, empty and very long texts, repeated rows and empty tables; columns beyond those of
`documents` pass through the first four stages whatever their names. What a stage does with them is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheafwork.llm import langid, mixing, ngram_join, packing, toxicity
from sheafwork.llm.common import stage_table, table


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a noisy-or toxicity of one half or more go.

    Null and empty texts have no sentences and stay; repeated rows share their text's fate; nothing is learnt, and nothing goes, without labels.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every language's centroids go.

    Null texts and texts without a letter are `und` and go; ties between centroids don't matter here; without any known language all go.
    """
    return langid.keep_identified(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Documents without a word, null texts among them, stay; a row repeated with id and text stays once; rows without an id come after those with one.
    """
    return ngram_join.keep_one(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture takes their source: some twice or more, some not at all.

    Null sources are one source; documents without a token follow their neighbours; rows with equal id and text stay together.
    """
    return mixing.mixed_documents(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; a null or empty text is its closing id alone, copies are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean_language),
    ("language_id", known_language),
    ("ngram_jaccard", distinct_documents),
    ("source_mixing", source_mixture),
    ("packing", packed_sequences),
]

#: The stages learn models, build signatures and pack by search: SQL can't express them. tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
