"""Small awkward tables, and plain-Python definitions to hold results against."""

from __future__ import annotations

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators use inside; they must pass through or be ignored.
EXTRA = {"score": "x", "row": 1, "rank": 2, "hilbert": 3, "size": "y", "label": None, "sequence_id": 9, "_tie": 0, "rep": "z", "kept": True, "bound": 5}


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = "alpha beta gamma delta omega river stone cloud paper light seven green quiet motor ladder".split()
    return " ".join(r.choice(words) for _ in range(n)) + "."


def awkward_rows() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls everywhere, empty, blank and very long texts, repeated rows."""
    base = prose(1, 60)
    rows = [
        (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base, "en", None, None), (3, None, "en", "a", 0), (4, "", None, "b", 0), (5, " \n\t ", "en", "b", 3), (6, "one", "en", "b", 3),
        (None, prose(2, 40), "en", "a", 1), (None, None, None, None, None), (7, prose(3, 30_000), "en", "a", 9), (8, "....!!!", "fr", "c", 7), (9, "été déjà là où être garçon naïf cœur", "fr", "c", 7),
        (10, base.replace("alpha", "ALPHA"), "en", "c", 1), (11, "日本語 テキスト", "ja", "c", 3), (12, "a\x00b  c\r\n\x0b d", "en", "c", 9),
    ]
    return rows + [(100 + i, prose(50 + i, 30 + i), "en" if i % 2 else "fr", f"s{i % 3}", i) for i in range(12)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, extra: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()]) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(doc_id) -> bytes:
    return b"" if doc_id is None else str(doc_id).encode()
