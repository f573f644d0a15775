"""Vector top-k, BM25, reciprocal-rank fusion, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_to


def vector_topk(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, id_column: str = "vec_id") -> DataFrame:
    """The k nearest by cosine after an optional metadata filter, ties by id: each task keeps its own k."""
    kept = vectors if where is None else vectors.where(where)
    scored = kept.withColumn("score", F.round(cosine_to(F.col("embedding"), query), 6)).where("score is not null")
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def diverse_topk(hits: DataFrame, group: str, id_column: str, k: int) -> DataFrame:
    """The best hit of each group, then the k best groups; a maximum by group, aggregated map-side."""
    best = hits.groupBy(group).agg(F.max(F.struct(F.col("score"), (-F.col(id_column)).alias("_id"))).alias("b"))
    return best.select(group, (-F.col("b._id")).alias(id_column), F.col("b.score").alias("score")).orderBy(F.desc("score"), id_column).limit(k)


def bm25(docs: DataFrame, terms: list[str], k: int, id_column: str = "doc_id", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25 of lower-case white-space words; idf below zero becomes epsilon times the mean idf of the terms.

    Only the query's terms are looked for in each text, all in one pass, so nothing is exploded and no word list is
    built; the corpus statistics are one row.
    """
    terms = sorted({t.lower() for t in terms})
    text, any_term = F.lower("text"), "|".join(rf"\Q{t}\E" for t in sorted(terms, key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(rf"(?<!\S)({any_term})(?!\S)"), F.lit(1))
    names, zeros = F.array(*[F.lit(t) for t in terms]), F.array(*[F.lit(0) for _ in terms])
    counts = F.aggregate(found, zeros, lambda done, word: F.transform(done, lambda n, i: n + (F.get(names, i) == word).cast("int")))
    # one generated row for each document: a plain projection would be repeated for every use of its columns
    once = F.explode(F.array(F.struct(F.regexp_count(text, F.lit(r"\S+")).alias("len"), counts.alias("tf"))))
    tf = docs.select(id_column, once.alias("r")).select(id_column, "r.len", *[F.col("r.tf")[i].alias(f"tf{i}") for i in range(len(terms))])
    # statistics and scores both read this exchange of thin rows: the texts are scanned once
    tf = tf.repartition(F.col(id_column))
    stats = tf.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    idf = [F.log(F.col("n") - F.col(f"df{i}") + 0.5) - F.log(F.col(f"df{i}") + 0.5) for i in range(len(terms))]
    mean = sum(idf[1:], idf[0]) / len(terms)
    stats = stats.select("n", "avg_len", mean.alias("mean_idf"), *[v.alias(f"idf{i}") for i, v in enumerate(idf)])
    joined = tf.join(F.broadcast(stats))
    part = lambda i: F.when(F.col(f"idf{i}") < 0, F.lit(epsilon) * F.col("mean_idf")).otherwise(F.col(f"idf{i}")) * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    score = sum([part(i) for i in range(1, len(terms))], part(0))
    return joined.select(id_column, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_column).limit(k)


def rrf(rankings: list[DataFrame], id_column: str, k: int, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank + 1) over top-k rankings (id, score), ranks from 0; the shown score is ten times
    that, at most 1. Windows run over top-k lists only."""
    parts = []
    for r in rankings:
        order = Window.orderBy(F.desc("score"), id_column)
        parts.append(r.select(id_column, (1.0 / (constant + F.row_number().over(order))).alias("part")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fused = out.groupBy(id_column).agg(F.round(F.sum("part"), 9).alias("rrf"))
    return fused.withColumn("score", F.round(F.least(F.lit(1.0), F.col("rrf") * 10), 6)).orderBy(F.desc("rrf"), id_column).limit(k)


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))
