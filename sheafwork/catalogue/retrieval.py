"""Chunks, vectors, BM25, fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunks, postings, retrieval, rows, staging, vector_lists
from . import tabular

QUERIES: dict[str, tuple] = {}


def register(name: str, table: str, sql: str | None = None):
    return tabular.register(name, table, sql, QUERIES)


_QUERY = [((7 * i) % 13 - 6) / 10.0 for i in range(64)]
_VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in _QUERY) + "]"
_COS = f"round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VEC}), 6)"


@register("vector_topk", "embeddings", f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(df):
    return retrieval.vector_topk(df, _QUERY, 20).select("vec_id", "score")


@register("vector_topk_filtered", "embeddings", f"SELECT vec_id, {_COS} AS score FROM embeddings WHERE label IN (1, 4) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(df):
    return retrieval.vector_topk(df, _QUERY, 10, F.col("label").isin(1, 4)).select("vec_id", "score")


@register("vector_diverse", "embeddings", f"WITH s AS (SELECT label, vec_id, {_COS} AS score FROM embeddings), b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) SELECT label, vec_id, score FROM b WHERE r = 1 ORDER BY score DESC, vec_id LIMIT 5")
def vector_diverse(df):
    from ..functions.vectors import cosine_to

    scored = df.select("label", "vec_id", F.round(cosine_to(F.col("embedding"), _QUERY), 6).alias("score"))
    return retrieval.diverse_topk(scored, "label", "vec_id", 5)


_TERMS = ["the", "and", "thing", "moron", "des"]
_TF = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(sorted(_TERMS)))
_N = len(_TERMS)
_IDF = [f"(ln(n - df{i} + 0.5) - ln(df{i} + 0.5))" for i in range(_N)]
_BM25 = f"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT doc_id, len(w) AS l, {_TF} FROM d),
s AS (SELECT count(*) AS n, avg(l) AS al, {', '.join(f'count(*) FILTER (tf{i} > 0) AS df{i}' for i in range(_N))} FROM t), m AS (SELECT *, ({' + '.join(_IDF)}) / {_N} AS mi FROM s)
SELECT doc_id, round({' + '.join(f'(CASE WHEN {_IDF[i]} < 0 THEN 0.25 * mi ELSE {_IDF[i]} END) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * l / al))' for i in range(_N))}, 6) AS score FROM t, m ORDER BY score DESC, doc_id LIMIT 20"""


@register("bm25_topk", "documents", _BM25)
def bm25_topk(df):
    return retrieval.bm25(df, _TERMS, 20)


@register("rrf_fusion", "embeddings", f"WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings QUALIFY r <= 30), b AS (SELECT vec_id, row_number() OVER (ORDER BY -{_COS} * (1 + vec_id % 7) DESC, vec_id) AS r FROM (SELECT vec_id, embedding FROM embeddings) e QUALIFY r <= 30) SELECT vec_id, round(sum(1.0 / (60 + r)), 9) AS rrf, round(least(1.0, 10 * round(sum(1.0 / (60 + r)), 9)), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) u GROUP BY vec_id ORDER BY rrf DESC, vec_id LIMIT 20")
def rrf_fusion(df):
    from ..functions.vectors import cosine_to

    scored = df.select("vec_id", F.round(cosine_to(F.col("embedding"), _QUERY), 6).alias("score"))
    first = scored.orderBy(F.desc("score"), "vec_id").limit(30)
    second = scored.select("vec_id", (-F.col("score") * (1 + F.col("vec_id") % 7)).alias("score")).orderBy(F.desc("score"), "vec_id").limit(30)
    return retrieval.rrf([first, second], "vec_id", 20)


@register("chunk_windows", "documents", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents), n AS (SELECT doc_id, max(i) + 1 AS n FROM l GROUP BY doc_id), k AS (SELECT doc_id, n, unnest(range(0, CASE WHEN n <= 5 THEN 1 ELSE CAST(ceil((n - 5) / 4.0) AS BIGINT) + 1 END)) AS chunk FROM n) SELECT k.doc_id, k.chunk, min(i) AS start_row, max(i) AS end_row, count(*) AS n_rows, md5(string_agg(line, chr(10) ORDER BY i)) AS content_md5 FROM k JOIN l ON l.doc_id = k.doc_id AND l.i >= k.chunk * 4 AND l.i < k.chunk * 4 + 5 GROUP BY k.doc_id, k.chunk")
def chunk_windows(df):
    """Lines of documents in windows of 5 that overlap by one."""
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_idx", "line"))
    out = chunks.chunk_rows(lines, "doc_id", "row_idx", F.col("line"), 5, 1)
    return out.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start_row").cast("long").alias("start_row"), F.col("end_row").cast("long").alias("end_row"), "n_rows", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@register("chunk_rows", "supplier", "WITH r AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, 's_suppkey: ' || s_suppkey || ', s_name: ' || s_name || ', s_nationkey: ' || s_nationkey AS t, count(*) OVER () AS n FROM supplier), k AS (SELECT unnest(range(0, CASE WHEN max(n) <= 50 THEN 1 ELSE CAST(ceil((max(n) - 50) / 45.0) AS BIGINT) + 1 END)) AS chunk FROM r) SELECT chunk, min(i) AS start_row, max(i) AS end_row, count(*) AS n_rows, md5(string_agg(t, chr(10) ORDER BY i)) AS content_md5 FROM k JOIN r ON i >= chunk * 45 AND i < chunk * 45 + 50 GROUP BY chunk")
def chunk_rows(df):
    numbered = rows.row_numbers(df, ["s_suppkey"]).withColumn("sheet", F.lit("supplier"))
    out = chunks.chunk_rows(numbered, "sheet", "row_idx", chunks.row_text(["s_suppkey", "s_name", "s_nationkey"]))
    return out.select(F.col("chunk").cast("long").alias("chunk"), "start_row", "end_row", "n_rows", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@register("column_summaries", "lineitem", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS least, max({c}) AS largest, round(avg({c}), 4) AS mean FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def column_summaries(df):
    return chunks.column_summaries(df, ["l_quantity", "l_extendedprice", "l_discount"], "lineitem").drop("content")


@register("first_hit_per_source", "documents", "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) t WHERE r <= 3")
def first_hit_per_source(df):
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    return ranked.where("r <= 3").select("source", "doc_id", "n_chars")


@register("bm25_index", "documents", _BM25)
def bm25_index(df):
    """The same ranking from the stored index, which is built once for a table's files."""
    return postings.PostingIndex.stored(df).search(_TERMS, 20)


@register("vector_lists", "embeddings", f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def vector_lists_topk(df):
    """The nearest found through stored lists; small tables have one list, so nothing is missed there."""
    index = vector_lists.VectorLists.build(df, staging.new_path(df.sparkSession, "vectors"))
    return index.search(_QUERY, 20).select("vec_id", "score")


_COLLECTIONS = " UNION ALL ".join(
    f"SELECT '{name}' AS collection, vec_id AS id, score FROM (SELECT vec_id, {_COS} AS score FROM embeddings WHERE label % 2 = {i} ORDER BY score DESC, vec_id LIMIT {k}) c{i}"
    for i, (name, k) in enumerate([("even", 10), ("odd", 5)])
)


@register("vector_collections", "embeddings", _COLLECTIONS)
def vector_collections(df):
    """Two collections searched together, each with its own number of hits."""
    own = {}
    for i, (name, k) in enumerate([("even", 10), ("odd", 5)]):
        own[name] = vector_lists.VectorLists.build(df.where(F.col("label") % 2 == i), staging.new_path(df.sparkSession, "vectors")), k
    return vector_lists.search_collections(own, _QUERY)


_STORED_CHUNKS = "SELECT doc_id, lang AS file_id, source AS extraction_strategy, text AS chunk_text, (n_chars % 100) / 100.0 AS quality_score, n_chars % 2 = 0 AS has_numbers, n_chars % 3 = 0 AS has_dates FROM documents"


def _stored_chunks(df):
    """Documents as stored chunks with metadata."""
    n = F.col("n_chars")
    flags = [(n % 2 == 0).alias("has_numbers"), (n % 3 == 0).alias("has_dates")]
    return df.select("doc_id", F.col("lang").alias("file_id"), F.col("source").alias("extraction_strategy"), F.col("text").alias("chunk_text"), (n % 100 / 100.0).alias("quality_score"), *flags)


@register("chunk_filters", "documents", f"SELECT doc_id, quality_score FROM ({_STORED_CHUNKS}) c WHERE file_id = 'en' AND chunk_text ILIKE '%THAT%' AND quality_score >= 0.3")
def chunk_filters(df):
    return _stored_chunks(df).where(chunks.chunk_condition(file_id="en", sheet_name="THAT", least_quality=0.3)).select("doc_id", "quality_score")


@register("analysis_filters", "documents", f"SELECT doc_id FROM ({_STORED_CHUNKS}) c WHERE has_numbers AND has_dates AND extraction_strategy = 'src3'")
def analysis_filters(df):
    return _stored_chunks(df).where(chunks.analysis_condition(["numbers", "dates", "words"], {"extraction_strategy": "src3"})).select("doc_id")


_STRATEGIES = (
    f"WITH e AS (SELECT file_id, extraction_strategy AS s, avg(quality_score) AS q FROM ({_STORED_CHUNKS}) c GROUP BY ALL), t AS (SELECT file_id, max(q) AS best, count(*) AS n, avg(q) AS mean FROM e GROUP BY 1) "
    "SELECT file_id, n AS strategies, min(s) AS best_strategy, round(min(best), 6) AS best_score, round(min(best - mean), 6) AS lead FROM e JOIN t USING (file_id) WHERE q = best GROUP BY file_id, n"
)


@register("strategy_comparison", "documents", _STRATEGIES)
def strategy_comparison(df):
    out = chunks.compare_strategies(_stored_chunks(df), "file_id", "extraction_strategy", "quality_score")
    return out.withColumn("best_score", F.round("best_score", 6)).withColumn("lead", F.round("lead", 6))
