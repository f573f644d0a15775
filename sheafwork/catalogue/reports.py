"""Statistics, admission, preferences, citations and other reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import access, metrics, profile, reports, stores
from . import tabular

QUERIES: dict[str, tuple] = {}


def register(name: str, table: str, sql: str | None = None):
    return tabular.register(name, table, sql, QUERIES)


_END = "TIMESTAMP '2024-01-31 00:00:00'"


def _end():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@register("chunk_statistics", "lineitem", "SELECT l_returnflag, count(DISTINCT l_partkey) AS chunks, count(DISTINCT l_suppkey) AS files, count(*) AS versions, round(avg(l_quantity - l_linenumber), 6) AS mean_rows FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def chunk_statistics(df):
    return reports.chunk_statistics(df, "l_partkey", "l_suppkey", "l_returnflag", "l_linenumber", "l_quantity").withColumn("mean_rows", F.round("mean_rows", 6))


@register("index_statistics", "orders", "SELECT o_orderstatus, count(*) AS n, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS latest FROM orders GROUP BY o_orderstatus")
def index_statistics(df):
    return reports.index_statistics(df, "o_orderstatus", "o_orderdate").select("o_orderstatus", "n", _stamp("latest"))


@register("preference_stats", "events", f"SELECT user_id, count(*) AS chosen, count(*) FILTER (ts >= {_END} - INTERVAL 7 DAY) AS recent FROM events GROUP BY user_id ORDER BY chosen DESC, user_id LIMIT 10")
def preference_stats(df):
    return reports.top_preferences(df, "user_id", "ts", _end())


@register("preference_matches", "part", "WITH s AS (SELECT p_partkey, lower(p_name) AS t, DATE '2024-01-31' - CAST(p_size AS INTEGER) * 3 AS day, p_size * 3 AS days FROM part), d AS (SELECT *, 1 - levenshtein(t, 'red bolt') / CAST(greatest(length(t), 8) AS DOUBLE) AS similarity FROM s) SELECT p_partkey, round(similarity, 6) AS similarity, round(similarity * CASE WHEN days <= 30 THEN 1.0 ELSE greatest(0.1, pow(0.5, (days - 30) / 60.0)) END, 6) AS score FROM d WHERE similarity >= 0.7")
def preference_matches(df):
    """All matches (the limit is the table's size)."""
    stored = df.select("p_partkey", "p_name", F.date_sub(F.lit("2024-01-31").cast("date"), F.col("p_size").cast("int") * 3).alias("at"))
    out = reports.preference_matches(stored, "Red  Bolt", "p_name", "at", F.lit("2024-01-31").cast("date"), n=2**31 - 1)
    return out.select("p_partkey", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@register("majority_language", "documents", "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) t WHERE r = 1")
def majority_language(df):
    return reports.majority(df, "source", "lang")


@register("expired_counts", "events", f"SELECT event_type, count(*) AS n, count(*) FILTER (ts < {_END} - INTERVAL 14 DAY) AS expired FROM events GROUP BY event_type")
def expired_counts(df):
    return reports.expired_counts(df, "event_type", "ts", _end(), 14)


@register("retention", "events", f"SELECT event_id FROM events WHERE ts >= {_END} - INTERVAL 14 DAY")
def retention(df):
    return reports.retained(df, "ts", _end(), 14).select("event_id")


_LIMITS = "CASE WHEN o_totalprice > 200000 THEN 'cost' WHEN o_orderkey % 7 > 5 THEN 'files' WHEN o_custkey > 1000 THEN 'rows' END"


def _admitted(df):
    return df.withColumn("reason", reports.admission(F.col("o_totalprice"), F.col("o_orderkey") % 7, F.col("o_custkey"), 200000, 5, 1000))


@register("cost_admission", "orders", f"SELECT o_orderkey, {_LIMITS} AS reason FROM orders")
def cost_admission(df):
    return _admitted(df).select("o_orderkey", "reason")


@register("usage_stats", "orders", f"SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_cost, max(o_totalprice) AS max_cost, count(*) FILTER ({_LIMITS} IS NOT NULL) AS rejected, count(*) FILTER (o_totalprice > 150000) AS high FROM orders GROUP BY o_orderpriority")
def usage_stats(df):
    return reports.usage_statistics(_admitted(df), "o_orderpriority", "o_totalprice", F.col("reason").isNotNull(), 150000).withColumn("mean_cost", F.round("mean_cost", 4))


@register("clarification_needed", "events", "WITH t AS (SELECT user_id, value / 100 AS s, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events), b AS (SELECT user_id, max(s) FILTER (r = 1) AS best, max(s) FILTER (r = 2) AS second FROM t WHERE r <= 2 GROUP BY user_id) SELECT user_id, round(best, 6) AS best, round(second, 6) AS second, best < 0.7 OR coalesce(best - second < 0.05, false) AS clarify FROM b")
def clarification_needed(df):
    out = reports.needs_clarification(df.select("user_id", (F.col("value") / 100).alias("score")), "user_id", "score")
    return out.select("user_id", F.round("best", 6).alias("best"), F.round("second", 6).alias("second"), "clarify")


@register("legacy_confidence", "lineitem", "SELECT l_returnflag, round(avg(0.4 * (1 - l_discount) + 0.3 * (l_quantity / 50) + 0.2 * (1 - l_tax) + 0.1), 6) AS confidence FROM lineitem GROUP BY l_returnflag")
def legacy_confidence(df):
    score = reports.legacy_confidence(1 - F.col("l_discount"), F.col("l_quantity") / 50, 1 - F.col("l_tax"), F.lit(1.0))
    return df.groupBy("l_returnflag").agg(F.round(F.avg(score), 6).alias("confidence"))


_KINDS = ["year", "month", "quarter", "date", "relative"]
_KIND = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"


def _kind():
    return F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 5 + 1).cast("int"))


@register("date_match", "orders", f"WITH t AS (SELECT o_orderkey, o_orderdate AS d, {_KIND} AS k, abs(date_diff('day', DATE '1998-05-17', CAST(o_orderdate AS DATE))) AS apart FROM orders) SELECT o_orderkey, round(CASE k WHEN 'year' THEN CASE WHEN year(d) = 1998 THEN 1.0 ELSE 0.0 END WHEN 'month' THEN CASE WHEN month(d) = 5 AND year(d) = 1998 THEN 1.0 WHEN month(d) = 5 THEN 0.5 ELSE 0.0 END WHEN 'quarter' THEN CASE WHEN year(d) = 1998 AND quarter(d) = 2 THEN 1.0 ELSE 0.0 END WHEN 'date' THEN CASE WHEN apart <= 7 THEN 1 - apart / CAST(7 AS DOUBLE) * 0.5 ELSE 0.0 END ELSE CASE WHEN apart <= 30 THEN 1 - apart / CAST(30 AS DOUBLE) * 0.5 ELSE 0.0 END END, 6) AS score FROM t")
def date_match(df):
    return df.select("o_orderkey", F.round(reports.date_match(F.col("o_orderdate"), F.lit("1998-05-17").cast("date"), _kind()), 6).alias("score"))


@register("date_labels", "orders", f"SELECT o_orderkey, CASE {_KIND} WHEN 'year' THEN strftime(o_orderdate, '%Y') WHEN 'month' THEN strftime(o_orderdate, '%B %Y') WHEN 'quarter' THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS label FROM orders")
def date_labels(df):
    return df.select("o_orderkey", reports.date_label(F.col("o_orderdate"), _kind()).alias("label"))


@register("temporal_references", "orders", "SELECT o_orderkey, array_to_string(list_sort(list_distinct(['Q' || quarter(o_orderdate), CAST(year(o_orderdate) AS VARCHAR), CAST(year(o_orderdate) - o_orderkey % 2 AS VARCHAR)])), ',') AS refs FROM orders")
def temporal_references(df):
    year = F.year("o_orderdate")
    said = F.concat(F.lit("Sales in Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), year.cast("string"), F.lit(" against "), (year - F.col("o_orderkey") % 2).cast("string"))
    return df.select("o_orderkey", F.array_join(reports.temporal_references(said), ",").alias("refs"))


@register("best_ranges", "orders", "SELECT strftime(start, '%Y-%m-%d') AS start, strftime(stop, '%Y-%m-%d') AS stop, confidence, o_orderkey FROM (SELECT date_trunc('month', o_orderdate) AS start, date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS stop, o_totalprice AS confidence, o_orderkey, row_number() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) t WHERE r = 1")
def best_ranges(df):
    start = F.date_trunc("month", "o_orderdate")
    ranges = df.select(F.date_format(start, "yyyy-MM-dd").alias("start"), F.date_format(F.add_months(start, 1), "yyyy-MM-dd").alias("stop"), F.col("o_totalprice").alias("confidence"), "o_orderkey")
    return reports.best_ranges(ranges, "start", "stop", "confidence")


@register("common_columns", "events", "SELECT event_type, count(DISTINCT user_id) AS files FROM events GROUP BY event_type HAVING count(DISTINCT user_id) = (SELECT count(DISTINCT user_id) FROM events)")
def common_columns(df):
    """Users as files, event types as columns."""
    return reports.common_values(df, "user_id", "event_type")


_MISSING = "(SELECT conv_id, array_to_string(list_sort(list_filter((SELECT list(DISTINCT role) FROM conversations), lambda r: NOT list_contains(own, r))), ',') AS missing FROM (SELECT conv_id, list(DISTINCT role) AS own FROM conversations GROUP BY conv_id) t)"


@register("missing_columns", "conversations", f"SELECT * FROM {_MISSING} m")
def missing_columns(df):
    """Conversations as files, roles as columns."""
    return reports.missing_columns(df, "conv_id", "role").withColumn("missing", F.array_join("missing", ","))


@register("alignment_quality", "conversations", f"SELECT count(*) AS files, round(1 - count(*) FILTER (missing <> '') / CAST(count(*) AS DOUBLE), 6) AS quality FROM {_MISSING} m")
def alignment_quality(df):
    return reports.alignment_quality(reports.missing_columns(df, "conv_id", "role")).withColumn("quality", F.round("quality", 6))


@register("expected_types", "part", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'date' WHEN 2 THEN 'text' ELSE '' END AS types FROM part")
def expected_types(df):
    lead = F.element_at(F.array(*[F.lit(t) for t in ("How many ", "When did we ship ", "Who sold ", "Show ")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return df.select("p_partkey", F.array_join(reports.expected_types(F.concat(lead, "p_name")), ",").alias("types"))


_YEARS = list(range(1995, 2002))


@register("comparison_table", "orders", "SELECT o_orderpriority, " + ", ".join(f"min_by(o_totalprice, o_orderkey) FILTER (year(o_orderdate) = {y}) AS y{y}" for y in _YEARS) + " FROM orders GROUP BY o_orderpriority")
def comparison_table(df):
    out = reports.comparison_table(df.withColumn("file", F.year("o_orderdate")), "o_orderpriority", "file", "o_totalprice", "o_orderkey", _YEARS)
    return out.withColumnsRenamed({str(y): f"y{y}" for y in _YEARS})


@register("citations", "customer", "SELECT c_nationkey, c_nationkey || ' (' || string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) || ')' AS citation FROM customer GROUP BY c_nationkey")
def citations(df):
    return reports.citations(df, "c_nationkey", "c_mktsegment")


@register("files_with_latest", "", "SELECT c_custkey, o_orderdate, o_totalprice FROM (SELECT c_custkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o.o_orderkey DESC) AS r FROM customer LEFT JOIN orders o ON o_custkey = c_custkey) t WHERE r = 1")
def files_with_latest(read_):
    orders = read_("orders").withColumnRenamed("o_custkey", "c_custkey")
    out = reports.with_latest(read_("customer").select("c_custkey"), orders, "c_custkey", "o_orderkey", ["o_orderdate", "o_totalprice"])
    return out.select("c_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_totalprice")


@register("rated_chunks", "", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) >= 2)")
def rated_chunks(read_):
    feedback = read_("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return reports.rated_at_least(read_("customer").select("c_custkey"), feedback, "c_custkey")


@register("cached_embeddings", "documents", "SELECT lang, doc_id % 3 <> 0 AND doc_id % 7 <> 0 AS hit, count(*) AS n, CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))) AS BIGINT) AS words FROM documents GROUP BY ALL")
def cached_embeddings(df):
    """The cache lacks every third document and holds another text of every seventh; words of misses are the cost."""
    cache = df.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return reports.cached(df, cache, "doc_id", "text").groupBy("lang", "hit").agg(F.count("*").alias("n"), F.sum("words").alias("words"))


@register("subscriptions", "customer", "SELECT c_custkey FROM customer WHERE c_custkey % 4 > 1")
def subscriptions(df):
    kinds = F.array(F.lit("query"), F.when(F.col("c_custkey") % 4 > 1, "export").otherwise("index"))
    return reports.subscribed(df.withColumn("events", kinds), "events", "export").select("c_custkey")


@register("visible_templates", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderstatus = 'P'")
def visible_templates(df):
    return reports.visible_templates(df, "o_custkey", 7, F.col("o_orderstatus") == "P").select("o_orderkey")


@register("pending_deliveries", "orders", "SELECT o_orderkey, least(pow(2, o_orderkey % 5), 30.0) AS delay FROM orders WHERE o_orderkey % 5 < 3 ORDER BY o_orderdate, o_orderkey LIMIT 50")
def pending_deliveries(df):
    out = reports.pending_deliveries(df.withColumn("attempts", F.col("o_orderkey") % 5), "attempts", "o_orderdate", "o_orderkey")
    return out.select("o_orderkey", stores.retry_delay(F.col("attempts") + 1).alias("delay"))


@register("audit_denied", "events", "SELECT event_id FROM events WHERE value > 50 AND ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, event_id LIMIT 100")
def audit_denied(df):
    log = df.select(F.col("event_id").alias("entry_id"), F.col("ts").alias("at"), (F.col("value") <= 50).alias("allowed"))
    return access.audit_denied(log, F.lit("2024-01-10 00:00:00").cast("timestamp")).select(F.col("entry_id").alias("event_id"))


@register("metric_lines", "events", "SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def metric_lines(df):
    return metrics.exposition(df.groupBy(F.col("event_type").alias("type")).count(), "events_total", "type", "count")


@register("resolved_references", "conversations", "SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS resolved FROM conversations")
def resolved_references(df):
    """Every third turn names a file; the others mean the last one named."""
    named = df.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.col("turn")).alias("file"))
    return reports.last_known(named, "conv_id", ["turn"], "file").select("conv_id", "turn", "resolved")


@register("change_summaries", "documents")
def change_summaries(df):
    """Each document against itself without its first line and with one more at the end."""
    new = F.concat_ws("\n", F.array_append(F.slice(F.split("text", "\n"), 2, 2**31 - 1), F.lit("end")))
    return df.select("doc_id", text.change_summary(F.col("text"), new).alias("summary"))


@register("similar_names", "part")
def similar_names(df):
    """The three names nearest to a given one, whatever the order of their words."""
    names = df.select("p_name").distinct()
    ratio = text.sequence_ratio("bolt red")(text.sorted_tokens(F.col("p_name")))
    return names.select("p_name", F.round(ratio, 6).alias("ratio")).where("ratio >= 0.6").orderBy(F.desc("ratio"), "p_name").limit(3)


def _facts(expr: str) -> str:
    return " UNION ALL ".join(expr.format(c=c, lo=lo, hi=hi) for c, lo, hi in (("l_quantity", "', from ' || min(l_quantity)", " || ' to ' || max(l_quantity)"), ("l_returnflag", "''", "")))


@register("summary_text", "lineitem", _facts("SELECT '{c}' AS \"column\", '{c}: ' || count(*) || ' rows, ' || count(*) FILTER ({c} IS NULL) || ' missing, ' || count(DISTINCT {c}) || ' distinct' || {lo}{hi} AS sentence FROM lineitem"))
def summary_text(df):
    return reports.summary_text(profile.profile(df, ["l_quantity", "l_returnflag"]))


@register("query_suggestions", "lineitem", "SELECT \"column\", suggestion FROM (VALUES ('l_tax', 'What is the total l_tax'), ('l_tax', 'What is the average l_tax'), ('l_linestatus', 'How many rows by l_linestatus'), ('l_linestatus', 'Show l_linestatus')) t(\"column\", suggestion) WHERE (SELECT count(DISTINCT l_linestatus) FROM lineitem) <= 10")
def query_suggestions(df):
    return reports.query_suggestions(profile.profile(df, ["l_tax", "l_linestatus"]))


@register("sheet_overview", "supplier", "SELECT 'Sheet supplier: ' || count(*) || ' rows, 4 columns: s_suppkey, s_name, s_nationkey, s_acctbal' AS overview FROM supplier")
def sheet_overview(df):
    return reports.sheet_overview("supplier", df)


@register("collection_routes", "documents", "SELECT CASE doc_id % 4 WHEN 1 THEN 'pivots' WHEN 2 THEN 'charts' ELSE 'chunks' END AS collection, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def collection_routes(df):
    kind = F.when(F.col("doc_id") % 4 == 1, "pivot").when(F.col("doc_id") % 4 == 2, "chart").when(F.col("doc_id") % 4 == 3, "row")
    return df.groupBy(reports.collection(kind).alias("collection")).agg(F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"))
