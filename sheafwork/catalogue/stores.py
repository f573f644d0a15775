"""Versions, feedback, change detection, metrics, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import incremental, metrics, staging, stored, stores
from . import tabular

QUERIES: dict[str, tuple] = {}


def register(name: str, table: str, sql: str | None = None):
    return tabular.register(name, table, sql, QUERIES)


@register("latest_version", "conversations", "SELECT conv_id, max(turn) AS turn, md5(max_by(text, turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def latest_version(df):
    return stores.latest(df.select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("version_history", "conversations", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 ORDER BY turn DESC LIMIT 5")
def version_history(df):
    return stores.history(df, "conv_id", 3, "turn", 5).select("conv_id", "turn", "role")


@register("next_version", "conversations", "SELECT conv_id, max(turn) + 1 AS next_version FROM conversations GROUP BY conv_id")
def next_version(df):
    return stores.next_version(df, "conv_id", "turn")


@register("version_rollback", "conversations", "SELECT conv_id, (SELECT max(turn) + 1 FROM conversations WHERE conv_id = 5) AS turn, role, md5(text) AS text_md5 FROM conversations WHERE conv_id = 5 AND turn = 1")
def version_rollback(df):
    return stores.rollback(df, "conv_id", 5, "turn", 1).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_RATED = "(SELECT user_id, event_id % 5 + 1 AS rating, ts FROM events) r"


def _rated(df):
    return df.select("user_id", (F.col("event_id") % 5 + 1).alias("rating"), "ts")


@register("feedback_stats", "events", f"SELECT count(*) AS n, count(DISTINCT user_id) AS rated, round(avg(rating), 6) AS mean_rating, count(*) FILTER (rating <= 2) AS negative FROM {_RATED}")
def feedback_stats(df):
    return stores.feedback_stats(_rated(df), "user_id", "rating").withColumn("mean_rating", F.round("mean_rating", 6))


@register("feedback_by_key", "events", f"SELECT user_id, count(*) AS n, round(avg(rating), 6) AS mean_rating, count(*) FILTER (rating <= 2) AS negative, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM {_RATED} GROUP BY user_id")
def feedback_by_key(df):
    out = stores.feedback_by_key(_rated(df), "user_id", "rating", "ts")
    return out.withColumn("mean_rating", F.round("mean_rating", 6)).withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


@register("flagged", "events", f"SELECT user_id, count(*) AS negative FROM {_RATED} WHERE rating <= 2 GROUP BY user_id HAVING count(*) >= 3")
def flagged(df):
    return stores.flagged(_rated(df), "user_id", "rating")


@register("top_problematic", "events", f"SELECT user_id, count(*) AS negative FROM {_RATED} WHERE rating <= 2 GROUP BY user_id ORDER BY negative DESC, user_id LIMIT 10")
def top_problematic(df):
    return stores.top_problematic(_rated(df), "user_id", "rating")


_OLD = "(SELECT doc_id, sha256(to_json([text, lang])) AS hash FROM documents WHERE doc_id % 10 <> 0) o"
_NEW = "(SELECT doc_id, sha256(to_json([CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END, lang])) AS hash FROM documents WHERE doc_id % 13 <> 0) n"


def _both(df):
    new = df.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return incremental.content_hash(df.where("doc_id % 10 <> 0"), "doc_id", ["text", "lang"]), incremental.content_hash(new.where("doc_id % 13 <> 0"), "doc_id", ["text", "lang"])


@register("incremental_diff", "documents", f"SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'no_change' ELSE 'modified' END AS change FROM {_OLD} FULL JOIN {_NEW} ON o.doc_id = n.doc_id")
def incremental_diff(df):
    return incremental.diff(*_both(df), "doc_id")


@register("changed_files", "documents", f"SELECT n.doc_id FROM {_NEW} LEFT JOIN {_OLD} ON o.doc_id = n.doc_id WHERE o.doc_id IS NULL OR o.hash <> n.hash OR n.doc_id % 50 = 1")
def changed_files(df):
    old, new = _both(df)
    known = old.withColumn("status", F.when(F.col("doc_id") % 50 == 1, "failed").otherwise("indexed"))
    return incremental.changed(new, known, "doc_id").select("doc_id")


@register("deleted_ids", "documents", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 13 = 0")
def deleted_ids(df):
    old, new = _both(df)
    return incremental.deleted(new, old, "doc_id")


@register("upsert_latest", "orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert_latest(df):
    rows = df.select("o_orderkey", "o_totalprice")
    return incremental.upsert(rows, rows.where("o_orderkey % 9 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), "o_orderkey")


@register("histogram_percentiles", "events", "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS largest, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def histogram_percentiles(df):
    return metrics.histogram_stats(df, "event_type", "value").withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")}).withColumn("total", F.round("total", 4))


_RECENT = (
    "SELECT event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS largest, round(quantile_cont(value, 0.5), 6) AS p50, "
    "round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 "
    "FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 1000) e GROUP BY event_type"
)


@register("histogram_recent", "events", _RECENT)
def histogram_recent(df):
    """Percentiles of each type's 1000 newest values."""
    out = metrics.histogram_stats(df, "event_type", "value", [F.desc("ts"), F.desc("event_id")])
    return out.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")}).withColumn("total", F.round("total", 4))


@register("recent_records", "events", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_records(df):
    return metrics.recent_records(df, [F.desc("ts"), F.desc("event_id")], "click", "event_type").select("event_id", "event_type", "value")


@register("exceeded_records", "events", "SELECT event_id, event_type, value FROM events WHERE value > CASE WHEN event_type = 'click' THEN 40 ELSE 60 END ORDER BY ts DESC, event_id DESC LIMIT 100")
def exceeded_records(df):
    limit = F.when(F.col("event_type") == "click", 40).otherwise(60)
    return metrics.exceeded_records(df, "value", limit, [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type", "value")


@register("perf_summary", "events", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS largest, round(avg(value), 6) AS mean, count(*) FILTER (value > 50) AS exceeded, round(count(*) FILTER (value > 50) / CAST(count(*) AS DOUBLE) * 100, 4) AS exceeded_pct FROM events GROUP BY event_type")
def perf_summary(df):
    return metrics.performance(df, "event_type", "value", F.lit(50.0)).withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@register("last_messages", "conversations", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) t WHERE r <= 3")
def last_messages(df):
    return metrics.last_n(df, "conv_id", [F.desc("turn")], 3).select("conv_id", "turn", "role")


@register("session_summary", "conversations", "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS asked, max(turn) AS last_turn, sum(length(text)) AS chars FROM conversations GROUP BY conv_id")
def session_summary(df):
    return df.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("asked"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).alias("chars"))


@register("trace_assembly", "events", "SELECT user_id, count(*) AS steps, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended FROM events GROUP BY user_id")
def trace_assembly(df):
    out = stores.assemble_traces(df, "user_id", "event_type", "ts", "value")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", "steps", stamp("started"), stamp("ended"))


@register("staleness", "", "SELECT o_orderkey, o_orderkey % 17 = 0 OR c_custkey IS NULL OR o_custkey % 5 > 2 AS stale FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0) c ON o_custkey = c_custkey")
def staleness(read_):
    lineage = read_("orders").select("o_orderkey", F.col("o_custkey").alias("file_id"), (F.col("o_orderkey") % 17 == 0).alias("is_stale"), F.lit(2).alias("indexed"))
    files = read_("customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") % 5).alias("modified"))
    return stores.staleness(lineage, files, "file_id").select("o_orderkey", "stale")


@register("cache_invalidation", "orders", "SELECT o_orderkey AS cache_key FROM orders WHERE NOT (o_custkey % 10 = 3 OR (o_custkey + 1) % 10 = 3)")
def cache_invalidation(df):
    """Results rest on two customers each; every customer whose key ends in 3 changed."""
    cache = df.select(F.col("o_orderkey").alias("cache_key"), F.array(F.col("o_custkey"), F.col("o_custkey") + 1).alias("file_ids"))
    gone = df.select(F.explode(F.array(F.col("o_custkey"), F.col("o_custkey") + 1)).alias("file_id")).where("file_id % 10 = 3").distinct()
    return stores.invalidate(cache, gone).select("cache_key")


@register("schedules", "orders", "SELECT o_orderkey, strftime(o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 1 DAY WHEN o_orderkey % 3 = 1 THEN INTERVAL 7 DAY ELSE INTERVAL 30 DAY END, '%Y-%m-%d') AS next_run FROM orders")
def schedules(df):
    kind = F.when(F.col("o_orderkey") % 3 == 0, "daily").when(F.col("o_orderkey") % 3 == 1, "weekly").otherwise("monthly")
    return df.select("o_orderkey", F.date_format(stores.next_run(F.col("o_orderdate"), kind), "yyyy-MM-dd").alias("next_run"))


@register("batch_progress", "orders", "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed, round(count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS share FROM orders GROUP BY o_orderpriority")
def batch_progress(df):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return stores.progress(df.select("o_orderpriority", status.alias("status")), "o_orderpriority", "status")


_MERGED = (
    "SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1996 THEN 'late' ELSE 'early' END AS state, round(CASE WHEN year(o_orderdate) >= 1996 THEN 2 * o_totalprice ELSE o_totalprice END, 2) AS price "
    "FROM orders WHERE NOT (year(o_orderdate) >= 1996 AND o_orderstatus = 'P')"
)


@register("stored_merge", "orders", _MERGED)
def stored_merge(df):
    """A stored table after two merges: later orders replace or join the first ones, some are deleted; a repeated batch changes nothing."""
    rows = df.groupBy("o_orderkey").agg(F.first("o_orderdate").alias("day"), F.first("o_orderstatus").alias("status"), F.first("o_totalprice").alias("price"))
    late = F.year("day") >= 1996
    first = rows.select("o_orderkey", F.lit("early").alias("state"), F.round("price", 2).alias("price"))
    table = stored.StoredTable.create(df.sparkSession, staging.new_path(df.sparkSession, "orders"), first.schema, ["o_orderkey"], 16)
    table.merge(first, writer="load", batch=0)
    updates = rows.where(late).select("o_orderkey", F.lit("late").alias("state"), F.round(2 * F.col("price"), 2).alias("price"), (F.col("status") == "P").alias("gone"))
    for _ in range(2):
        table.merge(updates, deleted=F.col("gone"), writer="load", batch=1)
    return table.read()
