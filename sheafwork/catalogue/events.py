"""Grouping extensions, windows over time and sessions over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import events
from . import tabular

QUERIES: dict[str, tuple] = {}


def register(name: str, table: str, sql: str | None = None):
    return tabular.register(name, table, sql, QUERIES)


_STAMP = "yyyy-MM-dd HH:mm:ss"


def _shown(df, column):
    return df.withColumn(column, F.date_format(column, _STAMP))


@register("ext_groupby", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem GROUP BY ALL")
def ext_groupby(df):
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@register("ext_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(df):
    return df.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("ext_pivot", "orders", "SELECT year(o_orderdate) AS year, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def ext_pivot(df):
    out = df.groupBy(F.year("o_orderdate").cast("long").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return out.select("year", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@register("ext_tumbling", "events", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def ext_tumbling(df):
    return _shown(events.tumbling(df), "window_start").withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@register("ext_sliding", "events", "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) t GROUP BY w")
def ext_sliding(df):
    return _shown(events.sliding(df), "window_start").withColumn("total", F.round("total", 4))


@register("ext_session", "events", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, sid")
def ext_session(df):
    return _shown(events.sessions(df), "session_start").withColumn("total", F.round("total", 4))


@register("ext_distinct", "events", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def ext_distinct(df):
    return events.distinct_events(df).groupBy("event_type").agg(F.count("*").alias("n"))
