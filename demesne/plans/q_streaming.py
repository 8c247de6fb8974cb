"""Streaming queries, checked against their batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from demesne.streaming import events as S


def st_tumbling(spark, d):
    out = S.drain(S.tumbling(S.event_stream(spark, d)), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


def st_sliding(spark, d):
    out = S.drain(S.sliding(S.event_stream(spark, d)), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def st_sessions(spark, d):
    out = S.drain(S.sessions(S.event_stream(spark, d)), "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def st_dedupe(spark, d):
    out = S.drain(S.deduplicated(S.event_stream(spark, d)))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"st_tumbling": st_tumbling, "st_sliding": st_sliding, "st_sessions": st_sessions, "st_dedupe": st_dedupe}
SQL = {
    "st_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS total FROM events GROUP BY 1, 2",
    "st_sliding": "WITH w AS (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) SELECT strftime(s, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM w GROUP BY 1, 2",
    "st_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1",
    "st_dedupe": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
}
