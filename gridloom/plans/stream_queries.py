"""Streams run to their end over the events table, and the SQL of the same result in one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.streaming import signals as T

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


@query("stream_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(floor(value)) AS BIGINT) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR]) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf):
    return T.finished(T.sliding(T.event_stream(spark, sf)), "complete").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("stream_pre_emphasis", "SELECT user_id, event_id, round(value - 0.95 * coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 4) AS y FROM events")
def stream_pre_emphasis(spark, sf):
    return T.finished(T.pre_emphasis(T.event_stream(spark, sf)), "append").withColumn("y", F.round("y", 4))


@query("stream_distinct", "SELECT CAST(count(DISTINCT event_id) AS BIGINT) AS n FROM events")
def stream_distinct(spark, sf):
    return T.finished(T.distinct_events(T.event_stream(spark, sf)), "append").agg(F.count("*").alias("n"))


@query("stream_sessions")
def stream_sessions(spark, sf):
    return T.finished(T.sessions(T.event_stream(spark, sf)), "complete").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
