"""Batch twins of the streaming operators."""

from pyspark.sql import functions as F

from tessel.plans.registry import Loader, Registry
from tessel.streaming import events as ev

query = Registry()


@query("st01_window_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t: Loader):
    return ev.window_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour")


@query("st02_sliding_counts", "SELECT b + k * INTERVAL '30 minutes' - INTERVAL '30 minutes' AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b, event_type, value FROM events), range(2) r(k) GROUP BY ALL")
def _(t: Loader):
    return ev.window_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour", "30 minutes")


@query("st03_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL '2 hours' AS ended, count(*) AS n FROM s GROUP BY user_id, k")
def _(t: Loader):
    return ev.sessions(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "2 hours")


@query("st04_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def _(t: Loader):
    return ev.first_seen(t.events, "ts", ["user_id", "event_type"]).select("user_id", "event_type")


@query("st05_running_hits", "SELECT event_type, user_id % 10 AS bucket, count(*) AS hit_count FROM events GROUP BY ALL")
def _(t: Loader):
    return ev.running_hits(t.events, [F.col("event_type"), (F.col("user_id") % 10).alias("bucket")])


QUERIES, ORACLES = query.queries, query.oracles
