"""Windows over events and job states."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.plans.registry import query
from folio.sources.tables import table
from folio.streaming import events as E


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(s, d):
    return E.tumbling(table(s, d, "events"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '1 hour', ts), time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour']) AS start FROM events) GROUP BY ALL")
def events_sliding(s, d):
    return E.sliding(table(s, d, "events"))


@query(
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events),"
    " k AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM k GROUP BY user_id, k"
)
def events_session(s, d):
    return E.sessions(table(s, d, "events"))


JOBS = "j AS (SELECT CAST(user_id AS VARCHAR) AS document_id, ts, CASE event_type WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'heartbeat' END AS event FROM events)"


@query(f"WITH {JOBS}, a AS (SELECT document_id, count(*) FILTER (event = 'running') AS attempts, arg_max(event, row(ts, event)) AS last FROM j GROUP BY 1) SELECT *, last = 'failed' AND attempts < 5 AS retry FROM a")
def job_attempts(s, d):
    event = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("heartbeat")
    return E.attempts(table(s, d, "events").select(F.col("user_id").cast("string").alias("document_id"), "ts", event.alias("event")))


@query("SELECT event_type, count(*) AS n, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k FROM events GROUP BY event_type")
def event_props(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 6).alias("mean_k"))
