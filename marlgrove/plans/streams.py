"""Streaming queries, each run to the end of the table and equal to its batch form."""

from __future__ import annotations

from ..streaming import jobs
from .registry import query


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    return jobs.run_to_table(jobs.tumbling(jobs.source(spark, f"{sf_dir}/events.parquet")), "complete")


@query("SELECT start, count(*) AS n FROM (SELECT date_trunc('day', ts) - INTERVAL 1 DAY * unnest([0, 1]) AS start FROM events) GROUP BY 1")
def stream_sliding(spark, sf_dir):
    return jobs.run_to_table(jobs.sliding(jobs.source(spark, f"{sf_dir}/events.parquet")), "complete")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_session(spark, sf_dir):
    return jobs.run_to_table(jobs.by_session(jobs.source(spark, f"{sf_dir}/events.parquet")), "complete")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, sf_dir):
    return jobs.run_to_table(jobs.deduplicated(jobs.source(spark, f"{sf_dir}/events.parquet")).select("event_id"))


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")
def stream_incremental(spark, sf_dir):
    import datetime

    return jobs.run_to_table(jobs.newer_than(jobs.source(spark, f"{sf_dir}/events.parquet"), datetime.datetime(2024, 1, 15)).select("event_id"))


@query("SELECT conv_id, any_value(n) AS turns, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 20 GROUP BY 1")
def stream_conversation_state(spark, sf_dir):
    return jobs.run_to_table(jobs.conversation_state(jobs.source(spark, f"{sf_dir}/conversations.parquet")), "update", ["conv_id"])
