"""Streaming twins, and extras beyond the operators that graphs and documents need: windows, cubes, approximate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..streaming import messages, stream as S
from .registry import Registry
from .views import Tables

R = Registry()
query = R.query


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_metric(t: Tables) -> DataFrame:
    rows = S.files(t.spark, t.sf_dir, "events.parquet", t.events)
    return S.latest(S.running_sums(rows, "event_type", "value"), "complete", "metric")


@query("SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def stream_accumulate(t: Tables) -> DataFrame:
    rows = S.files(t.spark, t.sf_dir, "conversations.parquet", t.conversations)
    found = S.latest(S.accumulate(rows, "conv_id", "text"), "update", "accumulate")
    return found.groupBy("conv_id").agg(F.max("n").alias("n"), F.max("chars").alias("chars"))  # later batches hold more


@query("SELECT conv_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id")
def stream_messages(t: Tables) -> DataFrame:
    """Each conversation as the stream's list state holds it."""
    rows = S.files(t.spark, t.sf_dir, "conversations.parquet", t.conversations).select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("place"), "role", "text")
    with messages.list_state(t.spark):
        found = S.latest(messages.accumulated(rows), "update", "messages")
    last = found.groupBy("conv_id").agg(F.max_by(F.struct("n", "messages"), "n").alias("x"))  # later batches hold more
    return last.select("conv_id", "x.n", F.array_join(F.transform("x.messages", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n").alias("said"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(t: Tables) -> DataFrame:
    return S.tumbling(t.events)


@query("SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start, event_type, value FROM events) GROUP BY ALL")
def events_sliding(t: Tables) -> DataFrame:
    return S.tumbling(t.events, "1 day", "12 hours")


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def events_session(t: Tables) -> DataFrame:
    return S.sessions(t.events)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_lines(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lines(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"))
