"""Streaming jobs (ST), each checked against its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.tsstats import spike_thresholds
from tidemark.queries.registry import KEYS, TYPES, events, query, rd, rs, table
from tidemark.session import durable
from tidemark.streaming import jobs


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return jobs.stream_files(spark, sf, schema, "events.parquet")


@query(
    "st1_ingest_payloads",
    "SELECT event_id, event_type || '_k' AS field, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, "
    "CAST(ts AS DATE) AS date FROM events",
)
def st1(spark, sf):
    raw = event_stream(spark, sf).select("event_id", "ts", "event_type", "props")
    landed = jobs.ingest_payloads(raw, "event_type", "props", "ts")
    return jobs.run_available(landed.drop("ts"), "ingest")


@query(
    "st1_assemble_snapshots",
    "SELECT * FROM (SELECT ts AS fetched_at, "
    + ", ".join(
        f"max(CASE WHEN event_type = '{t}' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END) AS {t}_k" for t in TYPES
    )
    + " FROM events GROUP BY ts) WHERE epoch_us(fetched_at) <= "
    "(SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 1800000000",
)
def st1_wide(spark, sf):
    """Wide rows straight from the stream; the last half hour is still open."""
    raw = event_stream(spark, sf).select(F.col("ts").alias("fetched_at"), "event_type", "props")
    wide = jobs.stream_snapshots(raw, [f"{t}_k" for t in TYPES], "event_type", "props", "fetched_at")
    return jobs.run_available(wide, "snapshots")


@query(
    "st2_resample_stream",
    "SELECT event_type AS series_id, make_timestamp((epoch_us(ts) // 900000000) * 900000000) AS ts, "
    + rs("avg(value)")
    + " AS value FROM events GROUP BY 1, 2 HAVING (max(epoch_us(ts)) // 900000000 + 1) * 900000000 <= "
    "(SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 1800000000",
)
def st2(spark, sf):
    raw = event_stream(spark, sf).select("ts", F.col("event_type").alias("series_id"), "value")
    out = jobs.run_available(jobs.stream_resample(raw, KEYS, "ts", "value"), "resampled")
    return out.withColumn("value", rd("value"))


@query(
    "st3_spike_flags",
    "SELECT e.event_id, e.event_type AS series_id, e.value, 'congestion_spike' AS holiday FROM events e JOIN ("
    "SELECT event_type AS t, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1) q ON q.t = e.event_type "
    "WHERE e.value > q.p95",
)
def st3(spark, sf):
    levels = durable(spike_thresholds(events(spark, sf), KEYS, "value", {"p95": 0.95}))
    raw = event_stream(spark, sf).select("event_id", F.col("event_type").alias("series_id"), "value")
    flagged = jobs.stream_spikes(raw, levels, KEYS, "value", "p95").drop("p95")
    return jobs.run_available(flagged, "spikes")
