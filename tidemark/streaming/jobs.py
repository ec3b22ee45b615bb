"""Structured Streaming jobs over landed snapshot files.

Each function builds a streaming DataFrame; ``run_available`` drains what has landed into a
Parquet table with a checkpoint, so a restarted job continues where the lost one stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import new_path
from tidemark.sources.snapshots import DROPPED_COLUMNS, payload_fields, wide_fields


def stream_files(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def ingest_payloads(stream: DataFrame, endpoint: str, payload: str, ts: str) -> DataFrame:
    """Landed JSON payloads to ``(event keys, field, number)`` rows. Flattening to wide rows is a
    batch pivot on top (``flatten_payloads``); the stream itself keeps no state."""
    named = stream.withColumnRenamed(endpoint, "endpoint").withColumnRenamed(payload, "payload")
    return payload_fields(named).withColumn("date", F.to_date(ts))


def stream_snapshots(
    stream: DataFrame,
    fields: Sequence[str],
    endpoint: str,
    payload: str,
    ts: str,
    lateness: str = "30 minutes",
) -> DataFrame:
    """Landed JSON payloads to wide rows, one per snapshot instant, as ``flatten_payloads`` makes them.

    The endpoints of a snapshot may land in any files and micro-batches: what has come is kept as state per
    instant, and the row is written once the watermark passes it. A payload that lands twice changes nothing,
    and a restarted job goes on with the state of its checkpoint.
    """
    named = stream.withColumnRenamed(endpoint, "endpoint").withColumnRenamed(payload, "payload")
    long = payload_fields(named.select(F.col(ts).cast("timestamp").alias("_t"), "endpoint", "payload"))
    fields = [f for f in fields if f not in DROPPED_COLUMNS]
    timed = long.filter(F.col("field").isin(*fields)).withWatermark("_t", lateness)
    wide = timed.groupBy("_t").agg(*wide_fields(fields))
    return wide.select(F.col("_t").cast("timestamp_ntz").alias(ts), *fields)


def stream_resample(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    step: str = "15 minutes",
    lateness: str = "30 minutes",
) -> DataFrame:
    """Running bin means; a bin is emitted once the watermark passes it, later rows are dropped."""
    timed = stream.withColumn("_t", F.col(ts).cast("timestamp"))
    return (
        timed.withWatermark("_t", lateness)
        .groupBy(F.window("_t", step).alias("_w"), *keys)
        .agg(F.avg(value).alias(value))
        .select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("ts"), value)
    )


def stream_spikes(
    stream: DataFrame, thresholds: DataFrame, keys: Sequence[str], value: str, level: str
) -> DataFrame:
    """Rows above their series' trained threshold (stream-static join)."""
    joined = stream.join(thresholds, list(keys), "inner")
    return joined.filter(F.col(value) > F.col(level)).withColumn(
        "holiday", F.lit("congestion_spike")
    )


def run_available(
    stream: DataFrame, name: str, path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Process everything that has landed and return the sink table."""
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    checkpoint = checkpoint or new_path(spark, f"{name}-state")
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
