"""Snapshot tables: checked scans, drifting schemas, landed JSON payloads, append sink."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import require_columns
from tidemark.functions.histogram import pair_histogram, parse_pairs

# Nested or textual payload fields that do not become numeric columns.
DROPPED_FIELDS = ["feeRange"]
HISTOGRAM_FIELD = "fee_histogram"
DROPPED_COLUMNS = [
    "difficulty_adjustment_estimatedRetargetDate",
    "difficulty_adjustment_previousRetarget",
    "price_time",
]


def scan_snapshots(
    spark: SparkSession, path: str, time_col: str = "timestamp", merge_schema: bool = False
) -> DataFrame:
    """Parquet scan that fails early: missing path, unreadable data, no time column, no rows."""
    try:
        df = spark.read.option("mergeSchema", merge_schema).parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise FileNotFoundError(path) from err
        raise ValueError(f"cannot read {path}: {err}") from err
    except Exception as err:  # corrupt footers surface as a generic JVM error
        raise ValueError(f"cannot read {path}: {err}") from err
    require_columns(df, [time_col])
    if df.select(time_col).isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def union_snapshots(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of snapshots whose endpoint groups differ; absent columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def payload_fields(df: DataFrame, endpoint: str = "endpoint", payload: str = "payload"):
    """Explode JSON payloads to ``(…, field, number)`` rows, field = endpoint + '_' + key.

    A payload is one object or an array of objects of which the first counts. A nested list of fee and
    count pairs becomes one field per histogram bin, empty ones 0; other values that are not numbers (lists,
    texts) are left out.
    """
    as_map = "map<string,string>"
    body = F.trim(F.col(payload))
    first = F.when(
        body.startswith("["), F.element_at(F.from_json(body, f"array<{as_map}>"), 1)
    ).otherwise(F.from_json(body, as_map))
    exploded = df.select(
        *[c for c in df.columns if c not in (endpoint, payload)],
        F.col(endpoint).alias("_endpoint"),
        F.explode(first).alias("_key", "_text"),
    )
    name = F.concat_ws("_", "_endpoint", "_key")
    bins = F.transform_keys(
        pair_histogram(parse_pairs(F.col("_text"))), lambda k, _: F.concat(name, F.lit("_bin_"), k)
    )
    numbers = F.when(F.col("_key") == HISTOGRAM_FIELD, bins).otherwise(
        F.create_map(name, F.expr("try_cast(_text as double)"))
    )
    return (
        exploded.filter(~F.col("_key").isin(*DROPPED_FIELDS))
        .select(*[c for c in exploded.columns if c not in ("_endpoint", "_key", "_text")], F.explode(numbers).alias("field", "number"))
        .filter(F.col("number").isNotNull())
    )


def flatten_payloads(df: DataFrame, fields: Sequence[str], key: str = "fetched_at") -> DataFrame:
    """One wide row per snapshot. ``fields`` is the declared output schema, so no job is needed to
    discover it and files of every batch agree."""
    fields = [f for f in fields if f not in DROPPED_COLUMNS]
    long = payload_fields(df).filter(F.col("field").isin(*fields))
    return long.groupBy(key).agg(*wide_fields(fields))


def wide_fields(fields: Sequence[str]) -> list[Column]:
    """One column per field from (field, number) rows."""
    return [F.max(F.when(F.col("field") == f, F.col("number"))).alias(f) for f in fields]


def append_snapshots(df: DataFrame, path: str, ts: str) -> None:
    """Append to a Parquet table partitioned by day.

    The rebalance hint lets Spark split a busy day over many tasks and merge quiet ones, so files
    come out evenly sized whatever the daily volume."""
    (
        df.withColumn("date", F.to_date(ts))
        .hint("rebalance", "date")
        .write.mode("append")
        .option("maxRecordsPerFile", 20_000_000)
        .partitionBy("date")
        .parquet(path)
    )
