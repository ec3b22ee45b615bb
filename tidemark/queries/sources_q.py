"""Scans and sinks (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.histogram import bin_columns
from tidemark.queries.registry import (
    HOUR,
    both_models,
    TYPES,
    daily_orders,
    events,
    hourly,
    query,
    rd,
    rs,
    sql,
    table,
)
from tidemark.queries.rows_q import hist_cte
from tidemark.session import new_path
from tidemark.sources import snapshots, tables


@query(
    "s01_scan_snapshots",
    "SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events",
)
def s01(spark, sf):
    return snapshots.scan_snapshots(spark, f"{sf}/events.parquet", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "s02_flatten_payloads",
    "SELECT ts AS fetched_at, "
    + ", ".join(
        f"max(CASE WHEN event_type = '{t}' THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) "
        f"END) AS {t}_k"
        for t in TYPES
    )
    + " FROM events GROUP BY ts",
)
def s02(spark, sf):
    landed = table(spark, sf, "events").select(
        F.col("ts").alias("fetched_at"),
        F.col("event_type").alias("endpoint"),
        F.col("props").alias("payload"),
    )
    return snapshots.flatten_payloads(landed, [f"{t}_k" for t in TYPES])


@query(
    "s02_flatten_histogram",
    sql(
        f"SELECT make_timestamp(slot * {HOUR * 1_000_000}) AS fetched_at, n AS mempool_count, {', '.join(bin_columns())} "
        f"FROM hist JOIN (SELECT CAST(epoch_us(ts) // {HOUR * 1_000_000} AS BIGINT) AS slot, CAST(count(*) AS DOUBLE) AS n "
        "FROM ev GROUP BY 1) USING (slot)",
        hist_cte(),
    ),
)
def s02_histogram(spark, sf):
    """Payloads with a nested list of fee and count pairs, one an hour, come out as bins."""
    e = events(spark, sf).withColumn("fetched_at", calendar.slot_start(calendar.slot("ts", HOUR), HOUR))
    pairs = F.collect_list(F.array("value", "k")).alias("fee_histogram")
    landed = e.groupBy("fetched_at").agg(F.to_json(F.struct(pairs, F.count(F.lit(1)).alias("count"))).alias("payload"))
    landed = landed.withColumn("endpoint", F.lit("mempool"))
    return snapshots.flatten_payloads(landed, ["mempool_count", *bin_columns()])


@query(
    "s03_append_sink",
    "SELECT CAST(ts AS DATE) AS date, count(*) AS n, "
    + rs("sum(value)", 4)
    + " AS total FROM events GROUP BY 1",
)
def s03(spark, sf):
    path = new_path(spark, "snapshots")
    snapshots.append_snapshots(table(spark, sf, "events"), path, "ts")
    return (
        spark.read.parquet(path)
        .groupBy("date")
        .agg(F.count(F.lit(1)).alias("n"), rd(F.sum("value"), 4).alias("total"))
    )


@query(
    "s04_drifting_schemas",
    "SELECT event_type AS series_id, count(*) AS n, "
    "count(CASE WHEN event_type <> 'click' THEN value END) AS n_value FROM events GROUP BY 1",
)
def s04(spark, sf):
    e = events(spark, sf)
    lacking = e.filter("series_id = 'click'").select("series_id", "ts")
    whole = e.filter("series_id <> 'click'").select("series_id", "ts", "value")
    return (
        snapshots.union_snapshots([lacking, whole])
        .groupBy("series_id")
        .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"))
    )


@query(
    "s05_daily_history_csv",
    sql(f"SELECT day, {rs('total', 2)} AS total, n_orders FROM daily"),
)
def s05(spark, sf):
    path = new_path(spark, "history")
    d = daily_orders(spark, sf).withColumn(
        "day", F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    )
    tables.write_csv(d.withColumn("unused", F.lit(0)), path)
    schema = "day string, total double, n_orders bigint, unused int"
    back = tables.read_daily_history(spark, path, schema, "day", ["day", "total", "n_orders"])
    return back.withColumn("day", F.to_date("day")).withColumn("total", rd("total", 2))


@query(
    "s06_csv_sink",
    sql(
        f"SELECT series_id, count(*) AS n, {rs('sum(value)', 4)} AS total "
        "FROM hourly GROUP BY 1"
    ),
)
def s06(spark, sf):
    path = tables.write_csv(
        hourly(spark, sf).select("series_id", "slot", "value"), new_path(spark, "processed")
    )
    back = tables.read_csv(spark, path, "series_id string, slot bigint, value double")
    return back.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), rd(F.sum("value"), 4).alias("total")
    )


@query(
    "s07_csv_readback",
    "SELECT nullif(event_type, 'error') AS trend, count(*) AS n, "
    + rs("avg(value)")
    + " AS avg_mae FROM events GROUP BY 1",
)
def s07(spark, sf):
    e = events(spark, sf)
    scores = e.groupBy(F.nullif("series_id", F.lit("error")).alias("trend")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("avg_mae")
    )
    path = tables.write_csv(scores, new_path(spark, "cv"))
    back = tables.read_csv(spark, path, "trend string, n bigint, avg_mae double")
    return back.withColumn("avg_mae", rd("avg_mae"))


@query("s08_parquet_sink", sql(f"SELECT series_id, ts, {rs('value')} AS value FROM hourly"))
def s08(spark, sf):
    path = tables.write_parquet(hourly(spark, sf), new_path(spark, "clean"))
    return spark.read.parquet(path).select("series_id", "ts", rd("value").alias("value"))


@query(
    "s09_params_json",
    "SELECT event_type AS series_id, CAST(count(*) AS BIGINT) AS n_estimators, "
    "CAST(length(event_type) AS BIGINT) AS max_depth FROM events GROUP BY 1",
)
def s09(spark, sf):
    best = (
        events(spark, sf)
        .groupBy("series_id")
        .agg(F.count(F.lit(1)).alias("estimator__n_estimators"))
        .withColumn("estimator__max_depth", F.length("series_id"))
    )
    path = tables.write_params(best, new_path(spark, "params"))
    p = F.col("params")
    return tables.read_params(spark, path).select(
        p["series_id"].alias("series_id"),
        p["n_estimators"].cast("bigint").alias("n_estimators"),
        p["max_depth"].cast("bigint").alias("max_depth"),
    )


@query(
    "s10_forecast_store",
    sql(
        f"SELECT 'naive' AS model, series_id, ts, {rs('y_pred')} AS y_pred FROM naive UNION ALL "
        f"SELECT 'median', series_id, ts, {rs('y_pred')} FROM median_day"
    ),
)
def s10(spark, sf):
    both = both_models(spark, sf)
    path = tables.save_forecasts(both, new_path(spark, "forecasts"))
    return spark.read.parquet(path).select("model", "series_id", "ts", rd("y_pred").alias("y_pred"))


@query(
    "s11_profile",
    "SELECT * FROM (SELECT 'event_id' AS \"column\", 'bigint' AS dtype, count(*) AS n_rows, "
    "count(event_id) AS non_null FROM events UNION ALL "
    "SELECT 'ts', 'timestamp_ntz', count(*), count(ts) FROM events UNION ALL "
    "SELECT 'user_id', 'bigint', count(*), count(user_id) FROM events UNION ALL "
    "SELECT 'event_type', 'string', count(*), count(event_type) FROM events UNION ALL "
    "SELECT 'value', 'double', count(*), count(value) FROM events UNION ALL "
    "SELECT 'props', 'string', count(*), count(props) FROM events)",
)
def s11(spark, sf):
    return tables.profile(table(spark, sf, "events"))


