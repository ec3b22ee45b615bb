"""Query registry and the frames and SQL fragments queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.operators.clean import interpolate, onto_grid, resample
from tidemark.operators.forecast import (
    compare_models,
    last_day_fold,
    median_forecast,
    seasonal_naive,
)
from tidemark.operators.reshape import assign_folds
from tidemark.operators.splits import lengths
from tidemark.plans.lookup import attach_agg
from tidemark.session import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HOUR = 3600
DAY, WEEK, HORIZON = 24, 168, 24
TYPES = ["click", "error", "purchase", "signup", "view"]
KEYS = ["series_id"]


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rd(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; sums in another order differ in the last bits."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rs(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def rf(c: Column | str) -> Column:
    """Single precision, for means whose decimals would often end in an exact half."""
    return (F.col(c) if isinstance(c, str) else c).cast("float").cast("double")


def rfs(expr: str) -> str:
    return f"CAST(CAST({expr} AS FLOAT) AS DOUBLE)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        "ts",
        F.col("event_type").alias("series_id"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def gapped(spark: SparkSession, sf: str, step: int = HOUR) -> DataFrame:
    """Bin means on the regular grid, empty bins null."""
    binned = resample(events(spark, sf), KEYS, "ts", step, {"value": F.avg("value")})
    return onto_grid(binned, KEYS, step)


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Gap-filled hourly series; nulls only before a series' first value."""
    return interpolate(gapped(spark, sf), KEYS, "pos", ["value"])


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly series from their first value on, positions from 0."""
    known = durable(hourly(spark, sf).filter(F.col("value").isNotNull()))
    return attach_agg(known, KEYS, ["pos"], F.min("pos").alias("_p0")).select(
        "series_id", "ts", "slot", (F.col("pos") - F.col("_p0")).alias("pos"), "value"
    )


def wide_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """One row per hour: five observed targets (null where empty) and hourly features."""
    e = events(spark, sf).withColumn("slot", calendar.slot("ts", HOUR))
    return e.groupBy("slot").agg(
        *[F.avg(F.when(F.col("series_id") == t, F.col("value"))).alias(f"fee_{t}") for t in TYPES],
        F.count(F.lit(1)).cast("double").alias("mempool_count"),
        F.sum("value").alias("mempool_total"),
        F.avg("k").alias("price_k"),
    )


def daily_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.groupBy("day").agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n_orders")
    )


def last_day(spark: SparkSession, sf: str) -> DataFrame:
    """Dense series with the last 24 steps as the only test fold."""
    d = dense(spark, sf)
    return assign_folds(d, last_day_fold(lengths(d, KEYS, "pos"), KEYS, HORIZON), KEYS, "pos")


def _day_forecast(spark: SparkSession, sf: str, models) -> DataFrame:
    d = dense(spark, sf)
    folds = last_day_fold(lengths(d, KEYS, "pos"), KEYS, HORIZON)
    every = compare_models(d, folds, models)
    return every.join(d.select("series_id", "pos", "ts"), ["series_id", "pos"]).select(
        "model", "series_id", "ts", "y_true", "y_pred"
    )


MODELS = {
    "naive": lambda a: seasonal_naive(a, KEYS, "pos", "value", DAY),
    "median": lambda a: median_forecast(a, KEYS, "pos", "value"),
}


def naive_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """``series_id, ts, y_true, y_pred`` of the seasonal-naive forecast of the last day."""
    return _day_forecast(spark, sf, {"naive": MODELS["naive"]}).drop("model")


def median_day(spark: SparkSession, sf: str) -> DataFrame:
    return _day_forecast(spark, sf, {"median": MODELS["median"]}).drop("model")


def both_models(spark: SparkSession, sf: str) -> DataFrame:
    """The last day's forecasts of both baselines with a ``model`` column."""
    return _day_forecast(spark, sf, MODELS)


def gapped_ctes(step: int, suffix: str = "") -> str:
    us = step * 1_000_000
    return f"""
obs{suffix} AS (
  SELECT series_id, CAST(epoch_us(ts) // {us} AS BIGINT) AS slot, avg(value) AS value
  FROM ev GROUP BY 1, 2),
grid{suffix} AS (
  SELECT s.series_id, g.slot, CAST(g.slot - (SELECT min(slot) FROM obs{suffix}) AS BIGINT) AS pos
  FROM (SELECT DISTINCT series_id FROM obs{suffix}) s
  CROSS JOIN (SELECT unnest(generate_series((SELECT min(slot) FROM obs{suffix}),
                                            (SELECT max(slot) FROM obs{suffix}))) AS slot) g),
gapped{suffix} AS (
  SELECT g.series_id, g.slot, g.pos, make_timestamp(g.slot * {us}) AS ts, o.value
  FROM grid{suffix} g LEFT JOIN obs{suffix} o ON o.series_id = g.series_id AND o.slot = g.slot)"""


def filled_cte(src: str, out: str) -> str:
    return f"""
{out}_known AS (
  SELECT *,
    last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER up AS pp,
    last_value(value IGNORE NULLS) OVER up AS pv,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER dn AS np,
    first_value(value IGNORE NULLS) OVER dn AS nv
  FROM {src}
  WINDOW up AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         dn AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
{out} AS (
  SELECT series_id, slot, pos, ts,
    CASE WHEN value IS NOT NULL THEN value
         WHEN pp IS NOT NULL AND np IS NOT NULL THEN pv + (nv - pv) * (pos - pp) / (np - pp)
         ELSE pv END AS value
  FROM {out}_known)"""


PRELUDE = f"""WITH RECURSIVE
ev AS (
  SELECT event_id, ts, event_type AS series_id, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events),
{gapped_ctes(HOUR)},
{filled_cte("gapped", "hourly")},
dense AS (
  SELECT series_id, ts, slot, CAST(pos - min(pos) OVER (PARTITION BY series_id) AS BIGINT) AS pos, value
  FROM hourly WHERE value IS NOT NULL),
sizes AS (SELECT series_id, max(pos) + 1 AS n FROM dense GROUP BY 1),
wide AS (
  SELECT CAST(epoch_us(ts) // {HOUR * 1_000_000} AS BIGINT) AS slot,
    {", ".join(f"avg(CASE WHEN series_id = '{t}' THEN value END) AS fee_{t}" for t in TYPES)},
    CAST(count(*) AS DOUBLE) AS mempool_count, sum(value) AS mempool_total, avg(k) AS price_k
  FROM ev GROUP BY 1),
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total, count(*) AS n_orders
  FROM orders GROUP BY 1),
actual AS (
  SELECT d.series_id, d.ts, d.pos, d.value AS y_true, s.n
  FROM dense d JOIN sizes s ON s.series_id = d.series_id WHERE d.pos >= s.n - {HORIZON}),
naive AS (
  SELECT a.series_id, a.ts, a.pos, a.y_true, d.value AS y_pred
  FROM actual a JOIN dense d ON d.series_id = a.series_id AND d.pos = a.pos - {DAY}),
med AS (
  SELECT d.series_id, quantile_cont(d.value, 0.5) AS y_pred
  FROM dense d JOIN sizes s ON s.series_id = d.series_id
  WHERE d.pos < s.n - {HORIZON} GROUP BY 1),
median_day AS (
  SELECT a.series_id, a.ts, a.pos, a.y_true, m.y_pred
  FROM actual a JOIN med m ON m.series_id = a.series_id)
"""


def sql(body: str, *ctes: str) -> str:
    """Body with the shared CTEs in front; ``ctes`` are added after them."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"{PRELUDE}{extra}\n{body}"


EPS_SQL = "2.220446049250313e-16"


def metrics_sql(src: str, by: str, digits: int = 6) -> str:
    """Six metrics of ``src`` grouped by the comma-separated columns ``by``."""
    d = digits
    return f"""
SELECT {by},
  {rs("mae + std_diff + dev_error", d)} AS custom_loss, {rs("std_diff", d)} AS std_diff,
  {rs("dev_error", d)} AS dev_error, {rs("mae", d)} AS mae, {rs("mape", d)} AS mape,
  {rs("rmse", d)} AS rmse
FROM {raw_metrics_sql(src, by)}"""


def raw_metrics_sql(src: str, by: str) -> str:
    return f"""(
  SELECT {by}, abs(stddev_pop(y_pred) - stddev_pop(y_true)) AS std_diff,
    avg(abs(y_pred - y_true - me)) AS dev_error, avg(abs(y_pred - y_true)) AS mae,
    avg(abs(y_pred - y_true) / greatest(abs(y_true), {EPS_SQL})) AS mape,
    sqrt(avg((y_pred - y_true) * (y_pred - y_true))) AS rmse
  FROM (SELECT *, avg(y_pred - y_true) OVER (PARTITION BY {by}) AS me FROM {src})
  GROUP BY {by})"""


def round_metrics(df: DataFrame, digits: int = 6) -> DataFrame:
    from tidemark.functions.loss import METRICS

    return df.select(*[rd(c, digits).alias(c) if c in METRICS else c for c in df.columns])
