"""Scalar functions, windows and feature matrices (F, W, M22-M24)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import calendar, text
from tidemark.functions.histogram import HISTOGRAM_PREFIX, bin_columns, bin_start
from tidemark.operators import features
from tidemark.operators.aggregates import bin_totals
from tidemark.operators.clean import clean_series, clean_snapshots
from tidemark.plans.order import average_ranks, value_counts
from tidemark.queries.registry import (
    DAY,
    HORIZON,
    HOUR,
    KEYS,
    TYPES,
    dense,
    events,
    gapped,
    gapped_ctes,
    filled_cte,
    hourly,
    query,
    rd,
    rf,
    rfs,
    rs,
    sql,
    table,
    wide_hourly,
)
from tidemark.queries.rows_q import hist_cte, hist_hourly


@query(
    "f01_calendar_parts",
    "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(minute(ts) AS INTEGER) AS minute, "
    "CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month, "
    "CAST(year(ts) AS INTEGER) AS year FROM events",
)
def f01(spark, sf):
    parts = calendar.calendar_parts("ts")
    return events(spark, sf).select(
        "event_id", *[c.alias(n) for n, c in parts.items()], F.year("ts").alias("year")
    )


CYCLE_SQL = ", ".join(
    f"{rs(f'{fn}(2 * pi() * {part} / {period})', 9)} AS {name}_{fn}"
    for name, part, period in (
        ("hour", "hour(ts)", 24),
        ("day_of_week", "(isodow(ts) - 1)", 7),
        ("month", "month(ts)", 12),
        ("minute", "minute(ts)", 60),
    )
    for fn in ("sin", "cos")
)


@query("f02_cyclic_encoding", f"SELECT event_id, {CYCLE_SQL} FROM events")
def f02(spark, sf):
    return events(spark, sf).select(
        "event_id", *[rd(c, 9).alias(n) for n, c in calendar.cyclic("ts").items()]
    )


@query("f03_fee_histogram", sql("SELECT * FROM hist", hist_cte()))
def f03(spark, sf):
    return hist_hourly(spark, sf)


@query("f04_format_values",
    "SELECT event_id, CASE WHEN value / 500 < 0.0001 THEN '<0.0001' "
    "ELSE printf('%.4f', value / 517) END AS p_text, "
    "CASE WHEN value > 1 THEN printf('%.4e', value) ELSE 'Insufficient Data' END AS stat_text FROM events",
)
def f04(spark, sf):
    v = F.col("value")
    shown = F.when(v / 500 < 0.0001, F.lit(0.0)).otherwise(v / 517)
    return events(spark, sf).select(
        "event_id",
        F.when(v / 500 < 0.0001, F.lit("<0.0001"))
        .otherwise(text.format_p_value(F.greatest(shown, F.lit(0.0001))))
        .alias("p_text"),
        text.format_or_insufficient(F.when(v > 1, v)).alias("stat_text"),
    )


@query(
    "f05_pretty_labels",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_shipdate < TIMESTAMP '1997-01-01' THEN 'Early' "
    "ELSE 'Ship ' || l_returnflag || ' ' || l_linestatus END AS label FROM lineitem",
)
def f05(spark, sf):
    li = table(spark, sf, "lineitem")
    early = F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")
    name = F.when(early, F.lit("l_early")).otherwise(
        F.concat_ws("_", F.lit("l_ship"), "l_returnflag", "l_linestatus")
    )
    return li.select(
        "l_orderkey", "l_linenumber", text.pretty_label(name, "l_", {"l_early": "Early"}).alias("label")
    )


@query(
    "f06_bin_start",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS bin, CAST({c[len(HISTOGRAM_PREFIX):].split('_')[0]} AS DOUBLE) AS start, "
            f"count(CASE WHEN {c} > 0 THEN 1 END) AS n_hours FROM hist"
            for c in bin_columns()
        ),
        hist_cte(),
    ),
)
def f06(spark, sf):
    h = hist_hourly(spark, sf).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in bin_columns()])
    long = h.unpivot([], bin_columns(), "bin", "n_hours")
    return long.select("bin", bin_start(F.col("bin")).alias("start"), "n_hours")


FOURIER = {"daily": (1.0, 3), "weekly": (7.0, 2)}
FOURIER_SQL = ", ".join(
    f"{rs(f'{fn}({2 * math.pi * k / period!r} * epoch_us(ts) / 86400000000.0)', 5)} AS {name}_{fn}{k}"
    for name, (period, order) in FOURIER.items()
    for k in range(1, order + 1)
    for fn in ("sin", "cos")
)


@query("f07_fourier_terms", sql(f"SELECT series_id, pos, {FOURIER_SQL} FROM dense"))
def f07(spark, sf):
    terms = calendar.fourier(calendar.days("ts"), FOURIER)
    return dense(spark, sf).select(
        "series_id", "pos", *[rd(c, 5).alias(n) for n, c in terms.items()]
    )


@query(
    "f08_trend_hinges",
    sql(
        "SELECT d.series_id, d.pos, "
        + ", ".join(
            f"{rs(f'greatest(0, d.pos / (s.n - 1.0) - {0.8 * j / 5!r})')} AS hinge_{j}"
            for j in range(1, 6)
        )
        + " FROM dense d JOIN sizes s ON s.series_id = d.series_id"
    ),
)
def f08(spark, sf):
    from tidemark.plans.lookup import attach_agg

    d = attach_agg(dense(spark, sf), KEYS, ["pos"], F.max("pos").alias("_top"))
    scaled = F.col("pos") / F.col("_top").cast("double")
    cols = calendar.hinges(scaled, calendar.changepoints(5, 0.8))
    return d.select("series_id", "pos", *[rd(c).alias(n) for n, c in cols.items()])


# ---------------------------------------------------------------- windows

LAGS = [1, 2, 3, 24, 48, 168]


@query(
    "w01_lag_features",
    sql(
        f"SELECT series_id, pos, {rs('value')} AS value, "
        + ", ".join(
            f"{rs(f'lag(value, {k}) OVER (PARTITION BY series_id ORDER BY pos)')} AS value_lag_{k}"
            for k in LAGS
        )
        + " FROM hourly"
    ),
)
def w01(spark, sf):
    out = features.lag_features(hourly(spark, sf), KEYS, "pos", "value", LAGS)
    lags = [rd(f"value_lag_{k}").alias(f"value_lag_{k}") for k in LAGS]
    return out.select("series_id", "pos", rd("value").alias("value"), *lags)


@query(
    "w02_shift_features",
    sql(
        f"SELECT series_id, pos, {rs('y')} AS y, {rs('v')} AS value FROM (SELECT series_id, pos, "
        f"value AS y, lag(value, {HORIZON}) OVER (PARTITION BY series_id ORDER BY pos) AS v, "
        f"row_number() OVER (PARTITION BY series_id ORDER BY pos) AS rn FROM hourly) WHERE rn > {HORIZON}"
    ),
)
def w02(spark, sf):
    h = hourly(spark, sf).withColumn("y", F.col("value"))
    out = features.shift_features(h, KEYS, "pos", ["value"], HORIZON)
    return out.select("series_id", "pos", rd("y").alias("y"), rd("value").alias("value"))


@query(
    "w03_time_since_previous",
    "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER "
    "(PARTITION BY event_type ORDER BY ts, event_id) AS gap_us FROM events",
)
def w03(spark, sf):
    out = features.time_since_previous(events(spark, sf), KEYS, "ts", ["event_id"])
    return out.select("event_id", "gap_us")


ROLL_SQL = (
    "CASE WHEN count(value) OVER w = {n} THEN avg(value) OVER w END",
    "CASE WHEN count(value) OVER w = {n} THEN stddev_samp(value) OVER w END",
)


def roll_sql(ids: str, src: str, part: str, order: str, n: int) -> str:
    mean, std = (e.format(n=n) for e in ROLL_SQL)
    return (
        f"SELECT {ids}, {rfs(mean)} AS roll_mean, {rfs(std)} AS roll_std FROM {src} "
        f"WINDOW w AS (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    )


@query("w04_rolling_stats", sql(roll_sql("series_id, pos", "dense", "series_id", "pos", DAY)))
def w04(spark, sf):
    out = features.rolling_stats(dense(spark, sf), KEYS, "pos", "value", DAY)
    return out.select(
        "series_id", "pos", rf("roll_mean").alias("roll_mean"), rf("roll_std").alias("roll_std")
    )


@query(
    "w04_rolling_stats_rows", roll_sql("event_id", "events", "event_type", "ts, event_id", 288)
)
def w04b(spark, sf):
    out = features.rolling_stats_rows(events(spark, sf), KEYS, ["ts", "event_id"], "value", 288)
    return out.select(
        "event_id", rf("roll_mean").alias("roll_mean"), rf("roll_std").alias("roll_std")
    )


@query(
    "w05_interpolate_linear",
    sql(
        f"SELECT series_id, ts, {rs('value')} AS value FROM quarter",
        gapped_ctes(900, "_q").strip(),
        filled_cte("gapped_q", "quarter").strip(),
    ),
)
def w05(spark, sf):
    from tidemark.operators.clean import interpolate

    out = interpolate(gapped(spark, sf, 900), KEYS, "pos", ["value"])
    return out.select("series_id", "ts", rd("value").alias("value"))


@query(
    "w06_time_index",
    "SELECT event_id, CAST(trunc((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 02:00:00')) "
    "/ 900000000.0) AS BIGINT) AS time_idx FROM events",
)
def w06(spark, sf):
    index = calendar.time_index("ts", "2024-01-15 02:00:00", 900)
    return events(spark, sf).select("event_id", index.alias("time_idx"))


@query(
    "w07_week_index",
    "SELECT event_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) // 604800000000 + 1 "
    "AS week FROM events",
)
def w07(spark, sf):
    return features.week_index(events(spark, sf), "ts").select("event_id", "week")


CENTERED = f"""
centered AS (
  SELECT series_id, pos, value, CASE WHEN count(value) OVER w = {DAY + 1} THEN
    (sum(value) OVER w - (lag(value, {DAY // 2}) OVER o + lead(value, {DAY // 2}) OVER o) / 2) / {DAY} END AS trend
  FROM dense
  WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {DAY // 2} PRECEDING AND {DAY // 2} FOLLOWING),
         o AS (PARTITION BY series_id ORDER BY pos))"""


@query(
    "w08_centered_average",
    sql(f"SELECT series_id, pos, {rfs('trend')} AS trend FROM centered", CENTERED.strip()),
)
def w08(spark, sf):
    out = features.centered_average(dense(spark, sf), KEYS, "pos", "value", DAY)
    return out.select("series_id", "pos", rf("trend").alias("trend"))


@query(
    "w09_average_rank",
    "SELECT DISTINCT event_type AS series_id, value, rank() OVER (PARTITION BY event_type ORDER BY "
    "value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rank FROM events",
)
def w09(spark, sf):
    counts = value_counts(events(spark, sf), KEYS, "value")
    return average_ranks(counts, KEYS, "value").select("series_id", "value", "rank")


@query("w10_season_phase", sql(f"SELECT series_id, pos, CAST(pos % {DAY} AS INTEGER) AS phase FROM dense"))
def w10(spark, sf):
    return dense(spark, sf).select(
        "series_id", "pos", F.pmod("pos", F.lit(DAY)).cast("int").alias("phase")
    )


BIN_SUMS = ", ".join(f"sum({c}) AS {c}" for c in bin_columns())


@query(
    "w11_running_share",
    sql(
        f"SELECT bin, {rs('100.0 * sum(total) OVER (ORDER BY start ROWS UNBOUNDED PRECEDING) / sum(total) OVER ()')} "
        "AS cum_share FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS bin, {c[len(HISTOGRAM_PREFIX):].split('_')[0]}::DOUBLE AS start, "
            f"sum({c}) AS total FROM hist"
            for c in bin_columns()
        )
        + ")",
        hist_cte(),
    ),
)
def w11(spark, sf):
    out = bin_totals(hist_hourly(spark, sf), bin_columns())
    return out.select("bin", rd("cum_share").alias("cum_share"))


# ---------------------------------------------------------------- feature pipelines

FEES = [f"fee_{t}" for t in TYPES]


@query(
    "m22_fee_features",
    sql(
        f"SELECT timestamp, series_id, {rs('target')} AS target, mempool_count, "
        f"{rs('mempool_total', 4)} AS mempool_total, {rs('price_k')} AS price_k, "
        "CAST(trunc((epoch_us(timestamp) - epoch_us(TIMESTAMP '2024-01-10 02:00:00')) / 3600000000.0) AS BIGINT) AS time_idx, "
        + CYCLE_SQL.replace("(ts)", "(timestamp)")
        + " FROM ("
        + " UNION ALL ".join(
            f"SELECT make_timestamp(slot * {HOUR * 1_000_000}) AS timestamp, '{f}' AS series_id, "
            f"{f} AS target, mempool_count, mempool_total, price_k FROM wide"
            for f in FEES
        )
        + ")"
    ),
)
def m22(spark, sf):
    w = wide_hourly(spark, sf).withColumn("timestamp", calendar.slot_start("slot", HOUR)).drop("slot")
    out = features.fee_features(w, FEES, "timestamp", "2024-01-10 02:00:00", HOUR)
    digits = {"target": 6, "mempool_total": 4, "price_k": 6}
    return out.select(
        *[
            rd(c, 9).alias(c)
            if c.endswith(("_sin", "_cos"))
            else rd(c, digits[c]).alias(c)
            if c in digits
            else c
            for c in out.columns
        ]
    )


def _filled(col: str, out: str) -> str:
    return filled_cte(f"(SELECT series_id, slot, pos, ts, {col} AS value FROM gapped_m)", out).strip()


@query(
    "m23_clean_series",
    sql(
        f"SELECT a.series_id, a.ts, {rs('a.value')} AS value, {rs('b.value')} AS k "
        "FROM fill_v a JOIN fill_k b ON b.series_id = a.series_id AND b.pos = a.pos",
        gapped_ctes(900, "_m").strip().replace(
            "avg(value) AS value", "avg(value) AS value, avg(k) AS k"
        ).replace("o.value\n", "o.value, o.k\n"),
        _filled("value", "fill_v"),
        _filled("k", "fill_k"),
    ),
)
def m23(spark, sf):
    out = clean_series(events(spark, sf), KEYS, "ts", ["value", "k"], 900)
    return out.select("series_id", "ts", rd("value").alias("value"), rd("k").alias("k"))


MLAGS = [1, 2, 24]


@query(
    "m24_supervised_matrix",
    sql(
        f"SELECT series_id, pos, {rs('y')} AS value, "
        + ", ".join(f"{rs(f'x{k}')} AS value_lag_{k}" for k in MLAGS)
        + f", CASE WHEN pos > top - {HORIZON} THEN 'test' ELSE 'train' END AS split FROM ("
        f"SELECT *, max(pos) OVER (PARTITION BY series_id) AS top FROM (SELECT d.series_id, d.pos, d.value AS y, "
        + ", ".join(
            f"lag(d.value, {k + HORIZON}) OVER (PARTITION BY d.series_id ORDER BY d.pos) AS x{k}"
            for k in MLAGS
        )
        + f" FROM dense d JOIN sizes s ON s.series_id = d.series_id WHERE d.pos < s.n - {HORIZON})) "
        f"WHERE pos >= {HORIZON}"
    ),
)
def m24(spark, sf):
    d = dense(spark, sf).select("series_id", "pos", "value")
    return _matrix(d)


def _matrix(d):
    out = features.supervised_matrix(d, KEYS, "pos", "value", MLAGS, HORIZON)
    lags = [rd(f"value_lag_{k}").alias(f"value_lag_{k}") for k in MLAGS]
    return out.select("series_id", "pos", rd("value").alias("value"), *lags, "split")


@query(
    "m24_supervised_matrix_gapped",
    sql(
        f"SELECT series_id, pos, {rs('y')} AS value, "
        + ", ".join(f"{rs(f'x{k}')} AS value_lag_{k}" for k in MLAGS)
        + f", CASE WHEN i > top - {HORIZON} THEN 'test' ELSE 'train' END AS split FROM ("
        "SELECT *, max(i) OVER (PARTITION BY series_id) AS top FROM (SELECT series_id, pos, i, value AS y, n, "
        + ", ".join(f"lag(value, {k + HORIZON}) OVER (PARTITION BY series_id ORDER BY pos) AS x{k}" for k in MLAGS)
        + " FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS i, "
        f"count(*) OVER (PARTITION BY series_id) AS n FROM gapped WHERE value IS NOT NULL)) WHERE i < n - {HORIZON}) "
        f"WHERE i >= {HORIZON}"
    ),
)
def m24_gapped(spark, sf):
    """Hours without a value are dropped first: lags and shifts count the hours that are left."""
    return _matrix(gapped(spark, sf).select("series_id", "pos", "value"))


def _raw_filled(column: str) -> str:
    src = (
        f"raw_{column} AS (SELECT 'all' AS series_id, g.slot, g.slot - min(g.slot) OVER () AS pos, "
        f"make_timestamp(g.slot * 900000000) AS ts, r.{column} AS value FROM raw_grid g LEFT JOIN raw_bins r ON r.slot = g.slot)"
    )
    return f"{src},\n{filled_cte(f'raw_{column}', f'fill_{column}').strip()}"


@query(
    "m23_clean_snapshots",
    sql(
        f"SELECT a.ts, {rs('a.value')} AS mempool_count, {rs('b.value')} AS \"price_USD\" "
        "FROM fill_count a JOIN fill_usd b ON b.pos = a.pos",
        "raw_bins AS (SELECT CAST(epoch_us(ts) // 900000000 AS BIGINT) AS slot, avg(k) AS count, "
        "avg(CASE WHEN series_id = 'purchase' THEN value END) AS usd FROM ev GROUP BY 1)",
        "raw_grid AS (SELECT unnest(generate_series(min(slot), max(slot))) AS slot FROM raw_bins)",
        _raw_filled("count"),
        _raw_filled("usd"),
    ),
)
def m23_raw(spark, sf):
    """The cleaning from its real entry: wide raw snapshots with an epoch, other prices and high bins."""
    of = lambda t: F.when(F.col("series_id") == t, F.col("value"))
    raw = events(spark, sf).select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("k").alias("mempool_count"),
        of("purchase").alias("price_USD"),
        of("click").alias("price_EUR"),
        of("view").alias("mempool_fee_histogram_bin_300_350"),
    )
    out = clean_snapshots(raw)
    return out.select("ts", rd("mempool_count").alias("mempool_count"), rd("price_USD").alias("price_USD"))
