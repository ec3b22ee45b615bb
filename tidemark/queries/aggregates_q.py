"""Aggregates, correlations and scores (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.histogram import HISTOGRAM_PREFIX, bin_columns
from tidemark.operators import aggregates, correlation, metrics
from tidemark.operators.clean import resample
from tidemark.operators.features import week_index
from tidemark.operators.tsstats import decompose
from tidemark.functions.calendar import slot_start
from tidemark.queries.registry import (
    both_models,
    DAY,
    KEYS,
    TYPES,
    daily_orders,
    dense,
    events,
    metrics_sql,
    naive_forecast,
    query,
    raw_metrics_sql,
    rd,
    round_metrics,
    rs,
    sql,
    table,
    wide_hourly,
)
from tidemark.queries.rows_q import CV_CTE, SCORE_CTES, hist_cte, hist_hourly, naive_cv_folds, _scores


@query(
    "a01_resample_mean",
    "SELECT event_type AS series_id, make_timestamp((epoch_us(ts) // 900000000) * 900000000) AS ts, "
    + rs("avg(value)")
    + " AS value FROM events GROUP BY 1, 2",
)
def a01(spark, sf):
    out = resample(events(spark, sf), KEYS, "ts", 900, {"value": F.avg("value")})
    return out.select("series_id", slot_start("slot", 900).alias("ts"), rd("value").alias("value"))


@query(
    "a02_resample_sweep",
    " UNION ALL ".join(
        f"SELECT event_type AS series_id, {s} AS step, epoch_us(ts) // {s * 1_000_000} AS slot, "
        f"{rs('avg(value)')} AS value FROM events GROUP BY event_type, slot"
        for s in aggregates.SWEEP_SECONDS
    ),
)
def a02(spark, sf):
    out = aggregates.resample_sweep(events(spark, sf), KEYS, "ts", "value")
    return out.withColumn("value", rd("value"))


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DESCRIBE_SQL = " UNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", count({c}) AS count, {rs(f'avg({c})', 4)} AS mean, "
    f"{rs(f'stddev_samp({c})', 4)} AS std, min({c}) AS min, max({c}) AS max, "
    f"{rs(f'quantile_cont({c}, 0.25)', 4)} AS q25, {rs(f'quantile_cont({c}, 0.5)', 4)} AS q50, "
    f"{rs(f'quantile_cont({c}, 0.75)', 4)} AS q75 FROM lineitem GROUP BY l_returnflag"
    for c in MEASURES
)


@query("a03_describe", DESCRIBE_SQL)
def a03(spark, sf):
    out = aggregates.describe(table(spark, sf, "lineitem"), ["l_returnflag"], MEASURES)
    return out.select(
        "l_returnflag", "column", "count", "min", "max",
        *[rd(c, 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")],
    )


DECOMP_CTES = f"""
centered AS (
  SELECT series_id, pos, ts, value, CASE WHEN count(value) OVER w = {DAY + 1} THEN
    (sum(value) OVER w - (lag(value, {DAY // 2}) OVER o + lead(value, {DAY // 2}) OVER o) / 2) / {DAY} END AS trend
  FROM dense
  WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {DAY // 2} PRECEDING AND {DAY // 2} FOLLOWING),
         o AS (PARTITION BY series_id ORDER BY pos)),
phase_add AS (SELECT series_id, pos % {DAY} AS phase, avg(value - trend) AS a FROM centered GROUP BY 1, 2),
decomp AS (
  SELECT c.series_id, c.pos, c.ts, c.value, c.trend, p.seasonal, c.value - c.trend - p.seasonal AS resid
  FROM centered c JOIN (SELECT series_id, phase, a - avg(a) OVER (PARTITION BY series_id) AS seasonal
                        FROM phase_add) p ON p.series_id = c.series_id AND p.phase = c.pos % {DAY})"""


@query(
    "a04_group_describe",
    sql(
        "SELECT (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM decomp)) // 604800000000 + 1 AS week, "
        f"count(resid) AS count, {rs('avg(resid)')} AS mean, {rs('stddev_samp(resid)')} AS std, "
        f"{rs('min(resid)')} AS min, {rs('max(resid)')} AS max FROM decomp GROUP BY 1",
        DECOMP_CTES.strip(),
    ),
)
def a04(spark, sf):
    parts = decompose(dense(spark, sf), KEYS, "pos", "value", DAY)
    out = aggregates.group_moments(week_index(parts, "ts"), ["week"], "resid")
    return out.select("week", "count", *[rd(c).alias(c) for c in ("mean", "std", "min", "max")])


@query(
    "a05_quantiles",
    "SELECT event_type AS series_id, "
    + ", ".join(
        f"{rs(e)} AS {n}"
        for n, e in {
            "mean": "avg(value)",
            "median": "quantile_cont(value, 0.5)",
            "q90": "quantile_cont(value, 0.9)",
            "q95": "quantile_cont(value, 0.95)",
            "q99": "quantile_cont(value, 0.99)",
        }.items()
    )
    + " FROM events GROUP BY 1",
)
def a05(spark, sf):
    out = aggregates.peak_levels(events(spark, sf), KEYS, "value")
    return out.select(
        "series_id", *[rd(c).alias(c) for c in ("mean", "median", "q90", "q95", "q99")]
    )


@query(
    "a06_group_quantile_flag",
    sql(
        "SELECT day, total > thr AS spike FROM (SELECT day, round(total, 2) AS total, "
        "quantile_cont(round(total, 2), 0.95) OVER (PARTITION BY year(day)) AS thr FROM daily)"
    ),
)
def a06(spark, sf):
    d = daily_orders(spark, sf).select(
        "day", F.year("day").alias("year"), F.round("total", 2).alias("total")
    )
    return aggregates.above_group_quantile(d, ["year"], "total", 0.95).select("day", "spike")


@query(
    "a07_metrics_per_series",
    sql(
        f"SELECT series_id, {rs('mae')} AS \"MAE\", {rs('rmse')} AS \"RMSE\", "
        f"CASE WHEN has_zero THEN NULL ELSE {rs('mape')} END AS \"MAPE\", "
        f"{rs('mae + std_diff + dev_error')} AS custom_loss FROM "
        + raw_metrics_sql("naive", "series_id")
        + " m JOIN (SELECT series_id AS sid, bool_or(y_true = 0) AS has_zero FROM naive GROUP BY 1) z "
        "ON z.sid = m.series_id"
    ),
)
def a07(spark, sf):
    out = metrics.per_series_metrics(naive_forecast(spark, sf))
    return out.select("series_id", *[rd(c).alias(c) for c in ("MAE", "RMSE", "MAPE", "custom_loss")])


@query(
    "a08_std_difference",
    sql(
        f"SELECT series_id, {rs('abs(stddev_pop(y_pred) - stddev_pop(y_true))')} AS std_diff "
        "FROM naive GROUP BY 1"
    ),
)
def a08(spark, sf):
    from tidemark.functions import loss

    return naive_forecast(spark, sf).groupBy("series_id").agg(rd(loss.std_diff()).alias("std_diff"))


@query(
    "a09_deviation_error",
    sql(
        f"SELECT series_id, ts, {rs('abs(y_pred - y_true - avg(y_pred - y_true) OVER (PARTITION BY series_id))')} "
        "AS dev_error FROM naive"
    ),
)
def a09(spark, sf):
    out = metrics.deviation_errors(naive_forecast(spark, sf), KEYS)
    return out.select("series_id", "ts", rd("dev_error").alias("dev_error"))


@query(
    "a10_composite_loss",
    sql(
        f"SELECT series_id, {rs('mae + 0.5 * std_diff + 2.0 * dev_error')} AS custom_loss FROM "
        + raw_metrics_sql("naive", "series_id")
    ),
)
def a10(spark, sf):
    out = metrics.evaluate(naive_forecast(spark, sf), KEYS, 0.5, 2.0)
    return out.select("series_id", rd("custom_loss").alias("custom_loss"))


@query("a11_six_metrics", sql(metrics_sql("both_models", "model, series_id"), SCORE_CTES.strip()))
def a11(spark, sf):
    both = both_models(spark, sf)
    return round_metrics(metrics.evaluate(both, ["model", "series_id"]))


@query(
    "a12_training_loss",
    sql(
        "SELECT series_id, origin, "
        + rs(
            "avg(b + least(mae / (sp + 1e-8), 10) * sp + least(b / (dev + 1e-8), 10) * dev)"
        )
        + " AS loss FROM (SELECT series_id, origin, abs(e) AS b, abs(e - avg(e) OVER w) AS dev, "
        "avg(abs(e)) OVER w AS mae, abs(stddev_samp(p) OVER w - stddev_samp(t) OVER w) AS sp FROM "
        f"(SELECT d.series_id, d.pos // {DAY} AS origin, b.value AS p, d.value AS t, b.value - d.value AS e "
        f"FROM dense d JOIN dense b ON b.series_id = d.series_id AND b.pos = d.pos - {DAY}) "
        "WINDOW w AS (PARTITION BY series_id, origin)) GROUP BY 1, 2 HAVING count(*) > 1"
    ),
)
def a12(spark, sf):
    from tidemark.operators.features import lag_features

    d = lag_features(dense(spark, sf), KEYS, "pos", "value", [DAY])
    rows = d.filter(F.col("pos") >= DAY).select(
        "series_id",
        F.floor(F.col("pos") / DAY).alias("origin"),
        F.col("value").alias("y_true"),
        F.col(f"value_lag_{DAY}").alias("y_pred"),
    )
    out = metrics.training_loss(rows, ["series_id", "origin"])
    return out.filter(F.col("loss").isNotNull()).withColumn("loss", rd("loss"))


@query(
    "a13_cv_scores",
    sql(
        "SELECT series_id, CAST(config_id AS INTEGER) AS config_id, "
        + ", ".join(
            f"{rs(f'avg({m})')} AS {a}"
            for m, a in {
                "mae": "avg_mae",
                "mape": "avg_mape",
                "rmse": "avg_rmse",
                "std_diff": "avg_std_penalty",
                "dev_error": "avg_dev_error",
                "custom_loss": "avg_custom_score",
            }.items()
        )
        + " FROM cv_folds GROUP BY 1, 2 HAVING count(*) = count(custom_loss)",
        CV_CTE.strip(),
    ),
)
def a13(spark, sf):
    out = metrics.cv_scores(naive_cv_folds(spark, sf), ["series_id", "config_id"])
    return out.select(
        *[rd(c).alias(c) if c.startswith("avg_") else c for c in out.columns]
    )


@query(
    "a14_bin_totals",
    sql(
        f"SELECT bin, start, {rs('total', 2)} AS total, {rs('100.0 * total / sum(total) OVER ()')} AS share, "
        f"{rs('100.0 * sum(total) OVER (ORDER BY start ROWS UNBOUNDED PRECEDING) / sum(total) OVER ()')} AS cum_share, "
        f"{rs('ln(1 + total)')} AS log_total FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS bin, {c[len(HISTOGRAM_PREFIX):].split('_')[0]}::DOUBLE AS start, "
            f"sum({c}) AS total FROM hist"
            for c in bin_columns()
        )
        + ")",
        hist_cte(),
    ),
)
def a14(spark, sf):
    out = aggregates.bin_totals(hist_hourly(spark, sf), bin_columns())
    return out.select(
        "bin", "start", rd("total", 2).alias("total"),
        *[rd(c).alias(c) for c in ("share", "cum_share", "log_total")],
    )


def histogram_sql(k: str) -> str:
    return f"""
SELECT f.series_id, CAST(f.bin AS INTEGER) AS bin, {rs("f.lo + f.w * f.bin")} AS left_edge,
  CAST(count(h.bin) AS BIGINT) AS n
FROM (SELECT series_id, lo, w, unnest(range(k)) AS bin FROM (
        SELECT *, (hi - lo) / k AS w FROM (
          SELECT event_type AS series_id, min(value) AS lo, max(value) AS hi, {k} AS k
          FROM events GROUP BY 1))) f
LEFT JOIN (
  SELECT e.event_type AS series_id, least(CAST(floor((e.value - s.lo) / s.w) AS BIGINT), s.k - 1) AS bin
  FROM events e JOIN (SELECT *, (hi - lo) / k AS w FROM (
      SELECT event_type AS series_id, min(value) AS lo, max(value) AS hi, {k} AS k FROM events GROUP BY 1)) s
    ON s.series_id = e.event_type) h ON h.series_id = f.series_id AND h.bin = f.bin
GROUP BY 1, 2, 3"""


AUTO_BINS = (
    "CAST(ceil((max(value) - min(value)) / least((max(value) - min(value)) / (log2(count(*)) + 1), "
    "2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(*), 1.0 / 3))) AS BIGINT)"
)


@query("a15_histogram_fixed", histogram_sql("30"))
def a15(spark, sf):
    out = aggregates.equal_width_histogram(events(spark, sf), KEYS, "value", 30)
    return out.withColumn("left_edge", rd("left_edge"))


@query("a15_histogram_auto", histogram_sql(AUTO_BINS))
def a15b(spark, sf):
    out = aggregates.equal_width_histogram(events(spark, sf), KEYS, "value", "auto")
    return out.withColumn("left_edge", rd("left_edge"))


@query(
    "a16_kde_curve",
    f"""
SELECT s.series_id, CAST(i AS INTEGER) AS point, {rs("s.lo + (s.hi - s.lo) * i / 199")} AS x,
  {rs("sum(w.c * exp(-0.5 * pow((s.lo + (s.hi - s.lo) * i / 199 - w.value) / s.bw, 2))) / (any_value(s.n) * any_value(s.bw) * sqrt(2 * pi()))", 9)} AS density
FROM (SELECT event_type AS series_id, min(value) AS lo, max(value) AS hi, count(*) AS n,
        stddev_samp(value) * pow(count(*), -0.2) AS bw FROM events GROUP BY 1) s,
  range(200) g(i),
  (SELECT event_type AS sid, value, count(*) AS c FROM events GROUP BY 1, 2) w
WHERE w.sid = s.series_id GROUP BY s.series_id, i, s.lo, s.hi""",
)
def a16(spark, sf):
    out = aggregates.kde_curve(events(spark, sf), KEYS, "value")
    return out.select("series_id", "point", rd("x").alias("x"), rd("density", 9).alias("density"))


@query(
    "a17_box_stats",
    f"""
SELECT series_id, {rs("q1")} AS q1, {rs("med")} AS med, {rs("q3")} AS q3,
  min(CASE WHEN ok THEN value END) AS whisker_lo, max(CASE WHEN ok THEN value END) AS whisker_hi,
  count(CASE WHEN NOT ok THEN 1 END) AS n_outliers
FROM (SELECT e.event_type AS series_id, e.value, q.q1, q.med, q.q3,
        e.value >= q.q1 - 1.5 * (q.q3 - q.q1) AND e.value <= q.q3 + 1.5 * (q.q3 - q.q1) AS ok
      FROM events e JOIN (SELECT event_type AS t, quantile_cont(value, 0.25) AS q1,
        quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) q
      ON q.t = e.event_type)
GROUP BY 1, 2, 3, 4""",
)
def a17(spark, sf):
    out = aggregates.box_stats(events(spark, sf), KEYS, "value")
    return out.select(
        "series_id", *[rd(c).alias(c) for c in ("q1", "med", "q3")],
        "whisker_lo", "whisker_hi", "n_outliers",
    )


FEATURES = [*[f"fee_{t}" for t in TYPES], "mempool_count", "price_k"]


def matrix_sql(expr: str, columns, src: str = "wide", complete: str = "") -> str:
    """Full matrix as a union over ordered pairs; ``expr`` uses x and y."""
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {rs(expr)} AS r, count(*) AS n FROM "
        f"(SELECT {a} AS x, {b} AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL {complete})"
        for a in columns
        for b in columns
    )


def rank_matrix_sql(columns, src: str = "wide", complete: str = "") -> str:
    rank = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {rs('corr(rx, ry)')} AS r, count(*) AS n FROM (SELECT "
        f"{rank.format(c=a)} AS rx, {rank.format(c=b)} AS ry FROM {src} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL {complete})"
        for a in columns
        for b in columns
    )


@query("a18_pearson_matrix", sql(matrix_sql("corr(x, y)", FEATURES)))
def a18(spark, sf):
    return correlation.pearson_matrix(wide_hourly(spark, sf), FEATURES).withColumn("r", rd("r"))


@query("a19_spearman_matrix", sql(rank_matrix_sql(FEATURES)))
def a19(spark, sf):
    return correlation.spearman_matrix(wide_hourly(spark, sf), FEATURES).withColumn("r", rd("r"))


LISTWISE = "AND " + " AND ".join(f"fee_{t} IS NOT NULL" for t in TYPES)


@query(
    "a20_group_spearman",
    sql(
        "SELECT upper(x[5]) || x[6:] AS x_label, upper(y[5]) || y[6:] AS y_label, r, n FROM ("
        + rank_matrix_sql([f"fee_{t}" for t in TYPES], "wide", LISTWISE)
        + ")"
    ),
)
def a20(spark, sf):
    out = correlation.group_spearman(wide_hourly(spark, sf), "fee_")
    return out.withColumn("r", rd("r"))


@query("a21_correlation_summary")
def a21(spark, sf):
    return correlation.correlation_summary(wide_hourly(spark, sf), FEATURES[0], FEATURES[1:])


@query(
    "a22_modal_interval",
    "WITH g AS (SELECT event_type AS series_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) "
    "OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000000, event_id) AS d FROM events), "
    "c AS (SELECT series_id, d * 1000000 AS gap_us, count(*) AS n FROM g WHERE d IS NOT NULL GROUP BY 1, 2) "
    "SELECT c.series_id, c.gap_us, c.n, s.a AS first_ts, s.b AS last_ts FROM c "
    "JOIN (SELECT event_type, make_timestamp(min(epoch_us(ts) // 1000000) * 1000000) AS a, "
    "make_timestamp(max(epoch_us(ts) // 1000000) * 1000000) AS b FROM events GROUP BY 1) s "
    "ON s.event_type = c.series_id "
    "WHERE n = (SELECT max(n) FROM c c2 WHERE c2.series_id = c.series_id)",
)
def a22(spark, sf):
    whole = events(spark, sf).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return aggregates.modal_gap(whole, KEYS, "ts", ["event_id"])


@query("a23_deduplicate", "SELECT DISTINCT event_type AS series_id, date_trunc('hour', ts) AS ds FROM events")
def a23(spark, sf):
    e = events(spark, sf).select(
        "series_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ds")
    )
    return e.dropDuplicates(["series_id", "ds"])


@query(
    "a24_improvement",
    sql(
        f"SELECT model, {rs('custom_loss')} AS custom_loss, {rs('100.0 * (b - custom_loss) / b')} AS improvement_pct "
        "FROM scores, (SELECT min(custom_loss) AS b FROM scores WHERE model = 'median')",
        SCORE_CTES.strip(),
    ),
)
def a24(spark, sf):
    out = metrics.improvement(_scores(spark, sf), ["median"])
    return out.select(
        "model", rd("custom_loss").alias("custom_loss"), rd("improvement_pct").alias("improvement_pct")
    )


@query(
    "a25_sample_median",
    sql(
        f"SELECT series_id, CAST(pos % {DAY} AS INTEGER) AS step, {rs('quantile_cont(value, 0.5)')} AS y_pred "
        "FROM dense GROUP BY 1, 2"
    ),
)
def a25(spark, sf):
    """Past days as sample paths of the next one."""
    paths = dense(spark, sf).withColumn("step", F.pmod("pos", F.lit(DAY)).cast("int"))
    out = aggregates.sample_median(paths, ["series_id", "step"], "value")
    return out.withColumn("y_pred", rd("y_pred"))

