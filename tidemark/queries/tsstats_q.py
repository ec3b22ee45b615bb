"""Time-series statistics (T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import tsstats
from tidemark.operators.aggregates import SWEEP_SECONDS
from tidemark.queries.aggregates_q import DECOMP_CTES
from tidemark.queries.registry import (
    DAY,
    KEYS,
    daily_orders,
    dense,
    events,
    query,
    rd,
    rf,
    rfs,
    rs,
    sql,
)
from tidemark.session import durable


def _shifted(spark, sf):
    """Strictly positive series for ratios."""
    return dense(spark, sf).withColumn("value", F.col("value") + 1.0)


PARTS = ["trend", "seasonal", "resid"]


@query(
    "t01_decompose_additive",
    sql(
        f"SELECT series_id, pos, {', '.join(f'{rfs(c)} AS {c}' for c in PARTS)} FROM decomp",
        DECOMP_CTES.strip(),
    ),
)
def t01(spark, sf):
    out = tsstats.decompose(dense(spark, sf), KEYS, "pos", "value", DAY)
    return out.select("series_id", "pos", *[rf(c).alias(c) for c in PARTS])


MULT_CTES = f"""
pos_dense AS (SELECT series_id, pos, value + 1 AS value FROM dense),
m_centered AS (
  SELECT series_id, pos, value, CASE WHEN count(value) OVER w = {DAY + 1} THEN
    (sum(value) OVER w - (lag(value, {DAY // 2}) OVER o + lead(value, {DAY // 2}) OVER o) / 2) / {DAY} END AS trend
  FROM pos_dense
  WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {DAY // 2} PRECEDING AND {DAY // 2} FOLLOWING),
         o AS (PARTITION BY series_id ORDER BY pos)),
m_phase AS (SELECT series_id, pos % {DAY} AS phase, avg(value / trend) AS a FROM m_centered GROUP BY 1, 2),
m_decomp AS (
  SELECT c.series_id, c.pos, c.trend, p.seasonal, c.value / c.trend / p.seasonal AS resid
  FROM m_centered c JOIN (SELECT series_id, phase, a / avg(a) OVER (PARTITION BY series_id) AS seasonal
                          FROM m_phase) p ON p.series_id = c.series_id AND p.phase = c.pos % {DAY})"""


@query(
    "t01_decompose_multiplicative",
    sql(
        f"SELECT series_id, pos, {', '.join(f'{rfs(c)} AS {c}' for c in PARTS)} FROM m_decomp",
        MULT_CTES.strip(),
    ),
)
def t01b(spark, sf):
    out = tsstats.decompose(_shifted(spark, sf), KEYS, "pos", "value", DAY, "multiplicative")
    return out.select("series_id", "pos", *[rf(c).alias(c) for c in PARTS])


NLAGS = 48


def acf_ctes(src: str, nlags: int) -> str:
    return f"""
centred AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS x,
  count(*) OVER (PARTITION BY series_id) AS n FROM {src}),
products AS (
  SELECT a.series_id, CAST(k AS INTEGER) AS lag, sum(a.x * b.x) AS s, any_value(a.n) AS n
  FROM centred a, generate_series(0, {nlags}) g(k), centred b
  WHERE b.series_id = a.series_id AND b.pos = a.pos - k GROUP BY 1, 2),
acf AS (
  SELECT series_id, lag, s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY series_id) AS acf, n
  FROM products)"""


@query(
    "t02_autocorrelation",
    sql(
        f"SELECT series_id, lag, {rs('acf', 8)} AS acf, CASE WHEN lag = 0 THEN 0.0 ELSE "
        + rs(
            "1.959963984540054 * sqrt((1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf ELSE 0 END) "
            "OVER (PARTITION BY series_id ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n)",
            8,
        )
        + " END AS band, n FROM acf",
        acf_ctes("dense", NLAGS).strip(),
    ),
)
def t02(spark, sf):
    out = tsstats.acf(dense(spark, sf), KEYS, "pos", "value", NLAGS)
    return out.select("series_id", "lag", rd("acf", 8).alias("acf"), rd("band", 8).alias("band"), "n")


@query("t03_partial_autocorrelation")
def t03(spark, sf):
    return tsstats.pacf(dense(spark, sf), KEYS, "pos", "value", NLAGS, adjusted=False)


@query(
    "t03_pacf_two_lags",
    sql(
        f"SELECT series_id, {rs('r1', 8)} AS pacf1, {rs('(r2 - r1 * r1) / (1 - r1 * r1)', 8)} AS pacf2 FROM ("
        "SELECT series_id, max(CASE WHEN lag = 1 THEN s / (n - 1) END) / max(CASE WHEN lag = 0 THEN s / n END) AS r1, "
        "max(CASE WHEN lag = 2 THEN s / (n - 2) END) / max(CASE WHEN lag = 0 THEN s / n END) AS r2 "
        "FROM products GROUP BY 1)",
        acf_ctes("dense", 2).strip(),
    ),
)
def t03b(spark, sf):
    out = tsstats.pacf(dense(spark, sf), KEYS, "pos", "value", 2, adjusted=True)
    return out.groupBy("series_id").agg(
        *[rd(F.max(F.when(F.col("lag") == k, F.col("pacf"))), 8).alias(f"pacf{k}") for k in (1, 2)]
    )


SWEEP_CTES = (
    "swept AS ("
    + " UNION ALL ".join(
        f"SELECT series_id, {s} AS step, CAST(epoch_us(ts) // {s * 1_000_000} AS BIGINT) AS slot, "
        "avg(value) AS value FROM ev GROUP BY 1, 2, 3"
        for s in SWEEP_SECONDS
    )
    + "), swept_x AS (SELECT series_id, step, row_number() OVER w AS p, "
    "value - avg(value) OVER (PARTITION BY series_id, step) AS x FROM swept "
    "WINDOW w AS (PARTITION BY series_id, step ORDER BY slot)), "
    "swept_lag AS (SELECT series_id, step, x, lag(x, 1) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM swept_x "
    "WINDOW w AS (PARTITION BY series_id, step ORDER BY p)), "
    "ratios AS (SELECT series_id, step, n, r1 AS pacf1, (r2 - r1 * r1) / (1 - r1 * r1) AS pacf2 FROM ("
    "SELECT series_id, step, count(*) AS n, (sum(x * x1) / (count(*) - 1)) / (sum(x * x) / count(*)) AS r1, "
    "(sum(x * x2) / (count(*) - 2)) / (sum(x * x) / count(*)) AS r2 FROM swept_lag GROUP BY 1, 2))"
)


@query(
    "t04_decay_ratio",
    sql(
        f"SELECT series_id, step, n, {rs('pacf1', 8)} AS pacf1, {rs('pacf2', 8)} AS pacf2, "
        f"{rs('abs(pacf1) / abs(pacf2)', 5)} AS decay_ratio, CAST(row_number() OVER (PARTITION BY series_id "
        "ORDER BY abs(pacf1) / abs(pacf2) DESC, step) AS INTEGER) AS best_rank FROM ratios",
        SWEEP_CTES,
    ),
)
def t04(spark, sf):
    out = tsstats.decay_ratios(events(spark, sf), KEYS, "ts", "value")
    return out.select(
        "series_id", "step", "n", rd("pacf1", 8).alias("pacf1"), rd("pacf2", 8).alias("pacf2"),
        rd("decay_ratio", 5).alias("decay_ratio"), "best_rank",
    )


@query("t05_adf_test")
def t05(spark, sf):
    return tsstats.adf_test(dense(spark, sf), KEYS, "pos", "value")


@query("t06_adf_by_week")
def t06(spark, sf):
    return tsstats.adf_by_week(dense(spark, sf), KEYS, "pos", "ts", "value")


def naive_residuals(spark, sf):
    """Value minus the value a day before."""
    from tidemark.operators.features import lag_features

    lagged = lag_features(dense(spark, sf), KEYS, "pos", "value", [DAY])
    rows = lagged.filter(F.col("pos") >= DAY)
    return durable(
        rows.select(
            "series_id",
            (F.col("pos") - DAY).alias("pos"),
            (F.col("value") - F.col(f"value_lag_{DAY}")).alias("value"),
        )
    )


RESID_CTE = (
    f"resid AS (SELECT a.series_id, a.pos - {DAY} AS pos, a.value - b.value AS value FROM dense a "
    f"JOIN dense b ON b.series_id = a.series_id AND b.pos = a.pos - {DAY})"
)


@query(
    "t07_ljung_box",
    sql(
        f"SELECT series_id, n, {rs('n * (n + 2) * sum(acf * acf / (n - lag))', 5)} AS q_stat FROM acf "
        "WHERE lag > 0 GROUP BY series_id, n",
        RESID_CTE,
        acf_ctes("resid", 96).strip(),
    ),
)
def t07(spark, sf):
    out = tsstats.ljung_box(naive_residuals(spark, sf), KEYS, "pos", "value", 96)
    return out.select("series_id", "n", rd("q_stat", 5).alias("q_stat"))


@query("t07_ljung_box_p_value")
def t07b(spark, sf):
    return tsstats.ljung_box(naive_residuals(spark, sf), KEYS, "pos", "value", 96)


@query("t08_arch_lm")
def t08(spark, sf):
    return tsstats.arch_lm(naive_residuals(spark, sf), KEYS, "pos", "value")


@query("t09_normal_qq")
def t09(spark, sf):
    return tsstats.qq_pairs(naive_residuals(spark, sf), KEYS, "pos", "value")


@query(
    "t10_exponential_ks",
    f"""
SELECT series_id, any_value(n) AS n, {rs("any_value(rate)", 9)} AS rate,
  {rs("max(greatest(hi / n - cdf, cdf - lo / n))", 9)} AS ks_stat
FROM (SELECT series_id, n, rate, 1 - exp(-rate * value) AS cdf,
        sum(w) OVER (PARTITION BY series_id ORDER BY value) AS hi,
        sum(w) OVER (PARTITION BY series_id ORDER BY value) - w AS lo
      FROM (SELECT event_type AS series_id, value, count(*) AS w FROM events GROUP BY 1, 2) v
      JOIN (SELECT event_type AS t, count(*) AS n, 1 / avg(value) AS rate FROM events GROUP BY 1) s
        ON s.t = v.series_id)
GROUP BY series_id""",
)
def t10(spark, sf):
    out = tsstats.exponential_ks(events(spark, sf), KEYS, "value")
    return out.select("series_id", "n", rd("rate", 9).alias("rate"), rd("ks_stat", 9).alias("ks_stat"))


@query("t10_exponential_ks_p_value")
def t10b(spark, sf):
    return tsstats.exponential_ks(events(spark, sf), KEYS, "value")


@query(
    "t11_yearly_spikes",
    sql(
        "SELECT day, CAST(year(day) AS INTEGER) AS year, total, "
        "CAST(date_diff('day', lag(day) OVER (ORDER BY day), day) AS INTEGER) AS days_since FROM ("
        "SELECT day, round(total, 2) AS total, quantile_cont(round(total, 2), 0.95) "
        "OVER (PARTITION BY year(day)) AS thr FROM daily) WHERE total > thr"
    ),
)
def t11(spark, sf):
    d = daily_orders(spark, sf).select("day", F.round("total", 2).alias("total"))
    return tsstats.yearly_spikes(d, "day", "total").select("day", "year", "total", "days_since")


@query(
    "t12_spike_calendar",
    sql(
        "SELECT DISTINCT d.series_id, d.ts AS ds, 'congestion_spike' AS holiday FROM dense d JOIN ("
        "SELECT x.series_id, quantile_cont(x.value, 0.9) AS thr FROM dense x GROUP BY 1) t "
        "ON t.series_id = d.series_id WHERE d.value > t.thr"
    ),
)
def t12(spark, sf):
    return tsstats.spike_events(dense(spark, sf), KEYS, "ts", "value", 0.9)
