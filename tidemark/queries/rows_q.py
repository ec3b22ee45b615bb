"""Projections, filters, reshapes, joins, sorts and set operations (P, R, J, O, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import calendar
from tidemark.functions.columns import double_columns, require_columns, with_prefix
from tidemark.functions.histogram import HISTOGRAM_PREFIX, bin_columns, bin_start, high_bin_columns
from tidemark.functions.loss import METRICS
from tidemark.operators import clean, reshape
from tidemark.operators.aggregates import fee_histogram
from tidemark.operators.features import lag_features
from tidemark.operators.smoothing import hw_configs
from tidemark.operators.metrics import best_config, evaluate, leaderboard, metric_matrix
from tidemark.operators.splits import lengths, weekly_folds
from tidemark.plans.lookup import attach
from tidemark.plans.order import quantiles
from tidemark.session import durable
from tidemark.queries.registry import (
    both_models,
    DAY,
    HORIZON,
    HOUR,
    KEYS,
    TYPES,
    WEEK,
    dense,
    events,
    gapped,
    gapped_ctes,
    hourly,
    median_day,
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


def hist_hourly(spark, sf):
    e = events(spark, sf).withColumn("slot", calendar.slot("ts", HOUR))
    return fee_histogram(e, ["slot"], "value", "k")


def _hist_expr(column: str) -> str:
    label = column[len(HISTOGRAM_PREFIX) :]
    lo, hi = label.split("_")
    upper = "" if hi == "plus" else f" AND value < {hi}"
    return f"coalesce(sum(CASE WHEN value >= {lo}{upper} THEN k END), 0.0) AS {column}"


def hist_cte(columns=None) -> str:
    cols = ", ".join(_hist_expr(c) for c in (columns or bin_columns()))
    return (
        f"hist AS (SELECT CAST(epoch_us(ts) // {HOUR * 1_000_000} AS BIGINT) AS slot, {cols} "
        "FROM ev GROUP BY 1)"
    )


LOW_BINS = [c for c in bin_columns() if c not in high_bin_columns()]


@query("p01_drop_high_bins", sql(f"SELECT slot, {', '.join(LOW_BINS)} FROM hist", hist_cte()))
def p01(spark, sf):
    return clean.drop_present(hist_hourly(spark, sf), high_bin_columns())


@query(
    "p02_drop_prefix_except",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
)
def p02(spark, sf):
    o = table(spark, sf, "orders")
    return clean.keep_one_of_prefix(o, "o_order", "o_orderkey")


@query(
    "p03_prefix_select",
    "SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem",
)
def p03(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", *with_prefix(li, "l_line"))


@query(
    "p04_double_columns",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem",
)
def p04(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", *double_columns(li, ["l_tax"], ["l_disc"]))


@query(
    "p05_epoch_to_timestamp",
    "SELECT event_id, make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS timestamp FROM events",
)
def p05(spark, sf):
    raw = events(spark, sf).select(
        "event_id", calendar.slot("ts", 1).cast("double").alias("timestamp")
    )
    return clean.epoch_to_timestamp(raw, "timestamp")


@query(
    "p06_trim_last",
    sql(
        f"SELECT d.series_id, d.pos, {rs('d.value')} AS value FROM dense d "
        f"JOIN sizes s ON s.series_id = d.series_id WHERE d.pos < s.n - {HORIZON}"
    ),
)
def p06(spark, sf):
    out = clean.trim_last(dense(spark, sf), KEYS, "pos", HORIZON)
    return out.select("series_id", "pos", rd("value").alias("value"))


@query(
    "p06_take_last",
    sql(
        f"SELECT d.series_id, d.pos, {rs('d.value')} AS value FROM dense d "
        f"JOIN sizes s ON s.series_id = d.series_id WHERE d.pos >= s.n - {HORIZON}"
    ),
)
def p06b(spark, sf):
    out = clean.take_last(dense(spark, sf), KEYS, "pos", HORIZON)
    return out.select("series_id", "pos", rd("value").alias("value"))


@query(
    "p07_drop_first_row",
    "SELECT event_type AS series_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY "
    "event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn > 1",
)
def p07(spark, sf):
    return clean.drop_first(events(spark, sf), KEYS, ["ts", "event_id"]).select(
        "series_id", "event_id"
    )


@query(
    "p08_drop_nulls",
    sql(
        f"SELECT series_id, pos, {rs('value')} AS value, {rs('lagged')} AS value_lag_{DAY} FROM ("
        f"SELECT *, lag(value, {DAY}) OVER (PARTITION BY series_id ORDER BY pos) AS lagged "
        "FROM gapped) WHERE value IS NOT NULL AND lagged IS NOT NULL"
    ),
)
def p08(spark, sf):
    lagged = lag_features(gapped(spark, sf), KEYS, "pos", "value", [DAY])
    return clean.drop_null_rows(lagged).select(
        "series_id", "pos", rd("value").alias("value"),
        rd(f"value_lag_{DAY}").alias(f"value_lag_{DAY}"),
    )


@query("p09_one_series", sql(f"SELECT ts, {rs('value')} AS value FROM dense WHERE series_id = 'click'"))
def p09(spark, sf):
    return clean.one_series(dense(spark, sf), "click").select("ts", rd("value").alias("value"))


@query("p10_require_columns", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def p10(spark, sf):
    checked = require_columns(table(spark, sf, "events"), ["ts", "event_type", "value"])
    return checked.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p11_sentinel_rows",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.0",
)
def p11(spark, sf):
    return clean.sentinel_rows(
        table(spark, sf, "lineitem"), "l_discount", 0.0, ["l_orderkey", "l_linenumber"]
    )


@query(
    "p12_zero_and_positive",
    "SELECT event_type AS series_id, count(CASE WHEN value = 0 THEN 1 END) AS n_zero, "
    "count(CASE WHEN value > 0 THEN 1 END) AS n_positive, "
    + rs("avg(CASE WHEN value > 0 THEN value END)")
    + " AS mean_positive FROM events GROUP BY 1",
)
def p12(spark, sf):
    v = F.col("value")
    return events(spark, sf).groupBy("series_id").agg(
        F.count_if(v == 0).alias("n_zero"),
        F.count_if(v > 0).alias("n_positive"),
        rd(F.avg(F.when(v > 0, v))).alias("mean_positive"),
    )


@query(
    "p13_all_zero_columns",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", bool_and(coalesce({c} = 0, false)) AS all_zero FROM hist"
            for c in bin_columns()
        ),
        hist_cte(),
    ),
)
def p13(spark, sf):
    h = hist_hourly(spark, sf)
    return clean.all_zero_columns(h, with_prefix(h, HISTOGRAM_PREFIX))


@query(
    "p14_log_transforms",
    "SELECT event_id, "
    + rs("ln(1 + value)", 9)
    + " AS logged, "
    + rs("exp(ln(1 + value)) - 1")
    + " AS restored FROM events",
)
def p14(spark, sf):
    logged = F.log1p("value")
    return events(spark, sf).select(
        "event_id", rd(logged, 9).alias("logged"), rd(F.expm1(logged)).alias("restored")
    )


@query(
    "p15_unit_scale",
    "SELECT o_orderkey, round(o_totalprice * 100000000, 0) AS total_scaled FROM orders",
)
def p15(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.round(F.col("o_totalprice") * F.lit(100_000_000), 0).alias("total_scaled")
    )


@query(
    "p16_rename",
    sql(f"SELECT series_id, ts AS ds, {rs('ln(1 + value)')} AS y FROM dense"),
)
def p16(spark, sf):
    d = dense(spark, sf).withColumnsRenamed({"ts": "ds", "value": "y"})
    return d.select("series_id", "ds", rd(F.log1p("y")).alias("y"))


@query(
    "p17_round_half_even",
    sql(
        "SELECT series_id, pos, round_even(ln(1 + value), 4) + 0.0 AS v4, "
        "round_even(ln(1 + value), 3) + 0.0 AS v3, round_even(ln(1 + value), 2) + 0.0 AS v2 "
        "FROM dense"
    ),
)
def p17(spark, sf):
    x = F.log1p("value")
    return dense(spark, sf).select(
        "series_id", "pos", *[F.bround(x, d).alias(f"v{d}") for d in (4, 3, 2)]
    )


# ---------------------------------------------------------------- reshape

FEES = [f"fee_{t}" for t in TYPES]


@query(
    "r01_wide_to_long",
    sql(
        " UNION ALL ".join(
            f"SELECT slot, '{f}' AS series_id, {rs(f)} AS target FROM wide" for f in FEES
        )
    ),
)
def r01(spark, sf):
    long = reshape.to_long(wide_hourly(spark, sf), ["slot"], FEES)
    return long.withColumn("target", rd("target"))


def _scores(spark, sf):
    both = both_models(spark, sf)
    return evaluate(durable(both), ["model"])


SCORE_CTES = f"""
both_models AS (SELECT 'naive' AS model, series_id, ts, y_true, y_pred FROM naive UNION ALL
  SELECT 'median', series_id, ts, y_true, y_pred FROM median_day),
scores AS (SELECT *, mae + std_diff + dev_error AS custom_loss FROM {raw_metrics_sql("both_models", "model")})"""


@query(
    "r02_metric_matrix",
    sql(
        " UNION ALL ".join(
            f"SELECT '{m}' AS metric, "
            f"{rs(f'max(CASE WHEN model = {chr(39)}naive{chr(39)} THEN {m} END)')} AS naive, "
            f"{rs(f'max(CASE WHEN model = {chr(39)}median{chr(39)} THEN {m} END)')} AS median "
            "FROM scores"
            for m in METRICS
        ),
        SCORE_CTES.strip(),
    ),
)
def r02(spark, sf):
    m = metric_matrix(_scores(spark, sf), ["naive", "median"])
    return m.select("metric", rd("naive").alias("naive"), rd("median").alias("median"))


@query(
    "r03_transpose_metrics",
    sql(
        " UNION ALL ".join(
            f"SELECT model, '{m}' AS metric, {rs(m)} AS value FROM scores" for m in METRICS
        ),
        SCORE_CTES.strip(),
    ),
)
def r03(spark, sf):
    long = reshape.transpose_metrics(_scores(spark, sf), METRICS, ["model"])
    return long.withColumn("value", rd("value"))


@query(
    "r04_append_columns",
    "SELECT l_orderkey, l_linenumber, "
    + rs("l_extendedprice * (1 - l_discount)", 4)
    + " AS net, "
    + rs("l_extendedprice * (1 - l_discount) * (1 + l_tax)")
    + " AS gross, "
    + rs("ln(1 + l_quantity)")
    + " AS log_quantity FROM lineitem",
)
def r04(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_quantity"
    )
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    out = reshape.add_columns(
        li,
        {
            "net": rd(net, 4),
            "gross": rd(net * (1 + F.col("l_tax"))),
            "log_quantity": rd(F.log1p("l_quantity")),
        },
    )
    return out.select("l_orderkey", "l_linenumber", "net", "gross", "log_quantity")


# ---------------------------------------------------------------- joins


@query(
    "j01_join_features",
    sql(
        "SELECT l.slot, l.series_id, l.target, w.mempool_count, "
        f"{rs('w.mempool_total', 4)} AS mempool_total FROM ("
        + " UNION ALL ".join(
            f"SELECT slot, '{f}' AS series_id, {rs(f)} AS target FROM wide" for f in FEES
        )
        + ") l LEFT JOIN wide w ON w.slot = l.slot"
    ),
)
def j01(spark, sf):
    w = wide_hourly(spark, sf)
    long = reshape.to_long(w, ["slot"], FEES)
    features = w.select("slot", "mempool_count", rd("mempool_total", 4).alias("mempool_total"))
    return reshape.join_features(long, features, ["slot"]).withColumn("target", rd("target"))


@query(
    "j02_complete_pairs",
    sql(
        f"SELECT slot, {rs('fee_click')} AS fee_click, {rs('fee_view')} AS fee_view FROM wide "
        "WHERE fee_click IS NOT NULL AND fee_view IS NOT NULL"
    ),
)
def j02(spark, sf):
    pairs = reshape.complete_pairs(wide_hourly(spark, sf), "fee_click", "fee_view")
    return pairs.select(
        "slot", rd("fee_click").alias("fee_click"), rd("fee_view").alias("fee_view")
    )


@query(
    "j03_align_forecast",
    sql(f"SELECT series_id, ts, {rs('y_true')} AS y_true, {rs('y_pred')} AS y_pred FROM naive"),
)
def j03(spark, sf):
    n = naive_forecast(spark, sf)
    actual = dense(spark, sf).select("series_id", "ts", F.col("value").alias("y_true"))
    out = reshape.align_forecast(n.select("series_id", "ts", "y_pred"), actual)
    return out.select("series_id", "ts", rd("y_true").alias("y_true"), rd("y_pred").alias("y_pred"))


@query(
    "j04_compare_models",
    sql(
        f"SELECT n.series_id, n.ts, {rs('n.y_true')} AS y_true, {rs('n.y_pred')} AS y_pred_1, "
        f"{rs('m.y_pred')} AS y_pred_2 FROM naive n JOIN median_day m "
        "ON m.series_id = n.series_id AND m.ts = n.ts"
    ),
)
def j04(spark, sf):
    out = reshape.compare_forecasts(naive_forecast(spark, sf), median_day(spark, sf))
    return out.select(
        "series_id", "ts", *[rd(c).alias(c) for c in ("y_true", "y_pred_1", "y_pred_2")]
    )


EXPANDING_CTE = f"""
folds AS (
  SELECT series_id, n, i AS fold, 0 AS train_start, i * {WEEK} AS train_end,
         i * {WEEK} AS test_start, i * {WEEK} + {HORIZON} AS test_end
  FROM (SELECT *, unnest(generate_series(1, n // {WEEK} + 1)) AS i FROM sizes) WHERE i * {WEEK} + {HORIZON} <= n)"""


@query(
    "j05_assign_folds",
    sql(
        f"SELECT series_id, fold, part, count(*) AS n, {rs('sum(value)', 4)} AS total FROM ("
        "SELECT d.series_id, CAST(f.fold AS INTEGER) AS fold, d.value, CASE WHEN d.pos < f.train_end "
        "THEN 'train' ELSE 'test' END AS part FROM dense d JOIN folds f ON f.series_id = d.series_id "
        "AND d.pos >= f.train_start AND d.pos < f.test_end) GROUP BY 1, 2, 3",
        EXPANDING_CTE.strip(),
    ),
)
def j05(spark, sf):
    d = dense(spark, sf)
    folds = weekly_folds(lengths(d, KEYS, "pos"), KEYS, "expanding", WEEK, HORIZON)
    assigned = reshape.assign_folds(d, folds, KEYS, "pos")
    return assigned.groupBy("series_id", "fold", "part").agg(
        F.count(F.lit(1)).alias("n"), rd(F.sum("value"), 4).alias("total")
    )


@query(
    "j06_grid_by_folds",
    sql(
        "SELECT f.series_id, CAST(f.fold AS INTEGER) AS fold, t.trend, s.seasonal, d.damped "
        "FROM folds f, (VALUES ('add'), ('mul'), (NULL)) t(trend), "
        "(VALUES ('add'), ('mul'), (NULL)) s(seasonal), (VALUES (true), (false)) d(damped) "
        "WHERE NOT (t.trend IS NULL AND d.damped)",
        EXPANDING_CTE.strip(),
    ),
)
def j06(spark, sf):
    sizes = lengths(dense(spark, sf), KEYS, "pos")
    folds = weekly_folds(sizes, KEYS, "expanding", WEEK, HORIZON)
    return reshape.with_configs(folds, hw_configs(spark)).select(
        "series_id", "fold", "trend", "seasonal", "damped"
    )


@query(
    "j07_attach_statistics",
    "SELECT e.event_id, "
    + rs("e.value - m.med")
    + " AS centred FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.5) AS med "
    "FROM events GROUP BY 1) m ON m.event_type = e.event_type",
)
def j07(spark, sf):
    e = events(spark, sf)
    med = quantiles(e, KEYS, "value", {"med": 0.5})
    rows = attach(e.select("event_id", "series_id", "value"), med, KEYS, ["event_id"])
    return rows.select("event_id", rd(F.col("value") - F.col("med")).alias("centred"))


@query(
    "j08_regular_grid",
    sql(
        f"SELECT series_id, ts, {rs('value')} AS value FROM gapped_q",
        gapped_ctes(900, "_q").strip(),
    ),
)
def j08(spark, sf):
    return gapped(spark, sf, 900).select("series_id", "ts", rd("value").alias("value"))


@query(
    "j09_future_grid",
    sql(
        "SELECT series_id, CAST(i AS INTEGER) AS step, CAST(top + i AS BIGINT) AS slot FROM "
        "(SELECT series_id, max(slot) AS top FROM dense GROUP BY 1), "
        f"generate_series(1, {HORIZON}) g(i)"
    ),
)
def j09(spark, sf):
    return reshape.future_grid(dense(spark, sf), KEYS, "slot", HORIZON)


# ---------------------------------------------------------------- sorts, top-k, set operations


@query("o01_sort_by_time", sql(f"SELECT series_id, ts, {rs('value')} AS value FROM hourly"))
def o01(spark, sf):
    """Every series in time order inside its partition; a total order only where a sink wants it."""
    h = hourly(spark, sf).select("series_id", "ts", "slot", rd("value").alias("value"))
    parts = h.repartition("series_id", F.floor(F.col("slot") / 16384))
    return parts.sortWithinPartitions("series_id", "ts").drop("slot")


CV_CTE = f"""
cv_rows AS (
  SELECT d.series_id, p.lag AS config_id, CAST((d.pos - {WEEK}) // {DAY} + 1 AS INTEGER) AS fold,
         d.value AS y_true, b.value AS y_pred
  FROM dense d JOIN (VALUES (24), (48), (168)) p(lag) ON true
  JOIN dense b ON b.series_id = d.series_id AND b.pos = d.pos - p.lag WHERE d.pos >= {WEEK}),
cv_folds AS (SELECT *, mae + std_diff + dev_error AS custom_loss
  FROM {raw_metrics_sql("cv_rows", "series_id, config_id, fold")}),
cv AS (SELECT series_id, config_id, avg(custom_loss) AS avg_custom_score FROM cv_folds GROUP BY 1, 2)"""


def naive_cv_folds(spark, sf):
    """Naive forecasts with lags of one day, two days and a week, scored per day."""
    d = dense(spark, sf)
    lags = [24, 48, 168]
    rows = lag_features(d, KEYS, "pos", "value", lags).filter(F.col("pos") >= WEEK)
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("config_id"), F.col(f"value_lag_{k}").alias("y_pred"))
                for k in lags
            ]
        )
    )
    long = rows.select(
        "series_id",
        (F.floor((F.col("pos") - WEEK) / DAY) + 1).cast("int").alias("fold"),
        F.col("value").alias("y_true"),
        pairs.alias("_p"),
    ).select("series_id", "fold", "y_true", "_p.*")
    return evaluate(long, ["series_id", "config_id", "fold"])


@query(
    "o02_sort_by_score",
    sql(
        f"SELECT series_id, CAST(config_id AS INTEGER) AS config_id, {rs('avg_custom_score')} AS "
        "avg_custom_score FROM cv ORDER BY avg_custom_score",
        CV_CTE.strip(),
    ),
)
def o02(spark, sf):
    scores = naive_cv_folds(spark, sf).groupBy("series_id", "config_id").agg(
        F.avg("custom_loss").alias("avg_custom_score")
    )
    return scores.select(
        "series_id", "config_id", rd("avg_custom_score").alias("avg_custom_score")
    ).orderBy("avg_custom_score", "config_id")


@query(
    "o03_best_configuration",
    sql(
        f"SELECT series_id, CAST(config_id AS INTEGER) AS config_id, {rs('avg_custom_score')} AS "
        "avg_custom_score FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY "
        "avg_custom_score, config_id) AS rn FROM cv) WHERE rn = 1",
        CV_CTE.strip(),
    ),
)
def o03(spark, sf):
    scores = naive_cv_folds(spark, sf).groupBy("series_id", "config_id").agg(
        F.avg("custom_loss").alias("avg_custom_score")
    )
    best = best_config(scores, KEYS, "avg_custom_score", "config_id")
    return best.withColumn("avg_custom_score", rd("avg_custom_score"))


@query(
    "o04_last_steps_overall",
    sql(
        f"SELECT series_id, slot, {rs('value')} AS value FROM hourly "
        f"WHERE slot > (SELECT max(slot) FROM hourly) - {HORIZON}"
    ),
)
def o04(spark, sf):
    out = clean.take_last(hourly(spark, sf), [], "slot", HORIZON)
    return out.select("series_id", "slot", rd("value").alias("value"))


@query(
    "o05_sort_by_bin_start",
    sql(
        "SELECT bin, start, total FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS bin, {float(c[len(HISTOGRAM_PREFIX):].split('_')[0])}::DOUBLE AS start, "
            f"{rs(f'sum({c})', 2)} AS total FROM hist"
            for c in bin_columns()
        )
        + ") ORDER BY start",
        hist_cte(),
    ),
)
def o05(spark, sf):
    h = hist_hourly(spark, sf)
    sums = h.agg(*[F.sum(c).alias(c) for c in bin_columns()])
    long = reshape.to_long(sums, [], bin_columns(), "bin", "total")
    return long.select("bin", bin_start(F.col("bin")).alias("start"), rd("total", 2).alias("total")).orderBy("start")


@query(
    "o06_leaderboard",
    sql(
        f"SELECT model, {rs('custom_loss')} AS custom_loss, {rs('std_diff')} AS std_diff, "
        f"{rs('rmse')} AS rmse, CAST(rank() OVER (ORDER BY custom_loss) AS INTEGER) AS rank FROM scores",
        SCORE_CTES.strip(),
    ),
)
def o06(spark, sf):
    return round_metrics(leaderboard(_scores(spark, sf)))


@query(
    "u01_union_fold_metrics",
    sql(
        metrics_sql("(SELECT series_id, config_id, fold, y_true, y_pred FROM cv_rows)", "fold"),
        CV_CTE.strip(),
    ),
)
def u01(spark, sf):
    """Folds are rows from the start, so the union of per-fold results is one grouped aggregate."""
    d = dense(spark, sf)
    lags = [24, 48, 168]
    rows = lag_features(d, KEYS, "pos", "value", lags).filter(F.col("pos") >= WEEK)
    fold = (F.floor((F.col("pos") - WEEK) / DAY) + 1).cast("int").alias("fold")
    per_lag = [
        rows.select(fold, F.col("value").alias("y_true"), F.col(f"value_lag_{k}").alias("y_pred"))
        for k in lags
    ]
    every = per_lag[0].unionByName(per_lag[1]).unionByName(per_lag[2])
    return round_metrics(evaluate(every, ["fold"]))


@query(
    "u02_union_forecasts",
    sql(
        f"SELECT model, series_id, ts, {rs('y_true')} AS y_true, {rs('y_pred')} AS y_pred "
        "FROM both_models",
        SCORE_CTES.strip(),
    ),
)
def u02(spark, sf):
    both = both_models(spark, sf)
    return both.select(
        "model", "series_id", "ts", rd("y_true").alias("y_true"), rd("y_pred").alias("y_pred")
    )

