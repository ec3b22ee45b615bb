"""Forecasters, back-tests, leaderboard (M12-M21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.calendar import cyclic
from tidemark.functions.loss import METRICS
from tidemark.operators import forecast as fc
from tidemark.operators.additive import additive_forecast, additive_grid_search, grid_configs
from tidemark.operators.features import lag_features, shift_features
from tidemark.operators.metrics import evaluate, leaderboard
from tidemark.operators.reshape import assign_folds, parameter_grid
from tidemark.operators.rolling import (
    arma_folds,
    backtest_folds,
    compare_fold_models,
    naive_folds,
    score_fold_forecast,
)
from tidemark.operators.smoothing import (
    SMOOTHING,
    hw_configs,
    smooth_cv,
    smooth_fit,
    smooth_fitted,
    smooth_folds,
    smooth_forecast,
)
from tidemark.operators.splits import (
    counted_folds,
    lengths,
    rolling_origin_folds,
    sample_configs,
    weekly_folds,
    window_folds,
)
from tidemark.operators.trees import predict_trees, search_and_refit, tree_forecast, tree_random_search
from tidemark.queries.registry import (
    DAY,
    HORIZON,
    KEYS,
    WEEK,
    dense,
    last_day,
    metrics_sql,
    query,
    raw_metrics_sql,
    rd,
    round_metrics,
    rs,
    sql,
)
from tidemark.queries.rows_q import SCORE_CTES
from tidemark.session import durable, new_path
from tidemark.sources.models import load_state, save_state

FIXED = {"alpha": [0.3], "beta": [0.05], "gamma": [0.1], "phi": [1.0]}


def _one_config(spark, trend, seasonal, damped=False):
    rows = [(0, trend, seasonal, damped)]
    return spark.createDataFrame(
        rows, "config_id int, trend string, seasonal string, damped boolean"
    )


@query("m12_median_forecast", sql(f"SELECT series_id, pos, {rs('y_pred', 7)} AS y_pred FROM median_day"))
def m12(spark, sf):
    out = fc.median_forecast(last_day(spark, sf), KEYS, "pos", "value")
    return out.select("series_id", "pos", rd("y_pred", 7).alias("y_pred"))


HW_CTES = f"""
hw_train AS (
  SELECT d.series_id, d.pos, d.value FROM dense d JOIN sizes s ON s.series_id = d.series_id
  WHERE d.pos < s.n - {HORIZON}),
hw_start AS (
  SELECT series_id, l0, (l1 - l0) / {DAY} AS b0,
    list_transform(firsts, lambda x: x - l0) AS season FROM (
    SELECT series_id, avg(CASE WHEN pos < {DAY} THEN value END) AS l0,
      avg(CASE WHEN pos >= {DAY} AND pos < {2 * DAY} THEN value END) AS l1,
      list(value ORDER BY pos) FILTER (WHERE pos < {DAY}) AS firsts FROM hw_train GROUP BY 1)),
hw AS (
  SELECT series_id, CAST(0 AS BIGINT) AS t, l0 AS level, b0 AS slope, season FROM hw_start
  UNION ALL
  SELECT h.series_id, h.t + 1,
    0.3 * (y.value - h.season[1]) + 0.7 * (h.level + h.slope),
    0.05 * (0.3 * (y.value - h.season[1]) + 0.7 * (h.level + h.slope) - h.level) + 0.95 * h.slope,
    list_append(h.season[2:], 0.1 * (y.value - h.level - h.slope) + 0.9 * h.season[1])
  FROM hw h JOIN hw_train y ON y.series_id = h.series_id AND y.pos = h.t)"""


@query(
    "m13_holt_winters_fixed",
    sql(
        f"SELECT h.series_id, h.t + i - 1 AS pos, {rs('h.level + i * h.slope + h.season[i]', 7)} AS y_pred "
        "FROM hw h JOIN (SELECT series_id, max(t) AS t FROM hw GROUP BY 1) e "
        f"ON e.series_id = h.series_id AND e.t = h.t, generate_series(1, {HORIZON}) g(i)",
        HW_CTES.strip(),
    ),
)
def m13(spark, sf):
    d, folds = _last(spark, sf)
    out = smooth_folds(d, folds, KEYS, "pos", "value", DAY, _one_config(spark, "add", "add"), FIXED)
    return out.select("series_id", "pos", rd("y_pred", 7).alias("y_pred"))


def smoothing_ctes(windows: str, configs: list[tuple], only: str = "") -> str:
    """Recursion of all configurations and candidates over ``windows`` (series_id, fold, a, b, h).

    Leaves ``hw_end`` (final states of the best candidates) and ``hw_pred`` (series_id, fold, config_id, pos,
    y_pred). ``only`` names a single series_id condition.
    """
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    rows = ", ".join(f"({i}, CAST({quoted(t)} AS VARCHAR), CAST({quoted(s)} AS VARCHAR), {d})" for i, t, s, d in configs)
    lists = {k: "[" + ", ".join(map(str, v)) + "]" for k, v in SMOOTHING.items()}
    pick = lambda k, when, other: f"CASE WHEN {when} THEN {lists[k]} ELSE [{other}] END"
    return f"""
hw_win AS ({windows}),
hw_cfg AS (SELECT * FROM (VALUES {rows}) t(config_id, trend, seasonal, damped)),
hw_cand AS (
  SELECT config_id, trend, seasonal, row_number() OVER (ORDER BY config_id, i, j, k, l) AS cand,
    als[i] AS al, bes[j] AS be, gas[k] AS ga, phs[l] AS ph FROM (
    SELECT *, unnest(generate_series(1, len(phs))) AS l FROM (
    SELECT *, unnest(generate_series(1, len(gas))) AS k FROM (
    SELECT *, unnest(generate_series(1, len(bes))) AS j FROM (
    SELECT *, unnest(generate_series(1, len(als))) AS i FROM (
    SELECT *, {lists["alpha"]} AS als, {pick("beta", "trend IS NOT NULL", "0.0")} AS bes,
      {pick("gamma", "seasonal IS NOT NULL", "0.0")} AS gas, {pick("phi", "damped", "1.0")} AS phs FROM hw_cfg))))),
  ),
hw_range AS (
  SELECT w.series_id, w.fold, w.a, w.b, w.h, min(d.value) AS lo, max(d.value) - min(d.value) AS span
  FROM hw_win w JOIN dense d ON d.series_id = w.series_id AND d.pos >= w.a AND d.pos < w.b
  GROUP BY ALL HAVING count(*) = w.b - w.a AND w.b - w.a >= {2 * DAY}),
hw_val AS (
  SELECT r.series_id, r.fold, s.scaled, d.pos - r.a AS t,
    CAST(CASE WHEN s.scaled THEN 1.0 + (d.value - r.lo) / r.span ELSE d.value END AS DOUBLE) AS y
  FROM hw_range r JOIN dense d ON d.series_id = r.series_id AND d.pos >= r.a AND d.pos < r.b,
    (VALUES (true), (false)) s(scaled)),
hw_first AS (
  SELECT series_id, fold, scaled, avg(y) FILTER (WHERE t < {DAY}) AS l0, avg(y) FILTER (WHERE t >= {DAY}) AS l1,
    list(y ORDER BY t) FILTER (WHERE t < {DAY}) AS ys FROM hw_val WHERE t < {2 * DAY} GROUP BY 1, 2, 3),
hw_state AS (
  SELECT f.series_id, f.fold, c.cand, CAST(0 AS BIGINT) AS t, f.l0 AS level,
    CAST(CASE c.trend WHEN 'add' THEN (l1 - l0) / {DAY} WHEN 'mul' THEN pow(l1 / l0, 1.0 / {DAY}) ELSE 0 END AS DOUBLE) AS slope,
    CASE c.seasonal WHEN 'add' THEN list_transform(ys, lambda x: x - l0) WHEN 'mul' THEN list_transform(ys, lambda x: x / l0)
      ELSE [CAST(0 AS DOUBLE)] END AS season, CAST(0 AS DOUBLE) AS sse
  FROM hw_first f JOIN hw_cand c
    ON f.scaled = (coalesce(c.trend, '') = 'mul' OR coalesce(c.seasonal, '') = 'mul')
  UNION ALL
  SELECT series_id, fold, cand, t + 1, fresh,
    CASE trend WHEN 'add' THEN be * (fresh - level) + (1 - be) * ph * slope
      WHEN 'mul' THEN be * (fresh / level) + (1 - be) * pow(slope, ph) ELSE slope END,
    CASE seasonal WHEN 'add' THEN list_append(season[2:], ga * (y - base) + (1 - ga) * season[1])
      WHEN 'mul' THEN list_append(season[2:], ga * (y / base) + (1 - ga) * season[1]) ELSE season END,
    sse + (y - CASE seasonal WHEN 'add' THEN base + season[1] WHEN 'mul' THEN base * season[1] ELSE base END)
        * (y - CASE seasonal WHEN 'add' THEN base + season[1] WHEN 'mul' THEN base * season[1] ELSE base END)
  FROM (
    SELECT *, al * (CASE seasonal WHEN 'add' THEN y - season[1] WHEN 'mul' THEN y / season[1] ELSE y END) + (1 - al) * base AS fresh
    FROM (
      SELECT s.*, c.trend, c.seasonal, c.al, c.be, c.ga, c.ph, v.y,
        CASE c.trend WHEN 'add' THEN s.level + c.ph * s.slope WHEN 'mul' THEN s.level * pow(s.slope, c.ph) ELSE s.level END AS base
      FROM hw_state s JOIN hw_cand c ON c.cand = s.cand
      JOIN hw_val v ON v.series_id = s.series_id AND v.fold = s.fold AND v.t = s.t
        AND v.scaled = (coalesce(c.trend, '') = 'mul' OR coalesce(c.seasonal, '') = 'mul')))),
hw_end AS (
  SELECT * FROM (
    SELECT s.*, c.config_id, c.trend, c.seasonal, c.al, c.be, c.ga, c.ph, r.a, r.b, r.h, r.lo, r.span,
      row_number() OVER (PARTITION BY s.series_id, s.fold, c.config_id ORDER BY s.sse, s.cand) AS place
    FROM hw_state s JOIN hw_cand c ON c.cand = s.cand
    JOIN hw_range r ON r.series_id = s.series_id AND r.fold = s.fold AND s.t = r.b - r.a)
  WHERE place = 1),
hw_raw AS (
  SELECT *, CASE seasonal WHEN 'add' THEN grown + season[(i - 1) % {DAY} + 1] WHEN 'mul' THEN grown * season[(i - 1) % {DAY} + 1]
    ELSE grown END AS told FROM (
    SELECT *, CASE trend WHEN 'add' THEN level + damp * slope WHEN 'mul' THEN level * pow(slope, damp) ELSE level END AS grown FROM (
      SELECT *, list_sum(list_transform(generate_series(1, i), lambda x: pow(ph, x))) AS damp FROM (
        SELECT *, unnest(generate_series(1, h)) AS i FROM hw_end)))),
hw_pred AS (
  SELECT series_id, fold, config_id, b + i - 1 AS pos,
    CASE WHEN coalesce(trend, '') = 'mul' OR coalesce(seasonal, '') = 'mul' THEN (told - 1) * span + lo ELSE told END AS y_pred
  FROM hw_raw)"""


#: The 15 configurations as (config_id, trend, seasonal, damped), in the order of ``hw_configs``.
HW_FORMS = [
    (t, s, d)
    for t in ("add", "mul", None)
    for s in ("add", "mul", None)
    for d in (True, False)
    if t is not None or not d
]
HW_ALL = [(i, *form) for i, form in enumerate(HW_FORMS)]
HW_DAMPED = [(0, "add", "add", True)]
LAST_WINDOW = f"SELECT series_id, 1 AS fold, 0 AS a, n - {HORIZON} AS b, {HORIZON} AS h FROM sizes WHERE n > {HORIZON}"


def _last(spark, sf):
    d = dense(spark, sf)
    return d, fc.last_day_fold(lengths(d, KEYS, "pos"), KEYS, HORIZON)


@query(
    "m13_holt_winters_all_forms",
    sql(
        f"SELECT series_id, fold, config_id, pos, {rs('y_pred', 7)} AS y_pred FROM hw_pred",
        smoothing_ctes(LAST_WINDOW, HW_ALL).strip(),
    ),
)
def m13b(spark, sf):
    d, folds = _last(spark, sf)
    out = smooth_folds(d, folds, KEYS, "pos", "value", DAY, hw_configs(spark))
    return out.select("series_id", "fold", "config_id", "pos", rd("y_pred", 7).alias("y_pred"))


HW_ONE_STEP = """
SELECT e.series_id, e.fold, e.config_id, d.pos, {fitted} AS fitted, {resid} AS resid
FROM hw_end e JOIN hw_state s ON s.series_id = e.series_id AND s.fold = e.fold AND s.cand = e.cand
JOIN dense d ON d.series_id = s.series_id AND d.pos = e.a + s.t AND d.pos < e.b"""


@query(
    "m13_holt_winters_residuals",
    sql(
        HW_ONE_STEP.format(
            fitted=rs("s.level + e.ph * s.slope + s.season[1]", 7),
            resid=rs("d.value - (s.level + e.ph * s.slope + s.season[1])", 7),
        ),
        smoothing_ctes(LAST_WINDOW, HW_DAMPED).strip(),
    ),
)
def m13c(spark, sf):
    d, folds = _last(spark, sf)
    out = smooth_fitted(d, folds, KEYS, "pos", "value", DAY, _one_config(spark, "add", "add", True))
    return out.select("series_id", "fold", "config_id", "pos", rd("fitted", 7).alias("fitted"), rd("resid", 7).alias("resid"))


@query(
    "s10_fitted_states",
    sql(
        f"SELECT series_id, config_id, pos, {rs('y_pred', 7)} AS y_pred FROM hw_pred",
        smoothing_ctes(LAST_WINDOW, HW_ALL).strip(),
    ),
)
def s10_states(spark, sf):
    """Smoothing states fitted, saved as a version, loaded again and forecast from."""
    d, folds = _last(spark, sf)
    path = new_path(spark, "models")
    states = smooth_fit(d, folds, KEYS, "pos", "value", DAY, hw_configs(spark))
    save_state(states, path, "holt_winters", 1)
    out = smooth_forecast(load_state(spark, path, "holt_winters"), KEYS, "pos")
    return out.select("series_id", "config_id", "pos", rd("y_pred", 7).alias("y_pred"))


CV_WINDOW, CV_STEP = 336, 168
CV_WINDOWS = (
    f"SELECT series_id, CAST(i + 1 AS INTEGER) AS fold, i * {CV_STEP} AS a, i * {CV_STEP} + {CV_WINDOW} AS b, {HORIZON} AS h "
    f"FROM (SELECT *, unnest(generate_series(0, (n - {CV_WINDOW} - {HORIZON}) // {CV_STEP})) AS i FROM sizes "
    f"WHERE n >= {CV_WINDOW + HORIZON})"
)
CV_MEANS = {
    "avg_mae": "mae", "avg_mape": "mape", "avg_rmse": "rmse", "avg_std_penalty": "std_diff",
    "avg_dev_error": "dev_error", "avg_custom_score": "mae + std_diff + dev_error",
}


@query(
    "m14_holt_winters_cv",
    sql(
        "SELECT config_id, series_id, "
        + ", ".join(f"{rs(f'avg({v})')} AS {k}" for k, v in CV_MEANS.items())
        + ", trend, seasonal, damped FROM hw_score JOIN hw_cfg USING (config_id) GROUP BY ALL",
        smoothing_ctes(CV_WINDOWS, HW_ALL).strip(),
        "hw_both AS (SELECT p.series_id, p.fold, p.config_id, p.y_pred, d.value AS y_true FROM hw_pred p "
        "JOIN dense d ON d.series_id = p.series_id AND d.pos = p.pos),\n"
        f"hw_score AS (SELECT * FROM {raw_metrics_sql('hw_both', 'series_id, fold, config_id')})",
    ),
)
def m14(spark, sf):
    d = dense(spark, sf)
    folds = window_folds(lengths(d, KEYS, "pos"), KEYS, CV_WINDOW, CV_STEP, HORIZON)
    out = smooth_cv(d, folds, KEYS, "pos", "value", DAY, hw_configs(spark))
    return out.select("config_id", "series_id", *[rd(c).alias(c) for c in CV_MEANS], "trend", "seasonal", "damped")


@query("m15_seasonal_arma")
def m15(spark, sf):
    return arma_folds(*_last(spark, sf), KEYS, "pos", "value", DAY)


TREE_LAGS = [1, 2, 3, 24]
TREE_FEATURES = ["value_now", *[f"value_lag_{k}" for k in TREE_LAGS], "hour_sin", "hour_cos"]


def tree_rows(spark, sf):
    """Target with features as they were one horizon earlier, calendar of the target's own hour."""
    d = lag_features(dense(spark, sf), KEYS, "pos", "value", TREE_LAGS)
    d = d.withColumn("value_now", F.col("value"))
    shifted = shift_features(
        d, KEYS, "pos", ["value_now", *[f"value_lag_{k}" for k in TREE_LAGS]], HORIZON
    )
    hour = cyclic("ts")
    return durable(
        shifted.select("*", hour["hour_sin"].alias("hour_sin"), hour["hour_cos"].alias("hour_cos"))
    )


TREE_PARAMS = {"config_id": 0, "n_estimators": 5, "max_depth": 3, "learning_rate": 0.1}


@query("m16_boosted_trees")
def m16(spark, sf):
    rows = tree_rows(spark, sf)
    folds = fc.last_day_fold(lengths(rows, KEYS, "pos"), KEYS, HORIZON)
    assigned = assign_folds(rows, folds, KEYS, "pos")
    return tree_forecast(assigned, KEYS, "pos", "value", TREE_FEATURES, TREE_PARAMS)


@query("m17_tree_random_search")
def m17(spark, sf):
    rows = tree_rows(spark, sf)
    folds = counted_folds(lengths(rows, KEYS, "pos"), KEYS, 2, HORIZON)
    assigned = durable(assign_folds(rows, folds, KEYS, "pos"))
    grid = parameter_grid(
        spark,
        {"n_estimators": [3, 5], "max_depth": [2, 3], "learning_rate": [0.1]},
        "n_estimators int, max_depth int, learning_rate double",
    )
    configs = [r.asDict() for r in sample_configs(grid, 2).collect()]
    return tree_random_search(assigned, KEYS, "pos", "value", TREE_FEATURES, configs)[0]


@query("m17_refit_winner")
def m17_refit(spark, sf):
    """Forecasts of the last day by the search's winner, fitted again on all rows before it."""
    rows = tree_rows(spark, sf)
    sizes = lengths(rows, KEYS, "pos")
    search = durable(assign_folds(rows, counted_folds(sizes, KEYS, 2, HORIZON), KEYS, "pos"))
    last = durable(assign_folds(rows, fc.last_day_fold(sizes, KEYS, HORIZON), KEYS, "pos"))
    configs = [{**TREE_PARAMS, "config_id": k, "max_depth": k + 1} for k in (1, 2)]
    train = last.filter("part = 'train'")
    _, model = search_and_refit(search, train, KEYS, "pos", "value", TREE_FEATURES, configs, TREE_PARAMS)
    return predict_trees(model, last.filter("part = 'test'"), TREE_FEATURES).select(*KEYS, "pos", "y_pred")


TERMS = {"daily": (1.0, 3), "weekly": (7.0, 2)}
ADDITIVE = {
    "config_id": 0,
    "changepoint_prior_scale": 0.1,
    "seasonality_prior_scale": 10.0,
    "seasonality_mode": "multiplicative",
    "changepoint_range": 0.8,
    "n_changepoints": 25,
}


@query("m18_additive_model")
def m18(spark, sf):
    return additive_forecast(*_last(spark, sf), KEYS, "pos", "ts", "value", [ADDITIVE], TERMS)


@query("m19_additive_grid_search")
def m19(spark, sf):
    """All 216 configurations on a cut-off a day."""
    d = dense(spark, sf)
    folds = rolling_origin_folds(lengths(d, KEYS, "pos"), KEYS, WEEK, DAY, HORIZON)
    return additive_grid_search(d, folds, KEYS, "pos", "ts", "value", grid_configs(), TERMS)


# ---------------------------------------------------------------- back-tests

FOLD_NUMBERS = f"(SELECT *, unnest(generate_series(1, n // {WEEK} + 1)) AS i FROM sizes)"
FOLD_SOURCE = {
    "expanding": (
        f"SELECT series_id, i AS fold, 0 AS a, i * {WEEK} AS b, i * {WEEK} + {HORIZON} AS c, n FROM "
        f"{FOLD_NUMBERS} WHERE i * {WEEK} + {HORIZON} <= n"
    ),
    "sliding": (
        f"SELECT series_id, i AS fold, (i - 1) * {WEEK} AS a, i * {WEEK} AS b, i * {WEEK} + {HORIZON} AS c, n "
        f"FROM {FOLD_NUMBERS} WHERE i * {WEEK} + {HORIZON} <= n"
    ),
    "reverse": (
        f"SELECT series_id, i AS fold, greatest(0, n - {HORIZON} - i * {WEEK}) AS a, n - {HORIZON} AS b, n AS c, n "
        f"FROM {FOLD_NUMBERS} WHERE i <= (n - {HORIZON}) // {WEEK}"
    ),
}


def median_backtest_sql(mode: str) -> str:
    ctes = f"""
bt_folds AS ({FOLD_SOURCE[mode]}),
bt_level AS (SELECT f.series_id, f.fold, quantile_cont(d.value, 0.5) AS y_pred FROM bt_folds f
  JOIN dense d ON d.series_id = f.series_id AND d.pos >= f.a AND d.pos < f.b GROUP BY 1, 2),
bt AS (SELECT f.series_id, CAST(f.fold AS INTEGER) AS fold, d.value AS y_true, l.y_pred FROM bt_folds f
  JOIN dense d ON d.series_id = f.series_id AND d.pos >= f.b AND d.pos < f.c
  JOIN bt_level l ON l.series_id = f.series_id AND l.fold = f.fold)"""
    return sql(metrics_sql("bt", "series_id, fold"), ctes.strip())


def naive_backtest_sql(mode: str) -> str:
    ctes = f"""
bt_folds AS ({FOLD_SOURCE[mode]}),
bt AS (SELECT f.series_id, CAST(f.fold AS INTEGER) AS fold, d.value AS y_true, p.value AS y_pred
  FROM bt_folds f
  JOIN dense d ON d.series_id = f.series_id AND d.pos >= f.b AND d.pos < f.c
  JOIN dense p ON p.series_id = d.series_id AND p.pos = d.pos - {DAY})"""
    return sql(metrics_sql("bt", "series_id, fold"), ctes.strip())


def _weekly(spark, sf, mode):
    d = dense(spark, sf)
    return d, weekly_folds(lengths(d, KEYS, "pos"), KEYS, mode, WEEK, HORIZON)


def _naive(d, folds):
    return naive_folds(d, folds, KEYS, "pos", "value", DAY)


def _median(d, folds):
    assigned = durable(assign_folds(d, folds, KEYS, "pos"))
    return fc.median_forecast(assigned, KEYS, "pos", "value")


def _arma(d, folds):
    return arma_folds(d, folds, KEYS, "pos", "value", DAY)


def _smoothing(d, folds):
    one = _one_config(d.sparkSession, "add", "add", True)
    return smooth_folds(d, folds, KEYS, "pos", "value", DAY, one).select(*KEYS, "fold", "pos", "y_pred")


def smoothing_backtest_sql(mode: str) -> str:
    windows = f"SELECT series_id, CAST(fold AS INTEGER) AS fold, a, b, c - b AS h FROM ({FOLD_SOURCE[mode]}) WHERE c <= n"
    ctes = f"""{smoothing_ctes(windows, HW_DAMPED)},
bt AS (SELECT p.series_id, p.fold, d.value AS y_true, p.y_pred FROM hw_pred p
  JOIN dense d ON d.series_id = p.series_id AND d.pos = p.pos)"""
    return sql(metrics_sql("bt", "series_id, fold"), ctes.strip())


def _register_backtests():
    for mode in ("expanding", "sliding", "reverse"):

        def run(spark, sf, model, mode=mode):
            d, folds = _weekly(spark, sf, mode)
            return round_metrics(backtest_folds(d, durable(folds), model))

        sources = {
            "naive": (_naive, naive_backtest_sql(mode)),
            "median": (_median, median_backtest_sql(mode)),
            "holt_winters": (_smoothing, smoothing_backtest_sql(mode)),
            "arma": (_arma, None),
        }
        for name, (model, text) in sources.items():
            query(f"m20_backtest_{name}_{mode}", text)(lambda spark, sf, model=model, run=run: run(spark, sf, model))


_register_backtests()


@query(
    "m20_backtest_part_forecast",
    sql(
        f"SELECT series_id, fold, "
        + ", ".join(f"CASE WHEN fold % 2 = 0 THEN {c} END AS {c}" for c in METRICS)
        + f" FROM ({metrics_sql('bt', 'series_id, fold')})",
        f"bt_folds AS ({FOLD_SOURCE['expanding']}),\n"
        "bt AS (SELECT f.series_id, CAST(f.fold AS INTEGER) AS fold, d.value AS y_true, p.value AS y_pred "
        "FROM bt_folds f JOIN dense d ON d.series_id = f.series_id AND d.pos >= f.b AND d.pos < f.c "
        f"JOIN dense p ON p.series_id = d.series_id AND p.pos = d.pos - {DAY})",
    ),
)
def m20_part(spark, sf):
    """Every other fold is forecast for part of its horizon only, which scores null and not as a whole."""
    d, folds = _weekly(spark, sf, "expanding")
    told = _naive(d, folds).filter((F.col("fold") % 2 == 0) | (F.col("pos") % DAY < 20))
    return round_metrics(score_fold_forecast(d, folds, told, KEYS, "pos", "value"))


@query("m20_backtest_trees_expanding")
def m20_trees(spark, sf):
    rows = tree_rows(spark, sf)
    folds = weekly_folds(lengths(rows, KEYS, "pos"), KEYS, "expanding", WEEK, HORIZON)

    def model(assigned):
        return tree_forecast(
            assigned, KEYS, "pos", "value", TREE_FEATURES, TREE_PARAMS
        )

    return fc.backtest(rows, folds, model)


@query(
    "m21_leaderboard_baselines",
    sql(
        f"SELECT series_id, model, {rs('mae + std_diff + dev_error')} AS custom_loss, {rs('std_diff')} AS std_diff, "
        f"{rs('rmse')} AS rmse, CAST(rank() OVER (PARTITION BY series_id ORDER BY mae + std_diff + dev_error) AS INTEGER) "
        f"AS rank FROM {raw_metrics_sql('both_models', 'model, series_id')}",
        SCORE_CTES.strip(),
    ),
)
def m21(spark, sf):
    d, folds = _last(spark, sf)
    both = durable(compare_fold_models(d, folds, {"naive": _naive, "median": _median}))
    return round_metrics(leaderboard(evaluate(both, [*KEYS, "model"]), KEYS))


@query("m21_leaderboard_all_models")
def m21b(spark, sf):
    d, folds = _last(spark, sf)
    rows = tree_rows(spark, sf)

    def trees(_, folds):
        return tree_forecast(assign_folds(rows, folds, KEYS, "pos"), KEYS, "pos", "value", TREE_FEATURES, TREE_PARAMS)

    models = {
        "median": _median,
        "naive": _naive,
        "holt_winters": _smoothing,
        "arma": _arma,
        "additive": lambda d, f: additive_forecast(d, f, KEYS, "pos", "ts", "value", [ADDITIVE], TERMS),
        "trees": trees,
    }
    every = durable(compare_fold_models(d, folds, models))
    return leaderboard(evaluate(every, ["model"])).select("model", *[m for m in METRICS if m in ("custom_loss", "std_diff", "rmse")], "rank")
