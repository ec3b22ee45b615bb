"""Splits, scaling, folds and windows (M1-M11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reshape, splits
from tidemark.operators.smoothing import hw_configs
from tidemark.queries.registry import (
    DAY,
    HORIZON,
    KEYS,
    WEEK,
    dense,
    hourly,
    query,
    rd,
    rs,
    sql,
    wide_hourly,
)


@query(
    "m01_split_by_index",
    sql(
        "SELECT 'train' AS split, series_id, count(*) AS n, max(slot) AS last_slot FROM hourly "
        f"WHERE slot <= (SELECT max(slot) FROM hourly) - {HORIZON} GROUP BY 2 UNION ALL "
        "SELECT 'valid', series_id, count(*), max(slot) FROM hourly GROUP BY 2"
    ),
)
def m01(spark, sf):
    train, valid = splits.split_by_index(hourly(spark, sf), HORIZON, "slot")
    both = train.withColumn("split", F.lit("train")).unionByName(
        valid.withColumn("split", F.lit("valid"))
    )
    return both.groupBy("split", "series_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("slot").alias("last_slot")
    )


@query(
    "m02_tail_split",
    sql(
        f"SELECT d.series_id, d.pos, CASE WHEN d.pos >= s.n - {HORIZON} THEN 'test' ELSE 'train' END AS split "
        "FROM dense d JOIN sizes s ON s.series_id = d.series_id"
    ),
)
def m02(spark, sf):
    return splits.tail_split(dense(spark, sf), KEYS, "pos", HORIZON).select(
        "series_id", "pos", "split"
    )


SCALED = ["mempool_count", "mempool_total"]


@query(
    "m03_standard_scale",
    sql(
        "SELECT slot, "
        + ", ".join(
            f"{rs(f'({c} - (SELECT avg({c}) FROM train)) / (SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM train)', 8)} AS {c}"
            for c in SCALED
        )
        + ", price_USD FROM (SELECT slot, mempool_count, mempool_total, price_k AS price_USD FROM wide)",
        f"train AS (SELECT * FROM wide WHERE slot <= (SELECT max(slot) FROM wide) - {HORIZON})",
    ),
)
def m03(spark, sf):
    w = wide_hourly(spark, sf).select(
        "slot", *SCALED, F.col("price_k").alias("price_USD")
    )
    train, valid = splits.split_by_index(w, HORIZON, "slot")
    scaled = splits.standard_scale(train, [valid])[1]
    return scaled.select("slot", *[rd(c, 8).alias(c) for c in SCALED], "price_USD")


@query(
    "m04_min_max_scale",
    sql(
        "SELECT series_id, pos, "
        + rs(
            "1 + (value - min(value) OVER (PARTITION BY series_id)) / (max(value) OVER (PARTITION BY series_id) "
            "- min(value) OVER (PARTITION BY series_id))",
            8,
        )
        + " AS scaled FROM dense"
    ),
)
def m04(spark, sf):
    out = splits.min_max_scale(dense(spark, sf), KEYS, "value")
    return out.select("series_id", "pos", rd("scaled", 8).alias("scaled"))


@query(
    "m05_normalise_target",
    sql(
        f"SELECT d.series_id, d.pos, {rs('(d.value - t.c) / t.s', 8)} AS target_norm, "
        f"{rs('t.c', 8)} AS target_center, {rs('t.s', 8)} AS target_scale FROM dense d JOIN ("
        "SELECT x.series_id, avg(x.value) AS c, stddev_samp(x.value) AS s FROM dense x JOIN sizes z "
        f"ON z.series_id = x.series_id WHERE x.pos < z.n - {HORIZON} GROUP BY 1) t ON t.series_id = d.series_id"
    ),
)
def m05(spark, sf):
    split = splits.tail_split(dense(spark, sf), KEYS, "pos", HORIZON)
    out = splits.normalise_target(split.filter("split = 'train'"), split, "value")
    return out.select(
        "series_id", "pos",
        *[rd(c, 8).alias(c) for c in ("target_norm", "target_center", "target_scale")],
    )


# a week and half a week of hours
ENC, MIN_ENC = 168, 84
WINDOW_SQL = (
    "SELECT series_id, origin, CAST(encoder_length AS INTEGER) AS encoder_length, "
    f"CAST(decoder_length AS INTEGER) AS decoder_length, {rs('enc_sum', 7)} AS enc_sum, {rs('dec_sum', 7)} AS dec_sum, "
    f"{rs('first_enc')} AS first_enc, {rs('last_dec')} AS last_dec FROM ("
    "SELECT o.series_id, o.pos AS origin, count(CASE WHEN d.pos < o.pos THEN 1 END) AS encoder_length, "
    "count(CASE WHEN d.pos >= o.pos THEN 1 END) AS decoder_length, "
    "sum(CASE WHEN d.pos < o.pos THEN d.value END) AS enc_sum, "
    "sum(CASE WHEN d.pos >= o.pos THEN d.value END) AS dec_sum, arg_min(d.value, d.pos) AS first_enc, "
    "arg_max(d.value, d.pos) AS last_dec FROM dense o JOIN dense d ON d.series_id = o.series_id "
    f"AND d.pos >= o.pos - {ENC} AND d.pos < o.pos + {HORIZON} GROUP BY 1, 2) w "
)


def _window_summary(out):
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return out.select(
        "series_id",
        "origin",
        "encoder_length",
        "decoder_length",
        rd(total("encoder"), 7).alias("enc_sum"),
        rd(total("decoder"), 7).alias("dec_sum"),
        rd(F.element_at("encoder", 1)).alias("first_enc"),
        rd(F.element_at("decoder", -1)).alias("last_dec"),
    )


@query(
    "m06_encoder_windows",
    sql(
        WINDOW_SQL + f"WHERE encoder_length >= {MIN_ENC} AND decoder_length = {HORIZON}"
    ),
)
def m06(spark, sf):
    d = dense(spark, sf)
    return _window_summary(
        splits.encoder_windows(d, KEYS, "pos", "value", ENC, MIN_ENC, HORIZON)
    )


@query(
    "m06_last_window",
    sql(
        WINDOW_SQL + "JOIN sizes s ON s.series_id = w.series_id "
        f"WHERE origin = s.n - {HORIZON} AND encoder_length >= {MIN_ENC}"
    ).replace("SELECT series_id, origin,", "SELECT w.series_id, origin,"),
)
def m06b(spark, sf):
    d = dense(spark, sf)
    return _window_summary(
        splits.encoder_windows(d, KEYS, "pos", "value", ENC, MIN_ENC, HORIZON, last_only=True)
    )


def fold_sql(fold: str, edges: list[str], source: str, where: str) -> str:
    names = ["train_start", "train_end", "test_start", "test_end"]
    cols = ", ".join(f"CAST({e} AS BIGINT) AS {n}" for e, n in zip(edges, names, strict=True))
    return sql(f"SELECT series_id, CAST({fold} AS INTEGER) AS fold, {cols} FROM {source} WHERE {where}")


SERIES = "(SELECT *, unnest(generate_series(0, n)) AS i FROM sizes)"


@query(
    "m07_folds_expanding",
    fold_sql(
        "i",
        ["0", f"i * {WEEK}", f"i * {WEEK}", f"i * {WEEK} + {HORIZON}"],
        SERIES,
        f"i >= 1 AND i * {WEEK} + {HORIZON} <= n",
    ),
)
def m07(spark, sf):
    sizes = splits.lengths(dense(spark, sf), KEYS, "pos")
    return splits.weekly_folds(sizes, KEYS, "expanding", WEEK, HORIZON)


@query(
    "m07_folds_sliding",
    fold_sql(
        "i + 1",
        [f"i * {WEEK}", f"(i + 1) * {WEEK}", f"(i + 1) * {WEEK}", f"(i + 1) * {WEEK} + {HORIZON}"],
        SERIES,
        f"(i + 1) * {WEEK} + {HORIZON} <= n",
    ),
)
def m07b(spark, sf):
    sizes = splits.lengths(dense(spark, sf), KEYS, "pos")
    return splits.weekly_folds(sizes, KEYS, "sliding", WEEK, HORIZON)


@query(
    "m07_folds_reverse",
    fold_sql(
        "i",
        [f"greatest(0, n - {HORIZON} - i * {WEEK})", f"n - {HORIZON}", f"n - {HORIZON}", "n"],
        SERIES,
        f"i >= 1 AND i <= (n - {HORIZON}) // {WEEK}",
    ),
)
def m07c(spark, sf):
    sizes = splits.lengths(dense(spark, sf), KEYS, "pos")
    return splits.weekly_folds(sizes, KEYS, "reverse", WEEK, HORIZON)


@query(
    "m08_folds_by_count",
    fold_sql(
        "i",
        ["0", f"((n - {HORIZON}) // 6) * i", f"((n - {HORIZON}) // 6) * i", f"((n - {HORIZON}) // 6) * i + {HORIZON}"],
        SERIES,
        "i BETWEEN 1 AND 5",
    ),
)
def m08(spark, sf):
    sizes = splits.lengths(dense(spark, sf), KEYS, "pos")
    return splits.counted_folds(sizes, KEYS, 5, HORIZON)


@query(
    "m09_folds_fixed_window",
    fold_sql(
        "i + 1",
        ["i * 72", "i * 72 + 336", "i * 72 + 336", f"i * 72 + 336 + {HORIZON}"],
        SERIES,
        f"i * 72 + 336 + {HORIZON} <= n",
    ),
)
def m09(spark, sf):
    sizes = splits.lengths(dense(spark, sf), KEYS, "pos")
    return splits.window_folds(sizes, KEYS, 336, 72, HORIZON)


@query(
    "m10_folds_rolling_origin",
    sql(
        "SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY c) AS INTEGER) AS fold, "
        "CAST(0 AS BIGINT) AS train_start, CAST(c + 1 AS BIGINT) AS train_end, CAST(c + 1 AS BIGINT) AS test_start, "
        f"CAST(c + 1 + {HORIZON} AS BIGINT) AS test_end FROM (SELECT series_id, n - 1 - {HORIZON} - i * {DAY} AS c "
        f"FROM {SERIES}) WHERE c >= {WEEK}"
    ),
)
def m10(spark, sf):
    sizes = splits.lengths(dense(spark, sf), KEYS, "pos")
    return splits.rolling_origin_folds(sizes, KEYS, WEEK, DAY, HORIZON)


@query("m11_sampled_configurations")
def m11(spark, sf):
    """Eight sampled configurations crossed with every series' folds."""
    sizes = splits.lengths(dense(spark, sf), KEYS, "pos")
    folds = splits.weekly_folds(sizes, KEYS, "expanding", WEEK, HORIZON)
    return reshape.with_configs(folds, splits.sample_configs(hw_configs(spark), 8, 42))


