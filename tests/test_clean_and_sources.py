import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import NoDataError
from tidemark.functions.histogram import bin_columns
from tidemark.operators import clean, reshape
from tidemark.operators.features import fee_features, lag_features, shift_features, supervised_matrix
from tidemark.sources import snapshots, tables


@pytest.fixture(scope="module")
def raw(spark):
    """Irregular wide snapshots, epoch seconds, with high bins and foreign prices."""
    t0 = 1_741_140_000
    rows = [(float(t0 + s), float(i), float(2 * i), 1.0, 9.0, -1.0) for i, s in enumerate([10, 300, 2000, 3700])]
    low, high = bin_columns()[0], bin_columns()[-1]
    return spark.createDataFrame(
        rows,
        f"timestamp double, recommended_fee_fastestFee double, {low} double, {high} double, "
        "price_EUR double, price_USD double",
    )


def test_clean_snapshots(raw):
    out = clean.clean_snapshots(raw, chunk=2)
    assert bin_columns()[-1] not in out.columns and "price_EUR" not in out.columns
    rows = out.orderBy("ts").collect()
    assert [r.recommended_fee_fastestFee for r in rows] == [0.5, 1.25, 2.0, 2.5, 3.0]
    assert (rows[1].ts - rows[0].ts).total_seconds() == 900


def test_scan_errors(spark, raw, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshots.scan_snapshots(spark, str(tmp_path / "absent"))
    bad = tmp_path / "bad.parquet"
    bad.write_bytes(b"not a parquet file")
    with pytest.raises(ValueError):
        snapshots.scan_snapshots(spark, str(bad))
    good = str(tmp_path / "good")
    raw.write.parquet(good)
    assert snapshots.scan_snapshots(spark, good).count() == 4
    with pytest.raises(ValueError, match="missing"):
        snapshots.scan_snapshots(spark, good, "ts")
    empty = str(tmp_path / "empty")
    raw.limit(0).write.parquet(empty)
    with pytest.raises(ValueError, match="no rows"):
        snapshots.scan_snapshots(spark, empty)


def test_merge_schema(spark, raw, tmp_path):
    path = str(tmp_path / "drift")
    raw.write.parquet(f"{path}/day=1")
    raw.drop("price_USD").write.parquet(f"{path}/day=2")
    df = snapshots.scan_snapshots(spark, path, merge_schema=True)
    assert df.count() == 8 and df.filter("price_USD IS NULL").count() == 4


def test_payloads(spark):
    rows = [
        (1, "fees", '[{"medianFee": 3.5, "feeRange": [1, 2]}, {"medianFee": 9}]'),
        (1, "price", '{"USD": 100, "time": 5, "note": "x"}'),
        (2, "price", '{"USD": 101}'),
    ]
    df = spark.createDataFrame(rows, "fetched_at bigint, endpoint string, payload string")
    out = snapshots.flatten_payloads(df, ["fees_medianFee", "price_USD", "price_time"])
    assert out.columns == ["fetched_at", "fees_medianFee", "price_USD"]
    assert {tuple(r) for r in out.collect()} == {(1, 3.5, 100.0), (2, None, 101.0)}


def test_append_and_tables(spark, raw, tmp_path):
    path = str(tmp_path / "lake")
    df = clean.epoch_to_timestamp(raw, "timestamp")
    snapshots.append_snapshots(df, path, "timestamp")
    snapshots.append_snapshots(df, path, "timestamp")
    assert spark.read.parquet(path).count() == 8
    assert any(d.startswith("date=") for d in os.listdir(path))
    params = spark.createDataFrame([(3, 0.1)], "estimator__max_depth int, learning_rate double")
    stored = tables.write_params(params, str(tmp_path / "params"))
    assert tables.read_params(spark, stored).first().params == {"max_depth": "3", "learning_rate": "0.1"}
    csv = tables.write_csv(spark.createDataFrame([(None, 1.5)], "trend string, x double"), str(tmp_path / "c"))
    assert tuple(tables.read_csv(spark, csv, "trend string, x double").first()) == (None, 1.5)
    shape = {r.column: (r.n_rows, r.non_null) for r in tables.profile(raw).collect()}
    assert shape["timestamp"] == (4, 4)


def test_row_filters(spark):
    df = spark.createDataFrame(
        [("a", i, float(i)) for i in range(6)] + [("b", i, 0.0) for i in range(3)],
        "series_id string, pos bigint, value double",
    )
    assert clean.trim_last(df, ["series_id"], "pos", 2).count() == 5
    assert clean.take_last(df, ["series_id"], "pos", 2).count() == 4
    assert clean.take_last(df, [], "pos", 2).count() == 2
    assert clean.drop_first(df, ["series_id"], ["pos"]).count() == 7
    assert clean.one_series(df, "a").count() == 6
    with pytest.raises(NoDataError, match="No data found"):
        clean.one_series(df, "zzz")
    assert clean.sentinel_to_null(df, "value", 0.0).filter("value IS NULL").count() == 4
    zero = clean.all_zero_columns(
        spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, None, 0.0)], "a double, b double, c double"), ["a", "b", "c"]
    )
    assert {r.column: r.all_zero for r in zero.collect()} == {"a": True, "b": False, "c": False}


def test_compare_forecasts(spark):
    rows = [("s", f"2025-01-01 0{h}:00:00", 10.0 * h, 10.0 * h + 1) for h in range(4)]
    df = spark.createDataFrame(rows, "series_id string, t string, y_true double, y_pred double")
    df = df.select("series_id", F.col("t").cast("timestamp_ntz").alias("ts"), "y_true", "y_pred")
    assert reshape.compare_forecasts(df, df, "s").columns == ["series_id", "ts", "y_true", "y_pred_1", "y_pred_2"]
    assert reshape.compare_forecasts(df.limit(1), df).count() == 1
    with pytest.raises(NoDataError):
        reshape.compare_forecasts(df, df.withColumn("series_id", F.lit("other")), "s")
    with pytest.raises(ValueError, match="missing"):
        reshape.compare_forecasts(df.drop("y_pred"), df)


def test_fee_features(spark):
    cols = "timestamp timestamp_ntz, fast double, slow double, price_USD double, mempool_fee_histogram_bin_1_2 double"
    df = spark.sql("SELECT TIMESTAMP_NTZ '2025-03-05 02:15:00', 1.0D, 2.0D, 3.0D, 4.0D").toDF(
        *[c.split()[0] for c in cols.split(", ")]
    )
    out = fee_features(df, ["fast", "slow"]).collect()
    assert {(r.series_id, r.target, r.time_idx) for r in out} == {("fast", 1.0, 1), ("slow", 2.0, 1)}
    assert out[0].mempool_fee_histogram_bin_1_2 == pytest.approx(1.6094379)
    assert "hour" not in out[0].asDict() and "hour_sin" in out[0].asDict()
    with pytest.raises(ValueError, match="missing"):
        fee_features(df.drop("slow"), ["fast", "slow"])
    with pytest.raises(ValueError, match="timestamp"):
        fee_features(df.withColumn("timestamp", F.lit("x")), ["fast", "slow"])
    with pytest.raises(ValueError, match="reference"):
        fee_features(df, ["fast", "slow"], reference="nope")


def test_lags_and_shift(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(30)], "series_id string, pos bigint, v double")
    lagged = lag_features(df, ["series_id"], "pos", "v", [1, 5], chunk=4).orderBy("pos").collect()
    assert lagged[3].v_lag_1 == 2.0 and lagged[3].v_lag_5 is None and lagged[29].v_lag_5 == 24.0
    moved = shift_features(df, ["series_id"], "pos", ["v"], 7, chunk=4).orderBy("pos").collect()
    assert [r.pos for r in moved] == list(range(7, 30)) and moved[0].v == 0.0
    m = supervised_matrix(df, ["series_id"], "pos", "v", [1], 5, chunk=4).toPandas()
    assert m.pos.min() == 5 and m.pos.max() == 24 and (m.split == "test").sum() == 5
    assert (m.v_lag_1.dropna() == m.v[m.v_lag_1.notna()] - 6).all()


def test_supervised_matrix_is_the_same_for_every_chunk_size(spark):
    """Rows with gaps: frames count the rows that are left, also across chunk edges."""
    from tidemark.operators.tsstats import adf_test, arch_lm

    rng = np.random.default_rng(3)
    rows = [("s", i, float(v)) for i, v in enumerate(rng.normal(size=260)) if rng.random() > 0.3]
    df = spark.createDataFrame(rows, "series_id string, pos bigint, v double")
    values = [v for _, _, v in rows]
    want = {(rows[i][1], rows[i - 5 - 1][2], rows[i - 5 - 3][2]) for i in range(8, len(rows) - 5)}
    stats = set()
    for chunk in (8, 40, 16384):
        m = supervised_matrix(df, ["series_id"], "pos", "v", [1, 3], 5, chunk=chunk).collect()
        assert {(r.pos, r.v_lag_1, r.v_lag_3) for r in m if r.v_lag_3 is not None} == want
        assert len(m) == len(rows) - 10
        a = adf_test(df, ["series_id"], "pos", "v", chunk=chunk).first()
        b = arch_lm(df, ["series_id"], "pos", "v", chunk=chunk).first()
        stats.add((round(a.adf_stat, 8), a.used_lag, a.nobs, round(b.lm_stat, 8)))
    assert len(stats) == 1
    # the regression on consecutive values, with the lag the test chose
    adf, lag, nobs, lm = stats.pop()
    y = np.array(values)
    d = np.diff(y)
    x = np.column_stack([np.ones(nobs), y[lag:-1], *[d[lag - j : len(d) - j] for j in range(1, lag + 1)]])
    coef, *_ = np.linalg.lstsq(x, d[lag:], rcond=None)
    resid = d[lag:] - x @ coef
    se = np.sqrt(resid @ resid / (nobs - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    assert np.isclose(adf, coef[1] / se)
    e = y**2
    x = np.column_stack([np.ones(len(e) - 10), *[e[10 - j : len(e) - j] for j in range(1, 11)]])
    coef, *_ = np.linalg.lstsq(x, e[10:], rcond=None)
    resid = e[10:] - x @ coef
    assert np.isclose(lm, len(resid) * (1 - resid @ resid / ((e[10:] - e[10:].mean()) ** 2).sum()))


def test_null_groups_keep_their_density_curve(spark):
    from tidemark.operators.aggregates import kde_curve

    df = spark.createDataFrame([(k, float(v)) for k in ("a", None) for v in range(9)], "k string, v double")
    got = kde_curve(df, ["k"], "v", 5).collect()
    curves = {k: [r.density for r in sorted(got, key=lambda r: r.point) if r.k == k] for k in ("a", None)}
    assert len(curves["a"]) == 5 and np.allclose(curves["a"], curves[None])
