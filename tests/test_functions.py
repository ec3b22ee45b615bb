import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar, histogram, special, text
from tidemark.functions.columns import (
    MissingColumnsError,
    double_columns,
    require_columns,
    with_prefix,
)
from tidemark.operators.aggregates import bin_totals, fee_histogram


def test_fifty_two_bins():
    labels = histogram.bin_labels()
    assert len(labels) == 52
    assert labels[:2] == ["1_2", "2_3"] and labels[-2:] == ["950_1000", "1000_plus"]
    assert len(histogram.high_bin_columns(300)) == 15


EDGES = {
    0.5: None, 1.0: "1_2", 2.0: "2_3", 9.99: "9_10", 10.0: "10_12", 29.0: "28_30", 30.0: "30_35",
    99.0: "95_100", 100.0: "100_150", 999.0: "950_1000", 1000.0: "1000_plus", 5000.0: "1000_plus",
}


def test_bin_edges(spark):
    df = spark.createDataFrame([(k,) for k in EDGES], "fee double")
    got = {r.fee: r.b for r in df.select("fee", histogram.bin_label(F.col("fee")).alias("b")).collect()}
    assert got == EDGES


def test_pairs_and_rows_agree(spark):
    pairs = [[0.5, 9.0], [1.5, 2.0], [1.7, 3.0], [2000.0, 4.0], [7.0, 1.0, 1.0]]
    nested = spark.createDataFrame([(1, pairs)], "id int, pairs array<array<double>>")
    wide = nested.select(histogram.pair_histogram(F.col("pairs")).alias("h")).first().h
    assert len(wide) == 52 and wide["1_2"] == 5.0 and wide["1000_plus"] == 4.0
    assert sum(wide.values()) == 9.0
    rows = spark.createDataFrame([(1, p[0], p[1]) for p in pairs if len(p) == 2], "id int, fee double, n double")
    flat = fee_histogram(rows, ["id"], "fee", "n").first().asDict()
    assert {k: flat[histogram.HISTOGRAM_PREFIX + k] for k in wide} == wide


def test_pairs_are_read_once_for_all_bins(spark):
    # a random fee lands in one bin only if its pair is evaluated once a row, not once for each bin
    fee = F.floor(F.rand(7) * 990) + 1.5
    totals = histogram.pair_histogram(F.array(F.array(fee, F.lit(1.0))))
    rows = spark.range(100).select(totals.alias("h")).collect()
    assert [sum(r.h.values()) for r in rows] == [1.0] * 100


def test_shares_add_up(spark):
    cols = histogram.bin_columns()[:3]
    df = spark.createDataFrame([(1.0, 2.0, 1.0)], ", ".join(f"{c} double" for c in cols))
    out = {r.start: r for r in bin_totals(df, cols).collect()}
    assert out[2.0].share == 50.0 and out[3.0].cum_share == 100.0
    assert out[1.0].log_total == pytest.approx(math.log(2))


def test_time_index_truncates_toward_zero(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2025-03-05 01:50:00' AS ts UNION ALL SELECT TIMESTAMP_NTZ '2025-03-05 02:29:00'")
    got = [r[0] for r in df.select(calendar.time_index("ts", "2025-03-05 02:00:00", 900)).collect()]
    assert got == [0, 1]
    with pytest.raises(ValueError, match="invalid reference"):
        calendar.time_index("ts", "not a time", 900)


def test_cyclic_and_fourier(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2025-03-03 06:15:00' AS ts")
    c = df.select(*[v.alias(k) for k, v in calendar.cyclic("ts").items()]).first()
    assert c.hour_sin == pytest.approx(1) and c.day_of_week_sin == pytest.approx(0)
    assert c.month_sin == pytest.approx(1) and c.minute_sin == pytest.approx(1)
    f = calendar.fourier(calendar.days("ts"), {"daily": (1.0, 2)})
    row = df.select(*[v.alias(k) for k, v in f.items()]).first()
    assert row.daily_sin1 == pytest.approx(math.sin(2 * math.pi * 6.25 / 24), abs=1e-6)
    assert len(calendar.fourier(F.lit(1.0))) == 2 * (5 + 10 + 5)


def test_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3, 4.0)], "price_USD double, price_EUR double, n int, x double")
    assert with_prefix(df, "price_", ["price_E"]) == ["price_USD"]
    assert double_columns(df, ["x"], ["price_E"]) == ["price_USD"]
    with pytest.raises(MissingColumnsError, match="missing"):
        require_columns(df, ["x", "absent"])


def test_text(spark):
    df = spark.createDataFrame([(None,), (0.00001,), (0.12345,)], "p double")
    got = [r[0] for r in df.select(text.format_p_value(F.col("p"))).collect()]
    assert got == ["NA", "<0.0001", "0.1235"] or got == ["NA", "<0.0001", "0.1234"]
    names = spark.createDataFrame([("mempool_blocks_total_fees",), ("mempool_blocks_nTx",)], "c string")
    label = text.pretty_label(F.col("c"), "mempool_blocks_", {"mempool_blocks_nTx": "Next-Block #Tx"})
    assert [r[0] for r in names.select(label).collect()] == ["Total Fees", "Next-Block #Tx"]


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert special.chi2_sf(124.342113, 100) == pytest.approx(0.05, rel=1e-5)
    assert special.student_two_sided(2.228138851964939, 10) == pytest.approx(0.05, rel=1e-9)
    assert special.correlation_p(0.5, 20) == pytest.approx(0.0247, rel=1e-2)
    assert special.kolmogorov_sf(1.3581 / 10, 100) == pytest.approx(0.05, rel=1e-3)
    assert special.adf_p_value(-14.96) == pytest.approx(1.25e-27, rel=0.05)
    assert special.adf_p_value(-2.86154) == pytest.approx(0.05, abs=2e-3)
