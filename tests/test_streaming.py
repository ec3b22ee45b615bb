from datetime import datetime, timedelta

from tidemark.streaming import jobs

T0 = datetime(2025, 1, 1)
SCHEMA = "series_id string, ts timestamp_ntz, value double"


def land(spark, folder, name, minutes):
    rows = [("a", T0 + timedelta(minutes=m), float(m)) for m in minutes]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_late_rows_and_restart(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def drain():
        source = jobs.stream_files(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema)
        bins = jobs.stream_resample(source, ["series_id"], "ts", "value")
        return jobs.run_available(bins, "bins", out, state)

    land(spark, folder, "batch1", [0, 1, 20, 100])
    drain()
    land(spark, folder, "batch2", [2, 101, 200])  # minute 2 is behind the watermark by now
    got = {r.ts: r.value for r in drain().collect()}
    assert got[T0] == 0.5 and got[T0 + timedelta(minutes=15)] == 20.0
    assert got[T0 + timedelta(minutes=90)] == 100.5
    assert T0 + timedelta(minutes=195) not in got  # still open


def test_ingest_and_spikes(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(1, "price", '{"USD": 5, "note": "x"}', T0), (2, "fees", '[{"medianFee": 2}]', T0)]
    landed = spark.createDataFrame(rows, "id int, endpoint string, payload string, ts timestamp_ntz")
    landed.write.parquet(folder)
    stream = jobs.stream_files(spark, folder, landed.schema)
    got = jobs.run_available(jobs.ingest_payloads(stream, "endpoint", "payload", "ts"), "ingest")
    assert {(r.field, r.number) for r in got.collect()} == {("price_USD", 5.0), ("fees_medianFee", 2.0)}
    values = str(tmp_path / "v")
    land(spark, values, "one", [1, 50])
    levels = spark.createDataFrame([("a", 10.0)], "series_id string, p95 double")
    live = jobs.stream_files(spark, f"{values}/*", spark.createDataFrame([], SCHEMA).schema)
    flagged = jobs.run_available(jobs.stream_spikes(live, levels, ["series_id"], "value", "p95"), "spikes")
    assert [r.value for r in flagged.collect()] == [50.0]


def test_snapshots_assemble_over_batches_restarts_and_replays(spark, tmp_path):
    from tidemark.functions.histogram import bin_columns
    from tidemark.sources.snapshots import flatten_payloads

    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    fields = ["price_USD", "fees_fastestFee", *bin_columns()]
    schema = "endpoint string, payload string, ts timestamp_ntz"
    at = lambda m: T0 + timedelta(minutes=m)
    price = lambda m, v: ("price", f'{{"USD": {v}, "time": 3}}', at(m))
    mempool = ("mempool", '{"fee_histogram": [[1.5, 10], [1.2, 5], ["x", 3], 7, [12, null], [2000, 4]], "count": 3}', at(0))
    batches = [
        [price(0, 5.0), price(5, 6.0)],
        [mempool, ("fees", '{"fastestFee": 9}', at(5)), ("mempool", '{"fee_histogram": "none"}', at(5))],
        [price(0, 5.0), price(120, 7.0)],  # a replay, and the row that moves the watermark
        [price(200, 8.0)],
    ]

    def drain():
        source = jobs.stream_files(spark, f"{folder}/*", spark.createDataFrame([], schema).schema, files_per_batch=1)
        return jobs.run_available(jobs.stream_snapshots(source, fields, "endpoint", "payload", "ts"), "wide", out, state)

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/batch{k}")
        got = drain()  # every batch is a restarted job
    landed = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {r.ts: r for r in flatten_payloads(landed, fields, "ts").collect()}
    rows = {r.ts: r for r in got.select("ts", *fields).collect()}
    assert set(rows) == {at(0), at(5), at(120)} and len(got.collect()) == 3
    assert all(rows[t].asDict() == want[t].asDict() for t in rows)
    first = rows[at(0)]
    assert (first.price_USD, first.mempool_fee_histogram_bin_1_2, first.mempool_fee_histogram_bin_1000_plus) == (5.0, 15.0, 4.0)
    assert first.mempool_fee_histogram_bin_12_14 == 0.0 and first.fees_fastestFee is None
    assert rows[at(5)].mempool_fee_histogram_bin_1_2 is None
