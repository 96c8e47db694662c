import datetime as dt

from lucerna.streaming import ledger


def test_stream_matches_batch(spark, tmp_path):
    events = spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i % 3, "purchase" if i % 4 else "error", 1.25 * i) for i in range(40)],
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    )
    source, sink = str(tmp_path / "ledger"), str(tmp_path / "out")
    ledger.append(ledger.from_events(events), source)
    ledger.append(ledger.from_events(events), source)  # every line twice
    query = ledger.windows_to(spark, source, sink, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    got = {(r["window_start"], r["recurso"]): (r["lines"], r["cents"]) for r in spark.read.parquet(sink).collect()}
    want = {(r["window_start"], r["recurso"]): (r["lines"], r["cents"]) for r in ledger.windowed(ledger.from_events(events)).collect()}
    assert got and got.items() <= want.items()
    assert len(want) - len(got) <= 4  # windows that the watermark has not closed


def test_totals(spark):
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 2, "purchase", 0.02), (2, dt.datetime(2024, 1, 1), 3, "view", 1.0)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    assert [tuple(r) for r in ledger.totals(ledger.from_events(events)).collect()] == [("/v1/scan", "liquidado", 1, 2)]
