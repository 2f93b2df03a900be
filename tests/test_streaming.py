"""Streams give what the batch forms give, over several runs and after a repeated batch."""

from datetime import date, datetime

from outings.streaming.ingest import (append_stream, compacted_log, ends_per_key, fold_log, new_files, new_json_payloads,
                                       read_log, upsert_stream)

SCHEMA = "destination_id long, forecast_ts timestamp, forecast_date date, temperature_c double, seq long"
KEYS = ["destination_id", "forecast_ts"]


def batch(n):
    return [(d, datetime(2026, 1, 1, (d + h) % 5), date(2026, 1, 1 + n), float(10 * n + d + h), 100 * n + 10 * d + h)
            for d in range(3) for h in range(4) if (d + h + n) % 4]


def test_upsert_stream(spark, tmp_path):
    source, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    (tmp_path / "in").mkdir()
    rows = new_files(spark, source, SCHEMA)
    everything = []
    for n in (1, 0, 2):  # the first file to arrive is not the oldest
        spark.createDataFrame(batch(n), SCHEMA).coalesce(1).write.mode("append").parquet(source)
        everything += batch(n)
        upsert_stream(rows, log, check, KEYS, ["seq"]).awaitTermination()
    expected = expected_table(everything)
    whole = read_log(spark, log, SCHEMA)
    assert table_of(fold_log(whole, KEYS, ["seq"])) == expected
    assert table_of(fold_log(compacted_log(whole, KEYS, ["seq"], 1), KEYS, ["seq"])) == expected
    # The last batch runs again, as after a failure before its commit.
    ends_per_key(spark.createDataFrame(batch(2), SCHEMA), KEYS, ["seq"]).write.mode("overwrite").parquet(f"{log}/batch_id=2")
    assert table_of(fold_log(read_log(spark, log, SCHEMA), KEYS, ["seq"])) == expected


def expected_table(rows):
    out = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: r[4])
        out[key] = (*key, own[0][2], *own[-1][3:])
    return sorted(out.values())


def table_of(df):
    return sorted(tuple(r) for r in df.select("destination_id", "forecast_ts", "forecast_date", "temperature_c", "seq").collect())


def test_late_rows_and_old_sequence_numbers(spark, tmp_path):
    """A row that arrives long after others is in the result; a newer row that arrived first stays the newest."""
    source, log, check = (str(tmp_path / n) for n in ("in", "log", "check"))
    rows = [(1, datetime(2026, 3, 1), date(2026, 3, 1), 1.0, 20), (2, datetime(2026, 3, 2), date(2026, 3, 2), 2.0, 21),
            (2, datetime(2026, 1, 1), date(2026, 1, 1), 3.0, 22), (1, datetime(2026, 3, 1), date(2026, 3, 1), 4.0, 10)]
    for row in rows:
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        upsert_stream(new_files(spark, source, SCHEMA, files_per_batch=1), log, check, KEYS, ["seq"]).awaitTermination()
    got = table_of(fold_log(read_log(spark, log, SCHEMA), KEYS, ["seq"]))
    assert [(r[0], r[1].month, r[3], r[4]) for r in got] == [(1, 3, 1.0, 20), (2, 1, 3.0, 22), (2, 3, 2.0, 21)]


def test_json_payload_stream(spark, tmp_path):
    from outings.sources.payloads import weather_hours

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"destination_id": 1, "payload": "{\\"hourly\\": {\\"time\\": [\\"2026-01-01T00:00\\"], \\"temperature_2m\\": [3.5]}}"}\n')
    stream = weather_hours(new_json_payloads(spark, str(source), "destination_id long, payload string"))
    append_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [r.temperature_c for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3.5]
