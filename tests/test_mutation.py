"""Table changes against plain Python, and their repeatability."""

from datetime import date, datetime
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from outings.operators.keyed import assign_ids, latest_per_key, number_in_group
from outings.operators.mutation import (add_items, align_trips, append_in_group, delete_cascade, delete_rows,
                                        insert_absent, move_items, snapshot_diff, swap_items, upsert)
from outings.plans.weather import upsert_weather, upsert_weather_days
from workload.registry import Session

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3), st.integers(0, 100)), max_size=12)
SCHEMA = "a int, b int, v int"


@few
@given(old=rows, new=rows)
def test_upsert_is_a_keyed_overlay(spark, old, new):
    before, overlay = {(a, b): v for a, b, v in old}, {(a, b): v for a, b, v in new}
    target = spark.createDataFrame([(*k, v, "old") for k, v in before.items()], SCHEMA + ", kept string")
    source = spark.createDataFrame([(*k, v, "new") for k, v in overlay.items()], SCHEMA + ", kept string")
    once = upsert(target, source, ["a", "b"], ["v"])
    expected = {k: (v, "new") for k, v in overlay.items()} | {
        k: (overlay.get(k, v), "old") for k, v in before.items()}
    assert {(r.a, r.b): (r.v, r.kept) for r in once.snapshot.collect()} == expected
    assert {(r.a, r.b): r._change for r in once.changed.collect()} == {
        k: "updated" if k in before else "inserted" for k in overlay}
    twice = upsert(once.snapshot, source, ["a", "b"], ["v"])
    assert sorted(map(tuple, twice.snapshot.collect())) == sorted(map(tuple, once.snapshot.collect()))


@few
@given(data=rows)
def test_latest_and_insert_absent(spark, data):
    numbered = [(a, b, v, n) for n, (a, b, v) in enumerate(data)]
    df = spark.createDataFrame(numbered, SCHEMA + ", n int")
    latest = {(r.a, r.b): r.v for r in latest_per_key(df, ["a", "b"], [F.col("n").desc()]).collect()}
    assert latest == {(a, b): v for a, b, v, _ in numbered}
    target = spark.createDataFrame([(0, 0, -1)], SCHEMA)
    grown = insert_absent(target, df, ["a", "b"], first=[F.col("n")]).snapshot.collect()
    firsts = {}
    for a, b, v, _ in numbered:
        firsts.setdefault((a, b), v)
    assert {(r.a, r.b): r.v for r in grown} == firsts | {(0, 0): -1} and len(grown) == len(set(firsts) | {(0, 0)})


@pytest.mark.parametrize("block_rows", [3, 1_000_000])
def test_numbering_survives_a_hot_group(spark, block_rows):
    df = spark.range(0, 300).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") == 1, None)
                                    .otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    numbered = number_in_group(df, ["g"], "id", "n", block_rows).collect()
    groups = {}
    for r in numbered:
        groups.setdefault(r.g, []).append((r.id, r.n))
    assert len(numbered) == 300
    for pairs in groups.values():
        assert [n for _, n in sorted(pairs)] == list(range(1, len(pairs) + 1))


def test_append_positions(spark):
    target = spark.createDataFrame([("x", 4), ("x", 2), ("y", 7)], "g string, sort_order int")
    requests = spark.createDataFrame([(30, "x"), (10, "x"), (20, "z")], "seq long, g string")
    got = {r.seq: r.sort_order for r in append_in_group(target, requests, ["g"], "seq", block_rows=15).collect()}
    assert got == {10: 5, 30: 6, 20: 1}


def test_ids_are_dense_and_repeatable(spark):
    df = spark.range(0, 5000).select(F.concat(F.lit("k"), "id").alias("k"))
    first = {r.k: r.i for r in assign_ids(df, "i", ["k"], 100).collect()}
    assert sorted(first.values()) == list(range(101, 5101))
    assert first == {r.k: r.i for r in assign_ids(df.repartition(13), "i", ["k"], 100).collect()}


def test_upsert_weather_keeps_date_and_source(seeds):
    now = F.lit(datetime(2030, 1, 1)).cast("timestamp")
    source = seeds["weather_snapshots"].select(
        "destination_id", "forecast_ts", F.lit(date(1999, 1, 1)).alias("forecast_date"),
        (F.col("temperature_c") + 1).alias("temperature_c"), "precipitation_prob")
    extra = source.withColumn("destination_id", F.lit(2).cast("long"))
    table = {(r.destination_id, r.forecast_ts): r
             for r in upsert_weather(seeds["weather_snapshots"], source.union(extra), now).snapshot.collect()}
    old, new = table[1, datetime(2026, 8, 14, 9)], table[2, datetime(2026, 8, 14, 9)]
    assert (old.forecast_date, old.source, old.temperature_c, old.us_aqi, old.snapshot_id) == (
        date(2026, 8, 14), "open-meteo", 15.0, 22, 1)
    assert old.captured_at.year == 2030 and new.forecast_date == date(1999, 1, 1) and len(table) == 12


def test_only_touched_days_are_rewritten(spark, seeds, tmp_path):
    path = str(tmp_path / "weather")
    seeds["weather_snapshots"].write.partitionBy("forecast_date").parquet(path)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "weather").glob("*/*.parquet")}
    source = (seeds["weather_snapshots"].where("day(forecast_date) = 15")
              .select("destination_id", "forecast_ts", "forecast_date", F.lit(99.0).alias("temperature_c")))
    source = source.union(source.withColumn("destination_id", F.lit(2).cast("long")))
    assert upsert_weather_days(spark, path, source) == [date(2026, 8, 15)]
    after = spark.read.parquet(path).select("destination_id", "forecast_date", "temperature_c", "us_aqi").collect()
    assert len(after) == 8
    assert {r.temperature_c for r in after if r.forecast_date.day == 15} == {99.0}
    kept = {p for p in (tmp_path / "weather").glob("*/*.parquet") if p in files}
    assert kept == {p for p in files if "2026-08-15" not in str(p)}


def test_move_keeps_what_is_not_given(spark, seeds):
    moves = spark.createDataFrame([(1, "soon", "", None, "why"), (2, "2030-01-01", "10:00", "11:00", " ")],
                                  "item_id long, day_date string, start_time string, end_time string, reason string")
    moved = move_items(seeds["itinerary_items"], moves)
    after = {r.item_id: r for r in moved.snapshot.collect()}
    assert (after[1].day_date, after[1].start_time, after[1].reschedule_reason, after[1].status) == (
        date(2026, 8, 14), "08:00", "why", "rescheduled")
    assert (after[2].day_date, after[2].start_time, after[2].reschedule_reason) == (date(2030, 1, 1), "10:00", None)
    assert after[3].status == "planned" and after[3].updated_at is None
    assert {r.item_id for r in snapshot_diff(seeds["itinerary_items"], moved.snapshot).collect()} == {1, 2}
    swaps = spark.createDataFrame([(3, 4, "t", "r")], "item_id long, activity_id long, title string, reason string")
    swapped = {r.item_id: r for r in swap_items(seeds["itinerary_items"], swaps).changed.collect()}
    assert (swapped[3].title, swapped[3].status, swapped[3].reschedule_reason) == ("t", "rescheduled", "r")


def test_added_items(spark, seeds):
    requests = spark.createDataFrame(
        [(1, 1, "2026-08-14", "Coffee", 0, "08:00"), (2, 1, "whenever", None, 3, ""), (3, 1, "2027-01-01", "Late", 99, None),
         (4, 2, "2026-09-05", "Walk", None, None)],
        "request_id long, trip_id long, day_date string, title string, activity_id long, start_time string").select(
        "*", F.lit(None).cast("string").alias("end_time"), F.lit(None).cast("string").alias("notes"))
    added = {r.request_id: r for r in add_items(seeds["itinerary_items"], requests, seeds["trips"],
                                                seeds["activities"]).collect()}
    assert [(added[i].day_date.day, added[i].activity_id, added[i].sort_order, added[i].title) for i in (1, 2, 3, 4)] == [
        (14, None, 4, "Coffee"), (14, 3, 5, "Untitled"), (16, None, 4, "Late"), (5, None, 1, "Walk")]
    assert (added[1].start_time, added[2].start_time) == ("08:00", None)


def test_deletes(spark, seeds):
    gone = delete_rows(seeds["itinerary_items"], spark.createDataFrame([(1,), (99,)], "item_id long"), ["item_id"])
    assert gone.snapshot.count() == 8 and [r.title for r in gone.removed.collect()] == ["Johnston Canyon Hike"]
    users = seeds["users"].where("user_id = 1")
    left = delete_cascade(seeds, "users", users)
    assert {n: left[n].count() for n in ("users", "trips", "itinerary_items", "packing_items")} == {
        "users": 1, "trips": 1, "itinerary_items": 0, "packing_items": 0}
    with pytest.raises(ValueError, match="trips.destination_id"):
        delete_cascade(seeds, "destinations", seeds["destinations"].where("destination_id = 1"))
    left = delete_cascade(seeds, "activities", seeds["activities"].where("activity_id = 1"))
    assert left["itinerary_items"].where("activity_id IS NULL").count() == 2 and left["itinerary_items"].count() == 9


def test_aligned_trips(seeds):
    moved = align_trips(seeds["trips"].withColumn("start_date", F.lit(date(2020, 1, 1))),
                        seeds["weather_snapshots"]).snapshot
    spans = {r.trip_id: (r.start_date, r.end_date) for r in moved.collect()}
    assert spans[1] == (date(2026, 8, 14), date(2026, 8, 16)) and spans[2][0] == date(2020, 1, 1)


def test_requests_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def touch(value):
        seen.add(1)
        return value

    requests = spark.range(50).select(F.udf(touch, "long").asNondeterministic()("id").alias("seq"), (F.col("id") % 3).alias("g"))
    target = spark.createDataFrame([(0, 7), (2, 1)], "g long, sort_order int")
    got = {r.seq: r.sort_order for r in append_in_group(target, requests, ["g"], "seq", block_rows=15).collect()}
    assert got == {i: i // 3 + 1 + {0: 7, 2: 1}.get(i % 3, 0) for i in range(50)}
    assert seen.value == 50


def test_written_view_is_shuffled_once(spark, tmp_path):
    """The uses of a view that is written read it; they do not repeat its joins and windows."""
    spark.sql("SELECT 1L AS event_id, 4L AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT id AS o_orderkey, id AS o_custkey, 'O' AS o_orderstatus FROM range(6)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("""SELECT id % 6 AS l_orderkey, id AS l_partkey, id AS l_suppkey, CAST(id % 4 AS INT) AS l_linenumber, 'O' AS l_linestatus,
                 1.0D AS l_extendedprice, TIMESTAMP '2024-01-01' AS l_shipdate FROM range(40)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Session(spark, str(tmp_path))
    plain = {tuple(r) for r in Session(spark, str(tmp_path))("v_items").collect()}
    items = t.written("v_items")
    assert "Window" not in items._jdf.queryExecution().toString() and {tuple(r) for r in items.collect()} == plain
    assert t.written("v_items") is items and t("v_items") is items


def test_only_groups_of_several_blocks_are_counted(spark, monkeypatch):
    """Requests meet the ends of their groups and are numbered on one shuffle; the counts by block have rows for large groups only,
    and nothing but the result is left in the shared folder."""
    from outings.operators import keyed

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    counted, there = [], set(shared.glob("*"))
    monkeypatch.setattr(keyed, "materialized", lambda df, purpose, write=keyed.materialized: counted.append((purpose, (out := write(df, purpose)).count())) or out)
    rows = [(i, None if i % 4 == 3 else f"g{i % 4}", "n" * (i % 3)) for i in range(40)] + [(None, "g0", "late"), (500, "alone", "")]
    target = spark.createDataFrame([("g0", 7), ("g1", None), (None, 9)], "g string, sort_order int")
    got = append_in_group(target, spark.createDataFrame(rows, "seq long, g string, notes string"), ["g"], "seq", block_rows=1000)
    assert sorted(counted) == [("blocks", 1), ("large-groups", 1)]
    assert [p.name.split("-")[0] for p in set(shared.glob("*")) - there if "-" in p.name] == ["positions"]
    plan = got.collect()
    places = {(r.g, r.seq): r.sort_order for r in plan}
    assert len(plan) == 42 and places["g0", None] == 8 and places["alone", 500] == 1
    for g, first in (("g0", 9), ("g1", 1), ("g2", 1), (None, 1)):
        assert [places[g, i] for i in range(40) if (None if i % 4 == 3 else f"g{i % 4}") == g] == list(range(first, first + 10))
