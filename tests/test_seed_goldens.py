"""Expected results on the seed rows, worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from outings.functions.scalars import (aqi_label, blank_to_null, clamp_day, classify_place, hour_minute, iso_date, joined,
                                       month_day, page_slug, round_half_up, to_whole)
from outings.functions.vectors import HashEmbedder
from outings.plans.embedding import embed_activities, embed_destinations, embed_users, embedding_coverage
from outings.plans.itinerary import apply_plan, generate_itinerary, reschedule_for_weather
from outings.plans.packing import pack, packing_suggestions, with_packing_ids
from outings.plans.quality import QualityGateError, default_checks, gate, quality_report, report_summary
from outings.plans.scoring import Recording, evaluate_runs, score
from outings.plans.search import trip_search
from outings.plans.views import distinct_counts, items_per_day, row_counts, scale_summary, trip_bundle, trip_header
from outings.plans.weather import trip_weather
from outings.settings import Settings

EMBEDDER = HashEmbedder(32)
SMALL = Settings(embedding_dim=32)


@pytest.fixture(scope="module")
def embedded(seeds):
    return {**seeds, "activities": embed_activities(seeds["activities"], EMBEDDER, SMALL).snapshot.cache(),
            "destinations": embed_destinations(seeds["destinations"], EMBEDDER, SMALL).snapshot.cache(),
            "users": embed_users(seeds["users"], EMBEDDER, SMALL).snapshot.cache()}


def test_trip_weather(seeds):
    days = {(r.trip_id, r.forecast_date.day): r for r in trip_weather(seeds["trips"], seeds["weather_snapshots"]).collect()}
    assert sorted(days) == [(1, 14), (1, 15), (1, 16)]
    first, rainy, last = (days[1, d] for d in (14, 15, 16))
    assert (first.min_temp_c, first.max_temp_c, first.max_precip_prob, first.max_precip_mm, first.max_aqi,
            first.is_bad, first.bad_reason) == (14.0, 19.0, 10, 0.2, 25, False, None)
    assert (rainy.min_temp_c, rainy.max_temp_c, rainy.is_bad, rainy.bad_reason) == (12.0, 13.0, True, "rain likely (85%)")
    assert (last.max_aqi, last.is_bad) == (20, False)


def test_both_reasons_and_missing_values(spark, seeds):
    rows = [(1, "2026-08-14", None, 120), (1, "2026-08-15", 60, 100), (1, "2026-08-16", None, None)]
    weather = spark.createDataFrame(rows, "destination_id long, day string, precipitation_prob int, us_aqi int").select(
        "destination_id", F.to_date("day").alias("forecast_date"), F.lit(0.05).alias("temperature_c"),
        F.lit(0.25).alias("precipitation_mm"), "precipitation_prob", "us_aqi")
    days = {r.forecast_date.day: r for r in trip_weather(seeds["trips"], weather).collect()}
    assert days[14].bad_reason == "poor air quality (AQI 120)"
    assert days[15].bad_reason == "rain likely (60%); poor air quality (AQI 100)"
    assert (days[16].is_bad, days[16].bad_reason) == (False, None)
    assert (days[14].min_temp_c, days[14].max_precip_mm) == (0.1, 0.3)


def test_reschedule_moves_once(embedded):
    args = (embedded["activities"], embedded["weather_snapshots"], EMBEDDER)
    first = reschedule_for_weather(embedded["trips"], embedded["itinerary_items"], *args)
    (change,) = first.changes.collect()
    assert (change.item_id, change.action, change.from_day, change.to_day) == (
        5, "moved", date(2026, 8, 15), date(2026, 8, 14))
    assert change.reason == "Moved from 2026-08-15 to 2026-08-14: rain likely (85%)."
    items = first.items.snapshot.cache()
    moved = items.where("item_id = 5").first()
    assert (moved.day_date, moved.sort_order, moved.status, moved.reschedule_reason) == (
        date(2026, 8, 14), 2, "rescheduled", change.reason)
    assert items.count() == 9
    assert reschedule_for_weather(embedded["trips"], items, *args).changes.count() == 0


def test_reschedule_swaps_then_flags(embedded):
    weather = embedded["weather_snapshots"].withColumn("precipitation_prob", F.lit(90))
    trips, items = embedded["trips"], embedded["itinerary_items"]
    swapped = reschedule_for_weather(trips, items, embedded["activities"], weather, EMBEDDER)
    rows = swapped.changes.collect()
    assert {r.item_id for r in rows} == {1, 2, 5, 7} and {r.action for r in rows} == {"swapped"}
    indoor = {3: "Banff Park Museum", 4: "Banff Upper Hot Springs"}
    for r in rows:
        assert indoor[r.to_activity_id] == r.to_title
        assert r.reason == f"Swapped outdoor '{r.title}' for indoor '{r.to_title}': rain likely (90%)."
    after = {r.item_id: r for r in swapped.items.snapshot.collect()}
    assert after[1].activity_id in indoor and after[1].day_date == date(2026, 8, 14) and len(after) == 9

    nothing_indoors = embedded["activities"].where("is_outdoor")
    flagged = reschedule_for_weather(trips, items, nothing_indoors, weather, EMBEDDER).changes.collect()
    assert {r.action for r in flagged} == {"flagged"}
    assert flagged[0].reason == "Flagged: rain likely (90%). No indoor alternative found."


def test_packing(seeds):
    suggested = packing_suggestions(seeds["trips"].where("trip_id = 1"), seeds["weather_snapshots"],
                                    seeds["itinerary_items"], seeds["activities"]).cache()
    assert {r.item_name for r in suggested.collect()} == {
        "Reusable water bottle", "Phone + charger", "ID / travel documents", "Sunscreen SPF50", "Rain jacket",
        "Hiking shoes", "Swimwear"}
    packed = pack(seeds["packing_items"], suggested)
    changes = {r.item_name: r for r in packed.changed.collect()}
    assert sorted(n for n, r in changes.items() if r._change == "inserted") == [
        "Hiking shoes", "ID / travel documents", "Phone + charger"]
    jacket = changes["Rain jacket"]
    assert (jacket.reason, jacket.category, jacket.is_checked) == ("Rain forecast on at least one day.", "clothing", True)
    table = with_packing_ids(seeds["packing_items"], packed)
    assert sorted(r.packing_id for r in table.collect()) == list(range(1, 10))


def test_zero_degrees_is_cold(seeds):
    weather = seeds["weather_snapshots"].withColumn("temperature_c", F.lit(0.0))
    names = {r.item_name for r in packing_suggestions(seeds["trips"], weather, seeds["itinerary_items"],
                                                      seeds["activities"]).where("trip_id = 1").collect()}
    assert "Warm fleece layer" in names and "Sun hat" not in names


def test_counts(seeds, embedded):
    minimums = {"users": 2, "destinations": 3, "trips": 3, "activities": 12, "itinerary_items": 9,
                "weather_snapshots": 6, "packing_items": 6}
    report = row_counts(seeds, minimums).collect()
    assert {r.table_name: r.rows for r in report} == minimums and all(r["pass"] for r in report)
    counts = {r.metric: r.value for r in distinct_counts(seeds["destinations"], seeds["activities"]).collect()}
    assert counts == {"distinct_countries": 3, "distinct_activity_categories": 7, "outdoor_activities": 7,
                      "indoor_activities": 5}
    assert [r.items_that_day for r in items_per_day(seeds["itinerary_items"], seeds["trips"]).collect()] == [3, 3, 3]
    summary = {r.metric: r.value for r in scale_summary(embedded["destinations"], seeds["weather_snapshots"]).collect()}
    assert summary == {"destinations": 3, "countries": 3, "weather_rows": 6, "embedded_destinations": 3}


def test_embedding_coverage(seeds, embedded):
    def coverage(tables):
        rows = embedding_coverage({
            "destinations": (tables["destinations"], "description_embedding"),
            "activities": (tables["activities"], "requirements_embedding"),
            "users": (tables["users"], "notes_embedding")}).collect()
        return {r.col: (r.filled, r.total) for r in rows}

    assert coverage(seeds) == {"destinations": (0, 3), "activities": (0, 12), "users": (0, 2)}
    assert coverage(embedded) == {"destinations": (3, 3), "activities": (12, 12), "users": (2, 2)}
    assert embed_activities(embedded["activities"], EMBEDDER, SMALL).changed.count() == 0


def test_quality(seeds, embedded):
    checks = default_checks(SMALL)
    report = quality_report(embedded, checks).cache()
    assert report.count() == 10 and report.where("NOT passed").count() == 0
    assert len(gate(report)) == 10
    bare = quality_report(seeds, checks)
    warned = bare.where("NOT passed").collect()
    assert [(r.name, r.severity, r.detail) for r in warned] == [
        ("all activities embedded", "warn", "12 activities without an embedding")]
    assert report_summary(bare).first().passed
    broken = {**embedded, "weather_snapshots": embedded["weather_snapshots"].unionByName(
        embedded["weather_snapshots"].withColumn("us_aqi", F.lit(501)).withColumn("destination_id", F.lit(9)
                                                                                  .cast("long")))}
    with pytest.raises(QualityGateError, match="6 rows with out-of-range AQI"):
        gate(quality_report(broken, checks))
    details = {r.name: r.detail for r in quality_report(broken, checks).collect()}
    assert details["no orphan foreign keys"] == "6 orphan rows"
    repeated = {**embedded, "weather_snapshots": embedded["weather_snapshots"].union(embedded["weather_snapshots"])}
    assert not report_summary(quality_report(repeated, checks)).first().passed


def test_search_by_trip(embedded):
    found = trip_search(embedded["trips"], "park museum", embedded["activities"], EMBEDDER, k=2).collect()
    best = {r.trip_id: r.name for r in found if r.rank == 1}
    assert best == {1: "Banff Park Museum", 2: "Zion Human History Museum", 3: "Kyoto National Museum"}
    indoor = trip_search(embedded["trips"], "canyon hike", embedded["activities"], EMBEDDER, indoor_only=True).collect()
    assert indoor and not any(r.is_outdoor for r in indoor)


def test_itinerary(embedded):
    plan = generate_itinerary(embedded["trips"], embedded["users"], embedded["activities"],
                              embedded["weather_snapshots"], EMBEDDER).collect()
    rainy = [r for r in plan if r.trip_id == 1 and r.day_date.day == 15]
    assert all(r.indoor and r.notes == "Indoor pick due to weather" for r in rainy)
    by_trip = {}
    for r in plan:
        by_trip.setdefault(r.trip_id, []).append(r.activity_id)
    assert {t: len(ids) for t, ids in by_trip.items()} == {1: 4, 2: 4, 3: 4}
    assert all(len(set(ids)) == len(ids) for ids in by_trip.values())
    first_day = sorted((r.sort_order, r.start_time, r.end_time) for r in plan if r.trip_id == 2 and r.day_date.day == 4)
    assert first_day == [(1, "09:00", "11:00"), (2, "12:30", "14:30"), (3, "15:30", "17:00")]
    again = generate_itinerary(embedded["trips"], embedded["users"], embedded["activities"],
                               embedded["weather_snapshots"], EMBEDDER, existing=embedded["itinerary_items"])
    assert min(r.sort_order for r in again.collect() if r.trip_id == 1) == 4


def test_plan_replaces_items(embedded):
    trips = embedded["trips"].where("trip_id < 3")
    plan = generate_itinerary(trips, embedded["users"], embedded["activities"], embedded["weather_snapshots"], EMBEDDER)
    table = apply_plan(embedded["itinerary_items"], plan, trips).snapshot.collect()
    assert len(table) == 8 and sorted(r.item_id for r in table) == list(range(1, 9)) and all(r.updated_at for r in table)
    grown = apply_plan(embedded["itinerary_items"], plan)
    assert grown.snapshot.count() == 17 and grown.changed.agg(F.min("item_id")).first()[0] == 10


def test_recorded_runs(spark, embedded):
    items = embedded["itinerary_items"].join(embedded["activities"].select("activity_id", "is_outdoor"), "activity_id")
    done = reschedule_for_weather(embedded["trips"], embedded["itinerary_items"], embedded["activities"],
                                  embedded["weather_snapshots"], EMBEDDER).items.snapshot
    after = done.join(embedded["activities"].select("activity_id", "is_outdoor"), "activity_id")
    bad = trip_weather(embedded["trips"], embedded["weather_snapshots"]).where("is_bad").select(
        F.col("trip_id").alias("run_id"), F.col("forecast_date").alias("day_date"))

    def runs_of(df):
        return df.withColumnRenamed("trip_id", "run_id")

    transcript = spark.createDataFrame([(1, "retrieval", 0, "search_activities", None), (1, "grounding", 0, "get_trip", None),
                                        (2, "grounding", 0, "weather_by_day", "TimeoutError")],
                                       "run_id long, task string, step int, tool string, error string")
    none = runs_of(embedded["packing_items"]).limit(0)
    recording = Recording(transcript, (runs_of(items), runs_of(after)), (none, runs_of(embedded["packing_items"])),
                          (runs_of(items), runs_of(items).unionByName(runs_of(items).where("item_id = 1"))), bad)
    results = evaluate_runs(embedded["trips"].select(F.col("trip_id").alias("run_id")), recording)
    passed = {}
    for r in results.collect():
        passed.setdefault(r.run_id, {})[r.task.split(":")[0] + r.task[-6:]] = (r.passed, r.detail)
    assert passed[1] == {"retrievalvities": (True, "tools=search_activities"),
                         "reschedulead day": (True, "outdoor_before=4 still_on_bad_day_after=0"),
                         "reschedulereason": (True, "rescheduled=1 with_reason=1"),
                         "packingreated": (True, "before=0 after=6"), "add added": (True, "before=9 after=10"),
                         "groundingwering": (False, "tools=get_trip")}
    assert not any(ok for ok, _ in passed[2].values())
    scores = {r.run_id: (r.score, r.pass_rate) for r in score(results, ["run_id"]).collect()}
    assert scores[1] == ("5/6", 0.833) and scores[3] == ("0/6", 0.0)


def test_bundle(seeds):
    header = trip_header(seeds["trips"], seeds["destinations"])
    weather = trip_weather(seeds["trips"], seeds["weather_snapshots"])
    args = (header, weather, seeds["itinerary_items"], seeds["packing_items"])
    records = trip_bundle(*args).collect()
    first = sorted((r for r in records if r.trip_id == 1), key=lambda r: (r.section, r.day or date(1, 1, 1)))
    assert {r.trip_id for r in records} == {1, 2, 3}
    assert sorted(i.item_id for r in first for i in r.itinerary) == list(range(1, 10))
    assert [len(r.packing) for r in first if r.section == "packing"] == [6]
    assert [r.day.day for r in first if r.section == "weather"] == [14, 15, 16]
    assert not [r for r in records if r.trip_id == 3 and r.section == "itinerary"]


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_scalars(spark):
    kinds = spark.createDataFrame([("Banff Park Museum", None), ("Emerald Pools Trail", None), ("Nishiki", None),
                                   ("Old hall", "by the Hot Spring")], "t string, e string")
    category, is_outdoor = classify_place("t", "e")
    assert [tuple(r) for r in kinds.select(category, is_outdoor).collect()] == [
        ("attraction", 0), ("outdoor", 1), ("attraction", 0), ("outdoor", 1)]
    days = values(spark, clamp_day("d", F.to_date(F.lit("2026-08-14")), F.to_date(F.lit("2026-08-16"))).cast("string"),
                  [("",), ("tomorrow",), ("2026-08-01",), ("2026-09-01",), ("2026-08-15",), (None,), ("2026-13-45",)],
                  "d string")
    assert [d[-2:] for d in days] == ["14", "14", "14", "16", "15", "14", "16"]
    assert values(spark, aqi_label("a"), [(None,), (49,), (50,), (99,), (100,), (149,), (150,)], "a int") == [
        "—", "good", "moderate", "moderate", "unhealthy·sg", "unhealthy·sg", "unhealthy"]
    assert values(spark, iso_date("d").cast("string"), [("tomorrow",), ("2026-02-30",), ("2026-02-28",)], "d string") == [
        None, None, "2026-02-28"]
    assert values(spark, blank_to_null("x"), [("",), ("  ",), (" a ",), (None,)], "x string") == [None, None, " a ", None]
    assert values(spark, joined("; ", "a", "b"), [("x", None), ("", "y"), (None, ""), ("x", "y")],
                  "a string, b string") == ["x", "y", None, "x; y"]
    assert values(spark, round_half_up("x", 1), [(0.25,), (-0.25,), (12.05,), (-4.3499999999999996,)], "x double") == [
        0.3, -0.3, 12.1, -4.4]
    assert values(spark, to_whole("x"), [("2.5",), ("3.5",), ("x",), (None,)], "x string") == [2, 4, None, None]
    assert values(spark, page_slug("x"), [("Banff, Alberta",), ("a/b c",)], "x string") == ["Banff%2C_Alberta", "a/b_c"]
    assert values(spark, month_day("d"), [(date(2026, 8, 14),)], "d date") == ["08-14"]
    assert values(spark, hour_minute("x"), [("09:30:00",)], "x string") == ["09:30"]
