"""Payload parsing and the loads that build on it."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from outings.plans.load import run_load
from outings.plans.places import attraction_rows, bootstrap_destinations, bootstrap_summary, ingest_attractions
from outings.plans.weather import ingest_weather, join_hours
from outings.schemas import empty
from outings.settings import Settings
from outings.sources.catalog import destination_catalog
from outings.sources.fetch import TASKS_PER_CORE, fetch_payloads, spread
from outings.sources.payloads import (WEATHER_VARIABLES, air_hours, geocode_candidates, page_summary, radius_hits, rejected_hours,
                                      to_instant, weather_hours)


def payloads(spark, *texts):
    return spark.createDataFrame([(i, t if isinstance(t, (str, type(None))) else json.dumps(t))
                                  for i, t in enumerate(texts)], "destination_id long, payload string")


def hour(h):
    return f"2026-08-14T{h:02d}:00"


def test_hourly_edge_cases(spark):
    df = payloads(spark,
                  {"hourly": {"time": [hour(0), hour(1)], "temperature_2m": [1.5], "precipitation": [0.1, 0.2, 0.3],
                              "precipitation_probability": [2.5, 59.6]}},
                  {"hourly": {}}, {}, {"hourly": None}, "not json", None)
    rows = sorted(weather_hours(df).collect())
    assert [(r.destination_id, r.forecast_ts, r.temperature_c, r.precipitation_mm, r.precipitation_prob, r.wind_kph)
            for r in rows] == [(0, datetime(2026, 8, 14, 0), 1.5, 0.1, 2, None), (0, datetime(2026, 8, 14, 1), None, 0.2, 60, None)]


def test_hours_join_and_repeat(spark):
    weather = payloads(spark, {"hourly": {"time": [hour(0), hour(1), hour(0)], "temperature_2m": [1.0, 2.0, 3.0]}})
    air = payloads(spark, {"hourly": {"time": [hour(1), hour(2)], "us_aqi": [10, 20]}})
    full = {r.forecast_ts.hour: (r.temperature_c, r.us_aqi)
            for r in join_hours(weather_hours(weather), air_hours(air)).collect()}
    assert full == {0: (3.0, None), 1: (2.0, 10), 2: (None, 20)}
    left = join_hours(weather_hours(weather), air_hours(air), "left").collect()
    assert sorted(r.forecast_ts.hour for r in left) == [0, 1]
    stages = ingest_weather(weather_hours(weather), air_hours(air), empty(spark, "weather_snapshots"))
    serving = stages.serving.snapshot.collect()
    assert len(serving) == 3 and {r.source for r in serving} == {"open-meteo"} and all(r.captured_at for r in serving)
    nothing = ingest_weather(weather_hours(weather.limit(0)), air_hours(air.limit(0)), empty(spark, "weather_snapshots"))
    assert nothing.silver.count() == 0 and nothing.serving.snapshot.count() == 0


def test_local_hour_to_instant(spark):
    df = spark.createDataFrame([("2026-08-14T09:00", "America/Edmonton")], "t string, z string")
    row = df.select(to_instant(F.col("t").cast("timestamp_ntz"), "z").cast("string")).first()
    assert row[0] == "2026-08-14 15:00:00"


PAGES = {"query": {"pages": {
    "1": {"pageid": 1, "title": "Far Lake", "index": 2, "coordinates": [{"lat": 51.2, "lon": -115.5}], "extract": "water"},
    "2": {"pageid": 2, "title": "Town Library", "index": 1},
    "3": {"pageid": 3, "title": "Unplaced", "coordinates": []}}}}


def page_payloads(spark, *texts):
    return payloads(spark, *texts).select("destination_id", F.lit(51.1784).alias("latitude"),
                                          F.lit(-115.5708).alias("longitude"), "payload")


def test_nearby_pages(spark):
    rows = attraction_rows(page_payloads(spark, PAGES, {}, {"query": {}})).orderBy("position").collect()
    assert [(r.title, r.category, r.is_outdoor) for r in rows] == [
        ("Town Library", "attraction", 0), ("Far Lake", "outdoor", 1), ("Unplaced", "attraction", 0)]
    assert (rows[0].latitude, rows[1].latitude) == (51.1784, 51.2)
    assert [r.title for r in attraction_rows(page_payloads(spark, PAGES), 1).collect()] == ["Town Library"]


def test_attractions_become_activities(spark, seeds):
    known = seeds["activities"].withColumn("destination_id", F.lit(0).cast("long")).withColumn(
        "name", F.when(F.col("activity_id") == 1, "Town Library").otherwise(F.col("name")))
    got = ingest_attractions(page_payloads(spark, PAGES), known)
    new = {r.name: r for r in got.activities.changed.collect()}
    assert set(new) == {"Far Lake", "Unplaced"}
    lake = new["Far Lake"]
    assert (lake.description, lake.requirements, lake.is_outdoor, lake.weather_sensitive, lake.source) == (
        "water", "water", True, True, "wikimedia")
    assert got.bronze.columns[-1] == "_ingested_at" and got.bronze.count() == 3
    again = ingest_attractions(page_payloads(spark, PAGES), got.activities.snapshot)
    assert again.activities.changed.count() == 0


def test_other_payloads(spark):
    df = payloads(spark, {"results": [{"name": "A", "country": "X", "admin1": "R", "latitude": 1.0, "longitude": 2.0},
                                      {"name": "B"}]}, {})
    found = geocode_candidates(df, 1, keep=["destination_id"]).collect()
    assert [(r.destination_id, r.place_name, r.admin_region, r.timezone) for r in found] == [(0, "A", "R", None)]
    assert geocode_candidates(df, 5, keep=["destination_id"]).count() == 2
    page = payloads(spark, {"title": "T", "content_urls": {"desktop": {"page": "u"}}, "coordinates": None}, {})
    first, second = page.orderBy("destination_id").select(page_summary("payload").alias("p")).select("p.*").collect()
    assert (first.title, first.url, first.latitude) == ("T", "u", None) and second.url is None
    hits = payloads(spark, {"query": {"geosearch": [{"pageid": 7, "title": "P", "lat": 1.0, "lon": 2.0, "dist": 3.5}]}})
    assert [(r.pageid, r.distance_m) for r in radius_hits(hits).collect()] == [(7, 3.5)]


def test_bootstrap(spark, seeds):
    catalog = destination_catalog(spark)
    assert catalog.count() == 25
    answers = catalog.select(
        "name", F.when(F.col("name") == "Moab", "TimeoutError: late").alias("error"),
        F.when(F.col("name") == "Ubud", "{}").otherwise(
            F.to_json(F.struct(F.array(F.struct(F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))).alias("results"))))
        .alias("geocode"), F.lit('{"description": "short"}').alias("summary"))
    boot = bootstrap_destinations(catalog, seeds["destinations"], answers)
    report = {r.name: (r.status, r.reason) for r in boot.report.collect()}
    assert report["Banff"] == ("skipped", None) and report["Moab"] == ("failed", "TimeoutError: late")
    assert report["Ubud"] == ("failed", "no geocode match") and report["Bergen"] == ("inserted", None)
    assert {r.status: r.names for r in bootstrap_summary(boot.report).collect()} == {
        "skipped": 3, "failed": 2, "inserted": 20}
    new = {r.name: r for r in boot.destinations.changed.collect()}
    assert (new["Bergen"].country, new["Bergen"].description, new["Bergen"].source) == ("Norway", "short", "phase8-bootstrap")
    assert sorted(r.destination_id for r in new.values()) == list(range(4, 24))


def test_fetch_keeps_failures(spark):
    def fetcher(request):
        if request["destination_id"] == 2:
            raise ValueError("no such place")
        return {"payload": f"p{request['destination_id']}"}

    requests = spark.range(0, 5).withColumnRenamed("id", "destination_id")
    rows = {r.destination_id: (r.payload, r.error) for r in fetch_payloads(requests, fetcher, partitions=3).collect()}
    assert rows[2] == (None, "ValueError: no such place") and rows[4] == ("p4", None) and len(rows) == 5
    nothing = fetch_payloads(requests.limit(0), fetcher)
    assert nothing.count() == 0 and nothing.columns == ["destination_id", "payload", "error"]


def test_whole_load(spark, seeds):
    hours = {"hourly": {"time": [hour(9), hour(10)], "temperature_2m": [1.0, 2.0]}}
    air = {"hourly": {"time": [hour(9)], "us_aqi": [50]}}
    weather = spark.createDataFrame([(1, json.dumps(hours), json.dumps(air))],
                                    "destination_id long, weather string, air string")
    pages = page_payloads(spark, PAGES).withColumn("destination_id", F.lit(1).cast("long"))
    result = run_load(weather, pages, seeds, Settings(schema="load_test", embedding_dim=32), check=True)
    assert result["weather"]["fetched"] == 2 and result["weather"]["silver_rows"] == 2
    assert result["weather"]["bronze_table"].status == "written" and result["attractions"]["inserted"] == 3
    assert result["tables"]["weather_snapshots"].count() == 7 and result["tables"]["activities"].count() == 15
    assert spark.table(result["weather"]["silver_table"].table).count() == 2
    again = run_load(weather, pages, result["tables"], Settings(write_tables=False))
    assert again["weather"]["bronze_table"].status == "skipped" and again["attractions"]["inserted"] == 0
    assert again["tables"]["weather_snapshots"].count() == 7


def test_rejected_hours(spark):
    good = {"hourly": {"time": ["2024-01-01T00:00", None, "soon"], "temperature_2m": [1.0, 2.0, 3.0, 4.0]}}
    rows = [(0, json.dumps(good)), (1, None), (2, "{"), (3, "{}"), (4, '{"hourly": {}}'), (None, json.dumps(good)), (5, "[1]"), (6, ""),
            (7, '{"hourly": {"time": []}}')]
    df = spark.createDataFrame(rows, "destination_id long, payload string")
    got = {(r.destination_id, r.position, r.reason) for r in rejected_hours(df, WEATHER_VARIABLES).collect()}
    assert got == {(0, 1, "no time"), (0, 2, "bad time"), (0, 3, "no time"), (1, None, "no payload"), (2, None, "not json"), (3, None, "no hours"),
                   (4, None, "no hours"), (None, None, "no key"), (5, None, "not json"), (6, None, "not json")}


def test_number_of_fetch_tasks_has_a_bound(spark):
    most = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    assert spread(spark.range(40 * most), 1).rdd.getNumPartitions() == most
    assert spread(spark.range(3), 1).rdd.getNumPartitions() == 3
    requests = spark.range(2 * most).withColumnRenamed("id", "destination_id")
    answers = fetch_payloads(requests, lambda request: {"payload": str(request["destination_id"])}, per_task=1)
    assert answers.rdd.getNumPartitions() == most
    assert {r.payload for r in answers.collect()} == {str(i) for i in range(2 * most)}
