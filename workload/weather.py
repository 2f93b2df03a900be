"""Weather: roll-up, trip days, payload round trips, upsert, load, streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.functions.scalars import blank_to_null
from outings.operators.mutation import CHANGE
from outings.plans.weather import (daily_weather, ingest_weather, join_hours, silver_weather, trip_weather,
                                   upsert_weather, upsert_weather_version, weather_chart)
from outings.sources.fetch import fetch_payloads
from outings.sources.payloads import AIR_VARIABLES, WEATHER_VARIABLES, air_hours, rejected_hours, weather_hours
from outings.sources.snapshots import Snapshots
from outings.sources.tables import materialized, shared_folder
from outings.streaming.ingest import compacted_log, fold_log, new_files, read_log, upsert_stream
from workload.registry import query
from workload.standins import VIEWS


def newest() -> list:
    return [F.col("ingested_at").desc(), F.col("event_id").desc()]


DAYS = """
SELECT destination_id, forecast_date, CAST(round(CAST(min(temperature_c) AS DECIMAL(18,6)), 1) AS DOUBLE) AS min_temp_c,
       CAST(round(CAST(max(temperature_c) AS DECIMAL(18,6)), 1) AS DOUBLE) AS max_temp_c,
       max(precipitation_prob) AS max_precip_prob,
       CAST(round(CAST(max(precipitation_mm) AS DECIMAL(18,6)), 1) AS DOUBLE) AS max_precip_mm, max(us_aqi) AS max_aqi
FROM {v_weather} GROUP BY destination_id, forecast_date"""

TRIP_DAYS = """
SELECT t.trip_id, t.destination_id, d.forecast_date, d.min_temp_c, d.max_temp_c, d.max_precip_prob, d.max_precip_mm,
       d.max_aqi, coalesce(d.max_precip_prob, 0) >= 60 OR coalesce(d.max_aqi, 0) >= 100 AS is_bad,
       nullif(concat_ws('; ', CASE WHEN d.max_precip_prob >= 60 THEN concat('rain likely (', d.max_precip_prob, '%)') END,
              CASE WHEN d.max_aqi >= 100 THEN concat('poor air quality (AQI ', d.max_aqi, ')') END), '') AS bad_reason
FROM {v_trips} t JOIN {days} d ON d.destination_id = t.destination_id
 AND d.forecast_date BETWEEN t.start_date AND t.end_date"""

TRIP_DAY_VIEWS = {"days": DAYS, "trip_days": TRIP_DAYS}


@query("daily_weather", "SELECT * REPLACE (CAST(forecast_date AS VARCHAR) AS forecast_date) FROM {days}", {"days": DAYS})
def _daily_weather(t):
    return daily_weather(t("v_weather"))


@query("trip_weather", "SELECT * REPLACE (CAST(forecast_date AS VARCHAR) AS forecast_date) FROM {trip_days}",
       TRIP_DAY_VIEWS)
def _trip_weather(t):
    return trip_weather(t("v_trips"), t("v_weather"))


@query("weather_chart", """
SELECT trip_id, CAST(forecast_date AS VARCHAR) AS forecast_date, strftime(forecast_date, '%m-%d') AS day_label, max_aqi,
       CASE WHEN max_aqi IS NULL THEN '—' WHEN max_aqi < 50 THEN 'good' WHEN max_aqi < 100 THEN 'moderate'
            WHEN max_aqi < 150 THEN 'unhealthy·sg' ELSE 'unhealthy' END AS aqi_label,
       CASE WHEN max_aqi IS NULL THEN '#5f7688' WHEN max_aqi < 50 THEN '#6bd08f' WHEN max_aqi < 100 THEN '#eaa84a'
            WHEN max_aqi < 150 THEN '#f2864a' ELSE '#e0607b' END AS aqi_colour, max_temp_c
FROM {trip_days}""", TRIP_DAY_VIEWS)
def _weather_chart(t):
    return weather_chart(trip_weather(t("v_trips"), t("v_weather")))


SILVER = "SELECT * REPLACE (CAST(forecast_ts AS VARCHAR) AS forecast_ts, CAST(forecast_date AS VARCHAR) AS forecast_date) FROM "


@query("weather_silver_latest", SILVER + "{v_weather}")
def _weather_silver_latest(t):
    return silver_weather(t("v_bronze"), newest()).drop("ingested_at", "event_id")


def day_payloads(weather: DataFrame, variables: dict[str, str], name: str) -> DataFrame:
    """One payload of parallel arrays per destination and day, as a weather service sends it."""
    text = F.date_format("forecast_ts", "yyyy-MM-dd'T'HH:mm")
    hours = F.sort_array(F.collect_list(F.struct(text.alias("time"), *[F.col(c).alias(v)
                                                                      for v, c in variables.items()])))
    arrays = F.struct(*[F.col("_hours")[v].alias(v) for v in ("time", *variables)])
    return (weather.groupBy("destination_id", "forecast_date").agg(hours.alias("_hours"))
            .select("destination_id", "forecast_date", F.to_json(F.struct(arrays.alias("hourly"))).alias(name)))


def both_payloads(weather: DataFrame, air: DataFrame) -> DataFrame:
    """Weather and air payloads of a destination and day; either may be missing."""
    first = day_payloads(weather, {"temperature_2m": "temperature_c", "precipitation": "precipitation_mm",
                                   "precipitation_probability": "precipitation_prob"}, "weather")
    return first.join(day_payloads(air, {"us_aqi": "us_aqi"}, "air"), ["destination_id", "forecast_date"], "full")


def split_sides(t) -> DataFrame:
    """Weather without its driest hours, air quality without its worst ones: each side lacks hours of the other."""
    return both_payloads(t("v_weather").where("precipitation_prob >= 20"), t("v_weather").where("us_aqi < 150"))


SIDES = {"sides": """
SELECT destination_id, forecast_ts, forecast_date,
       CASE WHEN precipitation_prob >= 20 THEN temperature_c END AS temperature_c,
       CASE WHEN precipitation_prob >= 20 THEN precipitation_mm END AS precipitation_mm,
       CASE WHEN precipitation_prob >= 20 THEN precipitation_prob END AS precipitation_prob,
       CASE WHEN us_aqi < 150 THEN us_aqi END AS us_aqi
FROM {v_weather} WHERE precipitation_prob >= 20 OR us_aqi < 150"""}

HOUR_COLUMNS = ["destination_id", "forecast_ts", "forecast_date", "temperature_c", "precipitation_mm",
                "precipitation_prob", "us_aqi"]


def _joined(t, how: str) -> DataFrame:
    payloads = split_sides(t)
    return join_hours(weather_hours(payloads, "weather"), air_hours(payloads, "air"), how).select(*HOUR_COLUMNS)


ALL_HOURS = """
SELECT destination_id, forecast_ts, forecast_date, temperature_c, precipitation_mm, precipitation_prob,
       temperature_c * 0.5 + precipitation_prob AS wind_kph, us_aqi, us_aqi * 0.25 AS pm2_5,
       CASE WHEN us_aqi % 3 = 0 THEN NULL ELSE us_aqi * 0.5 END AS pm10, precipitation_mm + 1.5 AS uv_index FROM {v_weather}"""


@query("weather_all_variables", SILVER + "{all_hours}", {"all_hours": ALL_HOURS})
def _weather_all_variables(t):
    """Every variable of both services, through payloads."""
    hours = t.run(ALL_HOURS, v_weather=t("v_weather"))
    weather = day_payloads(hours, {name: column for name, (column, _) in WEATHER_VARIABLES.items()}, "weather")
    air = day_payloads(hours, {name: column for name, (column, _) in AIR_VARIABLES.items()}, "air")
    both = weather.join(air, ["destination_id", "forecast_date"])
    return join_hours(weather_hours(both, "weather"), air_hours(both, "air")).select(*hours.columns)


BROKEN = """
SELECT destination_id, forecast_date, destination_id * 31 + day(forecast_date) AS n,
       row_number() OVER (PARTITION BY destination_id, forecast_date ORDER BY forecast_ts) - 1 AS position, forecast_ts FROM {v_weather}"""


@query("weather_rejects", """
SELECT CASE WHEN n % 11 <> 3 THEN destination_id END AS destination_id, CAST(NULL AS INT) AS position,
       ['no payload', 'not json', 'no hours', 'no key'][n % 11 + 1] AS reason,
       [NULL, '{"hourly":', '{"daily":{', '{"hourly":'][n % 11 + 1] AS value FROM {broken} WHERE n % 11 < 4 AND position = 0
UNION ALL SELECT destination_id, CAST(position AS INT), 'bad time', strftime(forecast_ts, '%Y-%m-%d') FROM {broken}
WHERE n % 11 = 4 AND hour(forecast_ts) < 10
UNION ALL SELECT destination_id, 0, 'no time', NULL FROM {broken} WHERE n % 11 = 5 AND position = 0""", {"broken": BROKEN})
def _weather_rejects(t):
    """Payloads broken in six ways; every one is reported with its reason."""
    first = day_payloads(t("v_weather"), {"temperature_2m": "temperature_c"}, "weather")
    kind = F.pmod(F.col("destination_id") * 31 + F.day("forecast_date"), F.lit(11))
    text = (F.when(kind == 0, F.lit(None).cast("string")).when(kind == 1, F.lit('{"hourly": {"time": ['))
            .when(kind == 2, F.lit('{"daily":{}}')).when(kind == 4, F.replace("weather", F.lit("T0"), F.lit(" never ")))
            .when(kind == 5, F.replace("weather", F.lit('"time":['), F.lit('"time":[null,'))).otherwise(F.col("weather")))
    broken = first.select(F.when(kind != 3, F.col("destination_id")).alias("destination_id"), text.alias("payload"))
    found = rejected_hours(broken, WEATHER_VARIABLES)
    return found.withColumn("value", F.left("value", F.lit(10)))


@query("weather_hour_join_full", SILVER + "{sides}", SIDES)
def _join_full(t):
    return _joined(t, "full")


@query("weather_hour_join_left", SILVER + "{sides} WHERE precipitation_prob IS NOT NULL", SIDES)
def _join_left(t):
    return _joined(t, "left")


@query("weather_versions", """
SELECT 1 AS version, destination_id, CAST(forecast_ts AS VARCHAR) AS forecast_ts, CAST(forecast_date AS VARCHAR) AS forecast_date, temperature_c
FROM {v_weather} WHERE forecast_date <= DATE '2024-01-10'
UNION ALL
SELECT 2, destination_id, CAST(forecast_ts AS VARCHAR), CAST(forecast_date AS VARCHAR),
       CASE WHEN forecast_date >= DATE '2024-01-08' THEN temperature_c + 1.0 ELSE temperature_c END
FROM {v_weather} WHERE forecast_date <= DATE '2024-01-15'""")
def _weather_versions(t):
    """Two versions of a stored table, the second made by an upsert of some days."""
    weather = t("v_weather")
    table = Snapshots(t.spark, shared_folder(t.spark, "weather-table"))
    table.commit(weather.where("forecast_date <= DATE '2024-01-10'"), "forecast_date")
    newer = weather.where("forecast_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-15'").withColumn("temperature_c", F.col("temperature_c") + 1.0)
    upsert_weather_version(table, newer, newest_first=[F.col("temperature_c")])
    rows = [table.read(v).select(F.lit(v).alias("version"), "destination_id", "forecast_ts", "forecast_date", "temperature_c") for v in (1, 2)]
    return rows[0].unionByName(rows[1])


SHIFTED = """
SELECT destination_id, forecast_ts + INTERVAL 12 HOUR AS forecast_ts,
       CAST(forecast_ts + INTERVAL 12 HOUR AS DATE) AS forecast_date, temperature_c + 1.0 AS temperature_c,
       precipitation_mm, precipitation_prob, us_aqi, ingested_at, event_id
FROM {v_bronze}"""


@query("weather_upsert", """
SELECT destination_id, CAST(forecast_ts AS VARCHAR) AS forecast_ts,
       CAST(coalesce(o.forecast_date, n.forecast_date) AS VARCHAR) AS forecast_date,
       coalesce(n.temperature_c, o.temperature_c) AS temperature_c,
       coalesce(n.precipitation_mm, o.precipitation_mm) AS precipitation_mm,
       coalesce(n.precipitation_prob, o.precipitation_prob) AS precipitation_prob, coalesce(n.us_aqi, o.us_aqi) AS us_aqi,
       CASE WHEN n.forecast_date IS NULL THEN NULL WHEN o.forecast_date IS NULL THEN 'inserted' ELSE 'updated' END AS change
FROM {v_weather} o FULL JOIN (SELECT * FROM {shifted} QUALIFY row_number() OVER (
     PARTITION BY destination_id, forecast_ts ORDER BY ingested_at DESC, event_id DESC) = 1) n
USING (destination_id, forecast_ts)""", {"shifted": SHIFTED})
def _weather_upsert(t):
    shifted = t.run(SHIFTED, v_bronze=t("v_bronze"))
    target = t("v_weather")
    return upsert_weather(target, shifted, newest_first=newest()).frame.withColumnRenamed(CHANGE, "change")


@query("weather_ingest", """
SELECT destination_id, CAST(forecast_ts AS VARCHAR) AS forecast_ts,
       CAST(coalesce(o.forecast_date, n.forecast_date) AS VARCHAR) AS forecast_date,
       CASE WHEN n.forecast_date IS NULL THEN o.temperature_c ELSE n.temperature_c END AS temperature_c,
       CASE WHEN n.forecast_date IS NULL THEN o.precipitation_mm ELSE n.precipitation_mm END AS precipitation_mm,
       CASE WHEN n.forecast_date IS NULL THEN o.precipitation_prob ELSE n.precipitation_prob END AS precipitation_prob,
       CASE WHEN n.forecast_date IS NULL THEN o.us_aqi ELSE n.us_aqi END AS us_aqi
FROM {newest} o FULL JOIN {sides} n USING (destination_id, forecast_ts)""",
       {**SIDES, "shifted": SHIFTED, "newest": """
SELECT * FROM {shifted} QUALIFY row_number() OVER (
     PARTITION BY destination_id, forecast_ts ORDER BY ingested_at DESC, event_id DESC) = 1"""})
def _weather_ingest(t):
    """The whole load in one plan: payloads to bronze to silver to an upsert of an existing table."""
    payloads = split_sides(t)
    target = silver_weather(t.run(SHIFTED, v_bronze=t("v_bronze")), newest()).drop("ingested_at", "event_id")
    target = target.withColumn("forecast_ts", F.col("forecast_ts").cast("timestamp_ntz"))
    return ingest_weather(weather_hours(payloads, "weather"), air_hours(payloads, "air"), target).serving.snapshot


def offline_fetch(request: dict) -> dict:
    """A stand-in service: it answers with the payloads stored next to the request, and fails if there are none."""
    json.loads(request["stored_weather"])
    return {"weather": request["stored_weather"], "air": request["stored_air"]}


@query("parallel_fetch", SILVER + "{v_weather}")
def _parallel_fetch(t):
    stored = both_payloads(t("v_weather"), t("v_weather"))
    requests = stored.select("destination_id", F.col("weather").alias("stored_weather"),
                             F.col("air").alias("stored_air"))
    answers = fetch_payloads(materialized(requests, "requests"), offline_fetch, ("weather", "air"))
    answers = materialized(answers.select("destination_id", "weather", "air", "error"), "fetched")
    answers = answers.where(blank_to_null("error").isNull())
    return join_hours(weather_hours(answers, "weather"), air_hours(answers, "air")).select(*HOUR_COLUMNS)


ARRIVAL = ["ingested_at", "event_id"]


def _bronze_log(t, name: str) -> DataFrame:
    """The change log of the events, written as several files of which each spans the whole time, one file a batch."""
    folder = shared_folder(t.spark, name)
    t("events").repartition(5, "event_id").write.parquet(f"{folder}/in")
    events = new_files(t.spark, f"{folder}/in", t("events").schema, files_per_batch=1)
    rows = t.run(VIEWS["v_bronze"], events=events)
    upsert_stream(rows, f"{folder}/log", f"{folder}/checkpoint", ["destination_id", "forecast_ts"], ARRIVAL).awaitTermination()
    return read_log(t.spark, f"{folder}/log", rows.schema)


@query("stream_silver", SILVER + "{v_weather}")
def _stream_silver(t):
    """Whole rows, the latest of each key, whatever file they came in."""
    return fold_log(_bronze_log(t, "stream-silver"), ["destination_id", "forecast_ts"], ARRIVAL, first_wins=()).select(*HOUR_COLUMNS)


@query("stream_upsert", SILVER + """(
SELECT w.destination_id, w.forecast_ts, w.forecast_date, w.temperature_c, w.precipitation_mm, w.precipitation_prob,
       f.first_aqi AS us_aqi FROM {v_weather} w JOIN {firsts} f USING (destination_id, forecast_ts)) x""",
       {"firsts": """
SELECT destination_id, forecast_ts, us_aqi AS first_aqi FROM (
  SELECT b.*, row_number() OVER (PARTITION BY destination_id, forecast_ts ORDER BY ingested_at, event_id) AS rn
  FROM {v_bronze} b) x WHERE rn = 1"""})
def _stream_upsert(t):
    """The first air quality of an hour stays, all else is the latest; the log is compacted on the way."""
    key = ["destination_id", "forecast_ts"]
    log = compacted_log(_bronze_log(t, "stream-upsert"), key, ARRIVAL, up_to=2)
    return fold_log(log, key, ARRIVAL, first_wins=("us_aqi",)).select(*HOUR_COLUMNS)
