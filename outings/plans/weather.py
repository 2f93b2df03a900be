"""Weather by day for every trip, and the ingest that feeds it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outings.functions.scalars import aqi_colour, aqi_label, joined, month_day, round_half_up
from outings.operators.keyed import latest_per_key
from outings.operators.mutation import Mutation, upsert
from outings.schemas import DDL
from outings.settings import DEFAULTS, Settings
from outings.sources.snapshots import Snapshots
from outings.sources.tables import materialized, replace_partitions

HOUR_KEY = ["destination_id", "forecast_ts"]
# An upsert leaves forecast_date and source of a known hour as they are.
MEASURES = ["temperature_c", "precipitation_mm", "precipitation_prob", "wind_kph", "us_aqi", "pm2_5", "pm10",
            "uv_index"]


def daily_weather(weather: DataFrame) -> DataFrame:
    """One row per destination and day."""
    return weather.groupBy("destination_id", "forecast_date").agg(
        round_half_up(F.min("temperature_c"), 1).alias("min_temp_c"),
        round_half_up(F.max("temperature_c"), 1).alias("max_temp_c"),
        F.max("precipitation_prob").alias("max_precip_prob"),
        round_half_up(F.max("precipitation_mm"), 1).alias("max_precip_mm"),
        F.max("us_aqi").alias("max_aqi"))


def bad_reason(settings: Settings = DEFAULTS) -> Column:
    """Why a day is bad, from its maxima; null on a good day. A missing maximum is no reason."""
    prob, aqi = F.col("max_precip_prob"), F.col("max_aqi")
    rain = F.when(prob >= settings.rain_prob_threshold, F.concat(F.lit("rain likely ("), prob, F.lit("%)")))
    air = F.when(aqi >= settings.aqi_threshold, F.concat(F.lit("poor air quality (AQI "), aqi, F.lit(")")))
    return joined("; ", rain, air)


def trip_weather(trips: DataFrame, weather: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The forecast days inside every trip, with a bad-day flag and its reason.

    Hours are rolled up and judged once per destination and day. Trips are laid out by day, so that the join is an
    equality on both columns and no destination is a single join key. Only the span of the trips is read from the
    weather, which prunes the day folders of a partitioned table.
    """
    first, last = (trips.agg(end).scalar() for end in (F.min("start_date"), F.max("end_date")))
    days = daily_weather(weather.where(F.col("forecast_date").between(first, last))).withColumn("bad_reason", bad_reason(settings))
    trip_days = (trips.where(F.col("end_date") >= F.col("start_date"))
                 .select("trip_id", "destination_id",
                         F.explode(F.sequence("start_date", "end_date")).alias("forecast_date")))
    return (trip_days.join(days, ["destination_id", "forecast_date"])
            .select("trip_id", "destination_id", "forecast_date", "min_temp_c", "max_temp_c", "max_precip_prob",
                    "max_precip_mm", "max_aqi", F.col("bad_reason").isNotNull().alias("is_bad"), "bad_reason"))


def weather_chart(days: DataFrame) -> DataFrame:
    """Chart points from trip weather: label, air quality with its bucket and colour, maximum temperature."""
    return days.select("trip_id", "forecast_date", month_day("forecast_date").alias("day_label"), "max_aqi",
                       aqi_label("max_aqi").alias("aqi_label"), aqi_colour("max_aqi").alias("aqi_colour"),
                       "max_temp_c")


def join_hours(weather_hours: DataFrame, air_hours: DataFrame, how: str = "full",
               newest_first: Sequence[str] = ("position",)) -> DataFrame:
    """Weather and air-quality hours side by side; within a side the newest row of an hour counts.

    Both sides go through one aggregation on the hour, which removes repeated hours and joins the sides with a
    single shuffle. ``how`` is "full" (hours of either side) or "left" (hours the weather side has).
    """
    def values(df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in (*HOUR_KEY, *newest_first)]

    def side(df: DataFrame, own: str, other: str, other_df: DataFrame) -> DataFrame:
        nothing = F.lit(None).cast(other_df.select(F.struct(*values(other_df)).alias("x")).schema["x"].dataType)
        age = F.struct(*newest_first)
        return df.select(*HOUR_KEY, F.struct(*values(df)).alias(own), nothing.alias(other),
                         age.alias("_age"))

    both = (side(weather_hours, "_weather", "_air", air_hours)
            .unionByName(side(air_hours, "_air", "_weather", weather_hours)))
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))).alias(c) for c in ("_weather", "_air")]
    hours = both.groupBy(*HOUR_KEY).agg(*newest)
    if how == "left":
        hours = hours.where(F.col("_weather").isNotNull())
    return hours.select(*HOUR_KEY, F.to_date("forecast_ts").alias("forecast_date"),
                        *[F.col(f"_weather.{c}").alias(c) for c in values(weather_hours)],
                        *[F.col(f"_air.{c}").alias(c) for c in values(air_hours)])


def silver_weather(bronze: DataFrame, newest_first: Sequence[Column] | None = None) -> DataFrame:
    """The newest row of every destination and hour; ties go to the larger values, so reruns agree."""
    if newest_first is None:
        measures = [c for c in MEASURES if c in bronze.columns]
        newest_first = [F.col("_ingested_at").desc(), *[F.col(c).desc_nulls_last() for c in measures]]
    return latest_per_key(bronze, HOUR_KEY, newest_first)


def upsert_weather(target: DataFrame, source: DataFrame, now: Column | None = None,
                   newest_first: Sequence[Column] | None = None, source_name: str = "open-meteo") -> Mutation:
    now = F.current_timestamp() if now is None else now
    has = set(target.columns)
    inserts: Mapping[str, Column] = {c: v for c, v in {"source": F.lit(source_name), "captured_at": now}.items()
                                     if c in has}
    updates = {"captured_at": now} if "captured_at" in has else {}
    return upsert(target, source, HOUR_KEY, [c for c in MEASURES if c in has & set(source.columns)],
                  insert_values=inserts, update_values=updates, newest_first=newest_first)


def upsert_weather_days(spark: SparkSession, path: str, source: DataFrame, now: Column | None = None,
                        newest_first: Sequence[Column] | None = None) -> list:
    """Upsert into a table of files in day folders, reading and rewriting only the days the source has.

    The day of an hour must be its ``forecast_date`` on both sides. The merged days are written to the shared folder
    first, so a lost task never leaves a day half merged; the exchange of the folders at the end is not atomic, for which there is
    ``upsert_weather_version``. Returns the days.
    """
    days = [r[0] for r in source.select("forecast_date").distinct().collect()]  # at most the days of the calendar
    target = spark.read.schema(DDL["weather_snapshots"]).parquet(path).where(F.col("forecast_date").isin(days))
    merged = materialized(upsert_weather(target, source, now, newest_first).snapshot, "weather-days")
    replace_partitions(merged, path, "forecast_date")
    return days


def upsert_weather_version(table: Snapshots, source: DataFrame, now: Column | None = None,
                           newest_first: Sequence[Column] | None = None) -> int:
    """``upsert_weather_days`` as a new version of the table: readers see all days before the load or all after it, and a load that
    breaks off leaves the old version. Days without new rows are not read or written."""
    base = table.versions()[-1]
    days = [r[0] for r in source.select("forecast_date").distinct().collect()]  # at most the days of the calendar
    target = table.read(base).where(F.col("forecast_date").isin(days))
    return table.replace(upsert_weather(target, source, now, newest_first).snapshot, "forecast_date", base)


@dataclass(frozen=True)
class WeatherIngest:
    """The stages of one ingest, as lazy frames."""

    bronze: DataFrame
    silver: DataFrame
    serving: Mutation


def ingest_weather(weather_hours: DataFrame, air_hours: DataFrame, target: DataFrame, now: Column | None = None,
                   how: str = "full") -> WeatherIngest:
    """Parsed payload hours to bronze rows, silver rows and the new serving table."""
    now = F.current_timestamp() if now is None else now
    bronze = join_hours(weather_hours, air_hours, how).withColumn("_ingested_at", now)
    silver = silver_weather(bronze).drop("_ingested_at")
    return WeatherIngest(bronze, silver, upsert_weather(target, silver, now))
