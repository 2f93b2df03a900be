"""Rows from service payloads (JSON text)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.functions.geo import haversine_m
from outings.functions.scalars import col, to_whole

# Payload variable, column and type. Whole numbers arrive as doubles and are rounded.
WEATHER_VARIABLES = {
    "temperature_2m": ("temperature_c", "double"),
    "precipitation": ("precipitation_mm", "double"),
    "precipitation_probability": ("precipitation_prob", "int"),
    "wind_speed_10m": ("wind_kph", "double"),
}
AIR_VARIABLES = {
    "us_aqi": ("us_aqi", "int"),
    "pm2_5": ("pm2_5", "double"),
    "pm10": ("pm10", "double"),
    "uv_index": ("uv_index", "double"),
}

PLACES_SCHEMA = "results ARRAY<STRUCT<name STRING, country STRING, admin1 STRING, latitude DOUBLE, " \
                "longitude DOUBLE, timezone STRING>>"
PAGES_SCHEMA = "query STRUCT<pages MAP<STRING, STRUCT<pageid BIGINT, title STRING, index INT, " \
               "coordinates ARRAY<STRUCT<lat DOUBLE, lon DOUBLE>>, description STRING, extract STRING>>>"
HITS_SCHEMA = "query STRUCT<geosearch ARRAY<STRUCT<pageid BIGINT, title STRING, lat DOUBLE, lon DOUBLE, dist DOUBLE>>>"
SUMMARY_SCHEMA = "title STRING, description STRING, extract STRING, " \
                 "content_urls STRUCT<desktop STRUCT<page STRING>>, coordinates STRUCT<lat DOUBLE, lon DOUBLE>"


def hourly_rows(payloads: DataFrame, variables: Mapping[str, tuple[str, str]], payload: str = "payload",
                keep: Sequence[str] = ("destination_id",)) -> DataFrame:
    """One row per hour of a payload of parallel arrays; a short or missing array gives nulls.

    ``position`` is the place of the hour in its payload; of a repeated hour the last one counts.
    """
    arrays = ", ".join(f"`{name}`: array<double>" for name in variables)
    parsed = F.from_json(payload, f"struct<hourly: struct<time: array<string>, {arrays}>>")["hourly"]

    def values(name: str, kind: str) -> Column:
        return F.coalesce(F.col("_hourly")[name], F.array().cast(f"array<{kind}>")).alias(name)

    zipped = F.arrays_zip(values("time", "string"), *[values(name, "double") for name in variables])
    hours = (payloads.withColumn("_hourly", parsed)
             .select(*keep, F.posexplode(zipped).alias("position", "_hour"))
             .where(F.col("_hour.time").isNotNull()))
    columns = [(to_whole(F.col(f"_hour.{name}")) if kind == "int" else F.col(f"_hour.{name}")).alias(column)
               for name, (column, kind) in variables.items()]
    return hours.select(*keep, F.col("_hour.time").try_cast("timestamp_ntz").alias("forecast_ts"), *columns,
                        "position")


def rejected_hours(payloads: DataFrame, variables: Mapping[str, tuple[str, str]], payload: str = "payload",
                   keep: Sequence[str] = ("destination_id",)) -> DataFrame:
    """What ``hourly_rows`` leaves out or cannot use: the kept columns, position (null for a whole payload), reason and value.

    Reasons: "no payload", "not json" (the text does not parse), "no hours" (it has no list of times), "no key" (a kept column is
    null, so that the row could not be merged later), "no time" (an hour whose time is missing) and "bad time" (one that is no
    time). Rows with the first three give no hours.
    """
    arrays = ", ".join(f"`{name}`: array<double>" for name in variables)
    schema = f"struct<hourly: struct<time: array<string>, {arrays}>, _broken: string>"
    parsed = F.from_json(payload, schema, {"columnNameOfCorruptRecord": "_broken"})
    rows = payloads.select(*keep, F.col(payload).alias("_text"), parsed.alias("_parsed"))
    times = F.col("_parsed.hourly.time")
    null_key = F.lit(False)
    for name in keep:
        null_key = null_key | F.col(name).isNull()
    whole = (F.when(F.col("_text").isNull(), "no payload").when(F.col("_parsed").isNull() | F.col("_parsed._broken").isNotNull(), "not json")
             .when(times.isNull(), "no hours").when(null_key, "no key"))
    lost = rows.select(*keep, F.lit(None).cast("int").alias("position"), whole.alias("reason"), F.col("_text").alias("value"))
    # The longest array says how many hours the payload means to have.
    length = F.greatest(F.lit(0), *[F.coalesce(F.size(F.col("_parsed.hourly")[name]), F.lit(0)) for name in ("time", *variables)])
    hours = rows.where(whole.isNull()).select(*keep, times.alias("_times"), F.explode(F.when(length > 0, F.sequence(
        F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))).alias("position"))
    at = F.get("_times", F.col("position"))
    reason = F.when(at.isNull(), "no time").when(at.try_cast("timestamp_ntz").isNull(), "bad time")
    hours = hours.select(*keep, "position", reason.alias("reason"), at.alias("value"))
    return lost.unionByName(hours).where(F.col("reason").isNotNull())


def weather_hours(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ("destination_id",)) -> DataFrame:
    return hourly_rows(payloads, WEATHER_VARIABLES, payload, keep)


def air_hours(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ("destination_id",)) -> DataFrame:
    return hourly_rows(payloads, AIR_VARIABLES, payload, keep)


def to_instant(local: Column | str, zone: Column | str) -> Column:
    """The instant of a local wall time in a destination's time zone."""
    return F.to_utc_timestamp(col(local).cast("timestamp"), col(zone))


def geocode_candidates(payloads: DataFrame, count: int = 1, payload: str = "payload",
                       keep: Sequence[str] = ("name",)) -> DataFrame:
    """The first ``count`` places of a geocoding answer; none for an answer without results."""
    parsed = F.from_json(payload, PLACES_SCHEMA)["results"]
    return (payloads.select(*keep, F.posexplode(F.slice(parsed, 1, count)).alias("position", "_place"))
            .select(*keep, "position", F.col("_place.name").alias("place_name"), "_place.country",
                    F.col("_place.admin1").alias("admin_region"), "_place.latitude", "_place.longitude",
                    "_place.timezone"))


def nearby_pages(payloads: DataFrame, payload: str = "payload", latitude: str = "latitude",
                 longitude: str = "longitude", keep: Sequence[str] = ("destination_id",)) -> DataFrame:
    """Pages around a point. A page without coordinates takes those of the point and one without an index comes
    last; ``position`` orders the pages of a payload."""
    pages = F.from_json(payload, PAGES_SCHEMA)["query"]["pages"]
    own = F.get(F.col("_page.coordinates"), F.lit(0))
    rows = (payloads.select(*keep, F.col(latitude).alias("_lat"), F.col(longitude).alias("_lon"),
                            F.explode(F.map_values(pages)).alias("_page"))
            .select(*keep, "_lat", "_lon", "_page.*", F.coalesce(own["lat"], F.col("_lat")).alias("latitude"),
                    F.coalesce(own["lon"], F.col("_lon")).alias("longitude")))
    return rows.select(*keep, "pageid", "title", F.coalesce("index", F.lit(9999)).alias("position"), "latitude",
                       "longitude", haversine_m(F.col("_lat"), F.col("_lon"), F.col("latitude"), F.col("longitude"))
                       .alias("distance_m"), "description", "extract")


def radius_hits(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ("destination_id",)) -> DataFrame:
    """The hits of a radius search answer with the distances it states."""
    hits = F.from_json(payload, HITS_SCHEMA)["query"]["geosearch"]
    return (payloads.select(*keep, F.posexplode(hits).alias("position", "_hit"))
            .select(*keep, "position", "_hit.pageid", "_hit.title", F.col("_hit.lat").alias("latitude"),
                    F.col("_hit.lon").alias("longitude"), F.col("_hit.dist").alias("distance_m")))


def page_summary(payload: Column | str) -> Column:
    """The parts of a page summary as a struct; absent parts are null."""
    page = F.from_json(payload, SUMMARY_SCHEMA)
    return F.struct(page["title"].alias("title"), page["description"].alias("description"),
                    page["extract"].alias("extract"), page["content_urls"]["desktop"]["page"].alias("url"),
                    page["coordinates"]["lat"].alias("latitude"), page["coordinates"]["lon"].alias("longitude"))
