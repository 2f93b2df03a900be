"""The whole load: weather and attractions into bronze, silver and serving tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from outings.plans.places import ingest_attractions
from outings.plans.quality import default_checks, gate, quality_report
from outings.plans.weather import join_hours, silver_weather, upsert_weather
from outings.settings import DEFAULTS, Settings
from outings.sources.payloads import air_hours, weather_hours
from outings.sources.tables import materialized, save


def _counted(df: DataFrame, purpose: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The frame written once, and counts of its rows that the write itself observes; no job counts them again."""
    seen = Observation(purpose)
    counts = {"rows": F.count(F.lit(1)), **counts}
    written = materialized(df.observe(seen, *[value.alias(name) for name, value in counts.items()]), purpose)
    return written, seen.get


def run_load(payloads: DataFrame, page_payloads: DataFrame, tables: Mapping[str, DataFrame],
             settings: Settings = DEFAULTS, how: str = "full", check: bool = False, on_error: str = "warn") -> dict:
    """Parse the payloads, save bronze and silver, and give the new serving tables with row counts.

    ``payloads``: destination_id, weather, air. ``page_payloads``: destination_id, latitude, longitude, payload.
    Each stage is computed once, into the shared folder. With ``check`` a failed quality check raises, with
    ``on_error="raise"`` a table that cannot be written.
    """
    hours = join_hours(weather_hours(payloads, "weather"), air_hours(payloads, "air"), how)
    bronze, fetched = _counted(hours.withColumn("_ingested_at", F.current_timestamp()), "weather-bronze")
    bronze_table = save(bronze, "weather_bronze", "append", settings=settings, partition_by="forecast_date", on_error=on_error)
    silver, silver_rows = _counted(silver_weather(bronze).drop("_ingested_at"), "weather-silver")
    silver_table = save(silver, "weather_silver", "overwrite", settings=settings, partition_by="forecast_date", on_error=on_error)
    touched = {"upserted": F.count_if(F.col("_change").isNotNull()), "inserted": F.count_if(F.col("_change") == "inserted")}
    weather, served = _counted(upsert_weather(tables["weather_snapshots"], silver).frame, "weather-serving", **touched)

    places = ingest_attractions(page_payloads, tables["activities"])
    pages, found = _counted(places.bronze, "attractions-bronze")
    pages_table = save(pages, "attractions_bronze", "append", settings=settings, on_error=on_error)
    activities, added = _counted(places.activities.frame, "activities", **touched)

    new_tables = {**tables, "weather_snapshots": weather.drop("_change"), "activities": activities.drop("_change")}
    result = {
        "weather": {"fetched": fetched["rows"], "silver_rows": silver_rows["rows"], "upserted": served["upserted"],
                    "inserted": served["inserted"], "serving_rows": served["rows"], "bronze_table": bronze_table, "silver_table": silver_table},
        "attractions": {"fetched": found["rows"], "inserted": added["inserted"], "bronze_table": pages_table},
        "tables": new_tables,
    }
    if check:
        result["quality"] = gate(quality_report(new_tables, default_checks(settings)))
    return result
