"""Table schemas, keys and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

DDL = {
    "users": """
        user_id BIGINT, email STRING, display_name STRING, home_city STRING, interests ARRAY<STRING>,
        pace STRING, notes STRING, notes_embedding ARRAY<FLOAT>, created_at TIMESTAMP""",
    "destinations": """
        destination_id BIGINT, name STRING, country STRING, admin_region STRING, latitude DOUBLE,
        longitude DOUBLE, timezone STRING, description STRING, description_embedding ARRAY<FLOAT>,
        wikipedia_url STRING, source STRING, created_at TIMESTAMP""",
    "trips": """
        trip_id BIGINT, user_id BIGINT, destination_id BIGINT, title STRING, start_date DATE,
        end_date DATE, status STRING, created_at TIMESTAMP""",
    "activities": """
        activity_id BIGINT, destination_id BIGINT, name STRING, category STRING, description STRING,
        requirements STRING, requirements_embedding ARRAY<FLOAT>, is_outdoor BOOLEAN,
        weather_sensitive BOOLEAN, typical_duration_min INT, latitude DOUBLE, longitude DOUBLE,
        tags ARRAY<STRING>, source STRING, created_at TIMESTAMP""",
    "itinerary_items": """
        item_id BIGINT, trip_id BIGINT, activity_id BIGINT, day_date DATE, start_time STRING,
        end_time STRING, title STRING, notes STRING, status STRING, reschedule_reason STRING,
        sort_order INT, created_at TIMESTAMP, updated_at TIMESTAMP""",
    "weather_snapshots": """
        snapshot_id BIGINT, destination_id BIGINT, captured_at TIMESTAMP, forecast_ts TIMESTAMP_NTZ,
        forecast_date DATE, temperature_c DOUBLE, precipitation_mm DOUBLE, precipitation_prob INT,
        wind_kph DOUBLE, us_aqi INT, pm2_5 DOUBLE, pm10 DOUBLE, uv_index DOUBLE, source STRING, raw STRING""",
    "packing_items": """
        packing_id BIGINT, trip_id BIGINT, item_name STRING, category STRING, quantity INT,
        reason STRING, is_checked BOOLEAN, created_at TIMESTAMP""",
    "weather_bronze": """
        destination_id BIGINT, forecast_ts TIMESTAMP_NTZ, forecast_date DATE, temperature_c DOUBLE,
        precipitation_mm DOUBLE, precipitation_prob INT, wind_kph DOUBLE, us_aqi INT, pm2_5 DOUBLE,
        pm10 DOUBLE, uv_index DOUBLE, _ingested_at TIMESTAMP""",
    "attractions_bronze": """
        destination_id BIGINT, title STRING, description STRING, extract STRING, latitude DOUBLE,
        longitude DOUBLE, category STRING, is_outdoor BIGINT, _ingested_at TIMESTAMP""",
}
DDL["weather_silver"] = DDL["weather_bronze"].rsplit(",", 1)[0]

NATURAL_KEYS = {
    "users": ["email"],
    "destinations": ["name", "latitude", "longitude"],
    "activities": ["destination_id", "name"],
    "weather_snapshots": ["destination_id", "forecast_ts"],
    "packing_items": ["trip_id", "item_name"],
}

# Values an insert takes for columns it does not name.
COLUMN_DEFAULTS = {
    "users": {"interests": "array()", "pace": "'moderate'"},
    "destinations": {"source": "'open-meteo+wikimedia'"},
    "trips": {"status": "'planning'"},
    "activities": {"is_outdoor": "false", "weather_sensitive": "false", "tags": "array()", "source": "'wikimedia'"},
    "itinerary_items": {"status": "'planned'", "sort_order": "0"},
    "weather_snapshots": {"source": "'open-meteo'"},
    "packing_items": {"quantity": "1", "is_checked": "false"},
}


@dataclass(frozen=True)
class Reference:
    """A foreign key and what happens to the child rows when the parent row goes."""

    child: str
    column: str
    parent: str
    key: str
    on_delete: str


REFERENCES = [
    Reference("trips", "user_id", "users", "user_id", "cascade"),
    Reference("trips", "destination_id", "destinations", "destination_id", "restrict"),
    Reference("activities", "destination_id", "destinations", "destination_id", "cascade"),
    Reference("weather_snapshots", "destination_id", "destinations", "destination_id", "cascade"),
    Reference("itinerary_items", "trip_id", "trips", "trip_id", "cascade"),
    Reference("packing_items", "trip_id", "trips", "trip_id", "cascade"),
    Reference("itinerary_items", "activity_id", "activities", "activity_id", "set null"),
]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], DDL[table])


def create_tables(spark: SparkSession, schema: str, names=tuple(DDL)) -> None:
    """Create the tables that do not exist yet; the hourly tables are partitioned by day."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    for name in names:
        day = " PARTITIONED BY (forecast_date)" if "forecast_date" in DDL[name] else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{name} ({DDL[name]}) USING parquet{day}")
