"""Packing lists from weather and activities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.operators.keyed import assign_ids, highest
from outings.operators.mutation import Mutation, upsert
from outings.plans.weather import trip_weather
from outings.settings import DEFAULTS, Settings

# Item, category, reason and, where there is one, the condition on the trip.
EVERY_TRIP = (
    ("Reusable water bottle", "gear", "Staying hydrated on active days."),
    ("Phone + charger", "gear", "Everyday essential."),
    ("ID / travel documents", "documents", "Required for travel and entry."),
    ("Sunscreen SPF50", "health", "UV protection outdoors."),
)
ON_CONDITION = (
    ("rain", "Rain jacket", "clothing", "Rain forecast on at least one day."),
    ("bad_air", "N95 mask", "health", "Air quality forecast to be poor."),
    ("cold", "Warm fleece layer", "clothing", "Cold temperatures forecast."),
    ("hot", "Sun hat", "clothing", "Hot afternoons forecast."),
    ("outdoor", "Hiking shoes", "gear", "Outdoor trails on the itinerary."),
    ("swim", "Swimwear", "clothing", "Water/wellness activity planned."),
)
SWIM_CATEGORIES = ("wellness", "water")


def trip_conditions(trips: DataFrame, days: DataFrame, items: DataFrame, activities: DataFrame,
                    settings: Settings = DEFAULTS, swim_categories=SWIM_CATEGORIES) -> DataFrame:
    """What the weather and the activities of a trip call for, one row per trip.

    Only a missing value counts as missing: 0.0 degrees is cold.
    """
    def on_some(condition: Column) -> Column:
        return F.coalesce(F.bool_or(condition), F.lit(False))

    weather = days.groupBy("trip_id").agg(
        on_some(F.col("max_precip_prob") >= settings.rain_prob_threshold).alias("rain"),
        on_some(F.col("max_aqi") >= settings.aqi_threshold).alias("bad_air"),
        on_some(F.col("min_temp_c") <= settings.cold_at_most_c).alias("cold"),
        on_some(F.col("max_temp_c") >= settings.hot_at_least_c).alias("hot"))
    traits = activities.select("activity_id", "is_outdoor", F.col("category").isin(*swim_categories).alias("_swim"))
    plans = (items.select("trip_id", "activity_id").join(traits, "activity_id").groupBy("trip_id")
             .agg(on_some(F.col("is_outdoor")).alias("outdoor"), on_some(F.col("_swim")).alias("swim")))
    flags = [flag for flag, *_ in ON_CONDITION]
    return (trips.select("trip_id").join(weather, "trip_id", "left").join(plans, "trip_id", "left")
            .select("trip_id", *[F.coalesce(flag, F.lit(False)).alias(flag) for flag in flags]))


def packing_suggestions(trips: DataFrame, weather: DataFrame, items: DataFrame, activities: DataFrame,
                        settings: Settings = DEFAULTS, swim_categories=SWIM_CATEGORIES) -> DataFrame:
    """The items to pack for every trip: trip_id, item_name, category, quantity, reason."""
    days = trip_weather(trips, weather, settings)
    conditions = trip_conditions(trips, days, items, activities, settings, swim_categories)

    def entry(applies: Column, name: str, category: str, reason: str) -> Column:
        return F.struct(applies.alias("applies"), F.lit(name).alias("item_name"), F.lit(category).alias("category"),
                        F.lit(1).alias("quantity"), F.lit(reason).alias("reason"))

    entries = [entry(F.lit(True), *item) for item in EVERY_TRIP]
    entries += [entry(F.col(flag), *item) for flag, *item in ON_CONDITION]
    return conditions.select("trip_id", F.inline(F.array(*entries))).where("applies").drop("applies")


def pack(packing: DataFrame, suggestions: DataFrame) -> Mutation:
    """Add items to the packing lists. For a known item quantity and reason change, category and tick do not."""
    inserts = {"is_checked": F.lit(False)} if "is_checked" in packing.columns else {}
    return upsert(packing, suggestions, ["trip_id", "item_name"],
                  [c for c in ("quantity", "reason") if c in packing.columns], insert_values=inserts)


def with_packing_ids(packing: DataFrame, added: Mutation) -> DataFrame:
    """The new snapshot with ids for the inserted rows."""
    inserted = added.changed.where(F.col("_change") == "inserted").drop("_change")
    known = added.frame.where(F.col("_change").isNull() | (F.col("_change") == "updated")).drop("_change")
    numbered = assign_ids(inserted, "packing_id", ["trip_id", "item_name"], highest(packing, "packing_id"))
    return known.unionByName(numbered)


def list_packing(packing: DataFrame) -> DataFrame:
    return packing.orderBy("trip_id", F.col("category").asc_nulls_last(), "item_name")
