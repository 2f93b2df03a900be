"""Itineraries: generation, rescheduling for weather, and views."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.functions.scalars import col
from outings.functions.vectors import Embedder
from outings.operators.mutation import Mutation, insert_rows, partial_update
from outings.plans.search import rank_activities
from outings.plans.weather import trip_weather
from outings.settings import DEFAULTS, Settings
from outings.sources.tables import materialized

# Start and end of the slots of a day.
SLOTS = (("09:00", "11:00"), ("12:30", "14:30"), ("15:30", "17:00"), ("18:00", "19:30"))


def slot(position: Column, which: int) -> Column:
    """Start (0) or end (1) of the slot at a position from 0; null beyond the last slot."""
    return F.get(F.array(*[F.lit(times[which]) for times in SLOTS]), position)


def interest_text(interests: Column | str) -> Column:
    return F.coalesce(F.nullif(F.array_join(col(interests), " "), F.lit("")), F.lit("sightseeing"))


def query_text(interests: Column, indoor_only: Column) -> Column:
    scope = F.when(indoor_only, " indoor activities").otherwise(" outdoor and indoor activities")
    return F.concat(interests, scope)


def generate_itinerary(trips: DataFrame, users: DataFrame, activities: DataFrame, weather: DataFrame,
                       embedder: Embedder, settings: Settings = DEFAULTS,
                       existing: DataFrame | None = None) -> DataFrame:
    """The items of a day-by-day plan for every trip: each day the best activities not used before in the trip.

    A bad day takes only indoor activities, by their own ranking. Rankings are made once per destination and
    interest text, as long as the longest trip that uses them can need: n activities on each of d days never look
    beyond the first n*d. A fold over the days of a trip then picks without replacement; trips are independent.

    The plan replaces the items of the trips. With ``existing`` it is added to those items instead: positions
    continue after theirs, though their activities do not count as used.
    """
    n = settings.activities_per_day
    wishes = (trips.where(F.col("end_date") >= F.col("start_date"))
              .join(users.select("user_id", interest_text("interests").alias("interests")), "user_id", "left")
              .select("trip_id", "destination_id", "start_date", "end_date",
                      F.coalesce("interests", F.lit("sightseeing")).alias("interests")))
    days = F.datediff("end_date", "start_date") + 1
    wanted = (wishes.groupBy("destination_id", "interests").agg((F.max(days) * n).alias("k"))
              .withColumn("indoor_only", F.explode(F.array(F.lit(False), F.lit(True))))
              .withColumn("query", query_text(F.col("interests"), F.col("indoor_only"))))
    ranked = rank_activities(wanted, activities, None, embedder, query_id="interests")

    def ranking(kind: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(kind, F.struct("rank", "activity_id"))))["activity_id"]

    by_kind = (ranked.groupBy("destination_id", "interests")
               .agg(ranking(F.col("indoor_only")).alias("indoor"), ranking(~F.col("indoor_only")).alias("any")))
    bad_days = (trip_weather(trips, weather, settings).where("is_bad")
                .groupBy("trip_id").agg(F.collect_set("forecast_date").alias("bad_days")))

    no_ids = F.array().cast("array<bigint>")
    plan_type = "array<struct<day_date:date,indoor:boolean,picks:array<bigint>>>"
    day_list = F.transform(F.sequence("start_date", "end_date"), lambda day: F.struct(
        day.alias("day"), F.array_contains(F.col("bad_days"), day).alias("bad")))

    def plan_day(state: Column, day: Column) -> Column:
        ranking = F.when(day["bad"], F.col("indoor")).otherwise(F.col("any"))
        picks = F.slice(F.array_except(ranking, state["used"]), 1, n)
        entry = F.struct(day["day"].alias("day_date"), day["bad"].alias("indoor"), picks.alias("picks"))
        return F.struct(F.concat(state["used"], picks).alias("used"),
                        F.concat(state["plan"], F.array(entry)).alias("plan"))

    start = F.struct(no_ids.alias("used"), F.array().cast(plan_type).alias("plan"))
    planned = (wishes.join(by_kind, ["destination_id", "interests"])
               .join(bad_days, "trip_id", "left")
               .withColumn("bad_days", F.coalesce("bad_days", F.array().cast("array<date>")))
               .withColumn("days", day_list)
               .select("trip_id", F.inline(F.aggregate("days", start, plan_day, lambda state: state["plan"])))
               .select("trip_id", "day_date", F.col("indoor").alias("indoor_only"),
                       F.posexplode("picks").alias("position", "activity_id")))
    named = planned.join(activities.select("activity_id", F.col("name").alias("title"), "is_outdoor"), "activity_id")
    if existing is None:
        named = named.withColumn("_end", F.lit(0))
    else:
        ends = existing.groupBy("trip_id", "day_date").agg(F.max("sort_order").alias("_end"))
        named = named.join(ends, ["trip_id", "day_date"], "left")
    return named.select(
        "trip_id", "day_date", "activity_id", "title", slot(F.col("position"), 0).alias("start_time"),
        slot(F.col("position"), 1).alias("end_time"),
        F.when(F.col("indoor_only"), "Indoor pick due to weather").alias("notes"),
        F.lit("planned").alias("status"),
        (F.coalesce("_end", F.lit(0)) + F.col("position") + 1).cast("int").alias("sort_order"),
        (~F.col("is_outdoor")).alias("indoor"))


def apply_plan(items: DataFrame, plan: DataFrame, replaced: DataFrame | None = None,
               now: Column | None = None) -> Mutation:
    """The itinerary table with a generated plan; the items of the ``replaced`` trips go, planned anew or not."""
    now = F.current_timestamp() if now is None else now
    kept = items if replaced is None else items.join(replaced.select("trip_id"), "trip_id", "left_anti")
    kept = kept.select(*items.columns)
    return insert_rows(kept, plan, "item_id", ["trip_id", "day_date", "sort_order"],
                       {"created_at": now, "updated_at": now})


@dataclass(frozen=True)
class Reschedule:
    changes: DataFrame
    items: Mutation


def reschedule_for_weather(trips: DataFrame, items: DataFrame, activities: DataFrame, weather: DataFrame,
                           embedder: Embedder, settings: Settings = DEFAULTS,
                           now: Column | None = None) -> Reschedule:
    """Take outdoor items off bad days: to the first good day of the trip; if it has none, swap in the best indoor
    activity; if there is none either, flag the item. All trips change together or not at all.

    Items of any status are considered, and a moved item keeps its position in the day. The changes are computed
    once, into the shared folder; the new items follow from them.
    """
    is_bad = F.col("is_bad")
    forecast = (trip_weather(trips, weather, settings).groupBy("trip_id", "destination_id")
                .agg(F.min(F.when(~is_bad, F.col("forecast_date"))).alias("to_day"),
                     F.map_from_entries(F.collect_list(F.when(is_bad, F.struct("forecast_date", "bad_reason"))))
                     .alias("bad_days")).where(F.size("bad_days") > 0))
    outdoor = activities.where("is_outdoor").select("activity_id")
    affected = (items.select("item_id", "trip_id", "day_date", "activity_id", "title")
                .join(forecast, "trip_id")
                .withColumn("bad_reason", F.try_element_at("bad_days", "day_date")).drop("bad_days")
                .where(F.col("bad_reason").isNotNull())
                .join(outdoor, "activity_id", "left_semi").drop("activity_id")
                .withColumn("query", F.when(F.col("to_day").isNull(),
                                            F.concat(F.lit("indoor alternative to "), F.col("title")))))
    affected = materialized(affected, "affected-items")
    wanted = (affected.where(F.col("query").isNotNull())
              .select("destination_id", "query", F.lit(True).alias("indoor_only")).distinct())
    names = activities.select("activity_id", F.col("name").alias("to_title"))
    best = (rank_activities(wanted, activities, 1, embedder).join(names, "activity_id")
            .select("destination_id", "query", F.col("activity_id").alias("to_activity_id"), "to_title"))
    decided = affected.join(best, ["destination_id", "query"], "left")

    moved, swapped = F.col("to_day").isNotNull(), F.col("to_activity_id").isNotNull()
    why = F.col("bad_reason")
    reason = (F.when(moved, F.format_string("Moved from %s to %s: %s.", F.col("day_date").cast("string"),
                                            F.col("to_day").cast("string"), why))
              .when(swapped, F.format_string("Swapped outdoor '%s' for indoor '%s': %s.", F.col("title"),
                                             F.col("to_title"), why))
              .otherwise(F.format_string("Flagged: %s. No indoor alternative found.", why)))
    changes = decided.select(
        "item_id", "trip_id", "title", F.when(moved, "moved").when(swapped, "swapped").otherwise("flagged")
        .alias("action"), F.col("day_date").alias("from_day"), "to_day", "to_activity_id", "to_title",
        F.col("bad_reason").alias("cause"), reason.alias("reason"))
    changes = materialized(changes, "reschedule-changes")
    values = {"day_date": F.coalesce("_new_to_day", "day_date"),
              "activity_id": F.coalesce("_new_to_activity_id", "activity_id"),
              "title": F.coalesce("_new_to_title", "title"), "status": F.lit("rescheduled"),
              "reschedule_reason": F.col("_new_reason"),
              "updated_at": F.current_timestamp() if now is None else now}
    applied = partial_update(items, changes, "item_id", {c: v for c, v in values.items() if c in items.columns})
    return Reschedule(changes, applied)


def list_itinerary(items: DataFrame, activities: DataFrame) -> DataFrame:
    """Items with the traits of their activity, in the order of the trip."""
    traits = activities.select("activity_id", F.col("is_outdoor").alias("_outdoor"), "category")
    shown = ["item_id", "trip_id", "day_date", "start_time", "end_time", "title", "status", "reschedule_reason",
             "activity_id"]
    return (items.join(traits, "activity_id", "left")
            .orderBy("trip_id", F.col("day_date").asc_nulls_last(), F.col("sort_order").asc_nulls_last(), "item_id")
            .select(*[c for c in shown if c in items.columns],
                    F.coalesce("_outdoor", F.lit(False)).alias("is_outdoor"), "category", "sort_order"))
