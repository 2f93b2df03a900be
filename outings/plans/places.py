"""New destinations and activities from service answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.functions.scalars import classify_place
from outings.operators.keyed import assign_ids, highest, top_per_group
from outings.operators.mutation import Mutation, insert_absent
from outings.sources.payloads import geocode_candidates, nearby_pages, page_summary


def attraction_rows(payloads: DataFrame, limit: int = 8) -> DataFrame:
    """Classified pages near every destination, the first ``limit`` of each payload.

    ``payloads``: destination_id, latitude, longitude, payload.
    """
    pages = top_per_group(nearby_pages(payloads), ["destination_id"],
                          [F.col("position"), F.col("pageid").asc_nulls_last(), F.col("title")], limit)
    category, is_outdoor = classify_place("title", "extract")
    return pages.select("destination_id", "title", "description", "extract", "latitude", "longitude",
                        category.alias("category"), is_outdoor.alias("is_outdoor"), "position")


@dataclass(frozen=True)
class AttractionIngest:
    bronze: DataFrame
    activities: Mutation


def add_attractions(activities: DataFrame, rows: DataFrame) -> Mutation:
    """Insert the attractions whose (destination, name) is new. The extract serves as description and as
    requirements, being outdoors also as being sensitive to weather."""
    new = rows.select("destination_id", F.col("title").alias("name"), "category",
                      F.col("extract").alias("description"), F.col("extract").alias("requirements"),
                      F.col("is_outdoor").cast("boolean").alias("is_outdoor"),
                      F.col("is_outdoor").cast("boolean").alias("weather_sensitive"), "latitude", "longitude",
                      F.lit("wikimedia").alias("source"), "position")
    first = [F.col("position"), F.col("latitude").asc_nulls_last(), F.col("description").asc_nulls_last()]
    return insert_absent(activities, new, ["destination_id", "name"], first=first)


def ingest_attractions(payloads: DataFrame, activities: DataFrame, limit: int = 8,
                       now: Column | None = None) -> AttractionIngest:
    rows = attraction_rows(payloads, limit)
    bronze = rows.drop("position").withColumn("_ingested_at", F.current_timestamp() if now is None else now)
    return AttractionIngest(bronze, add_attractions(activities, rows))


@dataclass(frozen=True)
class Bootstrap:
    report: DataFrame
    destinations: Mutation


def bootstrap_destinations(catalog: DataFrame, destinations: DataFrame, answers: DataFrame,
                           source: str = "phase8-bootstrap") -> Bootstrap:
    """Add the catalog destinations that are not there yet.

    ``catalog``: name, country. ``answers``: name, geocode and summary payloads, and an error text or null.
    The report has one row per catalog name: "inserted", "skipped" (already there) or "failed", with a reason.
    """
    place = geocode_candidates(answers, 1, payload="geocode")
    place = place.select("name", F.col("country").alias("_country"), "admin_region", "latitude", "longitude",
                         "timezone", F.lit(True).alias("_found"))
    page = answers.select("name", "error", page_summary("summary").alias("_page"))
    known = destinations.select("name", F.lit(True).alias("_known")).distinct()
    names = catalog.groupBy("name").agg(F.min("country").alias("country"))
    rows = names.join(known, "name", "left").join(page, "name", "left").join(place, "name", "left")
    status = (F.when(F.col("_known"), "skipped").when(F.col("error").isNotNull(), "failed")
              .when(F.col("_found").isNull(), "failed").otherwise("inserted"))
    reason = (F.when(F.col("_known"), None).when(F.col("error").isNotNull(), F.col("error"))
              .when(F.col("_found").isNull(), "no geocode match"))
    judged = rows.select("name", F.coalesce(F.nullif("_country", F.lit("")), "country").alias("country"),
                         "admin_region", "latitude", "longitude", "timezone",
                         F.coalesce(F.nullif(F.col("_page.extract"), F.lit("")),
                                    F.nullif(F.col("_page.description"), F.lit(""))).alias("description"),
                         F.col("_page.url").alias("wikipedia_url"), F.lit(source).alias("source"),
                         status.alias("status"), reason.alias("reason"))
    inserts = judged.where(F.col("status") == "inserted")
    numbered = assign_ids(inserts, "destination_id", ["name"], highest(destinations, "destination_id"))
    added = numbered.drop("status", "reason")
    return Bootstrap(judged.select("name", "status", "reason"), insert_absent(destinations, added, ["name"]))


def bootstrap_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("names"))
