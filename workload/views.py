"""Listings, nested records, checks and counts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from outings.functions.geo import haversine_m
from outings.functions.scalars import (aqi_label, classify_place, hour_minute, month_day, page_slug, round_half_even,
                                       round_half_up)
from outings.operators.mutation import move_items
from outings.operators.places import places_within_radius
from outings.plans.itinerary import list_itinerary
from outings.plans.packing import list_packing
from outings.plans.quality import (count_orphans, default_checks, orphans, quality_report, reference_report,
                                   report_summary)
from outings.plans.scoring import (Recording, combine, count_change, evaluate_runs, every_change_has_reason, no_outdoor_on_bad_day,
                                   score, tool_fired)
from outings.plans.views import (as_json, country_histogram, distinct_counts, itinerary_by_day, items_per_day,
                                 list_destinations, row_counts, scale_summary, trip_bundle, trip_header)
from outings.plans.weather import trip_weather
from outings.settings import Settings
from outings.sources.catalog import DESTINATIONS, destination_catalog
from outings.sources.tables import footer_summary
from workload.changes import MOVES, MOVED
from workload.registry import query
from workload.weather import TRIP_DAY_VIEWS

HEADER = """
SELECT t.trip_id, t.title, CAST(t.start_date AS VARCHAR) AS start_date, CAST(t.end_date AS VARCHAR) AS end_date, t.status,
       d.destination_id, d.name AS destination, d.country, d.latitude, d.longitude
FROM {v_trips} t JOIN {v_destinations} d ON d.destination_id = t.destination_id"""


@query("trip_listing", HEADER)
def _trip_listing(t):
    return trip_header(t("v_trips"), t("v_destinations"))


@query("destination_listing", """
SELECT destination_id, name, country, latitude, longitude, left(coalesce(description, ''), 240) AS blurb
FROM {v_destinations}""")
def _destination_listing(t):
    return list_destinations(t("v_destinations"))


@query("itinerary_listing", """
SELECT i.item_id, i.trip_id, CAST(i.day_date AS VARCHAR) AS day_date, i.title, i.status, i.activity_id,
       coalesce(a.is_outdoor, FALSE) AS is_outdoor, a.category, i.sort_order
FROM {v_items} i LEFT JOIN {v_activities} a ON a.activity_id = i.activity_id""")
def _itinerary_listing(t):
    return list_itinerary(t("v_items"), t("v_activities"))


@query("packing_listing", "SELECT trip_id, item_name, category, quantity FROM {v_packing}")
def _packing_listing(t):
    return list_packing(t("v_packing"))


@query("trip_bundle", """
SELECT h.trip_id, h.title, h.destination, s.section, CAST(s.day AS VARCHAR) AS day, coalesce(s.n, 0) AS n_entries,
       coalesce(s.entries, '') AS entries
FROM {header} h LEFT JOIN (
  SELECT trip_id, 'weather' AS section, forecast_date AS day, count(*) AS n, string_agg(CAST(is_bad AS VARCHAR), '|') AS entries
  FROM {trip_days} GROUP BY trip_id, forecast_date
  UNION ALL SELECT trip_id, 'itinerary', day_date, count(*), string_agg(title, '|' ORDER BY sort_order, item_id)
  FROM {v_items} GROUP BY trip_id, day_date
  UNION ALL SELECT trip_id, 'packing', NULL, count(*), string_agg(item_name, '|' ORDER BY category, item_name)
  FROM {v_packing} GROUP BY trip_id) s ON s.trip_id = h.trip_id""", {**TRIP_DAY_VIEWS, "header": HEADER})
def _trip_bundle(t):
    bundle = trip_bundle(trip_header(t("v_trips"), t("v_destinations")), trip_weather(t("v_trips"), t("v_weather")),
                         t("v_items"), t("v_packing"))
    fields = {"weather": "is_bad", "itinerary": "title", "packing": "item_name"}
    entries = F.concat(*[F.coalesce(F.array_join(F.col(s)[f].cast("array<string>"), "|"), F.lit("")) for s, f in fields.items()])
    sizes = [F.coalesce(F.array_size(s), F.lit(0)) for s in fields]
    return bundle.select("trip_id", "title", "destination", "section", "day",
                         (sizes[0] + sizes[1] + sizes[2]).cast("long").alias("n_entries"), entries.alias("entries"))


@query("itinerary_by_day", """
SELECT trip_id, CAST(day_date AS VARCHAR) AS day_date, string_agg(title, '|' ORDER BY sort_order, item_id) AS titles
FROM {v_items} GROUP BY trip_id, day_date""")
def _itinerary_by_day(t):
    return itinerary_by_day(t("v_items")).select("trip_id", "day_date", F.array_join("items.title", "|").alias("titles"))


@query("trip_json", """
SELECT concat('{"trip_id":', trip_id, ',"title":"', title, '","start_date":"', start_date, '","quantity":',
              CAST(CAST(n AS DOUBLE) AS VARCHAR), '}') AS json
FROM (SELECT t.trip_id, t.title, t.start_date, count(p.trip_id) AS n FROM {v_trips} t
      LEFT JOIN {v_packing} p ON p.trip_id = t.trip_id GROUP BY ALL) x""")
def _trip_json(t):
    counts = t("v_packing").groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    rows = t("v_trips").join(counts, "trip_id", "left").select(
        "trip_id", "title", "start_date", F.coalesce("n", F.lit(0)).cast("decimal(10,0)").alias("quantity"))
    return as_json(rows)


@query("trip_nested_json", """
SELECT concat('{"trip_id":', trip_id, ',"items":', CASE WHEN n = 0 THEN 'null' ELSE concat('[', list, ']') END, '}') AS json
FROM (SELECT t.trip_id, count(i.item_id) AS n,
             string_agg(concat('{"item_id":', i.item_id, ',"day_date":"', i.day_date, '","cost":', CAST(CAST(i.sort_order AS DOUBLE) AS VARCHAR),
                               ',"by_day":{"', i.day_date, '":', CAST(CAST(i.sort_order AS DOUBLE) AS VARCHAR), '}}'), ',' ORDER BY i.item_id) AS list
      FROM {v_trips} t LEFT JOIN {v_items} i ON i.trip_id = t.trip_id GROUP BY t.trip_id) x""")
def _trip_nested_json(t):
    """Dates and decimals inside lists, structs and maps."""
    cost = F.col("sort_order").cast("decimal(12,2)")
    entry = F.struct("item_id", "day_date", cost.alias("cost"), F.create_map("day_date", cost).alias("by_day"))
    items = t("v_items").groupBy("trip_id").agg(F.collect_list(entry).alias("items"))
    ordered = F.array_sort("items", lambda a, b: (a["item_id"] - b["item_id"]).cast("int"))
    return as_json(t("v_trips").join(items, "trip_id", "left").select("trip_id", ordered.alias("items")))


STANDINS = {"users": "v_users", "destinations": "v_destinations", "trips": "v_trips", "activities": "v_activities",
            "itinerary_items": "v_items", "weather_snapshots": "v_weather", "packing_items": "v_packing"}
# Least number of rows per table.
MINIMUMS = {"users": 2, "destinations": 3, "trips": 3, "activities": 12, "itinerary_items": 9,
            "weather_snapshots": 6, "packing_items": 6}


def _tables(t):
    return {name: t(view) for name, view in STANDINS.items()}


@query("quality_report", """
SELECT 'weather.forecast_ts not null' AS name, count(*) = 0 AS passed, concat(count(*), ' null forecast_ts') AS detail,
       'error' AS severity FROM {v_bronze} WHERE forecast_ts IS NULL
UNION ALL SELECT 'destinations have coordinates', count(*) = 0, concat(count(*), ' destinations missing lat/long'), 'error'
FROM {v_destinations} WHERE latitude IS NULL OR longitude IS NULL
UNION ALL SELECT 'us_aqi within 0-500', count(*) = 0, concat(count(*), ' rows with out-of-range AQI'), 'error'
FROM {v_bronze} WHERE us_aqi < 0 OR us_aqi > 500
UNION ALL SELECT 'precipitation_prob within 0-100', count(*) = 0, concat(count(*), ' rows with out-of-range precip prob'),
       'error' FROM {v_bronze} WHERE precipitation_prob < 0 OR precipitation_prob > 100
UNION ALL SELECT 'trips end_date >= start_date', count(*) = 0, concat(count(*), ' trips with end before start'), 'error'
FROM {v_trips} WHERE end_date < start_date
UNION ALL SELECT 'embeddings are 64-dim', count(*) = 0, concat(count(*), ' embeddings with wrong dimension'), 'error'
FROM {v_activities} WHERE len(requirements_embedding) <> 64
UNION ALL SELECT 'all activities embedded', count(*) = 0, concat(count(*), ' activities without an embedding'), 'warn'
FROM {v_activities} WHERE requirements_embedding IS NULL
UNION ALL SELECT 'no orphan foreign keys', sum(n) = 0, concat(CAST(sum(n) AS BIGINT), ' orphan rows'), 'error' FROM (
  SELECT count(*) AS n FROM {v_trips} c LEFT JOIN {v_destinations} p USING (destination_id) WHERE p.name IS NULL
  UNION ALL SELECT count(*) FROM {v_items} c LEFT JOIN {v_trips} p USING (trip_id) WHERE p.title IS NULL
  UNION ALL SELECT count(*) FROM {v_bronze} c LEFT JOIN {v_destinations} p USING (destination_id) WHERE p.name IS NULL
  UNION ALL SELECT count(*) FROM {v_packing} c LEFT JOIN {v_trips} p USING (trip_id) WHERE p.title IS NULL) x
UNION ALL SELECT 'every trip has a user', count(*) = 0, concat(count(*), ' trips without a user'), 'error'
FROM {v_trips} c LEFT JOIN {v_users} p USING (user_id) WHERE p.email IS NULL
UNION ALL SELECT 'weather_snapshots unique per (dest, hour)', count(*) = 0,
       concat(count(*), ' duplicate (destination_id, forecast_ts) keys'), 'error'
FROM (SELECT destination_id, forecast_ts FROM {v_bronze} GROUP BY 1, 2 HAVING count(*) > 1) d""")
def _quality_report(t):
    """All checks, on the raw weather rows so that repeated keys are found."""
    tables = _tables(t) | {"weather_snapshots": t("v_bronze")}
    tables["destinations"] = t("v_destinations").withColumn("description_embedding", F.lit(None).cast("array<float>"))
    return quality_report(tables, default_checks(Settings(embedding_dim=64)))


@query("quality_summary", """
SELECT bad = 0 AS passed, CAST(10 AS BIGINT) AS n_checks, CAST(CASE WHEN bad = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_failed_errors
FROM (SELECT count(*) AS bad FROM (SELECT destination_id, forecast_ts FROM {v_bronze}
                                   GROUP BY 1, 2 HAVING count(*) > 1) d) x""")
def _quality_summary(t):
    return report_summary(_quality_report(t))


BROKEN = {
    "b_weather": """
SELECT destination_id, CASE WHEN event_id % 50 = 1 THEN NULL ELSE forecast_ts END AS forecast_ts,
       CASE WHEN event_id % 40 = 2 THEN -1 WHEN event_id % 40 = 3 THEN 501 ELSE us_aqi END AS us_aqi,
       CASE WHEN event_id % 30 = 4 THEN 101 ELSE precipitation_prob END AS precipitation_prob FROM {v_bronze}""",
    "b_destinations": """
SELECT d.destination_id, name, CASE WHEN d.destination_id % 5 = 1 THEN NULL ELSE latitude END AS latitude, longitude,
       CASE WHEN d.destination_id % 4 = 0 THEN slice(e.embedding, 1, 3) ELSE e.embedding END AS description_embedding
FROM {v_destinations} d LEFT JOIN {embeddings} e ON e.vec_id = d.destination_id""",
    "b_activities": """
SELECT activity_id, destination_id, CASE WHEN activity_id % 6 = 2 THEN slice(requirements_embedding, 1, 5)
       ELSE requirements_embedding END AS requirements_embedding FROM {v_activities}""",
    "b_trips": """
SELECT trip_id, CASE WHEN trip_id % 9 = 4 THEN -user_id ELSE user_id END AS user_id,
       CASE WHEN trip_id % 8 = 5 THEN -1 - destination_id ELSE destination_id END AS destination_id, title,
       start_date, CASE WHEN trip_id % 7 = 6 THEN DATE '2023-01-01' ELSE end_date END AS end_date FROM {v_trips}""",
}


@query("quality_broken", """
SELECT name, bad = 0 AS passed, concat(bad, ' ', what) AS detail, severity FROM (
SELECT 'weather.forecast_ts not null' AS name, count(*) AS bad, 'null forecast_ts' AS what, 'error' AS severity
FROM {b_weather} WHERE forecast_ts IS NULL
UNION ALL SELECT 'destinations have coordinates', count(*), 'destinations missing lat/long', 'error'
FROM {b_destinations} WHERE latitude IS NULL OR longitude IS NULL
UNION ALL SELECT 'us_aqi within 0-500', count(*), 'rows with out-of-range AQI', 'error'
FROM {b_weather} WHERE us_aqi < 0 OR us_aqi > 500
UNION ALL SELECT 'precipitation_prob within 0-100', count(*), 'rows with out-of-range precip prob', 'error'
FROM {b_weather} WHERE precipitation_prob < 0 OR precipitation_prob > 100
UNION ALL SELECT 'trips end_date >= start_date', count(*), 'trips with end before start', 'error'
FROM {b_trips} WHERE end_date < start_date
UNION ALL SELECT 'embeddings are 64-dim', (SELECT count(*) FROM {b_destinations} WHERE len(description_embedding) <> 64)
       + (SELECT count(*) FROM {b_activities} WHERE len(requirements_embedding) <> 64), 'embeddings with wrong dimension', 'error'
UNION ALL SELECT 'all activities embedded', count(*), 'activities without an embedding', 'warn'
FROM {b_activities} WHERE requirements_embedding IS NULL
UNION ALL SELECT 'no orphan foreign keys', CAST(sum(n) AS BIGINT), 'orphan rows', 'error' FROM (
  SELECT count(*) AS n FROM {b_trips} c LEFT JOIN {b_destinations} p USING (destination_id) WHERE p.name IS NULL
  UNION ALL SELECT count(*) FROM {v_items} c LEFT JOIN {b_trips} p USING (trip_id) WHERE p.title IS NULL
  UNION ALL SELECT count(*) FROM {b_weather} c LEFT JOIN {b_destinations} p USING (destination_id) WHERE p.name IS NULL
  UNION ALL SELECT count(*) FROM {v_packing} c LEFT JOIN {b_trips} p USING (trip_id) WHERE p.title IS NULL) x
UNION ALL SELECT 'every trip has a user', count(*), 'trips without a user', 'error'
FROM {b_trips} c LEFT JOIN {v_users} p USING (user_id) WHERE p.email IS NULL
UNION ALL SELECT 'weather_snapshots unique per (dest, hour)', count(*), 'duplicate (destination_id, forecast_ts) keys', 'error'
FROM (SELECT destination_id, forecast_ts FROM {b_weather} GROUP BY 1, 2 HAVING count(*) > 1) d) z""",
       {k: v.replace("slice(e.embedding, 1, 3)", "e.embedding[1:3]").replace("slice(requirements_embedding, 1, 5)",
                                                                           "requirements_embedding[1:5]") for k, v in BROKEN.items()})
def _quality_broken(t):
    """Every check on tables in which it finds something, both vector tables included."""
    def broken(name):
        return t.run(BROKEN[name], **{used: t(used) for used in dict.fromkeys(re.findall(r"{(\w+)}", BROKEN[name]))})

    tables = _tables(t) | {"weather_snapshots": broken("b_weather"), "destinations": broken("b_destinations"),
                           "activities": broken("b_activities"), "trips": broken("b_trips")}
    return quality_report(tables, default_checks(Settings(embedding_dim=64)))


@query("orphan_rows", """
SELECT i.trip_id, i.item_id FROM {v_items} i LEFT JOIN {v_trips} t ON t.trip_id = i.trip_id AND t.status <> 'booked'
WHERE t.trip_id IS NULL""")
def _orphan_rows(t):
    return orphans(t("v_items"), "trip_id", t("v_trips").where("status <> 'booked'"), "trip_id").select("trip_id", "item_id")


@query("orphan_counts", """
SELECT count(*) AS bad FROM {v_items} i LEFT JOIN {v_trips} t ON t.trip_id = i.trip_id AND t.status <> 'booked'
WHERE t.trip_id IS NULL""")
def _orphan_counts(t):
    return count_orphans(t("v_items"), "trip_id", t("v_trips").where("status <> 'booked'"), "trip_id")


@query("reference_report", """
SELECT 'trips' AS child, 'users' AS parent, count(*) AS orphans FROM {v_trips} c
LEFT JOIN (SELECT user_id FROM {v_users} WHERE notes IS NOT NULL) p USING (user_id) WHERE p.user_id IS NULL
UNION ALL SELECT 'trips', 'destinations', count(*) FROM {v_trips} c LEFT JOIN {v_destinations} p USING (destination_id)
WHERE p.name IS NULL
UNION ALL SELECT 'itinerary_items', 'trips', count(*) FROM {v_items} c LEFT JOIN {v_trips} p USING (trip_id)
WHERE p.title IS NULL""")
def _reference_report(t):
    return reference_report({"users": t("v_users").where("notes IS NOT NULL"), "destinations": t("v_destinations"),
                             "trips": t("v_trips"), "itinerary_items": t("v_items")})


@query("scalar_functions", """
SELECT o_orderkey AS id, CAST(round(CAST(o_totalprice / 8 AS DECIMAL(18,6)), 1) AS DOUBLE) AS half_up,
       round_even(o_totalprice, 0) AS half_even, strftime(o_orderdate, '%m-%d') AS month_day,
       replace(o_orderpriority, ' ', '_') AS slug, left(CAST(CAST(o_orderdate AS TIME) AS VARCHAR), 5) AS hour_minute,
       CASE WHEN o_totalprice / 1000 < 50 THEN 'good' WHEN o_totalprice / 1000 < 100 THEN 'moderate'
            WHEN o_totalprice / 1000 < 150 THEN 'unhealthy·sg' ELSE 'unhealthy' END AS label
FROM {orders}""")
def _scalar_functions(t):
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    return t("orders").select(
        F.col("o_orderkey").alias("id"), round_half_up(price / 8, 1).alias("half_up"),
        round_half_even(price).alias("half_even"), month_day(F.to_date(day)).alias("month_day"),
        page_slug("o_orderpriority").alias("slug"), hour_minute(F.date_format(day, "HH:mm:ss")).alias("hour_minute"),
        aqi_label(price / 1000).alias("label"))


@query("row_minimums", "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS rows, CAST({MINIMUMS[name]} AS BIGINT) AS minimum, "
    f"count(*) >= {MINIMUMS[name]} AS pass FROM {{{view}}}" for name, view in STANDINS.items()))
def _row_minimums(t):
    return row_counts(_tables(t), MINIMUMS)


@query("distinct_counts", """
SELECT 'distinct_countries' AS metric, count(DISTINCT country) AS value FROM {v_destinations}
UNION ALL SELECT 'distinct_activity_categories', count(DISTINCT category) FROM {v_activities}
UNION ALL SELECT 'outdoor_activities', count(*) FILTER (WHERE is_outdoor) FROM {v_activities}
UNION ALL SELECT 'indoor_activities', count(*) FILTER (WHERE NOT is_outdoor) FROM {v_activities}""")
def _distinct_counts(t):
    return distinct_counts(t("v_destinations"), t("v_activities"))


@query("items_per_day", """
SELECT t.title, CAST(i.day_date AS VARCHAR) AS day_date, count(*) AS items_that_day
FROM {v_items} i JOIN {v_trips} t ON t.trip_id = i.trip_id GROUP BY t.trip_id, t.title, i.day_date""")
def _items_per_day(t):
    return items_per_day(t("v_items"), t("v_trips"))


@query("country_histogram", "SELECT country, count(*) AS destinations FROM {v_destinations} GROUP BY country")
def _country_histogram(t):
    return country_histogram(t("v_destinations"))


@query("scale_summary", """
SELECT 'destinations' AS metric, count(*) AS value FROM {v_destinations}
UNION ALL SELECT 'countries', count(DISTINCT country) FROM {v_destinations}
UNION ALL SELECT 'embedded_destinations', count(*) FROM {v_destinations} d JOIN {embeddings} e ON e.vec_id = d.destination_id
  WHERE d.destination_id % 3 <> 1
UNION ALL SELECT 'weather_rows', count(*) FROM {v_weather}""")
def _scale_summary(t):
    vectors = t("embeddings").where("vec_id % 3 <> 1").select(F.col("vec_id").alias("destination_id"), F.col("embedding").alias("description_embedding"))
    return scale_summary(t("v_destinations").join(vectors, "destination_id", "left"), t("v_weather"))


@query("footer_summary", """
SELECT 'lineitem' AS table_name, 'l_orderkey' AS column_name, count(*) AS "rows", min(l_orderkey) AS least, max(l_orderkey) AS greatest FROM {lineitem}
UNION ALL SELECT 'orders', 'o_custkey', count(*), min(o_custkey), max(o_custkey) FROM {orders}
UNION ALL SELECT 'events', 'user_id', count(*), min(user_id), max(user_id) FROM {events}""")
def _footer_summary(t):
    """Counts and extremes from the footers of the files; no row is read."""
    out = None
    for name, column in (("lineitem", "l_orderkey"), ("orders", "o_custkey"), ("events", "user_id")):
        rows, ends = footer_summary(t.spark, f"{t.sf_dir}/{name}.parquet", [column])
        least, greatest = ends[column]
        part = t.spark.range(1).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), F.lit(rows).cast("long").alias("rows"),
                                       F.lit(least).cast("long").alias("least"), F.lit(greatest).cast("long").alias("greatest"))
        out = part if out is None else out.unionByName(part)
    return out


@query("distances", """
SELECT destination_id, next_id, round_even(2 * 6371000 * atan2(sqrt(c), sqrt(1 - c)), 0) AS distance_m FROM (
  SELECT destination_id, next_id, CASE WHEN lon1 IS NOT NULL THEN least(1.0, pow(sin(radians(lat2 - lat1) / 2), 2)
         + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)) END AS c
  FROM (SELECT a.destination_id, b.destination_id AS next_id, a.latitude + 0.5 AS lat1, b.latitude + 0.25 AS lat2,
               CASE WHEN a.destination_id % 9 = 4 THEN NULL ELSE a.longitude END AS lon1, b.longitude AS lon2
        FROM {v_destinations} a JOIN {v_destinations} b ON b.destination_id = a.destination_id + 1) p) x""")
def _distances(t):
    """The distance expression, with missing coordinates."""
    a = t("v_destinations").select("destination_id", (F.col("latitude") + 0.5).alias("lat1"),
                                   F.when(F.col("destination_id") % 9 != 4, F.col("longitude")).alias("lon1"))
    b = t("v_destinations").select((F.col("destination_id") - 1).alias("destination_id"), F.col("destination_id").alias("next_id"),
                                   (F.col("latitude") + 0.25).alias("lat2"), F.col("longitude").alias("lon2"))
    return a.join(b, "destination_id").select("destination_id", "next_id", haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("distance_m"))


@query("items_of_a_day", """
SELECT trip_id, title, sort_order FROM {v_items} i WHERE day_date = (SELECT start_date FROM {v_trips} t WHERE t.trip_id = i.trip_id)""")
def _items_of_a_day(t):
    """The items of the first day of every trip."""
    first = t("v_trips").select("trip_id", "start_date")
    return t("v_items").join(first, "trip_id").where("day_date = start_date").select("trip_id", "title", "sort_order")


@query("catalog_events", """
SELECT c.name, c.country, count(*) AS events FROM {events} e
JOIN (VALUES """ + ", ".join(f"({n}, '{name}', '{country}')" for n, (name, country) in enumerate(DESTINATIONS)) + """) AS c(place, name, country)
  ON e.user_id % 25 = c.place GROUP BY c.name, c.country""")
def _catalog_events(t):
    """The catalog as driving table of 25 rows; the events are counted before they meet it."""
    names = F.array(*[F.lit(name) for name, _ in DESTINATIONS])
    counts = t("events").groupBy((F.col("user_id") % 25).cast("int").alias("place")).agg(F.count(F.lit(1)).alias("events"))
    return destination_catalog(t.spark).withColumn("place", (F.array_position(names, F.col("name")) - 1).cast("int")).join(
        counts, "place").select("name", "country", "events")


# Frequent words of the test texts, so that every branch of the classifier is taken.
INDOOR_WORDS, OUTDOOR_WORDS = ("ment", "tion", "ung"), ("the", "eau", "ein", "que", "of")


def _any(words):
    return " OR ".join(f"contains(text, '{w}')" for w in words)


@query("classify_text", f"""
SELECT doc_id, CASE WHEN NOT ({_any(INDOOR_WORDS)}) AND ({_any(OUTDOOR_WORDS)}) THEN 'outdoor' ELSE 'attraction' END
       AS category, CAST(NOT ({_any(INDOOR_WORDS)}) AND ({_any(OUTDOOR_WORDS)}) AS BIGINT) AS is_outdoor
FROM (SELECT doc_id, lower(concat_ws(' ', source, text)) AS text FROM {{documents}}) d""")
def _classify_text(t):
    category, is_outdoor = classify_place("source", "text", INDOOR_WORDS, OUTDOOR_WORDS)
    return t("documents").select("doc_id", category.alias("category"), is_outdoor.alias("is_outdoor"))


RADIUS_M, NEAREST = 2_000_000, 8


@query("places_within_radius", f"""
SELECT centre_id, place_id, distance_m, CAST(rn AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY centre_id ORDER BY distance_m, place_id) AS rn FROM (
    SELECT c.destination_id AS centre_id, p.destination_id AS place_id,
           round_even(2 * 6371000 * atan2(sqrt(least(h, 1.0)), sqrt(1 - least(h, 1.0))), 0) AS distance_m
    FROM {{v_destinations}} c, {{v_destinations}} p,
    LATERAL (SELECT sin(radians(p.latitude - c.latitude) / 2) ** 2 + cos(radians(c.latitude)) * cos(radians(p.latitude))
             * sin(radians(p.longitude - c.longitude) / 2) ** 2 AS h) x) y
  WHERE distance_m <= {RADIUS_M}) z WHERE rn <= {NEAREST}""")
def _places_within_radius(t):
    places = t("v_destinations").select(F.col("destination_id").alias("place_id"), "latitude", "longitude")
    return places_within_radius(places.withColumnRenamed("place_id", "centre_id"), places, RADIUS_M, NEAREST)


@query("transcript_scores", """
SELECT conv_id AS run_id, 'the assistant answers' AS task, bool_or(role = 'assistant') AS passed,
       concat('tools=', string_agg(DISTINCT role, ', ' ORDER BY role)) AS detail FROM {conversations} GROUP BY conv_id
UNION ALL
SELECT conv_id, 'the system speaks', bool_or(role = 'system'),
       concat('tools=', string_agg(DISTINCT role, ', ' ORDER BY role)) FROM {conversations} GROUP BY conv_id""")
def _transcript_scores(t):
    transcript = t("conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("step"),
                                           F.col("role").alias("tool"))
    runs = transcript.select("run_id").distinct()
    return combine([tool_fired(runs, transcript, "the assistant answers", "assistant"),
                    tool_fired(runs, transcript, "the system speaks", "system")])


def _outcomes(t):
    items = t.written("v_items").withColumn("reschedule_reason", F.lit(None).cast("string"))
    after = move_items(items, t.run(MOVES, v_items=t("v_items"))).snapshot
    traits = t("v_activities").select("activity_id", "is_outdoor")

    def state(df):
        return df.join(traits, "activity_id").withColumnRenamed("trip_id", "run_id")

    bad = (trip_weather(t("v_trips"), t("v_weather")).where("is_bad")
           .select(F.col("trip_id").alias("run_id"), F.col("forecast_date").alias("day_date")))
    runs = t("v_trips").select(F.col("trip_id").alias("run_id"))
    packing = t("v_packing").withColumnRenamed("trip_id", "run_id")
    return combine([
        no_outdoor_on_bad_day(runs, state(items), state(after), bad, "no outdoor item left on a bad day"),
        every_change_has_reason(runs, state(after), "every change has a reason"),
        count_change(runs, packing.where("quantity < 20"), packing, "the packing list grows"),
        count_change(runs, packing.where("quantity < 20"), packing, "one item is added", 1)])


OUTCOMES = {**TRIP_DAY_VIEWS, **MOVED, "traits": """
SELECT t.trip_id, count(*) FILTER (WHERE a.is_outdoor AND i.status = 'planned') AS n_before,
       count(*) FILTER (WHERE m.status = 'rescheduled') AS n_changed,
       count(*) FILTER (WHERE m.status = 'rescheduled' AND m.reschedule_reason IS NOT NULL) AS n_reasons,
       count(*) FILTER (WHERE a.is_outdoor AND m.status = 'planned' AND b.is_bad) AS n_left
FROM {v_trips} t LEFT JOIN ({v_items} i JOIN {v_activities} a ON a.activity_id = i.activity_id
     JOIN {moved} m ON m.item_id = i.item_id) ON i.trip_id = t.trip_id
LEFT JOIN {trip_days} b ON b.trip_id = m.trip_id AND b.forecast_date = m.day_date
GROUP BY t.trip_id""", "packs": """
SELECT t.trip_id, count(p.trip_id) FILTER (WHERE quantity < 20) AS n_before, count(p.trip_id) AS n_after
FROM {v_trips} t LEFT JOIN {v_packing} p ON p.trip_id = t.trip_id GROUP BY t.trip_id""", "outcomes": """
SELECT trip_id AS run_id, 'no outdoor item left on a bad day' AS task, n_before > 0 AND n_left = 0 AS passed,
       concat('outdoor_before=', n_before, ' still_on_bad_day_after=', n_left) AS detail FROM {traits}
UNION ALL SELECT trip_id, 'every change has a reason', n_changed > 0 AND n_changed = n_reasons,
       concat('rescheduled=', n_changed, ' with_reason=', n_reasons) FROM {traits}
UNION ALL SELECT trip_id, 'the packing list grows', n_after > n_before, concat('before=', n_before, ' after=', n_after)
FROM {packs}
UNION ALL SELECT trip_id, 'one item is added', n_after = n_before + 1, concat('before=', n_before, ' after=', n_after)
FROM {packs}"""}


@query("outcome_scores", "SELECT * FROM {outcomes}", OUTCOMES)
def _outcome_scores(t):
    return _outcomes(t)


@query("pass_rates", """
SELECT task, concat(count(*) FILTER (WHERE passed), '/', count(*)) AS score,
       round_even(count(*) FILTER (WHERE passed) / count(*), 3) AS pass_rate FROM {outcomes} GROUP BY task""", OUTCOMES)
def _pass_rates(t):
    return score(_outcomes(t), ["task"])


STEPS = """
SELECT conv_id AS run_id, CASE WHEN turn % 2 = 0 THEN 'retrieval' ELSE 'grounding' END AS task,
       CASE role WHEN 'user' THEN 'search_activities' WHEN 'assistant' THEN 'weather_by_day' ELSE role END AS tool,
       CASE WHEN length(text) % 7 = 0 THEN 'broke off' END AS error FROM {conversations}"""


@query("golden_tasks", """
SELECT run_id, task, passed, detail FROM {outcomes}
UNION ALL
SELECT t.trip_id, k.name, coalesce(bool_or(s.tool = k.tool) AND NOT bool_or(s.error IS NOT NULL), FALSE),
       concat('tools=', coalesce(string_agg(DISTINCT s.tool, ', ' ORDER BY s.tool), ''))
FROM {v_trips} t CROSS JOIN (VALUES ('searches for indoor activities', 'retrieval', 'search_activities'),
                                    ('checks weather before answering', 'grounding', 'weather_by_day')) AS k(name, task, tool)
LEFT JOIN {steps} s ON s.run_id = t.trip_id AND s.task = k.task GROUP BY t.trip_id, k.name""", {**OUTCOMES, "steps": STEPS})
def _golden_tasks(t):
    """The six tasks of an evaluation in one aggregation."""
    items = t.written("v_items").withColumn("reschedule_reason", F.lit(None).cast("string"))
    after = move_items(items, t.run(MOVES, v_items=t("v_items"))).snapshot
    traits = t("v_activities").select("activity_id", "is_outdoor")

    def state(df):
        return df.join(traits, "activity_id").withColumnRenamed("trip_id", "run_id")

    bad = (trip_weather(t("v_trips"), t("v_weather")).where("is_bad")
           .select(F.col("trip_id").alias("run_id"), F.col("forecast_date").alias("day_date")))
    packing = t("v_packing").withColumnRenamed("trip_id", "run_id")
    grown = (packing.where("quantity < 20"), packing)
    recording = Recording(t.run(STEPS, conversations=t("conversations")), (state(items), state(after)), grown, grown, bad)
    found = evaluate_runs(t("v_trips").select(F.col("trip_id").alias("run_id")), recording)
    # The twin has the tasks under the names of the other score queries.
    names = {"reschedule: no outdoor item left on a bad day": "no outdoor item left on a bad day",
             "reschedule: every change has a reason": "every change has a reason", "packing: list is created": "the packing list grows",
             "add: exactly one item added": "one item is added", "retrieval: searches for indoor activities": "searches for indoor activities",
             "grounding: checks weather before answering": "checks weather before answering"}
    return found.replace(names, subset=["task"])
