"""Table changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from outings.functions.scalars import INDOOR_KEYWORDS, OUTDOOR_KEYWORDS
from outings.operators.keyed import assign_ids, latest_per_key
from outings.operators.mutation import (CHANGE, add_items, align_trips, delete_cascade, delete_rows, insert_absent,
                                        insert_rows,                                        move_items, snapshot_diff, swap_items, upsert)
from outings.plans.packing import pack, packing_suggestions
from outings.plans.load import run_load
from outings.plans.seeding import Parent, seed_table
from outings.plans.places import bootstrap_destinations, ingest_attractions
from outings.schemas import empty
from outings.settings import Settings
from workload.registry import query
from workload.weather import TRIP_DAY_VIEWS, both_payloads

VISITED = """
SELECT a.destination_id, a.name, a.category, a.is_outdoor, i.item_id
FROM {v_items} i JOIN {v_activities} a ON a.activity_id = i.activity_id"""


@query("activities_insert_absent", """
SELECT activity_id, destination_id, name, category, is_outdoor, NULL AS change
FROM {v_activities} WHERE is_outdoor
UNION ALL
SELECT DISTINCT NULL, v.destination_id, v.name, v.category, v.is_outdoor, 'inserted'
FROM {visited} v WHERE NOT EXISTS (SELECT 1 FROM {v_activities} a
     WHERE a.is_outdoor AND a.destination_id = v.destination_id AND a.name = v.name)""", {"visited": VISITED})
def _activities_insert_absent(t):
    known = (t("v_activities").where("is_outdoor")
             .select("activity_id", "destination_id", "name", "category", "is_outdoor"))
    visited = t.run(VISITED, v_items=t("v_items"), v_activities=t("v_activities"))
    added = insert_absent(known, visited, ["destination_id", "name"], first=[F.col("item_id")])
    return added.frame.withColumnRenamed(CHANGE, "change")


SEED = """
SELECT u.email, d.name AS destination, t.title, t.start_date, t.end_date, t.status
FROM {v_trips} t JOIN {v_users} u ON u.user_id = t.user_id JOIN {v_destinations} d ON d.destination_id = t.destination_id"""
PHASES = "(VALUES ('planning', 'open'), ('booked', 'open'), ('complete', 'closed')) AS p(status, phase)"


@query("seed_fk_resolution", """
SELECT u.user_id, d.destination_id, s.title, CAST(s.start_date AS VARCHAR) AS start_date,
       CAST(s.end_date AS VARCHAR) AS end_date, s.status, p.phase
FROM {seed} s JOIN {v_users} u ON u.email = s.email JOIN {v_destinations} d ON d.name = s.destination
JOIN """ + PHASES + """ ON p.status = s.status
WHERE NOT EXISTS (SELECT 1 FROM {v_trips} x WHERE x.status = 'complete' AND x.user_id = u.user_id AND x.title = s.title)""",
       {"seed": SEED})
def _seed_fk_resolution(t):
    """Seed rows with natural keys: resolve their parents, then insert those the table lacks."""
    seed = t.run(SEED, **{v: t(v) for v in ("v_trips", "v_users", "v_destinations")})
    phases = t.run(f"SELECT * FROM {PHASES}")
    parents = (seed.join(t("v_users").select("email", "user_id"), "email")
               .join(t("v_destinations").select(F.col("name").alias("destination"), "destination_id"), "destination")
               .join(phases, "status")
               .select("user_id", "destination_id", "title", "start_date", "end_date", "status", "phase"))
    known = t("v_trips").where("status = 'complete'").select("user_id", "destination_id", "title", "start_date",
                                                             "end_date", "status", F.lit(None).cast("string")
                                                             .alias("phase"))
    added = insert_absent(known, parents, ["user_id", "title"], first=[F.col("destination_id")])
    return added.changed.drop(CHANGE)


LOST = "CASE WHEN {id} % 13 = 5 THEN concat(d.name, ' elsewhere') ELSE d.name END AS destination"
SEEDS = {
    "seed_activities": f"""
SELECT a.activity_id, {LOST.format(id="a.activity_id")}, a.name, a.category, a.is_outdoor
FROM {{v_activities}} a JOIN {{v_destinations}} d ON d.destination_id = a.destination_id""",
    "seed_weather": f"""
SELECT {LOST.format(id="w.us_aqi")}, w.forecast_ts, w.forecast_date, w.temperature_c, w.us_aqi
FROM {{v_weather}} w JOIN {{v_destinations}} d ON d.destination_id = w.destination_id""",
    "seed_items": """
SELECT i.item_id, t.title AS trip, CASE WHEN i.item_id % 17 = 3 THEN 'no such activity' ELSE a.name END AS activity, i.day_date, i.title, i.status
FROM {v_items} i JOIN {v_trips} t ON t.trip_id = i.trip_id JOIN {v_activities} a ON a.activity_id = i.activity_id""",
    "seed_packing": """
SELECT CASE WHEN p.quantity % 13 = 5 THEN 'no such trip' ELSE t.title END AS trip, p.item_name, p.category, p.quantity
FROM {v_packing} p JOIN {v_trips} t ON t.trip_id = p.trip_id"""}


def _seed(t, name: str):
    used = {v: t(v) for v in ("v_activities", "v_destinations", "v_weather", "v_items", "v_trips", "v_packing") if f"{{{v}}}" in SEEDS[name]}
    return t.run(SEEDS[name], **used)


def _places(t) -> Parent:
    return Parent(t("v_destinations"), {"destination": "name"}, "destination_id")


@query("seed_activities", """
SELECT d.destination_id, s.name, s.category, s.is_outdoor FROM {seed_activities} s JOIN {v_destinations} d ON d.name = s.destination
WHERE NOT EXISTS (SELECT 1 FROM {v_activities} a WHERE a.is_outdoor AND a.destination_id = d.destination_id AND a.name = s.name)""", SEEDS)
def _seed_activities(t):
    known = t("v_activities").where("is_outdoor").select("activity_id", "destination_id", "name", "category", "is_outdoor")
    done = seed_table(_seed(t, "seed_activities").drop("activity_id"), [_places(t)], known, ["destination_id", "name"], [F.col("category")])
    return done.table.changed.select("destination_id", "name", "category", "is_outdoor")


@query("seed_weather", """
SELECT d.destination_id, CAST(s.forecast_ts AS VARCHAR) AS forecast_ts, s.temperature_c, s.us_aqi, 'seed' AS source
FROM {seed_weather} s JOIN {v_destinations} d ON d.name = s.destination
WHERE NOT EXISTS (SELECT 1 FROM {v_weather} w WHERE w.us_aqi < 100 AND w.destination_id = d.destination_id AND w.forecast_ts = s.forecast_ts)""", SEEDS)
def _seed_weather(t):
    known = t("v_weather").where("us_aqi < 100").withColumn("source", F.lit("service"))
    done = seed_table(_seed(t, "seed_weather"), [_places(t)], known, ["destination_id", "forecast_ts"], [F.col("temperature_c")],
                      {"source": F.lit("seed")})
    return done.table.changed.select("destination_id", "forecast_ts", "temperature_c", "us_aqi", "source")


@query("seed_items", """
SELECT t.trip_id, a.activity_id, CAST(s.day_date AS VARCHAR) AS day_date, s.title, s.status FROM (
  SELECT *, row_number() OVER (PARTITION BY trip, day_date, title ORDER BY item_id) AS rn FROM {seed_items} WHERE activity <> 'no such activity') s
JOIN {v_trips} t ON t.title = s.trip JOIN {v_activities} a ON a.name = s.activity
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {v_items} i WHERE i.status = 'done' AND i.trip_id = t.trip_id AND i.day_date = s.day_date
                             AND i.title = s.title)""", SEEDS)
def _seed_items(t):
    """Two parents: the trip and the activity."""
    known = t("v_items").where("status = 'done'")
    parents = [Parent(t("v_trips"), {"trip": "title"}, "trip_id"), Parent(t("v_activities"), {"activity": "name"}, "activity_id")]
    done = seed_table(_seed(t, "seed_items"), parents, known, ["trip_id", "day_date", "title"], [F.col("item_id")])
    return done.table.changed.select("trip_id", "activity_id", "day_date", "title", "status")


@query("seed_packing", """
SELECT t.trip_id, s.item_name, s.category, s.quantity FROM {seed_packing} s JOIN {v_trips} t ON t.title = s.trip
WHERE NOT EXISTS (SELECT 1 FROM {v_packing} p WHERE p.quantity < 20 AND p.trip_id = t.trip_id AND p.item_name = s.item_name)""", SEEDS)
def _seed_packing(t):
    done = seed_table(_seed(t, "seed_packing"), [Parent(t("v_trips"), {"trip": "title"}, "trip_id")], t("v_packing").where("quantity < 20"),
                      ["trip_id", "item_name"], [F.col("quantity")])
    return done.table.changed.select("trip_id", "item_name", "category", "quantity")


@query("seed_rejected", """
SELECT 'items' AS seeds, trip AS parent, 'activity_id' AS missing, count(*) AS n FROM {seed_items} WHERE activity = 'no such activity' GROUP BY trip
UNION ALL SELECT 'activities', destination, 'destination_id', count(*) FROM {seed_activities} WHERE ends_with(destination, ' elsewhere') GROUP BY destination
UNION ALL SELECT 'packing', trip, 'trip_id', count(*) FROM {seed_packing} WHERE trip = 'no such trip' GROUP BY trip""", SEEDS)
def _seed_rejected(t):
    """Seed rows whose parent is not there, counted by the name they give."""
    trips = Parent(t("v_trips"), {"trip": "title"}, "trip_id")
    cases = [("items", "trip", [trips, Parent(t("v_activities"), {"activity": "name"}, "activity_id")], t("v_items"), ["trip_id", "day_date", "title"]),
             ("activities", "destination", [_places(t)], t("v_activities"), ["destination_id", "name"]),
             ("packing", "trip", [trips], t("v_packing"), ["trip_id", "item_name"])]
    out = None
    for name, parent, parents, target, key in cases:
        lost = seed_table(_seed(t, f"seed_{name}"), parents, target, key, [F.col(key[-1])]).rejected
        part = lost.groupBy(F.lit(name).alias("seeds"), F.col(parent).alias("parent"), "missing").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


BOOT = """
SELECT name, country AS catalog_country, latitude, longitude, description,
       CASE WHEN longitude > 150 THEN 'TimeoutError: no answer' END AS error,
       CASE WHEN latitude < -60 THEN NULL WHEN longitude < 0 THEN upper(country) ELSE '' END AS geo_country,
       latitude >= -60 AS found, latitude >= 30 AS known
FROM {v_destinations}"""
JUDGED = {"boot": BOOT, "judged": """
SELECT *, CASE WHEN known THEN 'skipped' WHEN error IS NOT NULL OR NOT found THEN 'failed' ELSE 'inserted' END AS status,
       CASE WHEN known THEN NULL WHEN error IS NOT NULL THEN error WHEN NOT found THEN 'no geocode match' END AS reason
FROM {boot}"""}


def _bootstrap(t):
    boot = t.run(BOOT, v_destinations=t("v_destinations"))
    place = F.struct(F.struct("name", F.col("geo_country").alias("country"), F.concat(F.lit("r-"), "name")
                              .alias("admin1"), "latitude", "longitude", F.lit("UTC").alias("timezone")).alias("x"))
    answers = boot.select(
        "name", "error",
        F.when(F.col("found"), F.to_json(F.struct(F.array(place["x"]).alias("results")))).otherwise("{}")
        .alias("geocode"),
        F.to_json(F.struct(F.col("name").alias("title"), F.col("description").alias("extract"),
                           F.lit("a place").alias("description"))).alias("summary"))
    known = t("v_destinations").where("latitude >= 30").select(
        "destination_id", "name", "country", F.lit(None).cast("string").alias("admin_region"), "latitude",
        "longitude", F.lit(None).cast("string").alias("timezone"), "description", F.lit("seed").alias("source"))
    return bootstrap_destinations(boot.select("name", F.col("catalog_country").alias("country")), known, answers)


@query("destinations_bootstrap", "SELECT name, status, reason FROM {judged}", JUDGED)
def _destinations_bootstrap(t):
    return _bootstrap(t).report


@query("destinations_inserted", """
SELECT (SELECT max(destination_id) FROM {v_destinations} WHERE latitude >= 30)
       + row_number() OVER (ORDER BY left(md5(name), 3), name) AS destination_id, name,
       coalesce(nullif(geo_country, ''), catalog_country) AS country, concat('r-', name) AS admin_region, latitude,
       longitude, 'UTC' AS timezone, coalesce(nullif(description, ''), 'a place') AS description, 'phase8-bootstrap' AS source
FROM {judged} WHERE status = 'inserted'""", JUDGED)
def _destinations_inserted(t):
    return _bootstrap(t).destinations.changed.drop(CHANGE)


PAGES = """
SELECT destination_id, activity_id AS pageid, CASE WHEN activity_id % 3 = 0 THEN name ELSE concat('Sight ', activity_id) END AS title,
       CASE WHEN activity_id % 5 = 2 THEN NULL ELSE CAST((activity_id * 7) % 11 AS INT) END AS idx,
       CASE WHEN activity_id % 4 = 1 THEN NULL ELSE activity_id % 90 + 0.5 END AS lat,
       CASE WHEN activity_id % 4 = 1 THEN NULL ELSE activity_id % 180 - 0.25 END AS lon, category AS description,
       CASE activity_id % 6 WHEN 0 THEN 'A Museum by the lake' WHEN 1 THEN 'lake trail' WHEN 2 THEN 'old town' WHEN 3 THEN 'Hot Spring'
       WHEN 4 THEN 'city centre and garden' END AS extract
FROM {v_activities}"""


def _said(words) -> str:
    return "(" + " OR ".join(f"contains(said, '{w}')" for w in words) + ")"


NEAR = {"pages": PAGES, "sights": f"""
SELECT *, NOT {_said(INDOOR_KEYWORDS)} AND {_said(OUTDOOR_KEYWORDS)} AS outdoors FROM (
  SELECT p.*, lower(concat_ws(' ', title, extract)) AS said, coalesce(lat, d.latitude) AS latitude,
         coalesce(lon, d.longitude) AS longitude,
         row_number() OVER (PARTITION BY p.destination_id ORDER BY coalesce(idx, 9999), pageid, title) AS place
  FROM {{pages}} p JOIN {{v_destinations}} d USING (destination_id)) x WHERE place <= 8"""}


def _page_payloads(t):
    """The answer of a place service for every destination: a map of pages, some without coordinates or index."""
    pages = t.run(PAGES, v_activities=t("v_activities"))
    page = F.struct("pageid", "title", F.col("idx").alias("index"),
                    F.when(F.col("lat").isNotNull(), F.array(F.struct("lat", "lon"))).alias("coordinates"), "description", "extract")
    answer = F.struct(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("pageid").cast("string"), page))).alias("pages")).alias("query"))
    answers = pages.groupBy("destination_id").agg(F.to_json(answer).alias("payload"))
    return t("v_destinations").select("destination_id", "latitude", "longitude").join(answers, "destination_id")


@query("attractions_bronze", """
SELECT destination_id, title, description, extract, latitude, longitude, CASE WHEN outdoors THEN 'outdoor' ELSE 'attraction' END AS category,
       CAST(outdoors AS BIGINT) AS is_outdoor FROM {sights}""", NEAR)
def _attractions_bronze(t):
    return ingest_attractions(_page_payloads(t), t("v_activities")).bronze.drop("_ingested_at")


@query("attractions_ingest", """
SELECT destination_id, title AS name, CASE WHEN outdoors THEN 'outdoor' ELSE 'attraction' END AS category, outdoors AS is_outdoor
FROM (SELECT *, row_number() OVER (PARTITION BY destination_id, title ORDER BY place) AS rn FROM {sights}) s
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM {v_activities} a WHERE a.destination_id = s.destination_id AND a.name = s.title)""", NEAR)
def _attractions_ingest(t):
    """New activities from the pages, with the default keyword lists; known names are left alone."""
    added = ingest_attractions(_page_payloads(t), t("v_activities")).activities.changed
    return added.select("destination_id", "name", "category", "is_outdoor")


@query("load_tables", """
SELECT 'bronze' AS layer, destination_id, CAST(forecast_ts AS VARCHAR) AS at, temperature_c, us_aqi FROM {v_weather}
UNION ALL SELECT 'silver', destination_id, CAST(forecast_ts AS VARCHAR), temperature_c, us_aqi FROM {v_weather}
UNION ALL SELECT 'serving', destination_id, CAST(forecast_ts AS VARCHAR), temperature_c, us_aqi FROM {v_weather}
UNION ALL SELECT 'attractions', destination_id, title, latitude, CAST(outdoors AS INT) FROM {sights}""", NEAR)
def _load_tables(t):
    """The whole load; its saved bronze and silver tables and the new serving table are read back."""
    schema = f"load_{uuid.uuid4().hex[:12]}"
    serving = empty(t.spark, "weather_snapshots")
    done = run_load(both_payloads(t("v_weather"), t("v_weather")), _page_payloads(t),
                    {"weather_snapshots": serving, "activities": t("v_activities")}, Settings(schema=schema), on_error="raise")
    layers = {"bronze": t.spark.table(done["weather"]["bronze_table"].table), "silver": t.spark.table(done["weather"]["silver_table"].table),
              "serving": done["tables"]["weather_snapshots"]}
    rows = t.spark.table(done["attractions"]["bronze_table"].table).select(
        F.lit("attractions").alias("layer"), "destination_id", F.col("title").alias("at"), F.col("latitude").alias("temperature_c"),
        F.col("is_outdoor").cast("int").alias("us_aqi"))
    for name, df in layers.items():
        rows = rows.unionByName(df.select(F.lit(name).alias("layer"), "destination_id", F.col("forecast_ts").cast("string").alias("at"),
                                          F.col("temperature_c").cast("double"), F.col("us_aqi").cast("int")))
    return rows


@query("load_counts", """
SELECT 'weather fetched' AS measure, count(*) AS n FROM {v_weather} UNION ALL SELECT 'weather silver', count(*) FROM {v_weather}
UNION ALL SELECT 'weather upserted', count(*) FROM {v_weather}
UNION ALL SELECT 'weather inserted', count(*) FROM {v_weather} WHERE forecast_date > DATE '2024-01-10'
UNION ALL SELECT 'attractions fetched', count(*) FROM {sights} UNION ALL SELECT 'attractions inserted', count(*) FROM {added}""", {
    **NEAR, "added": """
SELECT DISTINCT destination_id, title FROM {sights} s
WHERE NOT EXISTS (SELECT 1 FROM {v_activities} a WHERE a.destination_id = s.destination_id AND a.name = s.title)"""})
def _load_counts(t):
    """What a load over a partly filled table counts while it writes."""
    known = empty(t.spark, "weather_snapshots").unionByName(
        t("v_weather").where("forecast_date <= DATE '2024-01-10'"), allowMissingColumns=True)
    done = run_load(both_payloads(t("v_weather"), t("v_weather")), _page_payloads(t),
                    {"weather_snapshots": known, "activities": t("v_activities")}, Settings(write_tables=False))
    weather, pages = done["weather"], done["attractions"]
    rows = [("weather fetched", weather["fetched"]), ("weather silver", weather["silver_rows"]), ("weather upserted", weather["upserted"]),
            ("weather inserted", weather["inserted"]), ("attractions fetched", pages["fetched"]), ("attractions inserted", pages["inserted"])]
    return t.spark.createDataFrame(rows, "measure string, n long")


@query("assign_ids", """
SELECT (SELECT max(trip_id) FROM {v_trips}) + row_number() OVER (ORDER BY left(md5(title), 3), title) AS new_id, title
FROM {v_trips}""")
def _assign_ids(t):
    trips = t("v_trips")
    return assign_ids(trips.select("title"), "new_id", ["title"], trips.agg(F.max("trip_id")).scalar())


PACK_CHANGES = """
SELECT l_orderkey AS trip_id, CASE WHEN l_linestatus = 'O' THEN concat(p_name, ' spare') ELSE p_name END AS item_name,
       'gear' AS category, CAST(max(l_quantity) AS INT) AS quantity, max(l_returnflag) AS reason
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY 1, 2"""


@query("packing_upsert", """
SELECT trip_id, item_name, coalesce(o.category, n.category) AS category, coalesce(n.quantity, o.quantity) AS quantity,
       n.reason, coalesce(o.is_checked, FALSE) AS is_checked
FROM (SELECT *, TRUE AS is_checked FROM {v_packing}) o FULL JOIN {pack_changes} n USING (trip_id, item_name)""",
       {"pack_changes": PACK_CHANGES})
def _packing_upsert(t):
    packing = t("v_packing").withColumn("reason", F.lit(None).cast("string")).withColumn("is_checked", F.lit(True))
    return pack(packing, t.run(PACK_CHANGES, lineitem=t("lineitem"), part=t("part"))).snapshot


SWIM = ("economy", "small")


@query("packing_rules", """
SELECT c.trip_id, r.item_name, r.category, 1 AS quantity, r.reason
FROM {conditions} c JOIN (VALUES
  ('', 'Reusable water bottle', 'gear', 'Staying hydrated on active days.'),
  ('', 'Phone + charger', 'gear', 'Everyday essential.'),
  ('', 'ID / travel documents', 'documents', 'Required for travel and entry.'),
  ('', 'Sunscreen SPF50', 'health', 'UV protection outdoors.'),
  ('rain', 'Rain jacket', 'clothing', 'Rain forecast on at least one day.'),
  ('bad_air', 'N95 mask', 'health', 'Air quality forecast to be poor.'),
  ('cold', 'Warm fleece layer', 'clothing', 'Cold temperatures forecast.'),
  ('hot', 'Sun hat', 'clothing', 'Hot afternoons forecast.'),
  ('outdoor', 'Hiking shoes', 'gear', 'Outdoor trails on the itinerary.'),
  ('swim', 'Swimwear', 'clothing', 'Water/wellness activity planned.')) AS r(flag, item_name, category, reason)
ON r.flag = '' OR (r.flag = 'rain' AND c.rain) OR (r.flag = 'bad_air' AND c.bad_air) OR (r.flag = 'cold' AND c.cold)
   OR (r.flag = 'hot' AND c.hot) OR (r.flag = 'outdoor' AND c.outdoor) OR (r.flag = 'swim' AND c.swim)""",
       {**TRIP_DAY_VIEWS, "conditions": """
SELECT t.trip_id, bool_or(d.max_precip_prob >= 60) AS rain, bool_or(d.max_aqi >= 100) AS bad_air,
       bool_or(d.min_temp_c <= 8) AS cold, bool_or(d.max_temp_c >= 25) AS hot, any_value(p.outdoor) AS outdoor,
       any_value(p.swim) AS swim
FROM {v_trips} t LEFT JOIN {trip_days} d ON d.trip_id = t.trip_id
LEFT JOIN (SELECT i.trip_id, bool_or(a.is_outdoor) AS outdoor, bool_or(a.category IN ('economy', 'small')) AS swim
           FROM {v_items} i JOIN {v_activities} a ON a.activity_id = i.activity_id GROUP BY i.trip_id) p
ON p.trip_id = t.trip_id GROUP BY t.trip_id"""})
def _packing_rules(t):
    return packing_suggestions(t("v_trips"), t("v_weather"), t("v_items"), t("v_activities"), swim_categories=SWIM)


REQUESTS = """
SELECT item_id AS request_id, trip_id, CASE WHEN status = 'done' THEN '' WHEN sort_order = 2 THEN 'tomorrow'
       WHEN sort_order = 3 THEN '2023-06-01' WHEN sort_order = 4 THEN '2099-01-01' ELSE CAST(day_date AS STRING) END AS day_date,
       CASE WHEN sort_order = 5 THEN NULL ELSE title END AS title, activity_id * 2 AS activity_id,
       CASE WHEN sort_order = 1 THEN '09:00' ELSE ' ' END AS start_time, CAST(NULL AS STRING) AS end_time,
       CAST(NULL AS STRING) AS notes
FROM {v_items}"""


PLACED = """
SELECT q.*, CASE WHEN regexp_matches(q.day_date, '^[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]$')
                       THEN greatest(t.start_date, least(t.end_date, TRY_CAST(q.day_date AS DATE))) ELSE t.start_date END AS day
      FROM {requests} q JOIN {v_trips} t ON t.trip_id = q.trip_id"""


@query("append_sort_order", """
SELECT r.request_id, r.trip_id, CAST(r.day AS VARCHAR) AS day_date, coalesce(r.title, 'Untitled') AS title,
       a.activity_id, nullif(trim(r.start_time), '') AS start_time, r.end_time, r.notes, 'planned' AS status,
       CAST(coalesce(e.top, 0) + row_number() OVER (PARTITION BY r.trip_id, r.day ORDER BY r.request_id) AS INT) AS sort_order
FROM {placed} r
LEFT JOIN {v_activities} a ON a.activity_id = r.activity_id
LEFT JOIN (SELECT trip_id, day_date, max(sort_order) AS top FROM {v_items} GROUP BY 1, 2) e
  ON e.trip_id = r.trip_id AND e.day_date = r.day""", {"requests": REQUESTS, "placed": PLACED})
def _append_sort_order(t):
    requests = t.run(REQUESTS, v_items=t.written("v_items"))
    return add_items(t("v_items"), requests, t("v_trips"), t("v_activities"))


@query("items_added", """
SELECT item_id, trip_id, activity_id, CAST(day_date AS VARCHAR) AS day_date, title, status, sort_order, NULL AS change
FROM {v_items}
UNION ALL
SELECT (SELECT max(item_id) FROM {v_items}) + row_number() OVER (ORDER BY left(md5(CAST(r.request_id AS VARCHAR)), 3), r.request_id),
       r.trip_id, a.activity_id, CAST(r.day AS VARCHAR), coalesce(r.title, 'Untitled'), 'planned',
       CAST(coalesce(e.top, 0) + row_number() OVER (PARTITION BY r.trip_id, r.day ORDER BY r.request_id) AS INT), 'inserted'
FROM {placed} r LEFT JOIN {v_activities} a ON a.activity_id = r.activity_id
LEFT JOIN (SELECT trip_id, day_date, max(sort_order) AS top FROM {v_items} GROUP BY 1, 2) e
  ON e.trip_id = r.trip_id AND e.day_date = r.day""", {"requests": REQUESTS, "placed": PLACED})
def _items_added(t):
    requests = t.run(REQUESTS, v_items=t.written("v_items"))
    added = add_items(t("v_items"), requests, t("v_trips"), t("v_activities"))
    return insert_rows(t("v_items"), added, "item_id", ["request_id"]).frame.withColumnRenamed(CHANGE, "change")


MOVES = """
SELECT item_id, CASE WHEN sort_order = 1 THEN CAST(day_date + 1 AS STRING) WHEN sort_order = 2 THEN 'next week' END AS day_date,
       CAST(NULL AS STRING) AS start_time, CAST(NULL AS STRING) AS end_time,
       CASE WHEN sort_order < 4 THEN concat('asked for by ', title) ELSE ' ' END AS reason
FROM {v_items} WHERE status = 'planned'"""
MOVED = {"moves": MOVES, "moved": """
SELECT i.item_id, i.trip_id, i.activity_id,
       CASE WHEN m.item_id IS NOT NULL AND i.sort_order = 1 THEN i.day_date + 1 ELSE i.day_date END AS day_date, i.title,
       CASE WHEN m.item_id IS NOT NULL THEN 'rescheduled' ELSE i.status END AS status, i.sort_order,
       CASE WHEN m.item_id IS NOT NULL THEN nullif(trim(m.reason), '') END AS reschedule_reason
FROM {v_items} i LEFT JOIN {moves} m ON m.item_id = i.item_id"""}


def _moved(t):
    items = t("v_items").withColumn("reschedule_reason", F.lit(None).cast("string"))
    return items, move_items(items, t.run(MOVES, v_items=t("v_items")))


@query("move_items", "SELECT * REPLACE (CAST(day_date AS VARCHAR) AS day_date) FROM {moved}", MOVED)
def _move_items(t):
    return _moved(t)[1].snapshot


SWAPS = """
SELECT i.item_id, a.activity_id, a.name AS title, concat('closed: ', i.title) AS reason
FROM {v_items} i JOIN {v_activities} a ON a.activity_id = i.activity_id + 1 WHERE i.status = 'done'"""


@query("swap_items", """
SELECT i.item_id, i.trip_id, coalesce(s.activity_id, i.activity_id) AS activity_id,
       CAST(i.day_date AS VARCHAR) AS day_date, coalesce(s.title, i.title) AS title,
       CASE WHEN s.item_id IS NULL THEN i.status ELSE 'rescheduled' END AS status, i.sort_order,
       s.reason AS reschedule_reason
FROM {v_items} i LEFT JOIN {swaps} s ON s.item_id = i.item_id""", {"swaps": SWAPS})
def _swap_items(t):
    items = t("v_items").withColumn("reschedule_reason", F.lit(None).cast("string"))
    return swap_items(items, t.run(SWAPS, v_items=t("v_items"), v_activities=t("v_activities"))).snapshot


@query("snapshot_diff", """
SELECT m.* REPLACE (CAST(m.day_date AS VARCHAR) AS day_date) FROM {moved} m
JOIN {v_items} i ON i.item_id = m.item_id WHERE m.status <> i.status OR i.sort_order = 6""", MOVED)
def _snapshot_diff(t):
    items, moved = _moved(t)
    return snapshot_diff(items.where("sort_order <> 6"), moved.snapshot)


@query("delete_items", """
SELECT 'kept' AS outcome, item_id, title FROM {v_items}
WHERE trip_id NOT IN (SELECT trip_id FROM {v_trips} WHERE status = 'complete')
UNION ALL
SELECT 'removed', item_id, title FROM {v_items}
WHERE trip_id IN (SELECT trip_id FROM {v_trips} WHERE status = 'complete')""")
def _delete_items(t):
    gone = delete_rows(t("v_items"), t("v_trips").where("status = 'complete'"), ["trip_id"])
    return (gone.snapshot.select(F.lit("kept").alias("outcome"), "item_id", "title")
            .unionByName(gone.removed.select(F.lit("removed").alias("outcome"), "item_id", "title")))


@query("delete_cascade", """
SELECT 'users' AS table_name, count(*) AS n_rows FROM {v_users} WHERE notes IS NOT NULL
UNION ALL SELECT 'trips', count(*) FROM {kept_trips}
UNION ALL SELECT 'itinerary_items', count(*) FROM {v_items} WHERE trip_id IN (SELECT trip_id FROM {kept_trips})
UNION ALL SELECT 'packing_items', count(*) FROM {v_packing} WHERE trip_id IN (SELECT trip_id FROM {kept_trips})""",
       {"kept_trips": """
SELECT trip_id FROM {v_trips} WHERE user_id NOT IN (SELECT user_id FROM {v_users} WHERE notes IS NULL)"""})
def _delete_cascade(t):
    tables = {"users": t("v_users"), "trips": t("v_trips"), "itinerary_items": t("v_items"),
              "packing_items": t("v_packing")}
    left = delete_cascade(tables, "users", t("v_users").where("notes IS NULL"))
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
              for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("align_trips", """
SELECT t.trip_id, t.user_id, t.destination_id, t.title, CAST(coalesce(s.first_day, t.start_date) AS VARCHAR) AS start_date,
       CAST(coalesce(s.last_day, t.end_date) AS VARCHAR) AS end_date, t.status
FROM {v_trips} t LEFT JOIN (
  SELECT destination_id, min(forecast_date) AS first_day, max(forecast_date) AS last_day
  FROM (SELECT destination_id, forecast_date, row_number() OVER (PARTITION BY destination_id ORDER BY forecast_date) AS rn
        FROM (SELECT DISTINCT destination_id, forecast_date FROM {v_weather}) d) x WHERE rn <= 3 GROUP BY 1) s
ON s.destination_id = t.destination_id""")
def _align_trips(t):
    return align_trips(t("v_trips"), t("v_weather")).snapshot


@query("vector_write_back", """
SELECT p_partkey AS activity_id, CAST(e.embedding[1] AS DOUBLE) AS first_value, e.vec_id IS NOT NULL AS has_vector
FROM {part} LEFT JOIN {embeddings} e ON e.vec_id = p_partkey""")
def _vector_write_back(t):
    """Vectors written to rows by key."""
    target = t("v_activities").select("activity_id", F.lit(None).cast("array<float>").alias("embedding"))
    source = latest_per_key(t("embeddings").select(F.col("vec_id").alias("activity_id"), "embedding")
                            .join(target.select("activity_id"), "activity_id", "left_semi"), ["activity_id"],
                            [F.col("embedding")])
    written = upsert(target, source, ["activity_id"], ["embedding"]).snapshot
    return written.select("activity_id", F.get("embedding", F.lit(0)).cast("double").alias("first_value"),
                          F.col("embedding").isNotNull().alias("has_vector"))
