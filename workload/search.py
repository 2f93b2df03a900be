"""Vectors: embedding, search, recall, and the plans that search."""

from __future__ import annotations

from pyspark.sql import functions as F

from outings.functions.scalars import round_half_up
from outings.functions.vectors import HashEmbedder
from outings.operators.approximate import (assign_cells, assign_tree, build_cells, index_buckets, load_buckets, load_cells, load_tree,
                                           search_buckets, search_cells, search_index, search_tree, store_buckets, store_cells, store_tree)
from outings.operators.nearest import nearest_to_few, nearest_vectors
from outings.plans.embedding import activity_text, destination_text, embed_missing, embedding_coverage
from outings.plans.itinerary import apply_plan, generate_itinerary, reschedule_for_weather
from outings.plans.recall import evaluate_retrieval, recall_per_query, recall_report
from outings.plans.search import PROBES, embed_queries, global_search, probe_queries, semantic_search
from outings.settings import Settings
from outings.sources.tables import materialized, shared_folder
from workload.registry import query
from workload.weather import TRIP_DAY_VIEWS

DIM = 64
EMBEDDER = HashEmbedder(DIM)


def hash_vectors(texts: str) -> dict[str, str]:
    """Views that embed the ``query`` column of view ``texts`` like ``HashEmbedder``."""
    return {
        "word_counts": f"""
SELECT query, place, count(*) AS n FROM (
  SELECT query, CAST(concat('0x', left(md5(word), 8)) AS BIGINT) % {DIM} AS place FROM (
    SELECT query, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS word FROM {{{texts}}}) w) p
GROUP BY query, place""",
        "text_vectors": f"""
SELECT q.query, list(CAST(CAST(coalesce(c.n, 0) / q.norm AS FLOAT) AS DOUBLE) ORDER BY r.place) AS vec
FROM (SELECT query, sqrt(sum(n * n)) AS norm FROM {{word_counts}} GROUP BY query) q
CROSS JOIN (SELECT unnest(range({DIM})) AS place) r
LEFT JOIN {{word_counts}} c ON c.query = q.query AND c.place = r.place GROUP BY q.query"""}


def hits(pairs: str, keep: str) -> str:
    """Rank pairs (with ``sim``) inside ``keep``, the way the library does."""
    return f"""
SELECT *, row_number() OVER (PARTITION BY {keep} ORDER BY sim DESC, activity_id) AS rn FROM ({pairs}) s"""


SIM = "round(list_cosine_similarity(CAST(a.requirements_embedding AS DOUBLE[]), v.vec), 9) AS sim"
SEARCH_TEXT = "concat(interest, ' trip outdoors')"


def search_views(indoor: bool) -> dict[str, str]:
    only = "AND NOT a.is_outdoor" if indoor else ""
    return {
        "wishes": f"""
SELECT t.trip_id, t.destination_id, {SEARCH_TEXT} AS query FROM {{v_trips}} t JOIN {{v_users}} u ON u.user_id = t.user_id""",
        "texts": "SELECT DISTINCT query FROM {wishes}", **hash_vectors("texts"),
        "ranked": hits(f"""
SELECT w.destination_id, w.query, a.activity_id, a.name, a.category, a.is_outdoor, {SIM}
FROM (SELECT DISTINCT destination_id, query FROM {{wishes}}) w JOIN {{text_vectors}} v ON v.query = w.query
JOIN {{v_activities}} a ON a.destination_id = w.destination_id
WHERE a.requirements_embedding IS NOT NULL {only}""", "destination_id, query")}


SEARCH_SQL = """
SELECT w.trip_id AS query_id, w.destination_id, r.activity_id, r.name, r.category, r.is_outdoor,
       CAST(round(CAST(r.sim AS DECIMAL(18,9)), 3) AS DOUBLE) AS similarity, CAST(r.rn AS INT) AS rank
FROM {wishes} w JOIN {ranked} r ON r.destination_id = w.destination_id AND r.query = w.query WHERE r.rn <= 5"""


def _semantic(t, indoor: bool):
    wishes = (t("v_trips").join(t("v_users").select("user_id", "interest"), "user_id")
              .select(F.col("trip_id").alias("query_id"), "destination_id",
                      F.concat("interest", F.lit(" trip outdoors")).alias("query"),
                      F.lit(indoor).alias("indoor_only")))
    return semantic_search(wishes, t("v_activities"), EMBEDDER)


@query("semantic_topk", SEARCH_SQL, search_views(False))
def _semantic_topk(t):
    return _semantic(t, False)


@query("semantic_topk_indoor", SEARCH_SQL, search_views(True))
def _semantic_topk_indoor(t):
    return _semantic(t, True)


GLOBAL_TEXT = "rainy day indoor activity, art and history"


@query("global_topk", f"""
SELECT a.activity_id, a.name, a.category, a.is_outdoor,
       CAST(round(CAST(a.sim AS DECIMAL(18,9)), 3) AS DOUBLE) AS similarity
FROM (SELECT a.*, {SIM} FROM {{v_activities}} a, {{text_vectors}} v WHERE a.requirements_embedding IS NOT NULL) a
ORDER BY sim DESC, activity_id LIMIT 5""",
       {"texts": f"SELECT '{GLOBAL_TEXT}' AS query", **hash_vectors("texts")})
def _global_topk(t):
    return global_search(t("v_activities"), GLOBAL_TEXT, EMBEDDER)


EXACT = """
SELECT query_id, item_id, CAST(round(CAST(sim AS DECIMAL(18,9)), 6) AS DOUBLE) AS similarity, CAST(rn AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rn FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS item_id,
           round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim
    FROM {embeddings} a, {embeddings} b) p) r WHERE rn <= 5"""


def _vectors(t):
    corpus = t("embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return corpus.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector")), corpus


def _shown(found):
    return found.select("query_id", "item_id", round_half_up("similarity", 6).alias("similarity"), "rank")


@query("neighbours_exact", EXACT)
def _neighbours_exact(t):
    queries, corpus = _vectors(t)
    return _shown(nearest_vectors(queries, corpus, 5))


CUT = {"cut": "SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN embedding[1:32] ELSE embedding END AS embedding FROM {embeddings}"}


@query("neighbours_mixed_lengths", EXACT.replace("{embeddings} a, {embeddings} b",
                                                 "{cut} a JOIN {cut} b ON len(a.embedding) = len(b.embedding)"), CUT)
def _neighbours_mixed_lengths(t):
    """Some vectors are cut short: they meet only each other."""
    queries, corpus = _vectors(t)
    short = F.col("item_id") % 7 == 3
    corpus = corpus.withColumn("embedding", F.when(short, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    queries = corpus.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return _shown(nearest_vectors(queries, corpus, 5))


CELLS = 16


@query("neighbours_all_cells", EXACT)
def _neighbours_all_cells(t):
    """A cell search that visits every cell is exact."""
    queries, corpus = _vectors(t)
    return _shown(search_cells(queries, build_cells(corpus, CELLS), 5, probes=CELLS))


PROBED = 4
ASSIGNED = """
SELECT vec_id, embedding, cell, rn FROM (
  SELECT a.vec_id, a.embedding, c.vec_id AS cell, row_number() OVER (PARTITION BY a.vec_id ORDER BY
         round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 9) DESC, c.vec_id) AS rn
  FROM {embeddings} a, {embeddings} c WHERE c.vec_id < 16) x WHERE rn <= 4"""


@query("search_given_cells", EXACT.replace("{embeddings} a, {embeddings} b", "{assigned} a JOIN {assigned} b ON b.rn = 1 AND a.cell = b.cell"),
       {"assigned": ASSIGNED})
def _search_given_cells(t):
    """A search that really is approximate, exact against its twin: 16 given centres, 4 cells visited, index on files."""
    queries, corpus = _vectors(t)
    centres = corpus.where(f"item_id < {CELLS}").select(F.col("item_id").alias("cell"), F.col("embedding").alias("centre"))
    folder = shared_folder(t.spark, "cells")
    store_cells(assign_cells(corpus, centres), folder)
    return _shown(search_cells(queries, load_cells(t.spark, folder), 5, PROBED))


def _sim(a: str, b: str) -> str:
    return f"round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 9)"


TREE = {
    "top_of": f"""
SELECT * FROM (SELECT a.vec_id, a.embedding, p.vec_id AS top, row_number() OVER (
    PARTITION BY a.vec_id ORDER BY {_sim("a.embedding", "p.embedding")} DESC, p.vec_id) AS rn
  FROM {{embeddings}} a, {{embeddings}} p WHERE p.vec_id < 4) x WHERE rn <= 2""",
    "cell_of": f"""
SELECT t.vec_id, t.embedding, t.rn, t.top, c.vec_id AS cell, {_sim("t.embedding", "c.embedding")} AS sim
FROM {{top_of}} t JOIN {{top_of}} c ON c.rn = 1 AND c.top = t.top AND c.vec_id < 24""",
    "at_home": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cell) AS place FROM {cell_of} WHERE rn = 1) x WHERE place = 1""",
    "calls": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cell) AS place FROM {cell_of}) x WHERE place <= 5"""}


@query("search_given_tree", EXACT.replace("{embeddings} a, {embeddings} b", "{calls} a JOIN {at_home} b ON a.cell = b.cell"), TREE)
def _search_given_tree(t):
    """Two levels of given centres, stored; two tops and five of their cells are visited."""
    queries, corpus = _vectors(t)
    tops = corpus.where("item_id < 4").select(F.col("item_id").alias("top"), F.col("embedding").alias("centre"))
    cells = corpus.where("item_id < 24")
    home = nearest_vectors(cells, tops, 1, query_id="item_id", query_vector="embedding", item_id="top", item_vector="centre")
    centres = cells.join(home.select("item_id", "top"), "item_id").select("top", F.col("item_id").alias("cell"), F.col("embedding").alias("centre"))
    folder = shared_folder(t.spark, "tree")
    store_tree(assign_tree(corpus, tops, centres), folder)
    return _shown(search_tree(queries, load_tree(t.spark, folder), 5, 5, 2))


@query("recall_given_cells", """
SELECT v.vec_id AS query_id, count(e.item_id) AS exact_k, (SELECT count(*) FROM {near} n WHERE n.query_id = v.vec_id) AS returned,
       count(n.item_id) AS overlap, CAST(round_even(count(n.item_id) / greatest(count(e.item_id), 1), 3) AS DOUBLE) AS recall_at_k
FROM {embeddings} v LEFT JOIN {exact} e ON e.query_id = v.vec_id LEFT JOIN {near} n ON n.query_id = v.vec_id AND n.item_id = e.item_id
GROUP BY v.vec_id""", {"assigned": ASSIGNED, "exact": EXACT, "near": EXACT.replace(
    "{embeddings} a, {embeddings} b", "{assigned} a JOIN {assigned} b ON b.rn = 1 AND a.cell = b.cell")})
def _recall_given_cells(t):
    """The recall of an approximate search, query by query."""
    queries, corpus = _vectors(t)
    centres = corpus.where(f"item_id < {CELLS}").select(F.col("item_id").alias("cell"), F.col("embedding").alias("centre"))
    folder = shared_folder(t.spark, "cells")
    store_cells(assign_cells(corpus, centres), folder)
    found = search_cells(queries, load_cells(t.spark, folder), 5, PROBED)
    return recall_per_query(queries, nearest_vectors(queries, corpus, 5), found).drop("_recall")


TABLES, BITS, PROBES_PER_TABLE = 4, 4, 3
PLANES = {
    "margins": f"""
SELECT v.vec_id, v.embedding, p.vec_id // {BITS} AS tab, p.vec_id % {BITS} AS bit,
       round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])), 9) AS margin
FROM {{embeddings}} v, {{embeddings}} p WHERE p.vec_id < {TABLES * BITS}""",
    "buckets": """
SELECT vec_id, any_value(embedding) AS embedding, tab, CAST(sum(CASE WHEN margin > 0 THEN 1 << bit ELSE 0 END) AS BIGINT) AS bucket
FROM {margins} GROUP BY vec_id, tab""",
    "prices": f"""
SELECT vec_id, tab, mask, sum(CASE WHEN (mask >> bit) & 1 = 1 THEN round(margin * margin, 12) ELSE 0 END) AS price
FROM {{margins}}, (SELECT unnest(range({1 << BITS})) AS mask) m GROUP BY vec_id, tab, mask""",
    "visits": f"""
SELECT b.vec_id, b.embedding, b.tab, xor(b.bucket, p.mask) AS bucket
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, tab ORDER BY price, mask) AS rn FROM {{prices}}) p
JOIN {{buckets}} b ON b.vec_id = p.vec_id AND b.tab = p.tab WHERE p.rn <= {PROBES_PER_TABLE}""",
    "met": """
SELECT DISTINCT q.vec_id AS query_id, b.vec_id AS item_id,
       round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sim
FROM {visits} q JOIN {buckets} b ON b.tab = q.tab AND b.bucket = q.bucket"""}


def _plane_index(t, corpus):
    """The first vectors are the planes; the index goes through files."""
    first = corpus.where(f"item_id < {TABLES * BITS}")
    directions = first.select((F.col("item_id") / BITS).cast("int").alias("table"), (F.col("item_id") % BITS).cast("int").alias("bit"),
                              F.col("embedding").alias("direction"))
    folder = shared_folder(t.spark, "buckets")
    store_buckets(index_buckets(corpus, directions), folder)
    return load_buckets(t.spark, folder)


@query("search_given_planes", """
SELECT query_id, item_id, CAST(round(CAST(sim AS DECIMAL(18,9)), 6) AS DOUBLE) AS similarity, CAST(rn AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rn FROM {met}) r WHERE rn <= 5""", PLANES)
def _search_given_planes(t):
    """A stored hash index with several probes per table, in the order of the distance to the planes."""
    queries, corpus = _vectors(t)
    return _shown(search_index(queries, _plane_index(t, corpus), 5, PROBES_PER_TABLE))


@query("recall_cells")
def _recall_cells(t):
    queries, corpus = _vectors(t)
    index = build_cells(corpus, CELLS)
    searches = {f"{probes} of {CELLS} cells": search_cells(queries, index, 5, probes) for probes in (1, 4, CELLS)}
    return recall_report(queries, nearest_vectors(queries, corpus, 5), searches)


@query("recall_buckets")
def _recall_buckets(t):
    queries, corpus = _vectors(t)
    found = search_buckets(queries, corpus, 5, DIM, tables=12, bits=5)
    return recall_per_query(queries, nearest_vectors(queries, corpus, 5), found).drop("_recall")


@query("recall_exact", """
SELECT vec_id AS query_id, CAST(5 AS BIGINT) AS exact_k, CAST(5 AS BIGINT) AS returned, CAST(5 AS BIGINT) AS overlap,
       CAST(1.0 AS DOUBLE) AS recall_at_k FROM {embeddings}""")
def _recall_exact(t):
    """The recall report of a search that visits every cell."""
    queries, corpus = _vectors(t)
    found = search_cells(queries, build_cells(corpus, CELLS), 5, probes=CELLS)
    return recall_per_query(queries, nearest_vectors(queries, corpus, 5), found).drop("_recall")


@query("probe_neighbours", f"""
SELECT query, activity_id AS item_id, CAST(round(CAST(sim AS DECIMAL(18,9)), 6) AS DOUBLE) AS similarity, CAST(rn AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, activity_id) AS rn FROM (
    SELECT v.query, a.activity_id, {SIM} FROM {{v_activities}} a, {{text_vectors}} v WHERE a.requirements_embedding IS NOT NULL) p
  WHERE sim IS NOT NULL AND NOT isnan(sim)) r WHERE rn <= 5""",
       {"texts": "SELECT unnest(['" + "', '".join(PROBES) + "']) AS query", **hash_vectors("texts")})
def _probe_neighbours(t):
    """The probe texts go to the corpus, which is not shuffled."""
    queries = embed_queries(probe_queries(t.spark), EMBEDDER)
    corpus = t("v_activities").select(F.col("activity_id").alias("item_id"), F.col("requirements_embedding").alias("embedding"))
    found = nearest_to_few(queries, corpus, 5).join(queries.select("query_id", "query"), "query_id")
    return found.select("query", "item_id", round_half_up("similarity", 6).alias("similarity"), "rank")


@query("probe_recall", """
SELECT query, CAST(5 AS BIGINT) AS exact_k, CAST(5 AS BIGINT) AS returned, CAST(5 AS BIGINT) AS overlap,
       CAST(1.0 AS DOUBLE) AS recall_at_k
FROM (VALUES """ + ", ".join(f"('{text}')" for text in PROBES) + """) AS p(query)
WHERE (SELECT count(*) FROM {v_activities} WHERE requirements_embedding IS NOT NULL) >= 5""")
def _probe_recall(t):
    def every_cell(queries, corpus, k):
        return search_cells(queries, build_cells(corpus, CELLS), k, probes=CELLS)

    scored = evaluate_retrieval(t("v_activities"), EMBEDDER, every_cell)
    return scored.select("query", "exact_k", "returned", "overlap", "recall_at_k")


@query("embedding_texts", """
SELECT 'destination' AS kind, destination_id AS id, trim(concat(name, '. ', coalesce(description, ''))) AS text
FROM {v_destinations}
UNION ALL SELECT 'activity', activity_id, concat_ws(' ', nullif(name, ''), nullif(category, '')) FROM {v_activities}
UNION ALL SELECT 'user', user_id, notes FROM {v_users} WHERE notes IS NOT NULL""")
def _embedding_texts(t):
    def texts(kind, view, key, text):
        return t(view).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), text.alias("text"))

    return (texts("destination", "v_destinations", "destination_id", destination_text())
            .unionByName(texts("activity", "v_activities", "activity_id", activity_text("name", "category")))
            .unionByName(texts("user", "v_users", "user_id", F.col("notes")).where("text IS NOT NULL")))


@query("embed_text_hash", """
SELECT d.doc_id, c.place, CAST(round(CAST(CAST(c.n / q.norm AS FLOAT) AS DOUBLE), 6) AS DOUBLE) AS weight
FROM (SELECT DISTINCT doc_id, text AS query FROM {documents}) d JOIN {word_counts} c ON c.query = d.query
JOIN (SELECT query, sqrt(sum(n * n)) AS norm FROM {word_counts} GROUP BY query) q ON q.query = d.query""",
       {"texts": "SELECT DISTINCT text AS query FROM {documents}", **hash_vectors("texts")})
def _embed_text_hash(t):
    texts = t("documents").select("doc_id", "text", F.lit(None).cast("array<float>").alias("vector"))
    done = embed_missing(texts, F.col("text"), "vector", EMBEDDER).snapshot
    return (done.select("doc_id", F.posexplode("vector").alias("place", "weight"))
            .where(F.col("weight") > 0)
            .select("doc_id", F.col("place").cast("long").alias("place"),
                    F.round(F.col("weight").cast("double"), 6).alias("weight")))


@query("embedding_coverage", """
SELECT 'activities.requirements_embedding' AS col, count(*) FILTER (WHERE requirements_embedding IS NOT NULL) AS filled,
       count(*) AS total FROM {v_activities}
UNION ALL SELECT 'users.notes_embedding', count(*) FILTER (WHERE notes IS NOT NULL), count(*) FROM {v_users}
UNION ALL SELECT 'activities after the job', count(*), count(*) FROM {v_activities}""")
def _embedding_coverage(t):
    users = t("v_users").withColumn("notes_embedding", F.lit(None).cast("array<float>"))
    embedded = embed_missing(users, F.col("notes"), "notes_embedding", EMBEDDER, eligible=F.col("notes").isNotNull())
    activities = t("v_activities")
    filled = embed_missing(activities, F.concat_ws(" ", "name", "category"), "requirements_embedding", EMBEDDER)
    return embedding_coverage({"activities.requirements_embedding": (activities, "requirements_embedding"),
                               "users.notes_embedding": (embedded.snapshot, "notes_embedding"),
                               "activities after the job": (filled.snapshot, "requirements_embedding")})


def _interests(t):
    return t("v_users").select("user_id", F.array("interest").alias("interests"))


N = 2
PLAN_VIEWS = {
    **TRIP_DAY_VIEWS,
    "wanted": """
SELECT DISTINCT t.destination_id, u.interest, k.indoor_only,
       concat(u.interest, CASE WHEN k.indoor_only THEN ' indoor activities' ELSE ' outdoor and indoor activities' END) AS query
FROM {v_trips} t JOIN {v_users} u ON u.user_id = t.user_id CROSS JOIN (VALUES (TRUE), (FALSE)) AS k(indoor_only)""",
    "texts": "SELECT DISTINCT query FROM {wanted}", **hash_vectors("texts"),
    "ranked": hits(f"""
SELECT w.destination_id, w.interest, w.indoor_only, a.activity_id, a.name, a.is_outdoor, {SIM}
FROM {{wanted}} w JOIN {{text_vectors}} v ON v.query = w.query JOIN {{v_activities}} a ON a.destination_id = w.destination_id
WHERE a.requirements_embedding IS NOT NULL AND NOT (w.indoor_only AND a.is_outdoor)""",
                   "destination_id, interest, indoor_only"),
    "plan_days": """
SELECT t.trip_id, t.destination_id, u.interest, t.start_date + CAST(o.step AS INT) AS day_date, o.step,
       coalesce(d.is_bad, FALSE) AS bad
FROM {v_trips} t JOIN {v_users} u ON u.user_id = t.user_id JOIN (SELECT unnest(range(4)) AS step) o
  ON t.start_date + CAST(o.step AS INT) <= t.end_date
LEFT JOIN {trip_days} d ON d.trip_id = t.trip_id AND d.forecast_date = t.start_date + CAST(o.step AS INT)""",
}


def _day_view(step: int) -> str:
    """The picks of one day of every trip, without those of the days before."""
    earlier = " UNION ALL ".join(f"SELECT trip_id, activity_id FROM {{day{s}}}" for s in range(step))
    unused = f"WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) e WHERE e.trip_id = c.trip_id AND e.activity_id = c.activity_id)"
    return f"""
SELECT * FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.trip_id ORDER BY c.place) AS pick FROM (
    SELECT p.trip_id, p.day_date, p.bad, r.activity_id, r.name, r.is_outdoor, r.rn AS place
    FROM {{plan_days}} p JOIN {{ranked}} r ON r.destination_id = p.destination_id AND r.interest = p.interest
     AND r.indoor_only = p.bad WHERE p.step = {step} AND r.rn <= {N * (step + 1)}) c {unused if step else ''}) x
WHERE pick <= {N}"""


PLAN_VIEWS |= {f"day{step}": _day_view(step) for step in range(4)}


@query("generate_itinerary", """
SELECT trip_id, CAST(day_date AS VARCHAR) AS day_date, activity_id, name AS title,
       CASE pick WHEN 1 THEN '09:00' WHEN 2 THEN '12:30' WHEN 3 THEN '15:30' WHEN 4 THEN '18:00' END AS start_time,
       CASE pick WHEN 1 THEN '11:00' WHEN 2 THEN '14:30' WHEN 3 THEN '17:00' WHEN 4 THEN '19:30' END AS end_time,
       CASE WHEN bad THEN 'Indoor pick due to weather' END AS notes, 'planned' AS status,
       CAST(pick AS INT) AS sort_order, NOT is_outdoor AS indoor
FROM (SELECT * FROM {day0} UNION ALL SELECT * FROM {day1} UNION ALL SELECT * FROM {day2} UNION ALL SELECT * FROM {day3}) d""",
       PLAN_VIEWS)
def _generate_itinerary(t):
    return generate_itinerary(t("v_trips"), _interests(t), t("v_activities"), t("v_weather"), EMBEDDER,
                              Settings(activities_per_day=N))


@query("itinerary_applied", """
SELECT item_id, trip_id, activity_id, CAST(day_date AS VARCHAR) AS day_date, title, status, sort_order FROM {v_items}
WHERE trip_id NOT IN (SELECT trip_id FROM {v_trips} WHERE status <> 'complete')
UNION ALL
SELECT (SELECT max(item_id) FROM {kept}) + row_number() OVER (
         ORDER BY left(md5(concat_ws(chr(31), trip_id, day_date, pick)), 3), trip_id, day_date, pick),
       trip_id, activity_id, CAST(day_date AS VARCHAR), name, 'planned', CAST(pick AS INT)
FROM {planned} WHERE trip_id IN (SELECT trip_id FROM {v_trips} WHERE status <> 'complete')""", {
    **PLAN_VIEWS, "planned": """
SELECT * FROM {day0} UNION ALL SELECT * FROM {day1} UNION ALL SELECT * FROM {day2} UNION ALL SELECT * FROM {day3}""",
    "kept": """
SELECT item_id FROM {v_items} WHERE trip_id NOT IN (SELECT trip_id FROM {v_trips} WHERE status <> 'complete')"""})
def _itinerary_applied(t):
    """New plans for the trips still ahead; those that are over keep their items."""
    ahead = t("v_trips").where("status <> 'complete'")
    plan = generate_itinerary(ahead, _interests(t), t("v_activities"), t("v_weather"), EMBEDDER,
                              Settings(activities_per_day=N))
    return apply_plan(t.written("v_items"), materialized(plan, "plan"), ahead).snapshot


CHANGE_VIEWS = {
    **TRIP_DAY_VIEWS,
    "affected": """
SELECT i.item_id, i.trip_id, b.destination_id, i.title, i.day_date, b.bad_reason, g.to_day,
       concat('indoor alternative to ', i.title) AS query
FROM {v_items} i JOIN {v_activities} a ON a.activity_id = i.activity_id AND a.is_outdoor
JOIN {trip_days} b ON b.trip_id = i.trip_id AND b.forecast_date = i.day_date AND b.is_bad
LEFT JOIN (SELECT trip_id, min(forecast_date) AS to_day FROM {trip_days} WHERE NOT is_bad GROUP BY trip_id) g
  ON g.trip_id = i.trip_id""",
    "texts": "SELECT DISTINCT query FROM {affected} WHERE to_day IS NULL", **hash_vectors("texts"),
    "best": "SELECT * FROM (" + hits(f"""
SELECT w.destination_id, w.query, a.activity_id, a.name, {SIM}
FROM (SELECT DISTINCT destination_id, query FROM {{affected}} WHERE to_day IS NULL) w
JOIN {{text_vectors}} v ON v.query = w.query
JOIN {{v_activities}} a ON a.destination_id = w.destination_id AND NOT a.is_outdoor
WHERE a.requirements_embedding IS NOT NULL""", "destination_id, query") + ") b WHERE rn = 1",
    "changes": """
SELECT c.item_id, c.trip_id, c.title,
       CASE WHEN to_day IS NOT NULL THEN 'moved' WHEN b.activity_id IS NOT NULL THEN 'swapped' ELSE 'flagged' END AS action,
       c.day_date AS from_day, c.to_day, b.activity_id AS to_activity_id, b.name AS to_title, c.bad_reason AS cause,
       CASE WHEN to_day IS NOT NULL THEN concat('Moved from ', c.day_date, ' to ', c.to_day, ': ', c.bad_reason, '.')
            WHEN b.activity_id IS NOT NULL
            THEN concat('Swapped outdoor ''', c.title, ''' for indoor ''', b.name, ''': ', c.bad_reason, '.')
            ELSE concat('Flagged: ', c.bad_reason, '. No indoor alternative found.') END AS reason
FROM {affected} c LEFT JOIN {best} b ON c.to_day IS NULL AND b.destination_id = c.destination_id AND b.query = c.query"""}


def _reschedule(t):
    items = t.written("v_items").withColumn("reschedule_reason", F.lit(None).cast("string"))
    return reschedule_for_weather(t("v_trips"), items, t("v_activities"), t("v_weather"), EMBEDDER)


@query("reschedule_for_weather", """
SELECT * REPLACE (CAST(from_day AS VARCHAR) AS from_day, CAST(to_day AS VARCHAR) AS to_day) FROM {changes}""", CHANGE_VIEWS)
def _reschedule_changes(t):
    return _reschedule(t).changes


@query("rescheduled_items", """
SELECT i.item_id, i.trip_id, coalesce(c.to_activity_id, i.activity_id) AS activity_id,
       CAST(coalesce(c.to_day, i.day_date) AS VARCHAR) AS day_date, coalesce(c.to_title, i.title) AS title,
       CASE WHEN c.item_id IS NULL THEN i.status ELSE 'rescheduled' END AS status, i.sort_order, c.reason AS reschedule_reason
FROM {v_items} i LEFT JOIN {changes} c ON c.item_id = i.item_id""", CHANGE_VIEWS)
def _rescheduled_items(t):
    return _reschedule(t).items.snapshot
