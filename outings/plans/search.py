"""Semantic search over activities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.functions.scalars import round_half_up
from outings.functions.vectors import Embedder, cosine_similarity, embed
from outings.operators.nearest import nearest_vectors
from outings.settings import DEFAULTS
from outings.sources.fetch import spread
from outings.sources.tables import materialized

# Probe texts of the retrieval report.
PROBES = (
    "rainy day indoor activity, art and history",
    "challenging mountain hike with great views",
    "relaxing spot to unwind after a long day",
    "family-friendly walk that is easy and short",
    "cultural landmark to learn local history",
    "water activity on a lake or river",
    "food and local cuisine experience",
    "photography spot with scenery",
)


def embed_queries(queries: DataFrame, embedder: Embedder, batch: int = DEFAULTS.embed_batch) -> DataFrame:
    """Adds ``query_vector``. Every distinct ``query`` text is embedded once, in tasks of a few requests; the result is written out, so that later uses do not call the embedder again."""
    texts = spread(queries.select("query").distinct(), 4 * batch)
    vectors = texts.withColumn("query_vector", embed("query", embedder, batch))
    return materialized(queries.join(vectors, "query"), "query-vectors")


def rank_activities(wanted: DataFrame, activities: DataFrame, k: int | None, embedder: Embedder,
                    query_id: str = "query") -> DataFrame:
    """Top activities for distinct (destination_id, indoor_only, query) rows: destination_id, indoor_only,
    ``query_id``, activity_id, similarity and rank.

    An activity takes part in the open searches of its destination and, when indoors, in the indoor ones.
    ``query_id`` names the query within its destination. Without ``k`` the rows have limits of their own, in ``k``.
    """
    flags = F.when(F.col("is_outdoor"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    corpus = (activities.where(F.col("requirements_embedding").isNotNull())
              .select("destination_id", F.explode(flags).alias("indoor_only"), "activity_id",
                      "requirements_embedding"))
    embedded = embed_queries(wanted, embedder)
    # Only the copies that some search asks for.
    corpus = corpus.join(embedded.select("destination_id", "indoor_only").distinct(), ["destination_id", "indoor_only"], "left_semi")
    k_column = None
    if k is None:
        k, k_column = embedded.agg(F.max("k")).first()[0] or 1, "k"
    return nearest_vectors(embedded, corpus, k, on=["destination_id", "indoor_only"], query_id=query_id,
                           item_id="activity_id", item_vector="requirements_embedding", k_column=k_column)


def semantic_search(queries: DataFrame, activities: DataFrame, embedder: Embedder,
                    k: int = DEFAULTS.top_k) -> DataFrame:
    """The k activities of the destination closest to each query.

    ``queries``: query_id, destination_id, query, indoor_only. Equal queries on a destination are searched once.
    """
    key = ["destination_id", "indoor_only", "query"]
    ranked = rank_activities(queries.select(*key).distinct(), activities, k, embedder)
    described = ranked.join(activities.select("activity_id", "name", "category", "is_outdoor"), "activity_id")
    return (queries.join(described, key)
            .select("query_id", "destination_id", "activity_id", "name", "category", "is_outdoor",
                    round_half_up("similarity", 3).alias("similarity"), "rank"))


def trip_search(trips: DataFrame, query: str, activities: DataFrame, embedder: Embedder,
                k: int = DEFAULTS.top_k, indoor_only: bool = False) -> DataFrame:
    """One text searched for every trip."""
    queries = trips.select(F.col("trip_id").alias("query_id"), "destination_id", F.lit(query).alias("query"),
                           F.lit(indoor_only).alias("indoor_only"))
    return semantic_search(queries, activities, embedder, k).withColumnRenamed("query_id", "trip_id")


def global_search(activities: DataFrame, query: str, embedder: Embedder, k: int = DEFAULTS.top_k) -> DataFrame:
    """The k activities of all destinations closest to one text: a top-k per task, then one merge."""
    vector = F.array(*[F.lit(float(x)) for x in embedder([query])[0]])
    similarity = F.round(cosine_similarity(F.col("requirements_embedding"), vector), 9)
    return (activities.where(F.col("requirements_embedding").isNotNull())
            .select("activity_id", "name", "category", "is_outdoor", similarity.alias("similarity"))
            .where(F.col("similarity").isNotNull() & ~F.isnan("similarity"))
            .orderBy(F.col("similarity").desc(), "activity_id").limit(k)
            .withColumn("similarity", round_half_up("similarity", 3)))


def probe_queries(spark, probes=PROBES) -> DataFrame:
    return spark.createDataFrame([(i, text) for i, text in enumerate(probes)], "query_id long, query string")


