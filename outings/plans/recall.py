"""Recall of approximate against exact search."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.functions.vectors import Embedder
from outings.operators.nearest import nearest_to_few
from outings.plans.search import PROBES, embed_queries, probe_queries
from outings.settings import DEFAULTS
from outings.sources.tables import materialized


def recall_per_query(queries: DataFrame, exact: DataFrame, approximate: DataFrame, query_id: str = "query_id",
                     item_id: str = "item_id") -> DataFrame:
    """For every query: exact and approximate result sizes, their overlap and recall (overlap / exact size)."""
    found = (exact.select(query_id, item_id, F.lit(True).alias("_exact"))
             .join(approximate.select(query_id, item_id, F.lit(True).alias("_approximate")), [query_id, item_id],
                   "full"))
    counts = found.groupBy(query_id).agg(
        F.count("_exact").alias("exact_k"), F.count("_approximate").alias("returned"),
        F.count_if(F.col("_exact") & F.col("_approximate")).alias("overlap"))
    sizes = ["exact_k", "returned", "overlap"]
    return (queries.select(query_id).join(counts, query_id, "left")
            .select(query_id, *[F.coalesce(c, F.lit(0)).alias(c) for c in sizes])
            .withColumn("_recall", F.col("overlap") / F.greatest("exact_k", F.lit(1)))
            .withColumn("recall_at_k", F.bround("_recall", 3)))


def recall_summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.bround(F.avg("_recall"), 3).alias("mean_recall_at_k"),
                         F.bround(F.avg("returned"), 2).alias("mean_rows_returned"),
                         F.count(F.lit(1)).alias("n_probes"))


def recall_report(queries: DataFrame, exact: DataFrame, searches: Mapping[str, DataFrame],
                  query_id: str = "query_id", item_id: str = "item_id") -> DataFrame:
    """One summary row per search. The exact result is computed once, into the shared folder."""
    truth = materialized(exact.select(query_id, item_id), "exact-neighbours")
    report = None
    for label, found in searches.items():
        row = recall_summary(recall_per_query(queries, truth, found, query_id, item_id))
        row = row.select(F.lit(label).alias("search"), "*")
        report = row if report is None else report.unionByName(row)
    return report


def evaluate_retrieval(activities: DataFrame, embedder: Embedder, approximate: Callable[[DataFrame, DataFrame, int], DataFrame],
                       k: int = DEFAULTS.top_k, probes: Sequence[str] = PROBES) -> DataFrame:
    """Recall of ``approximate(queries, corpus, k)`` for probe texts over all activities that have a vector."""
    queries = embed_queries(probe_queries(activities.sparkSession, probes), embedder)
    corpus = (activities.where(F.col("requirements_embedding").isNotNull())
              .select(F.col("activity_id").alias("item_id"), F.col("requirements_embedding").alias("embedding")))
    scored = recall_per_query(queries, nearest_to_few(queries, corpus, k), approximate(queries, corpus, k))
    return queries.select("query_id", "query").join(scored, "query_id")
