"""Embedding of texts that have no vector yet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.functions.scalars import joined
from outings.functions.vectors import Embedder, embed
from outings.operators.mutation import CHANGE, Mutation
from outings.settings import DEFAULTS, Settings
from outings.sources.fetch import spread


def destination_text() -> Column:
    return F.trim(F.concat(F.col("name"), F.lit(". "), F.coalesce("description", F.lit(""))))


def activity_text(*columns: str) -> Column:
    return F.coalesce(joined(" ", *(columns or ("name", "category", "requirements", "description"))), F.lit(""))


def embed_missing(df: DataFrame, text: Column, vector: str, embedder: Embedder,
                  settings: Settings = DEFAULTS, eligible: Column | None = None) -> Mutation:
    """Fill the null vectors of the eligible rows. Only rows that need a vector reach the embedder; they are dealt
    out evenly in tasks of a few requests, as new rows tend to lie together. Key and vector travel in one row, so nothing is
    joined."""
    eligible = F.lit(True) if eligible is None else eligible
    needed = F.col(vector).isNull() & F.coalesce(eligible, F.lit(False))
    kept = df.where(~needed).withColumn(CHANGE, F.lit(None).cast("string"))
    filled = (spread(df.where(needed), 4 * settings.embed_batch).withColumn(vector, embed(text, embedder, settings.embed_batch))
              .withColumn(CHANGE, F.lit("updated")))
    return Mutation(kept.unionByName(filled))


def embed_destinations(destinations: DataFrame, embedder: Embedder, settings: Settings = DEFAULTS) -> Mutation:
    return embed_missing(destinations, destination_text(), "description_embedding", embedder, settings)


def embed_activities(activities: DataFrame, embedder: Embedder, settings: Settings = DEFAULTS) -> Mutation:
    return embed_missing(activities, activity_text(), "requirements_embedding", embedder, settings)


def embed_users(users: DataFrame, embedder: Embedder, settings: Settings = DEFAULTS) -> Mutation:
    return embed_missing(users, F.col("notes"), "notes_embedding", embedder, settings, F.col("notes").isNotNull())


def embedding_coverage(vectors: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Filled and total per vector column. ``vectors``: label -> (frame, vector column)."""
    parts = [df.agg(F.count_if(F.col(column).isNotNull()).alias("filled"), F.count(F.lit(1)).alias("total"))
             .select(F.lit(label).alias("col"), "filled", "total") for label, (df, column) in vectors.items()]
    coverage = parts[0]
    for part in parts[1:]:
        coverage = coverage.unionByName(part)
    return coverage
