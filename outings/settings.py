"""Tunable values and the Spark SQL settings the library expects."""

from __future__ import annotations

import importlib
import os
import tempfile
import zipfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

# Adaptive execution splits the partitions of a join in which one key holds a large share of the rows, also where
# the split costs one more shuffle; all stored instants are UTC. Arrow batches are bounded by size, because a row may
# hold a whole block of vectors. Small partitions may stay apart, because the work per byte of a plan or a search is high. Shuffle files go
# when what they were written for has ended, not when the driver collects its garbage: a query has many steps, and writes what is used again.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 * 1024 * 1024),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

# Values for a session that does not state its own. Short rows are many times larger in the sorts and hash tables of a task than in a
# file, so a task reads less than the 64 MB of a shuffle and the 128 MB of a table that Spark takes.
UNLESS_STATED = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}


def apply_sql_settings(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    for key, value in UNLESS_STATED.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


_shipped: set[str] = set()


def ship_packages(spark: SparkSession, *packages: str) -> None:
    """Send Python packages to the workers, once per application, so that plans with Python parts run on executors
    where they are not installed. Always includes this one."""
    context = spark.sparkContext
    for name in ("outings", *packages):
        key = f"{context.applicationId}/{name}"
        if key in _shipped:
            continue
        folder = Path(importlib.import_module(name).__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(folder.rglob("*.py")):
                out.write(file, file.relative_to(folder.parent))
        context.addPyFile(str(archive))
        _shipped.add(key)


@dataclass(frozen=True)
class Settings:
    rain_prob_threshold: int = 60
    aqi_threshold: int = 100
    cold_at_most_c: float = 8.0
    hot_at_least_c: float = 25.0
    top_k: int = 5
    activities_per_day: int = 3
    embedding_dim: int = 1024
    embed_batch: int = 100
    catalog: str | None = None
    schema: str | None = None
    write_tables: bool = True

    @classmethod
    def from_env(cls, env=os.environ) -> Settings:
        """Read the values a deployment may override from environment variables."""
        return cls(
            rain_prob_threshold=int(env.get("RAIN_PROB_THRESHOLD", cls.rain_prob_threshold)),
            aqi_threshold=int(env.get("AQI_THRESHOLD", cls.aqi_threshold)),
            top_k=int(env.get("RETRIEVAL_TOP_K", cls.top_k)),
            embedding_dim=int(env.get("EMBEDDING_DIM", cls.embedding_dim)),
            catalog=env.get("OUTINGS_CATALOG") or None,
            schema=env.get("OUTINGS_SCHEMA") or None,
            write_tables=env.get("OUTINGS_WRITE_TABLES", "true").lower() == "true",
        )


DEFAULTS = Settings()
