"""Registration of a Spark query together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outings.settings import apply_sql_settings, ship_packages
from outings.sources.tables import materialized
from workload.standins import sql, table

Tables = Callable[[str], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``build(t)``, where ``t(name)`` is a test table or stand-in view. Dates and times go out as text."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_sql_settings(spark)
            ship_packages(spark, "workload")
            return plain(build(Session(spark, sf_dir)))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle, ctes)
        return build

    return register


class Session:
    """The tables of one scale factor; each is built once per query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._tables, self._written = spark, sf_dir, {}, set()

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name, self._tables)

    def written(self, name: str) -> DataFrame:
        """A view that a query uses more than once, written once: its shuffles are not repeated by every use."""
        if name not in self._written:
            self._tables[name] = materialized(self(name), name)
            self._written.add(name)
        return self._tables[name]

    def run(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)


def plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast("string").alias(f.name)
                       if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col(f.name)
                       for f in df.schema])
