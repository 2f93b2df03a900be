"""Table reads and writes."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from outings.schemas import DDL
from outings.settings import DEFAULTS, Settings

log = logging.getLogger(__name__)


def read_table(spark: SparkSession, location: str, table: str | None = None) -> DataFrame:
    """Read Parquet files; the columns of a known table are read with its declared types."""
    reader = spark.read if table is None else spark.read.schema(DDL[table])
    return reader.parquet(location)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int,
              properties: Mapping[str, str] | None = None) -> DataFrame:
    """Read a database table in key ranges, one range per task."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions,
                           properties=dict(properties or {}))


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000,
               properties: Mapping[str, str] | None = None) -> None:
    """Append to a database table in batches, each task over its own connection."""
    df.write.option("batchsize", batch).jdbc(url, table, mode="append", properties=dict(properties or {}))


def rows_to_frame(spark: SparkSession, rows, schema: StructType | str) -> DataFrame:
    """A small list of rows with declared types; empty lists keep the columns."""
    return spark.createDataFrame(rows, schema)


def preview(spark: SparkSession, table: str, rows: int = 15) -> DataFrame:
    return spark.table(table).limit(rows)


def quote(identifier: str) -> str:
    """An identifier in backticks, whether or not it has them already."""
    name = identifier.strip()
    if len(name) >= 2 and name[0] == name[-1] == "`":
        return name
    return "`" + name.replace("`", "``") + "`"


def target_schema(spark: SparkSession, catalog: str | None = None, schema: str | None = None,
                  settings: Settings = DEFAULTS) -> str:
    """Where tables go: the arguments, else the settings, else the session's current catalog and schema."""
    catalog = catalog or settings.catalog or spark.catalog.currentCatalog()
    schema = schema or settings.schema or spark.catalog.currentDatabase()
    return f"{quote(catalog)}.{quote(schema)}"


@dataclass(frozen=True)
class Written:
    """Outcome of a table write: "written", "skipped" or "failed"."""

    table: str
    status: str
    error: str | None = None


def save(df: DataFrame, table: str, mode: str, catalog: str | None = None, schema: str | None = None,
         settings: Settings = DEFAULTS, on_error: str = "warn", partition_by: str | None = None) -> Written:
    """Save as a managed table. With ``on_error="warn"`` a failure is logged and returned, not raised.

    ``mode`` is "append" or "overwrite"; an overwrite may change the columns.
    """
    spark = df.sparkSession
    where = target_schema(spark, catalog, schema, settings)
    name = f"{where}.{quote(table)}"
    if not settings.write_tables:
        return Written(name, "skipped")
    try:
        try:
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {where}")
        except Exception as error:
            log.warning("cannot create %s, using it as it is: %s", where, error)
        writer = (by_partition(df, partition_by) if partition_by else df).write.mode(mode).format("parquet")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.saveAsTable(name)
    except Exception as error:
        if on_error == "raise":
            raise
        log.warning("table %s was not written: %s", name, error)
        return Written(name, "failed", str(error))
    return Written(name, "written")


def append_bronze(df: DataFrame, path: str, now=None) -> None:
    """Append raw rows with the time of the ingest, in one folder per ingest day."""
    stamped = df.withColumn("_ingested_at", F.current_timestamp() if now is None else now)
    (by_partition(stamped.withColumn("_ingest_date", F.to_date("_ingested_at")), "_ingest_date")
     .write.mode("append").partitionBy("_ingest_date").parquet(path))


@contextmanager
def footer_reads(spark: SparkSession) -> Iterator[None]:
    """Inside the block, counts and extremes of whole Parquet tables are planned as reads of file footers."""
    old = {name: spark.conf.get(name) for name in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")}
    others = [name for name in old["spark.sql.sources.useV1SourceList"].split(",") if name.strip().lower() != "parquet"]
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(others))
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def footer_frame(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """One row with the number of rows and the extremes of number and date columns of a Parquet table; planned inside ``footer_reads``
    it reads the statistics of the files only."""
    ends = [end(c).alias(f"{name}_{c}") for c in columns for name, end in (("least", F.min), ("greatest", F.max))]
    return spark.read.parquet(path).agg(F.count("*").alias("rows"), *ends)


def footer_summary(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[int, dict[str, tuple]]:
    """Number of rows, and least and greatest value of each column."""
    with footer_reads(spark):
        row = footer_frame(spark, path, columns).first()
    return row["rows"], {c: (row[f"least_{c}"], row[f"greatest_{c}"]) for c in columns}


_owned: ContextVar[list[str] | None] = ContextVar("owned", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Intermediate folders that are written inside the block are removed when it ends, however it ends; what is made of them has
    to be written or collected before."""
    token = _owned.set([])
    try:
        yield _owned.get()
    finally:
        folders = _owned.get()
        _owned.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one the cluster names for checkpoints; only a local session may go without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        base = tempfile.mkdtemp(prefix="outings-")
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if _owned.get() is not None:
        _owned.get().append(folder)
    return folder


def write_snapshot(df: DataFrame, root: str, partition_by: str | None = None) -> str:
    """Write a new snapshot next to the older ones and return its path; nothing that is being read is touched."""
    path = f"{root.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    if partition_by:
        by_partition(df, partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return path


def by_partition(df: DataFrame, column: str) -> DataFrame:
    """Rows of a partition together, in tasks of the advisory size: few files, and a large partition is split."""
    return df.hint("rebalance", column)


def replace_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Replace the partitions that ``df`` has rows for and leave the others; ``df`` must not be read from ``path``."""
    (by_partition(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition_by).parquet(path))


def materialized(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: one computation, and no lineage to repeat."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, make: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """``make()`` as ``materialized`` writes it; the intermediate folders that are written on the way are removed then."""
    path = shared_folder(spark, purpose)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
