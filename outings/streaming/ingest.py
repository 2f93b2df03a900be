"""Streaming forms of the weather ingest.

Silver and serving tables are kept as a change log: every micro-batch writes the first and the last row of each of its
keys, by a declared order of the rows, into a folder named by the batch. A batch that is run again after a failure
replaces its own folder, so it counts once. Reading folds the log into one row per key by the same order, so the
result depends on the rows alone: not on how files fall into batches, nor on how late a row is. Nothing is dropped,
and a batch costs what it holds, not what the table holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from outings.operators.keyed import top_per_group


def new_files(spark: SparkSession, folder: str, schema: StructType | str, glob: str = "*.parquet",
              files_per_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files of a folder; a checkpointed query sees each file once."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def new_json_payloads(spark: SparkSession, folder: str, schema: StructType | str,
                      files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; the next start goes on after it."""
    return (rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def ends_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first and the last row of every key by ``order``; one row where they are the same."""
    first = top_per_group(rows, keys, [F.col(c).asc() for c in order], 1)
    last = top_per_group(rows, keys, [F.col(c).desc() for c in order], 1)
    return first.unionByName(last).distinct()


def upsert_stream(rows: DataFrame, log_path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str],
                  run_once: bool = True) -> StreamingQuery:
    """Write each micro-batch, reduced to the first and last row per key, to its folder of the change log. ``order``
    names the columns that say which row is newer, for instance the time of the ingest and a sequence number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ends_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if run_once else writer).start()


def read_log(spark: SparkSession, log_path: str, schema: StructType | str) -> DataFrame:
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.read.schema(StructType([*schema.fields]).add("batch_id", "long")).parquet(log_path)


def fold_log(log: DataFrame, keys: Sequence[str], order: Sequence[str],
             first_wins: Sequence[str] = ("forecast_date", "source")) -> DataFrame:
    """The table: for each key the values of its last row by ``order``, and those of the first for the columns an upsert
    leaves alone. Rows equal in ``order`` go by their batch. Both ends are cut inside the map tasks, so a key with many
    changes is no burden."""
    values = [c for c in log.columns if c not in (*keys, "batch_id")]
    oldest = [c for c in values if c in first_wins]
    line = [*order, "batch_id"]
    last = top_per_group(log, keys, [F.col(c).desc() for c in line], 1).select(*keys, *[c for c in values if c not in oldest])
    if not oldest:
        return last.select(*keys, *values)
    first = top_per_group(log, keys, [F.col(c).asc() for c in line], 1).select(*[F.col(k).alias(f"_{k}") for k in keys], *oldest)
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return last.join(first, same).select(*keys, *values)


def compacted_log(log: DataFrame, keys: Sequence[str], order: Sequence[str], up_to: int) -> DataFrame:
    """A shorter log that folds to the same table: of the batches up to ``up_to`` only the ends of each key stay, as that
    batch; later batches stay as they are."""
    old = ends_per_key(log.where(F.col("batch_id") <= up_to), keys, [*order, "batch_id"])
    return old.withColumn("batch_id", F.lit(up_to).cast("long")).unionByName(log.where(F.col("batch_id") > up_to))
