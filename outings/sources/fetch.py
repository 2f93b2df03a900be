"""Calls to a service, spread over the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Fetcher = Callable[[dict], dict[str, str | None]]

# Tasks per core that rows are dealt out to at most: enough to even out slow ones. More of them only cost their start.
TASKS_PER_CORE = 16


def spread(rows: DataFrame, per_task: int, partitions: int | None = None) -> DataFrame:
    """The rows dealt out to tasks of about ``per_task`` rows, by a hash of the whole row; to larger ones, where that would be more than
    ``TASKS_PER_CORE`` tasks a core."""
    if partitions is None:
        most = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
        partitions = min(most, max(1, -(-rows.count() // per_task)))
    hashed = [f.name for f in rows.schema if f.dataType.typeName() != "map"]
    return rows.repartition(partitions, F.xxhash64(*hashed))


def fetch_payloads(requests: DataFrame, fetcher: Fetcher, payloads: tuple[str, ...] = ("payload",),
                   per_task: int = 32, partitions: int | None = None) -> DataFrame:
    """Call ``fetcher`` once per request row; it gets the row as a dict and returns the named payloads.

    The request columns come first. A call that raises gives null payloads and its message in ``error``, so
    nothing is lost; ``where("error IS NULL")`` are the answers. Rows are dealt out evenly, about ``per_task`` to a
    task, so the number of tasks follows the number of requests, up to what the cores can use. Write the result before using it more than once: a
    recomputed task calls the service again.
    """
    schema = StructType(list(requests.schema.fields))
    for name in (*payloads, "error"):
        schema = schema.add(name, "string")

    def call(row: dict) -> tuple:
        try:
            answer = fetcher(row)
            return (*[answer.get(name) for name in payloads], None)
        except Exception as error:
            return (*[None] * len(payloads), f"{type(error).__name__}: {error}")

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            answers = pd.DataFrame([call(row) for row in chunk.to_dict("records")],
                                   columns=[*payloads, "error"], index=chunk.index, dtype=object)
            yield pd.concat([chunk, answers], axis=1)

    return spread(requests, per_task, partitions).mapInPandas(run, schema)
