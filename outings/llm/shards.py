"""Sharding by a keyed permutation of global row numbers: shard and slot of any row can be computed, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.llm.common import mixed, prepared
from outings.sources.tables import materialized

ROUNDS = 4


def _feistel(x: np.ndarray, bits: int, key: int, back: bool = False) -> np.ndarray:
    """A permutation of [0, 2^bits). The halves have bits // 2 and the rest; the rounds alternate between them."""
    low_bits = np.uint64(bits // 2)
    low_mask, high_mask = (np.uint64((1 << (bits // 2)) - 1), np.uint64((1 << (bits - bits // 2)) - 1))
    high, low = x >> low_bits, x & low_mask
    for r in (reversed(range(ROUNDS)) if back else range(ROUNDS)):
        if r % 2:
            low = low ^ (mixed(high, key * ROUNDS + r) & low_mask)
        else:
            high = high ^ (mixed(low, key * ROUNDS + r) & high_mask)
    return (high << low_bits) | low


def permute(numbers: np.ndarray, size: int, key: int = 1, back: bool = False) -> np.ndarray:
    """A permutation of [0, size): a number that leaves the range is permuted again until it is back in it."""
    x = np.asarray(numbers, dtype=np.uint64).copy()
    if size <= 1:
        return x.astype(np.int64)
    bits = (size - 1).bit_length()
    open_ = np.arange(len(x))
    while len(open_):
        x[open_] = _feistel(x[open_], bits, key, back)
        open_ = open_[x[open_] >= np.uint64(size)]
    return x.astype(np.int64)


def place(numbers: np.ndarray, size: int, shards: int, key: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers: the permuted number is dealt out in turn, so shard sizes differ by one at most."""
    at = permute(numbers, size, key)
    return at % shards, at // shards


def row_at(shard: np.ndarray, slot: np.ndarray, size: int, shards: int, key: int = 1) -> np.ndarray:
    """The row number that sits in a slot of a shard."""
    return permute(np.asarray(slot, np.int64) * shards + np.asarray(shard, np.int64), size, key, back=True)


def numbered(rows: DataFrame, order: list[str], number: str = "row_number") -> DataFrame:
    """Rows numbered 0, 1, ... in ``order``, whatever the partitions.

    Sorted by ranges (equal keys may be cut), written once, counted per file partition; the offsets of the partitions
    are the only thing that is added up on the driver, one row per partition.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    ranged = ranged.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    # monotonically_increasing_id is the partition in the upper 31 bits and the row in the lower 33.
    stored = materialized(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = {r["p"]: r["n"] for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    table = F.broadcast(spark.createDataFrame(offsets, "_part long, _offset long"))
    return (stored.withColumn("_part", part).join(table, "_part")
            .withColumn(number, F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_offset"))


def shard_rows(docs: DataFrame, shards: int = 24, key: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard for every row; law is ``rows``.

    A row's number is its rank by (doc_id, size, crc, text hash), nulls first; rows equal in all of these are
    interchangeable. Texts are only read for size and hash; what is sorted is a few integers per row. Defined cases: a null
    text has size 8 and null crc; a null doc_id is a row like any other; no rows give no rows; extra columns are
    ignored.
    """
    text = docs[text_col]
    rows = prepared(docs).select(
        docs[id_col].alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))
    rows = numbered(rows, ["doc_id", "size", "text_crc32", "text_hash"])
    total = rows.count()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            shard, slot = place(batch.column("row_number").to_numpy(), total, shards, key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "size", "text_crc32", "row_number")]
                + [pa.array(["rows"] * n, pa.string()), pa.array(shard.astype(np.int32)), pa.array(slot), pa.nulls(n, pa.int32())],
                names=["doc_id", "size", "text_crc32", "row_number", "law", "shard", "slot", "grown_shard"])

    return rows.drop("text_hash").mapInArrow(
        deal, f"doc_id {dict(rows.dtypes)['doc_id']}, size long, text_crc32 long, row_number long, law string, shard int, "
              "slot long, grown_shard int")


def write_shards(docs: DataFrame, path: str, shards: int = 24, key: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the rows of ``docs`` to ``path``, one folder per shard, sorted by slot within every file.

    Documents are joined to their place by id and text hash; rows equal in both are told apart by a running number.
    A shard is written by as many tasks as its size asks for.
    """
    shard, slot = "shard", "slot"
    placed = shard_rows(docs, shards, key, id_col, text_col).select("doc_id", "size", "text_crc32", shard, slot)
    same = [F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy(*same).orderBy("slot", "shard"))
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long")
    left = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("doc_id"), size.alias("size"),
                       F.crc32(docs[text_col].cast("binary")).alias("text_crc32"))
    left = left.withColumn("turn", F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("row"))))
    right = placed.withColumn("turn", turn)
    on = [left[c].eqNullSafe(right[c]) for c in ("doc_id", "size", "text_crc32", "turn")]
    joined = left.join(right, on).select("row", right[shard].alias("shard"), right[slot].alias("slot"))
    (joined.hint("rebalance", "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
