"""Latest row per key, top rows per group, and numbering.

A filter on ``row_number`` lets Spark cut every group to its first rows inside each map task, before the shuffle
(WindowGroupLimit), so a key that holds a third of the table sends only a few rows to its task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from outings.sources.tables import materialized


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  rank: str | None = None) -> DataFrame:
    position = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    name = rank or "_position"
    kept = df.withColumn(name, position).where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row per key: the newest. Give an order without ties to get the same survivor on every run."""
    return top_per_group(df, keys, newest_first, 1)


def join_groups(groups: DataFrame, on: Sequence[str], *sides: DataFrame) -> list[DataFrame]:
    """Left join of each side with facts about its large groups, one row per group.

    The groups are written once, so that Spark knows their size in bytes when it plans the joins: few are broadcast, many
    are joined by key, where adaptive execution splits a key that many rows share.
    """
    groups = materialized(groups, "large-groups")
    return [rows.join(groups, list(on), "left") for rows in sides]


def _blocked(df: DataFrame, sequence: str, block_rows: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(sequence) / block_rows).cast("long"))


def rows_before_blocks(df: DataFrame, group: Sequence[str], sequence: str, block_rows: int = 1_000_000) -> DataFrame:
    """How many rows of its group come before a block of ``number_in_group``, for the blocks that are not the first of their group.

    Most groups are one block, so only the groups of several are counted by block; the counts are written, so that Spark knows how few they are.
    """
    blocked = _blocked(df.select(*group, sequence), sequence, block_rows)
    numbers = F.count("_block")
    several = materialized(
        blocked.groupBy(*group).agg(F.min("_block").alias("_low"), F.max("_block").alias("_high"), numbers.alias("_numbers"), F.count(F.lit(1)).alias("_rows"))
        .where("_low < _high or (_numbers > 0 and _numbers < _rows)").select(*[F.col(key).alias(f"_in_{key}") for key in group]), "large-groups")
    cut = blocked.join(several, [F.col(key).eqNullSafe(F.col(f"_in_{key}")) for key in group], "left_semi")
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = (cut.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_rows"))
              .select(*[F.col(key).alias(f"_of_{key}") for key in (*group, "_block")], F.sum("_rows").over(earlier).alias("_before")))
    return materialized(before.where("_before is not null"), "blocks")


def number_in_group(df: DataFrame, group: Sequence[str], sequence: str, name: str,
                    block_rows: int = 1_000_000, before: DataFrame | None = None) -> DataFrame:
    """Number the rows of every group 1, 2, 3 ... by a unique whole-number column.

    Each group is cut into blocks of ``block_rows`` consecutive sequence values. Only a block is sorted in one
    task; the rows before a block come from the block counts, so the size of a group does not matter. ``before`` are the counts
    (``rows_before_blocks``) where they are known already.
    """
    before = rows_before_blocks(df, group, sequence, block_rows) if before is None else before
    keys = [*group, "_block"]
    in_block = F.row_number().over(Window.partitionBy(*keys).orderBy(sequence))
    same_block = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    return (_blocked(df, sequence, block_rows).withColumn("_in_block", in_block).join(before, same_block, "left")
            .select(*df.columns, (F.coalesce("_before", F.lit(0)) + F.col("_in_block")).alias(name)))


def assign_ids(df: DataFrame, id_column: str, unique_key: Sequence[str], start: Column | int = 0,
               hex_digits: int = 3) -> DataFrame:
    """Give rows the ids start+1, start+2, ... without gaps, in the order of the first ``hex_digits`` digits of the MD5 digest of their
    key, which must be unique, and of the key.

    The rows are written once by ranges of that order, with their place in their range; the counts of the ranges, one row per
    task, are the offsets. So the number of sort tasks follows the data, the input is read once, and the ids depend on the data
    alone, wherever the ranges are cut.
    """
    key = F.concat_ws("\u001f", *[F.col(c).cast("string") for c in unique_key])
    df = df.withColumn("_bucket", F.substring(F.md5(key), 1, hex_digits))
    keys = ["_bucket", *unique_key]
    # The number of a row holds its range in the upper bits and its place in the lower 33.
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialized(ranged, "ranges").withColumn("_range", F.shiftright("_at", 33))
    everything_before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
              .select("_range", F.coalesce(F.sum("_rows").over(everything_before), F.lit(0)).alias("_before")))
    start = F.lit(start) if isinstance(start, int) else start
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    new_id = (F.coalesce(start, F.lit(0)) + F.col("_before") + place).cast("long")
    # One row per task of the write.
    numbered = ranged.join(F.broadcast(before), "_range")
    return numbered.select(new_id.alias(id_column), *[c for c in df.columns if c not in ("_bucket", id_column)])


def highest(df: DataFrame, column: str) -> Column:
    """The largest value of a column, as a scalar sub-query."""
    return df.agg(F.max(column)).scalar()
