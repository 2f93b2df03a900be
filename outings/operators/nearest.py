"""Best k partners of every row, by blocks.

Comparing all rows of two sides is the work of an exact search. What must not happen is that all pairs become
rows, or that one group of pairs lands in one task. Both sides are therefore cut into blocks of bounded size and
every pair of blocks becomes one row, which holds the two blocks as lists. Scoring such a row, a tile of the matrix
after the other, gives back at most k partners per left row; a last window merges those. Pairs of blocks of one group
spread over all tasks, and many small groups share an Arrow batch. A row is shuffled once per block of the other side, so
blocks are as large as a task can well hold: up to ``SPREAD`` blocks a side the shuffle grows with the rows, not with the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructType

from outings.operators.keyed import join_groups, top_per_group
from outings.settings import ship_packages

Rows = pa.RecordBatch
Cost = Callable[[Rows, Rows], np.ndarray]

# A pair of blocks is one row, of at most twice so many bytes. A search without groups is cut into ``SPREAD`` blocks a side if these have
# ``BLOCK_ROWS`` rows, so that all cores have work. A pair is scored in tiles of TILE_ROWS x BLOCK_ROWS.
BLOCK_BYTES = 32 * 1024 * 1024
SPREAD = 8
BLOCK_ROWS = 2048
TILE_ROWS = 512


def best_partners(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str, k: int,
                  cost: Cost, left_values: Sequence[str], right_values: Sequence[str],
                  block_rows: int | None = None, k_column: str | None = None) -> DataFrame:
    """The k right rows with the least cost for every left row, among those that agree on the ``on`` columns.

    ``cost`` gets two Arrow batches and returns a matrix (left rows x right rows) in which not-a-number means "no
    partner". Rows with a null value take no part. Ties go to the smaller right id. Ids must be unique on each
    side within a group. With ``k_column`` every left row has its own limit, at most ``k``. Blocks are cut by size, or have about
    ``block_rows`` rows.
    Result: the ``on`` columns, both ids, ``cost`` and ``rank``.
    """
    group = list(on)
    ship_packages(left.sparkSession)
    left = left.select(*group, F.col(left_id).alias("_left"), *left_values,
                       (F.col(k_column) if k_column else F.lit(k)).cast("int").alias("_k"))
    right = right.select(*group, F.col(right_id).alias("_right"), *right_values)
    if group:
        left, right = left.dropna(subset=group), right.dropna(subset=group)
        sizes = (left.groupBy(*group).agg(_blocks(left, left_values, group, block_rows).alias("_left_blocks"))
                 .join(right.groupBy(*group).agg(_blocks(right, right_values, group, block_rows).alias("_right_blocks")), group))
        large = sizes.where((F.col("_left_blocks") > 1) | (F.col("_right_blocks") > 1))
        sized_left, sized_right = (side.na.fill(1, ["_left_blocks", "_right_blocks"]) for side in join_groups(
            large, group, left, right))
    else:
        numbers = {"_left_blocks": left.agg(_blocks(left, left_values, group, block_rows)).scalar(),
                   "_right_blocks": right.agg(_blocks(right, right_values, group, block_rows)).scalar()}
        sized_left, sized_right = left.withColumns(numbers), right.withColumns(numbers)
    pair = [*group, "_left_block", "_right_block"]

    def block(identifier: str, count: str) -> Column:
        return F.pmod(F.xxhash64(identifier), F.col(count)).cast("int")

    def every_block(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left_blocks = (sized_left
                   .select(*group, block("_left", "_left_blocks").alias("_left_block"),
                           every_block("_right_blocks").alias("_right_block"), "_left", "_k", *left_values)
                   .groupBy(*pair).agg(F.collect_list(F.struct("_left", "_k", *left_values)).alias("_lefts")))
    right_blocks = (sized_right
                    .select(*group, every_block("_left_blocks").alias("_left_block"),
                            block("_right", "_right_blocks").alias("_right_block"), "_right", *right_values)
                    .groupBy(*pair).agg(F.collect_list(F.struct("_right", *right_values)).alias("_rights")))
    pairs = left_blocks.join(right_blocks, pair).select(*group, "_lefts", "_rights")

    names = {f.name: f for f in (*left.schema.fields, *right.schema.fields)}
    schema = StructType([names[c] for c in (*group, "_left", "_k", "_right")]).add("cost", "double")
    arrow_schema = to_arrow_schema(schema)

    def scored(batch: Rows) -> Rows:
        found = [_best(batch.column("_lefts")[i].values, batch.column("_rights")[i].values, cost, k)
                 for i in range(batch.num_rows)]
        row_of = pa.array(np.repeat(np.arange(len(found)), [len(part[0]) for part in found]))
        columns = [batch.column(c).take(row_of) for c in group]
        columns += [pa.concat_arrays([part[j] for part in found]) for j in range(4)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow_schema)], schema=arrow_schema)

    def score(batches: Iterator[Rows]) -> Iterator[Rows]:
        for batch in batches:
            found = scored(batch) if batch.num_rows else None
            # The blocks go before the next ones are read.
            del batch
            if found is not None:
                yield found

    partial = pairs.mapInArrow(score, schema)
    ranked = top_per_group(partial, [*group, "_left"], [F.col("cost"), F.col("_right")], k, "rank")
    return (ranked.where(F.col("rank") <= F.col("_k"))
            .select(*group, F.col("_left").alias(left_id), F.col("_right").alias(right_id), "cost", "rank"))


def _blocks(side: DataFrame, values: Sequence[str], group: Sequence[str], block_rows: int | None) -> Column:
    """An aggregate: the blocks that a group of a side is cut into."""
    if block_rows is not None:
        return F.ceil(F.count(F.lit(1)) / block_rows).cast("int")
    by_size = F.ceil(F.sum(_row_bytes(side, values)) / BLOCK_BYTES)
    if group:
        return by_size.cast("int")
    return F.greatest(by_size, F.least(F.lit(SPREAD), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS)), F.lit(1)).cast("int")


def _row_bytes(side: DataFrame, values: Sequence[str]) -> Column:
    """About what a row takes in a block: its id, limit and values."""
    size = F.lit(24)
    for field in (side.schema[c] for c in values):
        if isinstance(field.dataType, ArrayType):
            width = 4 if isinstance(field.dataType.elementType, (FloatType, IntegerType)) else 8
            size = size + 16 + width * F.coalesce(F.array_size(field.name), F.lit(0))
        else:
            size = size + 8
    return size.cast("long")


def _best(lefts: pa.StructArray, rights: pa.StructArray, cost: Cost, k: int) -> tuple[pa.Array, ...]:
    """Left ids, their limits, right ids and costs of the best pairs of two blocks."""
    left, right = _complete(lefts), _complete(rights)
    by_id = pc.sort_indices(right.column("_right"))
    tiles = [_best_of_tile(left.slice(start, TILE_ROWS), right, by_id, cost, k)
             for start in range(0, left.num_rows if right.num_rows else 0, TILE_ROWS)]
    if not tiles:
        nothing = pa.array([], pa.float64())
        return (*[left.column(c).slice(0, 0) for c in ("_left", "_k")], right.column("_right").slice(0, 0), nothing)
    return tuple(pa.concat_arrays([tile[j] for tile in tiles]) for j in range(4))


def _best_of_tile(left: Rows, right: Rows, by_id: pa.Array, cost: Cost, k: int) -> tuple[pa.Array, ...]:
    """The right rows pass by in the order of their ids, ``BLOCK_ROWS`` at a time, so that the earlier one wins a tie. What is kept are
    the k best of every left row; of further rows only those with a cost up to the k-th of these are looked at."""
    rows, columns, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    limits = np.minimum(left.column("_k").to_numpy(), k)
    bound = np.full(left.num_rows, np.inf)
    for start in range(0, len(by_id), BLOCK_ROWS):
        costs = cost(left, right.take(by_id.slice(start, BLOCK_ROWS)))
        if not len(rows) and costs.shape[1] > 4 * k:
            # Only costs up to the k-th least can be among the best; equal ones stay in.
            finite = np.where(np.isfinite(costs), costs, np.inf)
            bound = np.partition(finite, k - 1, axis=1)[:, k - 1]
        new_rows, new_columns = np.nonzero(costs <= bound[:, None])
        new_values = costs[new_rows, new_columns]
        usable = np.isfinite(new_values)
        if not usable.any():
            continue
        rows = np.concatenate([rows, new_rows[usable]])
        columns = np.concatenate([columns, new_columns[usable] + start])
        values = np.concatenate([values, new_values[usable]])
        order = np.lexsort((columns, values, rows))
        rows, columns, values = rows[order], columns[order], values[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(left.num_rows))[rows]
        kept = place < k
        bound = np.full(left.num_rows, np.inf)
        bound[rows[place == k - 1]] = values[place == k - 1]
        rows, columns, values = rows[kept], columns[kept], values[kept]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(left.num_rows))[rows]
    kept = place < limits[rows]
    rows, columns = pa.array(rows[kept]), by_id.take(pa.array(columns[kept]))
    return (left.column("_left").take(rows), left.column("_k").take(rows), right.column("_right").take(columns),
            pa.array(values[kept]))


def _complete(block: pa.StructArray) -> Rows:
    rows = pa.RecordBatch.from_struct_array(block)
    for name in rows.schema.names:
        if rows.column(name).null_count:
            rows = rows.filter(pc.is_valid(rows.column(name)))
    return rows


def matrix(rows: Rows, column: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column as a matrix, without a Python object per row, and the length of every list. Shorter lists are
    filled with zeros."""
    lists = rows.column(column)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values.reshape(rows.num_rows, width), lengths
    out = np.zeros((rows.num_rows, width))
    out[np.arange(width) < lengths[:, None]] = values
    return out, lengths


def cosine_cost(left_vector: str, right_vector: str, digits: int = 9) -> Cost:
    """Minus the cosine similarity; vectors of different lengths are no partners. Rounding makes equal similarities
    equal, whatever the order of the sums."""

    def cost(left: Rows, right: Rows) -> np.ndarray:
        (a, a_length), (b, b_length) = matrix(left, left_vector), matrix(right, right_vector)
        width = min(a.shape[1], b.shape[1])
        with np.errstate(invalid="ignore", divide="ignore"):
            a = a / np.linalg.norm(a, axis=1, keepdims=True)
            b = b / np.linalg.norm(b, axis=1, keepdims=True)
        costs = a[:, :width] @ b[:, :width].T
        np.negative(np.round(costs, digits, out=costs), out=costs)
        if a.shape[1] == b.shape[1] and (a_length == width).all() and (b_length == width).all():
            return costs
        return np.where(a_length[:, None] == b_length, costs, np.nan)

    return cost


def nearest_vectors(queries: DataFrame, corpus: DataFrame, k: int, on: Sequence[str] = (),
                    query_id: str = "query_id", query_vector: str = "query_vector", item_id: str = "item_id",
                    item_vector: str = "embedding", k_column: str | None = None,
                    block_rows: int | None = None) -> DataFrame:
    """Exact top-k by cosine similarity: the ``on`` columns, query id, item id, similarity and rank. A query meets only
    vectors of its own length."""
    left = queries.withColumnRenamed(query_vector, "_query_vector")
    right = corpus.where(F.col(item_vector).isNotNull()).withColumnRenamed(item_vector, "_item_vector")
    found = best_partners(left, right, on, query_id, item_id, k, cosine_cost("_query_vector", "_item_vector"),
                          ["_query_vector"], ["_item_vector"], block_rows, k_column)
    return found.select(*on, query_id, item_id, (-F.col("cost")).alias("similarity"), "rank")


def nearest_to_few(queries: DataFrame, corpus: DataFrame, k: int, on: Sequence[str] = (), query_id: str = "query_id",
                   query_vector: str = "query_vector", item_id: str = "item_id", item_vector: str = "embedding",
                   block_queries: int = 1024) -> DataFrame:
    """``nearest_vectors`` for a set of queries that is small next to the corpus: the queries go to the corpus.

    Queries are numbered and sent to the tasks of the corpus scan in blocks of at most ``block_queries`` vectors, one scan per
    block. A task keeps the k best items that it has seen of every query of the block; what leaves it are ids and costs, so no
    vector of the corpus is shuffled, and a last window merges the tasks. Ties go to the smaller item id. Rows with a null id,
    group or vector take no part.
    """
    group = list(on)
    ship_packages(corpus.sparkSession)
    queries = queries.select(*group, F.col(query_id).alias("_left"), F.col(query_vector).alias("_query_vector")).dropna()
    count = queries.count()
    blocks = max(1, -(-count // block_queries))
    queries = queries.withColumn("_block", F.pmod(F.xxhash64("_left", *group), F.lit(blocks)))
    items = corpus.select(*group, F.col(item_id).alias("_right"), F.col(item_vector).alias("_item_vector")).dropna(subset=[*group, "_right"])
    cost = cosine_cost("_query_vector", "_item_vector")
    schema = StructType([queries.schema[c] for c in (*group, "_left")] + [items.schema["_right"]]).add("cost", "double")
    arrow_schema = to_arrow_schema(schema)
    partial = None
    for number in range(blocks):
        own = queries.where(F.col("_block") == number).drop("_block").toArrow().combine_chunks()
        if own.num_rows:
            found = items.mapInArrow(_keep_best(own, group, k, cost, arrow_schema), schema)
            partial = found if partial is None else partial.unionByName(found)
    if partial is None:
        partial = corpus.sparkSession.createDataFrame([], schema)
    ranked = top_per_group(partial, [*group, "_left"], [F.col("cost"), F.col("_right")], k, "rank")
    return ranked.select(*group, F.col("_left").alias(query_id), F.col("_right").alias(item_id), (-F.col("cost")).alias("similarity"), "rank")


def _keep_best(queries: pa.Table, group: list[str], k: int, cost: Cost, schema: pa.Schema) -> Callable[[Iterator[Rows]], Iterator[Rows]]:
    """The k best items of a task for every query of a block, kept while the items pass by."""

    def parts(rows: Rows) -> dict[tuple, np.ndarray]:
        """Row numbers of every group."""
        keys = list(zip(*(rows.column(c).to_pylist() for c in group))) if group else [()] * rows.num_rows
        out: dict[tuple, list[int]] = {}
        for at, key in enumerate(keys):
            out.setdefault(key, []).append(at)
        return {key: np.array(at) for key, at in out.items()}

    def run(batches: Iterator[Rows]) -> Iterator[Rows]:
        block = queries.to_batches()[0]
        wanted = parts(block)
        best: dict[tuple, Rows] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                items = batch.slice(start, BLOCK_ROWS)
                items = items.filter(pc.is_valid(items.column("_item_vector")))
                for key, at in parts(items).items():
                    if key in wanted:
                        own = items.take(pa.array(at))
                        found = _best_of(block.take(pa.array(wanted[key])), own, cost, k, best.get(key))
                        best[key] = found
        for key, found in best.items():
            columns = [pa.array([part] * found.num_rows, schema.field(c).type) for c, part in zip(group, key)]
            columns += [found.column(c).cast(schema.field(c).type) for c in ("_left", "_right", "cost")]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _best_of(left: Rows, right: Rows, cost: Cost, k: int, before: Rows | None) -> Rows:
    """The k best right rows of every left row, among a block and those kept before."""
    rows = left.append_column("_k", pa.array(np.full(left.num_rows, k, np.int32)))
    by_id = pc.sort_indices(right.column("_right"))
    tiles = [_best_of_tile(rows.slice(start, TILE_ROWS), right, by_id, cost, k) for start in range(0, rows.num_rows, TILE_ROWS)]
    found = [pa.concat_arrays([tile[i] for tile in tiles]) for i in (0, 2, 3)]
    if before is not None:
        found = [pa.concat_arrays([before.column(i), part.cast(before.column(i).type)]) for i, part in enumerate(found)]
    merged = pa.RecordBatch.from_arrays(found, names=["_left", "_right", "cost"])
    merged = merged.take(pc.sort_indices(merged, sort_keys=[("_left", "ascending"), ("cost", "ascending"), ("_right", "ascending")]))
    codes = merged.column("_left").dictionary_encode().indices.to_numpy()
    place = np.arange(len(codes)) - np.searchsorted(codes, codes)
    return merged.filter(pa.array(place < k))
