"""Approximate nearest neighbours: search only some cells, or only equal hash buckets."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outings.operators.keyed import top_per_group
from outings.operators.nearest import matrix, nearest_to_few, nearest_vectors
from outings.settings import ship_packages
from outings.sources.tables import materialized


@dataclass(frozen=True)
class CellIndex:
    """Vectors with the cell of their nearest centre. ``centres`` has one row per cell."""

    vectors: DataFrame
    centres: DataFrame


def build_cells(vectors: DataFrame, cells: int, vector: str = "embedding", seed: int = 7,
                iterations: int = 20) -> CellIndex:
    """Cluster the vectors by cosine."""
    usable = vectors.where(F.col(vector).isNotNull()).withColumn("_features", array_to_vector(vector))
    model = KMeans(k=cells, seed=seed, maxIter=iterations, distanceMeasure="cosine", featuresCol="_features",
                   predictionCol="cell").fit(usable.select("_features"))
    centres = [(cell, [float(x) for x in centre]) for cell, centre in enumerate(model.clusterCenters())]
    centre_frame = vectors.sparkSession.createDataFrame(centres, "cell long, centre array<float>")
    indexed = model.transform(usable).drop("_features").withColumn("cell", F.col("cell").cast("long"))
    return CellIndex(indexed, centre_frame)


def assign_cells(vectors: DataFrame, centres: DataFrame, item_id: str = "item_id", vector: str = "embedding") -> CellIndex:
    """An index with given centres (``cell``, ``centre``): every vector goes to the nearest, ties to the smaller cell.
    Vectors without a centre of their length, or without a direction, are left out."""
    own = nearest_vectors(vectors.select(item_id, vector), centres, 1, query_id=item_id, query_vector=vector, item_id="cell",
                          item_vector="centre")
    return CellIndex(vectors.join(own.select(item_id, "cell"), item_id), centres)


def store_cells(index: CellIndex, path: str, item_id: str = "item_id") -> None:
    """Write an index with one folder per cell. Ranges of (cell, id) share the work evenly, however full a cell is."""
    (index.vectors.repartitionByRange("cell", item_id).write.partitionBy("cell").parquet(f"{path}/vectors"))
    index.centres.write.parquet(f"{path}/centres")


def load_cells(spark: SparkSession, path: str) -> CellIndex:
    vectors = spark.read.parquet(f"{path}/vectors").withColumn("cell", F.col("cell").cast("long"))
    return CellIndex(vectors, spark.read.parquet(f"{path}/centres"))


def visited_only(stored: DataFrame, visits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows whose keys are visited. Spark takes the folders of a partitioned table from the visits when the scan starts; the
    comparison, true of every visit, is what tells it that they are worth it."""
    wanted = visits.select(*keys).distinct().where(F.col(keys[0]) >= 0)
    return stored.join(wanted, list(keys), "left_semi")


def search_cells(queries: DataFrame, index: CellIndex, k: int, probes: int, query_id: str = "query_id",
                 query_vector: str = "query_vector", item_id: str = "item_id",
                 item_vector: str = "embedding") -> DataFrame:
    """Top-k among the vectors in the ``probes`` cells nearest to each query."""
    near = nearest_vectors(queries, index.centres, probes, query_id=query_id, query_vector=query_vector,
                           item_id="cell", item_vector="centre")
    near = materialized(near.select(query_id, "cell"), "visits")
    visited = visited_only(index.vectors, near, ["cell"])
    found = nearest_vectors(queries.join(near, query_id), visited, k, on=["cell"], query_id=query_id, query_vector=query_vector,
                            item_id=item_id, item_vector=item_vector)
    return _merge(found, query_id, item_id, k)


@dataclass(frozen=True)
class CellTree:
    """Two levels of cells: ``tops`` (top, centre), ``centres`` (top, cell, centre), and ``vectors`` with the top and cell of each.
    A vector belongs to the nearest top and, of its cells, to the nearest; cells have numbers of their own over all tops."""

    vectors: DataFrame
    tops: DataFrame
    centres: DataFrame


def _spherical_means(points: np.ndarray, k: int, seed: int, iterations: int) -> np.ndarray:
    """Centres of at most ``k`` clusters by cosine; a centre that loses its points stays where it was."""
    with np.errstate(invalid="ignore", divide="ignore"):
        points = points / np.linalg.norm(points, axis=1, keepdims=True)
    points = points[np.isfinite(points).all(axis=1)]
    if not len(points):
        return points
    points = points[np.lexsort(points.T)]
    centres = points[np.random.default_rng(seed).permutation(len(points))[:k]]
    for _ in range(iterations):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def grow_tree(vectors: DataFrame, tops: int, cells_per_top: int, item_id: str = "item_id", vector: str = "embedding", seed: int = 7,
              iterations: int = 12, sample: int = 64) -> CellTree:
    """Centres of both levels from a sample, then the whole corpus assigned to them.

    At most ``sample`` vectors per centre are learned from, drawn by a hash of the id: ``tops * sample`` of the corpus by a task of their
    own for the upper level, ``cells_per_top * sample`` of every top, in parallel, for the lower. The driver sees no centre.
    """
    def means(group: list[str], k: int, names: str):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            centres = _spherical_means(np.stack(frame[vector].to_numpy()).astype(np.float64), k, seed, iterations)
            out = pd.DataFrame({"number": np.arange(len(centres)), "centre": list(centres.astype(np.float32))})
            for name in group:
                out[name] = frame[name].iloc[0]
            return out[[*group, "number", "centre"]]

        return lambda df: df.groupBy(*group).applyInPandas(run, names)

    ship_packages(vectors.sparkSession)
    usable = vectors.where(F.col(vector).isNotNull())
    order = [F.xxhash64(F.lit(seed), F.col(item_id).cast("string"))]
    one = top_per_group(usable.select(F.lit(0).alias("all"), item_id, vector), ["all"], order, tops * sample)
    upper = materialized(means(["all"], tops, "all int, number long, centre array<float>")(one).select(
        F.col("number").alias("top"), "centre"), "tops")
    own = nearest_vectors(usable.select(item_id, vector), upper, 1, query_id=item_id, query_vector=vector, item_id="top", item_vector="centre")
    some = top_per_group(usable.select(item_id, vector).join(own.select(item_id, "top"), item_id), ["top"], order, cells_per_top * sample)
    lower = means(["top"], cells_per_top, "top long, number long, centre array<float>")(some)
    cell = F.col("top") * cells_per_top + F.col("number")
    lower = materialized(lower.select("top", cell.alias("cell"), "centre"), "cells")
    return assign_tree(vectors, upper, lower, item_id, vector)


def assign_tree(vectors: DataFrame, tops: DataFrame, centres: DataFrame, item_id: str = "item_id", vector: str = "embedding") -> CellTree:
    """A tree with given centres. A vector is compared with the tops and with the cells of one top, not with all cells; vectors without a
    direction, or whose top has no cell of their length, are left out."""
    top = nearest_vectors(vectors.select(item_id, vector), tops, 1, query_id=item_id, query_vector=vector, item_id="top", item_vector="centre")
    placed = vectors.join(top.select(item_id, "top"), item_id)
    own = nearest_vectors(placed.select("top", item_id, vector), centres, 1, on=["top"], query_id=item_id, query_vector=vector,
                          item_id="cell", item_vector="centre")
    return CellTree(placed.drop("top").join(own.select(item_id, "top", "cell"), item_id), tops, centres)


def store_tree(tree: CellTree, path: str, item_id: str = "item_id") -> None:
    """Write a tree with a folder per cell; ranges of (cell, id) share the work evenly, however full a cell is."""
    (tree.vectors.repartitionByRange("cell", item_id).sortWithinPartitions("cell").write.partitionBy("top", "cell").parquet(f"{path}/vectors"))
    tree.tops.write.parquet(f"{path}/tops")
    tree.centres.write.parquet(f"{path}/centres")


def load_tree(spark: SparkSession, path: str) -> CellTree:
    return CellTree(*(spark.read.parquet(f"{path}/{part}") for part in ("vectors", "tops", "centres")))


def search_tree(queries: DataFrame, tree: CellTree, k: int, probes: int, top_probes: int, query_id: str = "query_id",
                query_vector: str = "query_vector", item_id: str = "item_id", item_vector: str = "embedding") -> DataFrame:
    """Top-k among the vectors in the ``probes`` nearest cells of the ``top_probes`` nearest tops of each query.

    The visited cells are a table that is joined; the scan of a stored tree takes its folders from it.
    """
    near = nearest_vectors(queries, tree.tops, top_probes, query_id=query_id, query_vector=query_vector, item_id="top", item_vector="centre")
    asked = queries.select(query_id, query_vector).join(near.select(query_id, "top"), query_id)
    cells = nearest_vectors(asked, tree.centres, probes, on=["top"], query_id=query_id, query_vector=query_vector, item_id="cell", item_vector="centre")
    best = top_per_group(cells, [query_id], [F.col("similarity").desc(), F.col("cell")], probes).select(query_id, "top", "cell")
    visits = materialized(best, "visits")
    visited = visited_only(tree.vectors, visits, ["top", "cell"])
    found = nearest_vectors(queries.select(query_id, query_vector).join(visits, query_id), visited, k, on=["cell"], query_id=query_id,
                            query_vector=query_vector, item_id=item_id, item_vector=item_vector)
    return _merge(found, query_id, item_id, k)


def hash_buckets(vector: Column | str, tables: int, bits: int, dim: int, seed: int = 7) -> Column:
    """For every table the sign pattern of the vector against ``bits`` random directions.

    The directions follow from the seed. The function is declared as not deterministic only to be called once per row.
    """
    directions = np.random.default_rng(seed).normal(size=(tables * bits, dim))

    @F.pandas_udf("array<long>")
    def buckets(chunks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        powers = 1 << np.arange(bits)
        for vectors in chunks:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            signs = np.stack(vectors.to_numpy()) @ directions.T > 0
            yield pd.Series(list(signs.reshape(-1, tables, bits) @ powers), dtype=object)

    return buckets.asNondeterministic()(vector)


def search_buckets(queries: DataFrame, corpus: DataFrame, k: int, dim: int, tables: int = 8, bits: int = 8,
                   seed: int = 7, query_id: str = "query_id", query_vector: str = "query_vector",
                   item_id: str = "item_id", item_vector: str = "embedding") -> DataFrame:
    """Top-k among the vectors that share a bucket with the query in at least one table."""

    def hashed(df: DataFrame, vector: str) -> DataFrame:
        pattern = hash_buckets(vector, tables, bits, dim, seed)
        return df.where(F.col(vector).isNotNull()).select("*", F.posexplode(pattern).alias("_table", "_bucket"))

    found = nearest_vectors(hashed(queries, query_vector), hashed(corpus, item_vector), k, on=["_table", "_bucket"],
                            query_id=query_id, query_vector=query_vector, item_id=item_id, item_vector=item_vector)
    return _merge(found, query_id, item_id, k)


@dataclass(frozen=True)
class HashIndex:
    """``entries``: the items once per table, with ``table``, ``part`` (the first bits of the bucket) and ``bucket``.
    ``directions`` has one row per plane: table, bit, direction."""

    entries: DataFrame
    directions: DataFrame


# A table is stored in at most 2^PART_BITS folders; inside a folder, rows are sorted by bucket.
PART_BITS = 6


def bits_for(rows: int, rows_per_bucket: int = 64) -> int:
    """Planes per table, so that a bucket of an evenly filled table has about so many rows."""
    return max(1, min(30, round(math.log2(max(1, rows / rows_per_bucket)))))


def random_directions(spark: SparkSession, tables: int, bits: int, dim: int, seed: int = 7) -> DataFrame:
    """Directions of a seeded normal distribution; they are data from then on, so every reader of an index has the same."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dim))
    rows = [(t, b, planes[t, b].tolist()) for t in range(tables) for b in range(bits)]
    return spark.createDataFrame(rows, "table int, bit int, direction array<double>")


def _planes(directions: DataFrame) -> np.ndarray:
    """(tables, bits, dim); the size follows from the parameters of the index, not from the corpus."""
    rows = sorted(directions.collect(), key=lambda r: (r["table"], r["bit"]))
    tables, bits = max(r["table"] for r in rows) + 1, max(r["bit"] for r in rows) + 1
    return np.array([r["direction"] for r in rows], np.float64).reshape(tables, bits, -1)


def probe_masks(margins: np.ndarray, probes: int) -> list[int]:
    """Which bits to turn, in the order of the squared distance to the planes that are crossed: the own bucket first.

    Best-first over sets of planes, nearest plane first: a set is followed by the one with its last plane moved on, and by
    the one with the next plane added.
    """
    order = np.argsort(np.abs(margins), kind="stable").tolist()
    price = [round(float(margins[b]) ** 2, 12) for b in order]
    masks, heap = [0], [(price[0], 1 << order[0], (0,))] if order else []
    while heap and len(masks) < probes:
        cost, mask, chosen = heapq.heappop(heap)
        masks.append(mask)
        last = chosen[-1]
        if last + 1 < len(order):
            moved = mask ^ (1 << order[last]) ^ (1 << order[last + 1])
            heapq.heappush(heap, (cost - price[last] + price[last + 1], moved, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + price[last + 1], mask | 1 << order[last + 1], (*chosen, last + 1)))
    return masks


def _in_buckets(df: DataFrame, vector: str, directions: DataFrame, probes: int = 1) -> DataFrame:
    """The rows of ``df`` with ``table``, ``part`` and ``bucket``, once per table and probe. Vectors that are null or of another length
    than the planes are left out."""
    planes = _planes(directions)
    tables, bits, dim = planes.shape
    flat, powers = planes.reshape(tables * bits, dim).T, 1 << np.arange(bits)
    shift = max(0, bits - PART_BITS)
    ship_packages(df.sparkSession)
    names = [*df.columns, "table", "part", "bucket"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column(vector)), dim))
            if not batch.num_rows:
                continue
            margins = np.round(matrix(batch, vector)[0] @ flat, 9).reshape(-1, tables, bits)
            own = (margins > 0) @ powers
            rows, table, bucket = [], [], []
            for row in range(batch.num_rows):
                for t in range(tables):
                    masks = probe_masks(margins[row, t], probes) if probes > 1 else [0]
                    rows += [row] * len(masks)
                    table += [t] * len(masks)
                    bucket += [int(own[row, t]) ^ m for m in masks]
            columns = list(batch.take(pa.array(rows)).columns)
            columns += [pa.array(table, pa.int32()), pa.array(np.array(bucket) >> shift, pa.int32()), pa.array(bucket, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, table int, part int, bucket long")


def index_buckets(corpus: DataFrame, directions: DataFrame, item_vector: str = "embedding") -> HashIndex:
    """Every item once per table, in the bucket of the sides of the planes it lies on."""
    return HashIndex(_in_buckets(corpus, item_vector, directions), directions)


def store_buckets(index: HashIndex, path: str) -> None:
    """Write an index with a folder per table and first bits of the bucket; rows of a folder are sorted by bucket, so that a reader
    skips row groups as well."""
    (index.entries.repartitionByRange("table", "bucket").sortWithinPartitions("table", "bucket")
     .write.partitionBy("table", "part").parquet(f"{path}/entries"))
    index.directions.write.parquet(f"{path}/directions")


def load_buckets(spark: SparkSession, path: str) -> HashIndex:
    return HashIndex(spark.read.parquet(f"{path}/entries"), spark.read.parquet(f"{path}/directions"))


def search_index(queries: DataFrame, index: HashIndex, k: int, probes: int, query_id: str = "query_id",
                 query_vector: str = "query_vector", item_id: str = "item_id", item_vector: str = "embedding", few: bool = False) -> DataFrame:
    """Top-k among the items in the ``probes`` buckets of every table that lie nearest to each query.

    Only the folders of visited buckets are read. With ``few`` the queries go to these rows, otherwise both meet by bucket.
    """
    visits = materialized(_in_buckets(queries.select(query_id, query_vector), query_vector, index.directions, probes), "visits")
    key = ["table", "bucket"]
    entries = visited_only(index.entries, visits, ["table", "part", "bucket"]).select(*key, item_id, item_vector)
    search = nearest_to_few if few else nearest_vectors
    found = search(visits.select(*key, query_id, query_vector), entries, k, on=key, query_id=query_id, query_vector=query_vector,
                   item_id=item_id, item_vector=item_vector)
    return _merge(found, query_id, item_id, k)


def _merge(found: DataFrame, query_id: str, item_id: str, k: int) -> DataFrame:
    """One top-k per query from its top-k per cell or bucket, in which an item may occur more than once."""
    distinct = found.groupBy(query_id, item_id).agg(F.max("similarity").alias("similarity"))
    return top_per_group(distinct, [query_id], [F.col("similarity").desc(), F.col(item_id)], k, "rank")
