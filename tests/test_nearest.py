"""Searches against brute force, with small blocks and crowded groups."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outings.functions.geo import EARTH_RADIUS_M, haversine_m
from outings.functions.vectors import HashEmbedder, cosine_similarity, embed
from outings.operators import nearest
from outings.operators.approximate import (bits_for, build_cells, grow_tree, index_buckets, load_buckets, load_cells, load_tree, probe_masks,
                                           random_directions, search_buckets, search_cells, search_index, search_tree, store_buckets,
                                           store_cells, store_tree)
from outings.operators.nearest import nearest_to_few, nearest_vectors
from outings.operators.places import places_within_radius
from outings.plans.recall import recall_per_query, recall_report, recall_summary

DIM = 8


def vectors(spark, n, seed, ident, name, groups=1):
    rng = np.random.default_rng(seed)
    # Whole numbers from a short range give many equal similarities.
    rows = [(i, (0 if i % 3 == 0 else i % groups), [float(x) for x in rng.integers(-1, 2, DIM)] if i % 11 else None)
            for i in range(n)]
    return spark.createDataFrame(rows, f"{ident} long, g long, {name} array<float>"), rows


def brute(queries, corpus, k, grouped):
    best = {}
    for q, g, a in queries:
        scored = []
        for i, h, b in corpus:
            if a is None or b is None or (grouped and g != h):
                continue
            norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            if norm:
                scored.append((-round(sum(x * y for x, y in zip(a, b)) / norm, 9), i))
        best[q] = [(i, -c) for c, i in sorted(scored)[:k]]
    return {q: found for q, found in best.items() if found}


@pytest.mark.parametrize("on,block_rows,shuffled", [([], 7, False), (["g"], 7, False), (["g"], 7, True),
                                                  (["g"], 1024, False)])
def test_exact_search(spark, on, block_rows, shuffled):
    """Also with the facts about large groups joined by key instead of broadcast."""
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    if shuffled:
        for name in limits:
            spark.conf.set(name, "-1")
    try:
        check_exact_search(spark, on, block_rows)
    finally:
        for name in limits:
            spark.conf.unset(name)


def check_exact_search(spark, on, block_rows):
    queries, q = vectors(spark, 60, 1, "query_id", "query_vector", 5)
    corpus, c = vectors(spark, 150, 2, "item_id", "embedding", 5)
    got = {}
    for r in nearest_vectors(queries, corpus, 4, on=on, block_rows=block_rows).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.item_id, round(r.similarity, 9) + 0.0)
    expected = brute(q, c, 4, bool(on))
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {
        k: [(i, round(s, 9) + 0.0) for i, s in v] for k, v in expected.items()}


def test_stored_index_reads_the_visited_cells(spark, tmp_path):
    corpus, _ = vectors(spark, 200, 3, "item_id", "embedding", 5)
    store_cells(build_cells(corpus, 8), str(tmp_path / "index"))
    queries, _ = vectors(spark, 2, 4, "query_id", "query_vector", 5)
    index = load_cells(spark, str(tmp_path / "index"))
    found = search_cells(queries.where("query_id = 1"), index, 3, probes=1)
    assert len(found.collect()) == 3 and 0 < rows_scanned(found, "vectors") < 180
    # A null vector visits no cell.
    nothing = search_cells(queries.where("query_id = 0"), index, 3, probes=1)
    assert nothing.collect() == [] and rows_scanned(nothing, "vectors") == 0


def rows_scanned(df, folder):
    """Rows that the finished plan of ``df`` read from files below ``folder``."""
    total, waiting = 0, [df._jdf.queryExecution().executedPlan()]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            waiting.append(node.plan())
        elif name == "FileSourceScanExec" and f"/{folder}" in node.relation().location().rootPaths().mkString(","):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("on,block_queries", [([], 1024), ([], 7), (["g"], 1024), (["g"], 9)])
def test_few_queries_go_to_the_corpus(spark, on, block_queries):
    queries, q = vectors(spark, 60, 1, "query_id", "query_vector", 5)
    corpus, c = vectors(spark, 5000, 2, "item_id", "embedding", 5)
    found = nearest_to_few(queries, corpus.repartition(6), 4, on=on, block_queries=block_queries)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.item_id, round(r.similarity, 9) + 0.0)
    expected = brute(q, c, 4, bool(on))
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: [(i, round(s, 9) + 0.0) for i, s in v] for k, v in expected.items()}
    # What is shuffled has no vector in it.
    plan = nearest_to_few(queries, corpus, 4, on=on)._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    assert "Exchange" in above and "vector" not in above and "embedding" not in above
    assert "Exchange" not in plan[plan.index("MapInArrow"):]
    assert nearest_to_few(queries.limit(0), corpus, 4).count() == 0 and nearest_to_few(queries, corpus.limit(0), 4, on=on).count() == 0


def test_probes_are_in_order():
    rng = np.random.default_rng(2)
    for bits in (1, 3, 6):
        margins = rng.normal(size=bits)
        every = sorted(range(1 << bits), key=lambda m: sum(margins[b] ** 2 for b in range(bits) if m >> b & 1))
        assert probe_masks(margins, 1 << bits) == every and probe_masks(margins, 3) == every[:3]


def test_stored_hash_index(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(800, DIM)))] + [(900, None), (901, [1.0])]
    corpus = spark.createDataFrame(rows, "item_id long, embedding array<float>").repartition(3).cache()
    queries = corpus.where("item_id % 40 = 7").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    bits = bits_for(800, 50)
    assert bits == 4 and bits_for(0) == 1 and bits_for(10 ** 12) == 30
    store_buckets(index_buckets(corpus, random_directions(spark, 3, bits, DIM)), str(tmp_path / "index"))
    index = load_buckets(spark, str(tmp_path / "index"))
    exact = nearest_vectors(queries, corpus, 5)
    means, scanned = [], []
    one = queries.where("query_id = 7")
    for probes in (1, 2, 4, 16):
        found = search_index(queries, index, 5, probes)
        means.append(recall_summary(recall_per_query(queries, exact, found)).first().mean_recall_at_k)
        assert sorted(map(tuple, search_index(queries, index, 5, probes, few=True).collect())) == sorted(map(tuple, found.collect()))
        single = search_index(one, index, 5, probes)
        single.collect()
        scanned.append(rows_scanned(single, "entries"))
    assert means == sorted(means) and means[0] < 1 and means[-1] == 1.0
    assert scanned == sorted(scanned) and scanned[0] < 800 and scanned[-1] == 2400


def test_tree_of_cells(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, DIM)))] + [(700, None), (701, [0.0] * DIM)]
    corpus = spark.createDataFrame(rows, "item_id long, embedding array<float>").cache()
    queries = corpus.where("item_id % 30 = 4").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    tree = grow_tree(corpus, 4, 5, sample=20)
    assert tree.tops.count() == 4 and tree.centres.count() == 20 and tree.vectors.count() == 600
    store_tree(tree, str(tmp_path / "tree"))
    stored = load_tree(spark, str(tmp_path / "tree"))
    exact = nearest_vectors(queries, corpus, 5)
    means = []
    for probes, tops in ((1, 1), (5, 2), (20, 4)):
        found = search_tree(queries, stored, 5, probes, tops)
        means.append(recall_summary(recall_per_query(queries, exact, found)).first().mean_recall_at_k)
    assert means[0] < means[1] < means[2] == 1.0
    single = search_tree(queries.where("query_id = 4"), stored, 5, 1, 1)
    single.collect()
    assert 0 < rows_scanned(single, "vectors") < 200


def test_vectors_of_unequal_length_never_meet(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id long, query_vector array<double>")
    corpus = spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.0, 0.0, 0.0]), (12, [1.0, 1.0, 0.0, 0.0]),
                                    (13, [0.0, 2.0, 0.0])], "item_id long, embedding array<double>")
    got = sorted((r.query_id, r.item_id, round(r.similarity, 3)) for r in nearest_vectors(queries, corpus, 4).collect())
    assert got == [(1, 12, 0.707), (2, 10, 0.0), (2, 13, 1.0)]


def test_arrow_batches_are_bounded(spark):
    """Rows of one megabyte come in small batches, so pairs of blocks do."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = spark.range(0, 150, 1, 1).select(F.array_repeat(F.lit(1.0), 131_072).alias("v"))
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) <= 70


def test_own_limits(spark):
    queries, _ = vectors(spark, 30, 1, "query_id", "query_vector")
    corpus, _ = vectors(spark, 90, 2, "item_id", "embedding")
    limited = queries.withColumn("k", (F.col("query_id") % 4).cast("int"))
    whole = {(r.query_id, r.item_id, r["rank"]) for r in nearest_vectors(queries, corpus, 3, block_rows=16).collect()}
    got = {(r.query_id, r.item_id, r["rank"])
           for r in nearest_vectors(limited, corpus, 3, k_column="k", block_rows=16).collect()}
    assert got == {(q, i, n) for q, i, n in whole if n <= q % 4}


def test_cosine_expression(spark):
    row = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    got = row.select(cosine_similarity(F.col("a"), F.col("b")), cosine_similarity(F.col("a"), F.col("z"))).first()
    assert got[0] == pytest.approx(0.8) and got[1] is None


def test_approximate_search(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(200, DIM)))]
    corpus = spark.createDataFrame(rows, "item_id long, embedding array<float>").cache()
    queries = corpus.select(F.col("item_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = nearest_vectors(queries, corpus, 5).cache()
    index = build_cells(corpus, 8)
    means = {}
    for probes in (1, 3, 8):
        found = search_cells(queries, index, 5, probes)
        means[probes] = recall_summary(recall_per_query(queries, exact, found)).first().mean_recall_at_k
    assert means[1] < means[3] < means[8] == 1.0
    store_cells(index, str(tmp_path / "cells"))
    stored = search_cells(queries, load_cells(spark, str(tmp_path / "cells")), 5, 3)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, search_cells(queries, index, 5, 3).collect()))
    hashed = recall_per_query(queries, exact, search_buckets(queries, corpus, 5, DIM, tables=12, bits=4))
    assert recall_summary(hashed).first().mean_recall_at_k > 0.6
    report = recall_report(queries, exact, {"all": search_cells(queries, index, 5, 8),
                                            "none": exact.limit(0)}).collect()
    assert {r.search: (r.mean_recall_at_k, r.mean_rows_returned, r.n_probes) for r in report} == {
        "all": (1.0, 5.0, 200), "none": (0.0, 0.0, 200)}


def metres(a, b):
    dlat, dlon = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(dlat / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(dlon / 2) ** 2
    h = min(h, 1.0)
    return round(EARTH_RADIUS_M * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))


@pytest.mark.parametrize("radius_m,crowd", [(50_000, 0), (900_000, 0), (900_000, 400), (15_000_000, 0)])
def test_radius_search(spark, radius_m, crowd):
    rng = np.random.default_rng(3)
    points = [(float(a), float(o)) for a, o in zip(rng.uniform(-90, 90, 120), rng.uniform(-180, 180, 120))]
    points += [(89.9, 10.0), (89.8, -170.0), (-90.0, 0.0), (-89.9, 77.0), (0.0, 180.0), (0.0, -180.0), (0.1, -179.9)]
    points += [(51.0, -115.5)] * 30 + [(51.2, -115.6)] * 3 + [(51.0 + i / 100, -115.5) for i in range(20)]
    # A town in which the search has to go down some levels, and one at the pole.
    points += [(float(a), float(o)) for a, o in zip(rng.normal(48.0, 0.002, crowd), rng.normal(11.0, 0.002, crowd))]
    points += [(90 - abs(float(a)), float(o)) for a, o in zip(rng.normal(0, 0.001, crowd // 4), rng.uniform(-180, 180, crowd // 4))]
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(99999, None, 1.0)],
                                   "place_id long, latitude double, longitude double")
    got = {}
    for r in places_within_radius(places.withColumnRenamed("place_id", "centre_id"), places, radius_m, 6).collect():
        got.setdefault(r.centre_id, []).append((r.distance_m, r.place_id))
    expected = {}
    for i, a in enumerate(points):
        near = sorted((metres(a, b), j) for j, b in enumerate(points) if metres(a, b) <= radius_m)
        expected[i] = near[:6]
    assert {c: sorted(v) for c, v in got.items()} == expected


def test_distance_expression(spark):
    row = spark.createDataFrame([(51.0, 0.0, 52.0, 1.0), (51.0, 0.0, None, 1.0)], "a double, b double, c double, d double")
    got = [r[0] for r in row.select(haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == [metres((51.0, 0.0), (52.0, 1.0)), None]


@pytest.mark.parametrize("dim", [1, 7, 64, 1024])
def test_embedding_as_expression(spark, dim):
    texts = ["", None, "one", "One one, ONE two", "État 3.5 a-b İx K", "x" * 500, " ".join(f"w{i % 90}" for i in range(3000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    found = df.select("id", embed("t", HashEmbedder(dim)).alias("v"))
    got = {r.id: r.v for r in found.collect()}
    for i, vector in enumerate(HashEmbedder(dim)(texts)):
        assert got[i] == vector.tolist()
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_embedding_batches(spark):
    sizes = spark.sparkContext.accumulator(0)

    class Counting(HashEmbedder):
        def __call__(self, texts):
            assert len(texts) <= 100
            sizes.add(len(texts))
            return super().__call__(texts)

    texts = spark.range(0, 1234).select("id", F.concat(F.lit("Text number "), "id").alias("t"))
    got = {r.id: r.v for r in texts.select("id", embed("t", Counting(16)).alias("v")).collect()}
    assert sizes.value == 1234 and len(got) == 1234
    assert got[77] == pytest.approx(HashEmbedder(16)(["Text number 77"])[0].tolist())
    assert HashEmbedder(4)([""]).tolist() == [[0.0, 0.0, 0.0, 0.0]]


def test_blocks_follow_the_bytes(spark):
    """A row is shuffled once per block of the other side, so their number must not follow the rows."""
    rows = spark.range(100_000).select("id", F.array(F.lit(1.0).cast("float")).alias("v"))
    assert rows.agg(nearest._blocks(rows, ["v"], [], None)).first()[0] == nearest.SPREAD
    assert rows.groupBy(F.lit(1)).agg(nearest._blocks(rows, ["v"], ["g"], None)).first()[1] == 1
    wide = spark.range(20_000).select("id", F.array_repeat(F.lit(1.0), 1000).alias("v"))
    assert wide.groupBy(F.lit(1)).agg(nearest._blocks(wide, ["v"], ["g"], None)).first()[1] == 5


def test_tiles_of_a_pair_keep_the_best(monkeypatch):
    """Right rows that pass by in parts give what the whole matrix gives: ties to the smaller id, limits, no partner where not a number."""
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 7)
    monkeypatch.setattr(nearest, "TILE_ROWS", 3)
    costs = np.random.default_rng(5).integers(0, 6, (11, 90)).astype(float)
    costs[np.random.default_rng(6).random(costs.shape) < 0.3] = np.nan
    costs[4] = np.nan
    ids = np.random.default_rng(7).permutation(90)
    lefts = pa.StructArray.from_arrays([pa.array(range(11)), pa.array([1, 2, 5] * 3 + [5, 9], pa.int32())], ["_left", "_k"])
    rights = pa.StructArray.from_arrays([pa.array(ids), pa.array(ids)], ["_right", "at"])

    def cost(left, right):
        return costs[np.ix_(left.column("_left").to_numpy(), right.column("at").to_numpy())]

    got = nearest._best(lefts, rights, cost, 5)
    wanted = []
    for row in range(11):
        best = sorted((costs[row, i], i) for i in range(90) if not np.isnan(costs[row, i]))
        wanted += [(row, i, c) for c, i in best[:min(5, lefts[row]["_k"].as_py())]]
    assert list(zip(got[0].to_pylist(), got[2].to_pylist(), got[3].to_pylist())) == wanted
