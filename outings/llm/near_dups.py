"""Near-duplicate documents by an LSH forest of sorted signature orders, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from outings.llm.common import SMALL_SLICE_BYTES, apart, connected, free_name, id_and_text, lowered, mixed, slices, within_bitmap, word_hashes
from outings.sources.tables import finished, materialized


@dataclass(frozen=True)
class Forest:
    """``orders`` sorted orders, each of ``DIGITS`` of the ``hashes`` minima. Neighbours share ``depth`` digits or more; where
    more than ``reach`` rows do, the nearest are those with the longest common prefix, so the depth adapts to the region.
    Pairs whose sketches (two bits of every minimum) differ in more than ``apart`` minima are no candidates: at a similarity of 0.75, 12 of
    64 are expected, and more than 30 turn up less than once in a million. Pairs with fewer than ``least`` equal minima are not looked at
    further (48 are expected, and fewer than 29 turn up about once in ten million).
    Rows of a region with more than ``reach`` rows meet again in ``deep`` further orders of twice the digits, ``near`` to a side, and by
    the shingles that ``rare`` of these rows or fewer hold."""

    words: int = 5
    percent: int = 75
    hashes: int = 64
    orders: int = 24
    depth: int = 3
    reach: int = 24
    apart: int = 30
    least: int = 29
    seed: int = 5
    rare: int = 32
    deep: int = 64
    near: int = 8


DIGITS = 8
# Classes that have this many candidates are compared in cells, where a set serves all its pairs; a cell has two groups of this size.
DENSE, GROUP = 16, 256


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of every text, A-Z lowered; a text with fewer words has one, of
    all its words; a text without words has none."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts, hashes = word_hashes(lowered(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)))
    ends = np.cumsum(size + 1)
    last = np.searchsorted(starts, ends)
    first = np.concatenate(([0], last[:-1]))
    with np.errstate(over="ignore"):
        factor = mixed(np.arange(words, dtype=np.uint64), salt=3) | np.uint64(1)
        count = len(hashes) - words + 1
        rolled = np.zeros(max(0, count), np.uint64)
        for j in range(words if count > 0 else 0):
            rolled += hashes[j:j + count] * factor[j]
        rolled = mixed(rolled)
        out = []
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= words:
                out.append(np.unique(rolled[a:b - words + 1]))
            elif b > a:
                own = hashes[a:b]
                out.append(mixed(np.array([(own * factor[:b - a]).sum(dtype=np.uint64)]), salt=b - a))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 1024):
            np.minimum(least, (x[at:at + 1024, None] * a + b).min(axis=0), out=least)
    return least


def _class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: two sums over its members."""
    with np.errstate(over="ignore"):
        return tuple(int(np.int64(mixed(shingles, salt=s).sum(dtype=np.uint64).astype(np.int64))) for s in (17, 18))


def signatures(docs: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """doc_id, of (hash of the whole text), n_shingles, cls and cls2 (128 bits of the set), sig (minima); texts without words have no
    cls and no sig."""
    df = id_and_text(docs, id_col, text_col).withColumn("of", F.xxhash64("text"))
    rng = np.random.default_rng(forest.seed)
    a = rng.integers(0, 1 << 32, forest.hashes, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, forest.hashes, dtype=np.uint64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=SMALL_SLICE_BYTES):
                sets = shingle_sets([t or b"" for t in part.column("text").to_pylist()], forest.words)
                classes = [_class_of(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("of"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([c[0] for c in classes], pa.int64()), pa.array([c[1] for c in classes], pa.int64()),
                     pa.array([_minima(s, a, b).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "of", "n_shingles", "cls", "cls2", "sig"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, of long, n_shingles long, cls long, cls2 long, sig binary")


def order_positions(forest: Forest, orders: int, digits: int, seed: int) -> np.ndarray:
    """The minima that each order reads, in turn: permutations of all of them, cut into runs of ``digits``."""
    rng = np.random.default_rng(seed)
    runs = forest.hashes // digits
    perms = [rng.permutation(forest.hashes)[:runs * digits].reshape(runs, digits) for _ in range(-(-orders // runs))]
    return np.concatenate(perms)[:orders]


def order_rows(classes: DataFrame, forest: Forest, positions: np.ndarray) -> DataFrame:
    """o, k1, k2, ... (four digits of 16 bits in each), s1, s2, ... (two bits of every minimum) and the other columns of a class, once per
    order."""
    digits = positions.shape[1]
    others = [c for c in classes.columns if c != "sig"]
    keys = [f"k{j + 1}" for j in range(digits // 4)]
    sketches = [f"s{j + 1}" for j in range(forest.hashes // 32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, forest.hashes)
            with np.errstate(over="ignore"):
                digit = ((sig * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64)
                two = ((sig * np.uint32(0x85EBCA6B)) >> np.uint32(30)).astype(np.uint64)
            sketch = [np.bitwise_or.reduce(two[:, j:j + 32] << (np.arange(32, dtype=np.uint64) * np.uint64(2)), axis=1)
                      for j in range(0, forest.hashes, 32)]
            for o, at in enumerate(positions):
                longs = [np.bitwise_or.reduce(digit[:, at[j:j + 4]] << np.array([48, 32, 16, 0], np.uint64), axis=1) for j in range(0, digits, 4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, o, np.int32)), *[pa.array(v.view(np.int64)) for v in (*longs, *sketch)]]
                    + [batch.column(c) for c in others], names=["o", *keys, *sketches, *others])

    kinds = ", ".join([f"{c} long" for c in (*keys, *sketches)] + [f"{c} {t}" for c, t in classes.dtypes if c != "sig"])
    return classes.mapInArrow(run, f"o int, {kinds}")


def neighbours(rows: DataFrame, forest: Forest, reach: int, best: int | None = None) -> DataFrame:
    """Candidate pairs (a, b) of classes that stand within ``reach`` in an order, share ``depth`` digits or more and have close sketches;
    with ``best``, only so many of the closest for every row.

    The rows of all orders are sorted by ranges of the whole key, so a crowded region is spread over tasks, and a task
    reads its range as a stream. The first and last rows of every range are compared once more across the borders.
    With a column ``comp``, rows of the same component make no pair, and a row also meets the ``hub`` of its neighbours.
    """
    has_comp = "comp" in rows.columns
    shift = 64 - 16 * forest.depth
    own_keys = sorted(c for c in rows.columns if c[0] == "k")
    sketches = sorted(c for c in rows.columns if c[0] == "s")
    keys = ["o", *own_keys, "cls"]
    extra = ["comp", "hub"] if has_comp else []
    names = keys + sketches + extra
    lanes = np.uint64(0x5555555555555555)

    def pairs_of(part: dict[str, np.ndarray], old: int) -> np.ndarray:
        """Pairs whose later row stands at ``old`` or behind."""
        firsts, seconds, differ = [], [], []
        n = len(part["o"])
        for d in range(1, min(reach, n - 1) + 1):
            i = np.arange(max(0, old - d), n - d)
            j = i + d
            near = (part["o"][i] == part["o"][j]) & (((part["k1"][i] ^ part["k1"][j]).view(np.uint64) >> np.uint64(shift)) == 0)
            near &= part["comp"][i] != part["comp"][j] if has_comp else part["cls"][i] != part["cls"][j]
            i, j = i[near], j[near]
            count = np.zeros(len(i), np.int64)
            for c in sketches:
                x = (part[c][i] ^ part[c][j]).view(np.uint64)
                count += np.bitwise_count((x | x >> np.uint64(1)) & lanes)
            close = count <= forest.apart
            firsts.append(i[close])
            seconds.append(j[close])
            differ.append(count[close])
        if not firsts:
            return np.zeros((0, 2), np.int64)
        i, j, count = np.concatenate(firsts), np.concatenate(seconds), np.concatenate(differ)
        if best is not None and len(i):
            row, pair = np.concatenate((i, j)), np.tile(np.arange(len(i)), 2)
            order = np.lexsort((pair, count[pair], row))
            row, pair = row[order], pair[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            chosen = np.unique(pair[place < best])
            i, j = i[chosen], j[chosen]
        out = [np.stack((part["cls"][i], part["cls"][j]), axis=1)]
        if has_comp:
            out += [np.stack((part["hub"][i], part["cls"][j]), axis=1), np.stack((part["cls"][i], part["hub"][j]), axis=1),
                    np.stack((part["hub"][i], part["hub"][j]), axis=1)]
        return np.unique(np.sort(np.concatenate(out), axis=1), axis=0)

    def emit(pairs: np.ndarray, edge: dict[str, np.ndarray] | None) -> pa.RecordBatch:
        n, m = len(pairs), len(edge["o"]) if edge else 0
        cols = [pa.array(np.concatenate((pairs[:, 0], np.zeros(m, np.int64))), mask=np.arange(n + m) >= n),
                pa.array(np.concatenate((pairs[:, 1], np.zeros(m, np.int64))), mask=np.arange(n + m) >= n)]
        for c in names:
            values = np.concatenate((np.zeros(n, np.int64), edge[c].astype(np.int64) if edge else np.zeros(0, np.int64)))
            cols.append(pa.array(values, mask=np.arange(n + m) < n))
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, opened = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = {c: batch.column(c).to_numpy() for c in names}
            if opened < reach:
                take = min(reach - opened, batch.num_rows)
                yield emit(np.zeros((0, 2), np.int64), {c: v[:take] for c, v in part.items()})
                opened += take
            old = 0
            if tail is not None:
                old = len(tail["o"])
                part = {c: np.concatenate((tail[c], v)) for c, v in part.items()}
            yield emit(pairs_of(part, old), None)
            tail = {c: v[-reach:] for c, v in part.items()}
        if tail is not None:
            yield emit(np.zeros((0, 2), np.int64), tail)

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"{c} long" for c in names)
    found = materialized(ordered.select(*names).mapInArrow(run, f"a long, b long, {kinds}"), "neighbours")
    edges = found.where("a is null").select(*names).distinct()
    side = Window.partitionBy("o").orderBy(*own_keys, "cls")
    later = F.array(*[F.lead(F.struct(*names), d).over(side) for d in range(1, reach + 1)])
    part = edges.withColumn("all_later", later).withColumn("later", F.explode("all_later")).where("later is not null")
    part = part.where(F.shiftrightunsigned(F.col("k1").bitwiseXOR(F.col("later.k1")), shift) == 0)
    one, other = (("comp", "hub"), ("cls", "hub")) if has_comp else (("cls",), ("cls",))
    part = part.where(F.col(one[0]) != F.col(f"later.{one[0]}")).select(F.inline(F.array(*[
        F.struct(F.col(x).alias("a"), F.col(f"later.{y}").alias("b")) for x in other for y in other])))
    across = part.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.where("a is not null").select("a", "b").unionByName(across).where("a <> b").distinct()


def promising(pairs: DataFrame, classes: DataFrame, forest: Forest) -> DataFrame:
    """The pairs with ``least`` equal minima or more whose sizes do not rule them out, and the number of these minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, forest.hashes) for c in ("x", "y"))
            equal = (x == y).sum(axis=1)
            good = pa.array(equal >= forest.least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good),
                                              pa.array(equal.astype(np.int32)).filter(good)], names=["a", "b", "equal"])

    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("x"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("y"))
    sized = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= forest.percent * F.greatest("na", "nb"))
    return sized.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, equal int")


def examined(met: DataFrame, known: DataFrame, classes: DataFrame, forest: Forest) -> DataFrame:
    """The pairs ``met`` with ``equal``, null if they are not ``promising``, and ``old``, which says that ``known`` (a, b, equal) told it: minima are long, so
    they are moved once for a pair, however many rounds it is met in."""
    marked = materialized(met.join(known.withColumn("old", F.lit(True)), ["a", "b"], "left"), "met")
    fresh = marked.where("old is null").select("a", "b")
    now = fresh.join(promising(fresh, classes, forest), ["a", "b"], "left").withColumn("old", F.lit(False))
    return marked.where("old").unionByName(now)


def sets_of(used: DataFrame, docs: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """cls and members (its shingles) of the classes of ``used`` (cls, rep), from the texts of one document of each."""
    df = id_and_text(docs, id_col, text_col)
    texts = within_bitmap(used, "rep")(df, F.col("doc_id")).join(used, F.col("doc_id") == F.col("rep")).select("cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=SMALL_SLICE_BYTES):
                sets = shingle_sets([t or b"" for t in part.column("text").to_pylist()], forest.words)
                # Rows that share the id but not the text are another class.
                same = pa.array([len(s) > 0 and _class_of(s)[0] == c for s, c in zip(sets, part.column("cls").to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["cls", "members"]).filter(same)

    return texts.mapInArrow(run, "cls long, members binary")


def crowded(rows: DataFrame, forest: Forest) -> DataFrame:
    """cls and comp of the rows that share ``depth`` digits of an order with more than ``reach`` rows, not all of one component."""
    keyed = rows.select("o", F.shiftrightunsigned("k1", 64 - 16 * forest.depth).alias("prefix"), "cls", "comp")
    regions = keyed.groupBy("o", "prefix").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    regions = regions.where((F.col("n") > forest.reach) & (F.col("lo") != F.col("hi"))).select("o", "prefix")
    return keyed.join(regions, ["o", "prefix"]).select("cls", "comp").distinct()


def crowd_pairs(crowd: DataFrame, docs: DataFrame, classes: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of different components of ``crowd`` (cls, comp) that share a rare shingle or all their frequent ones.

    Shingles are ordered by the number of rows of the crowd that hold them. Two similar sets share one of the first
    n - ceil(percent n) + 1 of each; if that one is rare, they meet here. A row also meets the smallest one with the same frequent
    shingles, and by frequent shingles the smallest ones of other selections that several rows hold; rows whose selections are
    all their own meet in the deeper orders only, so that many variants of a passage do not make all pairs.
    """
    crowd = crowd.join(classes.select("cls", "rep", F.col("n").alias("size")), "cls")
    crowd = materialized(crowd, "crowd")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members").to_pylist()
            if members:
                count = np.array([len(m) // 8 for m in members])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cls").to_numpy(), count)),
                                                  pa.array(np.frombuffer(b"".join(members), np.int64))], names=["cls", "shingle"])

    sets = sets_of(crowd.select("cls", "rep"), docs, forest, id_col, text_col)
    held = materialized(sets.mapInArrow(run, "cls long, shingle long"), "crowd-shingles")
    freq = held.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    rows = held.join(freq, "shingle")
    # The frequent shingles of a row are told by two sums; rare ones come first in its order, after those of one row alone.
    hot = rows.where(F.col("df") > forest.rare).groupBy("cls").agg(
        F.count("*").alias("n_hot"), *[F.sum(F.xxhash64(F.lit(k), "shingle").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)])
    cold = rows.where(F.col("df") <= forest.rare)
    counts = cold.groupBy("cls").agg(F.count("*").alias("n_cold"))
    facts = crowd.join(counts, "cls", "left").join(hot, "cls", "left").na.fill(0, ["n_cold", "n_hot"])
    first = F.col("size") - F.ceil(F.lit(forest.percent) * F.col("size") / 100) + 1
    single = F.col("size") - F.col("n_cold") - F.col("n_hot")
    facts = materialized(facts.withColumn("shown", F.greatest(F.lit(0), first - single)), "crowd-rows")
    fits = 100 * F.least("x.size", "y.size") >= forest.percent * F.greatest("x.size", "y.size")
    cross = (F.col("x.comp") != F.col("y.comp")) & fits
    place = F.row_number().over(Window.partitionBy("cls").orderBy("df", "shingle"))
    shown = cold.withColumn("place", place).join(facts.select("cls", "comp", "size", "shown"), "cls").where("place <= shown")
    shown = shown.select("cls", "comp", "size", "shingle")
    x, y = shown.alias("x"), shown.alias("y")
    by_rare = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.cls") < F.col("y.cls")) & cross)
    same = facts.where("n_hot > 0").select("cls", "comp", "size", "n_hot", "h1", "h2")
    smallest = same.groupBy("n_hot", "h1", "h2").agg(F.min(F.struct("size", "cls", "comp")).alias("m"), F.count("*").alias("holders"))
    smallest = materialized(smallest.select("n_hot", "h1", "h2", "holders", "m.*"), "crowd-smallest")
    x, y = same.alias("x"), smallest.alias("y")
    by_same = x.join(y, (F.col("x.n_hot") == F.col("y.n_hot")) & (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")) & cross)
    # Frequent shingles alone have to be enough for the other pairs; every row meets the smallest ones of the selections that several rows hold.
    several = smallest.where("holders > 1").select("cls", "n_hot")
    leading = F.greatest(F.lit(0), first - (F.col("size") - F.col("n_hot")))
    hot = rows.where(F.col("df") > forest.rare).withColumn("place", place).join(facts.select("cls", "comp", "size", "n_hot", leading.alias("leading")), "cls")
    hot = hot.where("place <= leading").select("cls", "comp", "size", "n_hot", "shingle")
    x, y = hot.alias("x"), hot.join(several.select("cls"), "cls", "left_semi").alias("y")
    alone = (100 + forest.percent) * F.least("x.n_hot", "y.n_hot") >= forest.percent * (F.col("x.size") + F.col("y.size"))
    by_hot = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & cross & alone)
    out = [p.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")) for p in (by_rare, by_same, by_hot)]
    return out[0].unionByName(out[1]).unionByName(out[2]).distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, forest: Forest, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough; the sets come from the texts of one document of each class."""
    used = materialized(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
                        .join(classes.select("cls", "rep"), "cls"), "used")
    sets = materialized(sets_of(used, docs, forest, id_col, text_col), "sets")
    both = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls")))
    dense = both.groupBy("cls").agg(F.count("*").alias("c")).where(F.col("c") >= DENSE).select("cls")
    dense = materialized(dense, "dense")
    rest = pairs
    for side in ("a", "b"):
        mine = dense.select(F.col("cls").alias(side), F.lit(True).alias("d" + side))
        rest = rest.join(mine, side, "left")
    rest = materialized(rest.withColumn("dense", F.coalesce(F.col("da") & F.col("db"), F.lit(False))).select("a", "b", "dense"), "split-pairs")
    by_join = _compared(rest.where("not dense").select("a", "b"), sets, forest)
    groups = -(-dense.count() // GROUP)
    if not groups:
        return by_join.distinct()
    return by_join.unionByName(_compared_in_cells(rest.where("dense").select("a", "b"), sets, forest, groups)).distinct()


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share ``percent`` % of their union."""
    both = np.sort(np.concatenate((x, y)), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _compared(pairs: DataFrame, sets: DataFrame, forest: Forest) -> DataFrame:
    """The similar pairs; every pair gets its two sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c) for c in ("x", "y"))
            good = [_similar(np.frombuffer(x[row].as_buffer(), np.uint64), np.frombuffer(y[row].as_buffer(), np.uint64), forest.percent)
                    for row in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _compared_in_cells(pairs: DataFrame, sets: DataFrame, forest: Forest, groups: int) -> DataFrame:
    """The similar pairs, where classes have many: classes are dealt to groups, the pairs of two groups are a cell, and a set goes to each of
    its cells once. A task holds the sets of two groups; cells follow each other in a sorted stream, sets before pairs."""
    group = {side: F.pmod(F.xxhash64(side), F.lit(groups)) for side in ("a", "b")}
    pairs = pairs.withColumn("cell", group["a"] * groups + group["b"])
    need = pairs.select("cell", F.col("a").alias("cls")).unionByName(pairs.select("cell", F.col("b").alias("cls"))).distinct()
    rows = need.join(sets, "cls").select("cell", F.col("cls").alias("a"), F.lit(None).cast("long").alias("b"), "members")
    rows = rows.unionByName(pairs.select("cell", "a", "b", F.lit(None).cast("binary").alias("members")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, {}
        for batch in batches:
            cells, a, b = (batch.column(c).to_pylist() for c in ("cell", "a", "b"))
            members, good = batch.column("members"), np.zeros(batch.num_rows, bool)
            for row, (c, one, two) in enumerate(zip(cells, a, b)):
                if c != cell:
                    cell, held = c, {}
                if two is None:
                    held[one] = np.frombuffer(members[row].as_py(), np.uint64)
                elif one in held and two in held:
                    good[row] = _similar(held[one], held[two], forest.percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    dealt = rows.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(compare, "a long, b long")


def _best_two(pairs: DataFrame) -> DataFrame:
    """The two pairs of every class with the most equal minima."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "equal"))
    best = Window.partitionBy("a").orderBy(F.col("equal").desc(), "b")
    return both.withColumn("r", F.row_number().over(best)).where("r <= 2").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verdicts(docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, of (hash of the text), n_shingles, component_id and kept of every row.

    Equal sets are one class from the start, however many copies there are. First every class meets its nearest
    neighbour on either side in all orders, and its two most promising pairs are confirmed on the whole sets. Then the
    search is repeated with components: neighbours in another component are compared with each other and with the hub of
    that component, its member with the most confirmed links. The two most promising pairs of a class are confirmed, until these join
    nothing; then all. A pair is looked at once: the numbers of equal minima and the pairs that were confirmed or not are remembered
    for the rounds that follow. So a crowded region need not be compared pair by pair, and a copy that is similar to the original
    alone still meets it. Classes without a candidate in another component leave the search, so each round is smaller.
    When a full round joins nothing, the rows of regions with more rows than a round looks at meet in further and deeper orders and by
    the shingles they share (``crowd_pairs``), and that ends the search.
    """
    table = materialized(signatures(docs, forest, id_col, text_col), "signatures")
    least = table.where("cls is not null and doc_id is not null").groupBy("cls", "cls2").agg(
        F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    found = table.where("cls is not null").join(least, ["cls", "cls2"]).where("doc_id = rep").select("cls", "rep", "n", "sig")
    classes = materialized(found.dropDuplicates(["cls"]), "classes")
    positions = order_positions(forest, forest.orders, DIGITS, forest.seed + 1)
    spark = docs.sparkSession

    def step(make: Callable[[], DataFrame]) -> DataFrame:
        """Pairs that are written; sets and other parts they are made of go at once."""
        return finished(spark, make, "pairs")

    known = table.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("equal")).limit(0)
    tested = known.select("a", "b")

    def promising_of(met: Callable[[], DataFrame]) -> DataFrame:
        """Written pairs (a, b, equal) of ``met`` that are promising."""
        nonlocal known
        found = step(lambda: examined(met(), known, classes, forest))
        known = known.unionByName(found.where("not old").drop("old"))
        return found.where("equal is not null").drop("old")

    def confirm(some: DataFrame) -> DataFrame:
        """The links among pairs that were not tested before."""
        nonlocal tested
        some = materialized(some.select("a", "b"), "tested")
        tested = tested.unionByName(some)
        return some if some.isEmpty() else step(lambda: confirmed(some, docs, classes, forest, id_col, text_col))

    def joined(comps: DataFrame, new: DataFrame) -> DataFrame:
        """The components with further links; a component is a star by now, so few rounds are left."""
        return connected(comps.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new), contract=True)

    pairs = promising_of(lambda: neighbours(order_rows(classes.select("cls", "sig"), forest, positions), forest, 1))
    links = confirm(_best_two(pairs))
    comps, best, active = connected(links, contract=True), 1, classes

    def in_components(some: DataFrame) -> DataFrame:
        both = links.select("a").unionByName(links.select(F.col("b").alias("a")))
        degree = both.groupBy("a").agg(F.count("*").alias("links")).join(comps, F.col("a") == F.col("node"))
        hubs = degree.groupBy("root").agg(F.max(F.struct("links", "a")).alias("best")).select("root", F.col("best.a").alias("hub"))
        named = comps.join(hubs, "root").select(F.col("node").alias("cls"), F.col("root").alias("comp"), "hub")
        return some.select("cls", "sig").join(named, "cls", "left").withColumns(
            {"comp": F.coalesce("comp", "cls"), "hub": F.coalesce("hub", "cls")})

    while True:
        rows = in_components(active)
        met = promising_of(lambda: neighbours(order_rows(rows, forest, positions), forest, forest.reach, best))
        pairs = step(lambda: apart(met, comps))
        untested = pairs.join(tested, ["a", "b"], "left_anti")
        new = confirm(untested if best is None else _best_two(untested))
        if new.count():
            links = materialized(links.unionByName(new).distinct(), "confirmed")
            comps = joined(comps, new)
        elif best is None:
            break
        else:
            best = None
        # A class that had no candidate in another component has none later; where few are left, the others stand nearer.
        left = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
        active = materialized(classes.join(left, "cls", "left_semi"), "active")
    # What is left are pairs that stand too far apart in a crowded region.
    rows = in_components(classes)
    crowd = materialized(crowded(order_rows(rows, forest, positions), forest), "crowded")
    further = order_positions(forest, forest.deep, 2 * DIGITS, forest.seed + 2)
    again = rows.join(crowd.select("cls"), "cls", "left_semi")
    pairs = step(lambda: crowd_pairs(crowd, docs, classes, forest, id_col, text_col))
    met = promising_of(lambda: pairs.unionByName(neighbours(order_rows(again, forest, further), forest, forest.near)).distinct())
    comps = joined(comps, confirm(apart(met, comps).join(tested, ["a", "b"], "left_anti")))
    roots = classes.select("cls", "rep").join(comps, F.col("cls") == F.col("node"), "left").select(
        "cls", "rep", F.coalesce("root", "cls").alias("root"))
    firsts = roots.groupBy("root").agg(F.min("rep").alias("component"))
    named = roots.join(firsts, "root").select("cls", "component")
    return table.join(named, "cls", "left").select(
        "doc_id", "of", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: components of documents with similar shingle sets.

    Defined cases: texts that are null, empty or without words have size 0 and are their own component; so are rows
    without id, with a null component; rows that share an id but not the text are documents of their own; repeated rows
    get the same verdict; no rows give no rows; extra columns are ignored.
    """
    return verdicts(docs, forest, id_col, text_col).drop("of")


def keep_one(docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns.

    A row goes by its id and its text, so another text under the id of a copy stays. Defined cases: rows without id stay; null texts
    and texts without words stay; repeated rows get the same verdict; no rows give no rows; columns may have any name.
    """
    name = free_name(docs, "verdict")
    gone = verdicts(docs, forest, id_col, text_col).where("not kept and doc_id is not null")
    gone = gone.select(F.col("doc_id").alias(name), F.col("of").alias(name + "_of")).distinct()
    text = F.xxhash64(docs[text_col].cast("binary"))
    return docs.join(gone, (docs[id_col] == F.col(name)) & (text == F.col(name + "_of")), "left_anti")
