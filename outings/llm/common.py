"""Helpers that several operators share: bounded slices of a batch, cached segments, word hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.settings import apply_sql_settings, ship_packages
from outings.sources.tables import materialized

# Text that one step of a Python worker holds in its unpacked form.
SLICE_BYTES = 4 << 20
# The same for steps that need many bytes for every byte of text.
SMALL_SLICE_BYTES = 1 << 20
# Distinct segments that a worker remembers; the table is emptied when it is full.
REMEMBERED = 400_000

# Odd multipliers and a shift pattern of a 64-bit finaliser.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def prepared(df: DataFrame) -> DataFrame:
    """Settings and package that the operators need. Shuffle files go when what they were written for has ended, not when the driver
    collects its garbage: an operator has many steps, and each writes its result."""
    apply_sql_settings(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    ship_packages(df.sparkSession)
    return df


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under names of its own; others are left behind, whatever they are called."""
    return prepared(docs).select(docs[id_col].alias("doc_id"), docs[text_col].cast("binary").alias("text"))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``budget`` bytes of text each; a longer text is a part of its own."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False),
                       dtype=np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def as_text(value: bytes | None) -> str:
    return "" if value is None else value.decode("utf-8", "replace")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(hidden)}


class Segments:
    """Ids of distinct segments, looked up by segment; ``encode`` turns a list of unknown segments into the ids of all of
    them, one after the other, and the number of ids of each."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.index, self.size = {}, 0
        self.lengths, self.starts, self.ids = (np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32))

    def begin(self) -> None:
        """To be called between slices: forgets everything when the table is full."""
        if len(self.index) > self.limit:
            self.clear()

    def codes(self, segments: list) -> np.ndarray:
        codes = np.fromiter(map(self.index.get, segments, repeat(-1)), np.int64, len(segments))
        unknown = codes < 0
        if unknown.any():
            missing = list(compress(segments, unknown.tolist()))
            self.add(list(dict.fromkeys(missing)))
            codes[unknown] = np.fromiter(map(self.index.__getitem__, missing), np.int64, len(missing))
        return codes

    def add(self, new: list) -> None:
        flat, lengths = self.encode(new)
        first = len(self.index)
        self.lengths = room(self.lengths, first + len(new))
        self.starts = room(self.starts, first + len(new))
        self.ids = room(self.ids, self.size + len(flat))
        self.lengths[first:first + len(new)] = lengths
        self.starts[first:first + len(new)] = self.size + np.cumsum(lengths) - lengths
        self.ids[self.size:self.size + len(flat)] = flat
        self.size += len(flat)
        self.index.update(zip(new, range(first, first + len(new))))

    def gather(self, codes: np.ndarray) -> np.ndarray:
        """The ids of all segments, one after the other."""
        return self.ids[spans(self.starts[codes], self.lengths[codes])]


class Strings:
    """Byte strings by number, written out for whole arrays of numbers at once."""

    def __init__(self, values: list[bytes]):
        self.data = np.frombuffer(b"".join(values), np.uint8)
        self.lengths = np.fromiter(map(len, values), np.int64, len(values))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def write(self, numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All strings one after the other, and where each ends."""
        lengths = self.lengths[numbers]
        return self.data[spans(self.starts[numbers], lengths)].tobytes(), np.cumsum(lengths)


def room(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    grown = np.zeros(max(size, 2 * len(values)), values.dtype)
    grown[:len(values)] = values
    return grown


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every pair, one after the other."""
    total = int(lengths.sum())
    begins = np.cumsum(lengths) - lengths
    return np.repeat(starts - begins, lengths) + np.arange(total, dtype=np.int64)


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 well-mixed bits of every 64-bit value."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * MIX_1
        x = (x ^ (x >> np.uint64(27))) * MIX_2
        return x ^ (x >> np.uint64(31))


_POWERS = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < size:
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 1 << 64)
        n = max(size, 1 << 16)
        with np.errstate(over="ignore"):
            for name, b in (("up", base), ("down", inverse)):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


_WORD = np.ones(256, np.int8)
_WORD[[32, 9, 10, 11, 12, 13]] = 0


def token_hashes(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, 64-bit hash and class of every run of bytes of one class; class 0 separates."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    kind = classes[data]
    starts = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    stops = np.append(starts[1:], len(kind))
    own = kind[starts]
    starts, stops, own = starts[own > 0], stops[own > 0], own[own > 0]
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
        hashes = (total[stops] - total[starts]) * down[starts]
        return starts, mixed(hashes + (stops - starts).astype(np.uint64) * MIX_1), own


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word ``[^\\x20\\x09-\\x0D]+`` of a byte array."""
    return token_hashes(data, _WORD)[:2]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z in a byte array."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def within_bitmap(keys: DataFrame, key: str, bits: int = 20) -> Callable[[DataFrame, Column], DataFrame]:
    """A filter that passes every row whose key is in ``keys``, and few others while ``keys`` is small.

    The table that is broadcast has 2^(bits - 6) rows at most (256 KB at 20 bits) whatever the size of ``keys``; when
    it fills up the filter passes everything, so a join has to follow in any case.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(1 << bits))
    words = (keys.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("long").alias("_word"))
             .agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS int)))").alias("_bits")))

    def only(df: DataFrame, value: Column) -> DataFrame:
        at = F.pmod(F.xxhash64(value), F.lit(1 << bits))
        marked = df.withColumn("_word", (at / 64).cast("long")).withColumn("_at", (at % 64).cast("int"))
        return (marked.join(F.broadcast(words), "_word")
                .where(F.col("_bits").bitwiseAND(F.expr("shiftleft(1L, _at)")) != 0).drop("_word", "_bits", "_at"))

    return only


def _contract(batches: Iterator[pa.RecordBatch], limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars around the smallest node of each component; whenever ``limit`` nodes are known, the
    stars so far are given out and forgotten."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
        if len(parent) > limit:
            yield stars()
            parent.clear()
    yield stars()


def connected(links: DataFrame, contract: bool = False, rounds: int = 200) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b); root is the smallest node that can be reached, itself included.

    Alternates large stars and small stars; each round is aggregations and joins on node ids and is written to the
    shared folder, so that no lineage grows. The loop ends when a round changes nothing; should that not happen within
    ``rounds`` (their number grows with the logarithm of a component), an error is raised. ``contract`` first reduces the
    links of every partition to stars, in Python, which saves rounds.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialized(edges.mapInArrow(_contract, "u long, v long") if contract else edges, "links")
    before = None
    for number in range(rounds + 1):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        if number == rounds:
            raise RuntimeError(f"components were not complete after {rounds} rounds")
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialized(hooked.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components; a node without a component is its own."""
    for side in ("a", "b"):
        named = comps.select(F.col("node").alias(side), F.col("root").alias("root_" + side))
        pairs = pairs.join(named, side, "left").withColumn("root_" + side, F.coalesce("root_" + side, side))
    return pairs.where("root_a <> root_b").drop("root_a", "root_b")
